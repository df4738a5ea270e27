"""Nulls, ties, repeated rows, anchors and long inputs of the core operators."""

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import aggregates, cards, estimate, extract, graph, joins, rules, windows
from quarry.operators.extract import Pattern
from quarry.sources import files


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_anchored_rules_see_lines(spark):
    docs = spark.createDataFrame([(1, "a\nusing X;\r\nb"), (2, "using Y;"), (3, "x"), (4, None), (5, "")], "id int, text string")
    found = [rules.Rule("start", "info", r"^using"), rules.Rule("end", "info", r";$"), rules.Rule("whole", "info", r"\Ax\Z"), rules.Rule("twice", "info", r"(X).*\1")]
    assert rows_of(rules.rule_scan(docs, found, "id"), "id", "rule", "line_no") == [(1, "end", 2), (1, "start", 2), (2, "end", 1), (2, "start", 1), (3, "whole", 1)]
    assert rows_of(rules.last_match(docs, "^using", "id"), "id", "line_no") == [(1, 2), (2, 1)]


def test_rules_for_files_and_context(spark):
    docs = spark.createDataFrame([(1, "cs", "open\n" + "\n" * 3 + "close"), (2, "cs", "open"), (3, None, "open close"), (4, "vb", "open\nclose skip")], "id int, kind string, text string")
    found = [rules.Rule("near", "warn", "open", context="close"), rules.Rule("only", "warn", "open", types=("cs",), unless_in_file="close"), rules.Rule("needs", "warn", "close", requires="skip")]
    assert rows_of(rules.rule_scan(docs, found, "id", "kind", before=2, after=2), "id", "rule") == [(2, "only"), (3, "near"), (4, "near"), (4, "needs")]


def test_globs(spark):
    cases = [("*.cs", "a.cs", True), ("a?b", "axb", True), ("[ab].txt", "b.txt", True), ("[!ab].txt", "b.txt", False), (".md", "x/y.md", True), ("a.b", "axb", False)]
    df = spark.createDataFrame(cases, "g string, p string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", F.rlike("p", rules.glob_pattern(F.col("g")))).collect())


def test_longest_prefix_keeps_repeats_and_null_paths(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/c"), (2, None), (3, "ab"), (4, "a")], "id int, path string")
    dims = spark.createDataFrame([("a", "x"), ("a/b", "y"), ("", "z")], "prefix string, owner string")
    assert rows_of(joins.longest_prefix(rows, dims, "path", "prefix", ["owner"]), "id", "owner") == [(1, "y"), (1, "y"), (2, None), (3, None), (4, "x")]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("chunked", [False, True])
def test_asof_equals_brute_force(spark, forward, chunked):
    rng = random.Random(4)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([*range(60), None])) for k in range(150)]
    right = [(rng.choice(["a", "a", "b", None]), t, t * 10) for t in rng.sample(range(60), 12)] + [("a", None, 5)]
    ldf, rdf = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    got = dict(rows_of(joins.asof(ldf, rdf, "k", "t", ["v"], "r_", forward, chunk=F.floor(F.col("t") / 7) if chunked else None), "id", "r_v"))
    for i, k, t in left:
        fit = [(x, v) for kk, x, v in right if None not in (k, kk, t, x) and kk == k and (x >= t if forward else x <= t)]
        assert got[i] == ((min if forward else max)(fit)[1] if fit else None)


def test_similar_names_lose_none(spark):
    rng = random.Random(1)
    names = ["abc", "axbxc", "", "aaa", "aab"] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    left, right = sorted(set(names[:35])), sorted(set(names[30:] + ["axbxc", ""]))
    got = joins.similar(spark.createDataFrame([(x,) for x in left] + [(None,)], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    assert rows_of(got, "a", "b") == sorted(((x, y) for x in left for y in difflib.get_close_matches(x, right, 3, 0.7)), key=str)


def test_private_keys_and_quoted_values_are_masked(spark):
    secrets = ["-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\nxyz\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nMIIcut", "password = 'two words here'"]
    masked = [r["m"] for r in spark.createDataFrame([(s,) for s in secrets], "s string").select(S.mask(F.col("s")).alias("m")).collect()]
    assert not any(x in m for m in masked for x in ("MII", "xyz", "two", "words", "here"))


def test_long_paths_and_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "src int, dst int")
    assert graph.shortest_path(chain, 0, 20).first()["hops"] == 20
    assert graph.shortest_path(chain, 0, 20, depth=5).count() == 0
    ring = spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)] + [(5, 7)], "src int, dst int")
    assert rows_of(graph.components(ring), "node", "component") == [(k, 0) for k in range(6)] + [(7, 7)]
    rng = random.Random(3)
    edges = {(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(22)}
    reach = {a: {a} for a in range(15)}
    for _ in range(15):
        for a in reach:
            reach[a] |= {d for s, d in edges if s in reach[a]}
    nodes = {x for e in edges for x in e}
    want = sorted((n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes)
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    assert sorted(tuple(r) for r in graph.components(df).select("node", "component").collect()) == want
    exact, near = (dict(rows_of(graph.blast_radius(df, exact=x), "node", "transitive")) for x in (True, False))
    assert exact == near


def test_schedules_hold_all_work(spark):
    work = spark.createDataFrame([("p", 1, "app", 250.0), ("p", 2, "odd", 4.0)], "plan string, item int, lane string, h double")
    done = cards.schedule(work, "plan", "item", "lane", "h", {"app": 1.0}).groupBy("item").agg(F.round(F.sum("hours"), 6).alias("h"), F.max("sprint").alias("last"))
    assert rows_of(done, "item", "h", "last") == [(1, 250.0, 250), (2, 4.0, None)]
    with pytest.raises(ValueError):
        cards.schedule(work, "plan", "item", "lane", "h", {"app": 0.0})


def test_every_match_of_a_line(spark):
    code = spark.createDataFrame([("a.js", "fetch('/a'); fetch('/b');\nfetch('/c')"), ("a.py", "fetch('/d')")], "path string, text string")
    found = extract.extract(code, [Pattern("fetch", r"\bfetch\('([^']+)", 1, 0, ("js",))], "path", "text")
    assert rows_of(found, "path", "line", "value") == [("a.js", 1, "/a"), ("a.js", 1, "/b"), ("a.js", 2, "/c")]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 5001])
def test_ranks_equal_sorting(spark, n):
    rng = random.Random(n)
    values = [("k", float(rng.choice([1, 2, 2, rng.random() * 50]))) for _ in range(n)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {r["k"]: (r["n"], r["lo"], r["mid"], r["hi"]) for r in aggregates.least_median_greatest(df, ["k"], "v").collect()}
    own = sorted(v for k, v in values if k == "k")
    assert got == {"k": (n, own[0], statistics.median(own), own[-1]), "one": (1, 3.0, 3.0, 3.0)}
    for p in (0.1, 0.5, 0.8):
        assert aggregates.nearest_rank(df.where("k = 'k'"), ["k"], "v", p).first()["q"] == own[round(p * (n - 1))]


def test_extrapolation_without_peers(spark):
    known, other = spark.createDataFrame([("a", 2.0), ("a", 4.0)], "g string, v double"), spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, g string")
    assert rows_of(estimate.extrapolate(known, other, "g", "v"), "id", "lo", "mid", "hi", "has_peers") == [(1, 2.0, 3.0, 4.0, True), (2, 1.0, 3.0, 8.0, False), (3, 1.0, 3.0, 8.0, False)]


def test_running_totals_by_chunks(spark):
    rows = spark.createDataFrame([("a", t, t % 5) for t in range(40)], "k string, t int, size int")
    whole, cut = (windows.running_slots(rows, ["k"], ["t"], "size", 7, c) for c in (None, F.floor(F.col("t") / 6)))
    assert rows_of(whole, "t", "first_slot", "last_slot") == rows_of(cut, "t", "first_slot", "last_slot")


def test_walk_reads_only_what_fits(spark, tmp_path):
    root = tmp_path / "src"
    (root / "bin").mkdir(parents=True)
    for name, body in (("a.cs", "int x;"), ("big.cs", "y" * 500), ("bin/no.cs", "z")):
        (root / name).write_text(body)
    assert rows_of(files.walk(spark, str(root), max_bytes=100).withColumn("n", F.length("content")), "path", "n", "rejected") == [("a.cs", 6, False), ("big.cs", None, True)]
