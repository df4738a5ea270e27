"""What keeps the work of queries on large tables spread and bounded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import callgraph as G
from quarry.operators import codesql, sqltext
from quarry.plans import callgraphs, scripts
from quarry.plans.registry import Tables
from quarry.streaming import events

LARGE = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources_of_one_small_file_are_cut_in_several_tasks(spark):
    rows = callgraphs._sources(Tables(spark, LARGE))
    assert rows.rdd.getNumPartitions() == 4


def test_next_braces_are_not_looked_for_row_by_row(spark):
    """A frame that ends with the last row is read anew for every row."""
    df = spark.createDataFrame([("a", "class A { }")], "path string, code string")
    assert "unboundedfollowing" not in plan(G._around(codesql.code_tokens(df, "path", "code"))).lower()


def test_arguments_that_are_names(spark):
    code = 'class A { void M(int a) { N(x, "y", z + 1, (w), P(q)); new R(s); v[t](u); } int Q(x) { } }'
    s = G.Symbols(spark.createDataFrame([("a", code)], "path string, code string"), "path", "code")
    want = codesql.calls(codesql.code_tokens(spark.createDataFrame([("a", code)], "path string, code string"), "path", "code")).where("form = 'name'").select("path", "pos", "value")
    assert sorted(map(tuple, s.given().collect())) == sorted(map(tuple, want.collect())) and want.count() == 3


def test_only_tokens_that_edges_read_are_stored(spark):
    df = spark.createDataFrame([("1", callgraphs.CODE.replace("§", "1"))], "path string, code string")
    s = G.Symbols(df, "path", "code")
    assert s.near.count() < 0.75 * codesql.code_tokens(df, "path", "code").count() and not hasattr(s, "tokens")


def test_scripts_stay_in_their_task(spark):
    """Tokens are not shuffled: a script's task has all of it."""
    rows = scripts._scripts(Tables(spark, LARGE))
    assert rows.rdd.getNumPartitions() == 10
    assert plan(sqltext.facts(rows, "id", "body")).count("Exchange") == 1
    assert plan(sqltext.lineage(rows, "body", "id")).count("Exchange") == 1


def test_lineage_sorts_tokens_four_times(spark):
    assert plan(sqltext.lineage(scripts._scripts(Tables(spark, LARGE)), "body", "id")).count("Sort [") <= 4


def test_facts_sort_names_by_batch_and_no_window_by_statement(spark):
    found = plan(sqltext.facts(scripts._scripts(Tables(spark, LARGE)), "id", "body"))
    assert found.count("Sort [") <= 4 and "block" not in "".join(x.split("[")[1] for x in found.split("\n") if "- Sort [" in x)


SAMPLES = {
    "top": "TOP (1)", "apply": "outer apply", "nolock": "ReadUncommitted", "readpast": "READPAST", "locking_hints": "tablockx", "temp_table": "#a", "table_variable": "declare @a table", "dynamic": "execute (", "merge": "merge a",
    "output": "output deleted", "identity": "scope_identity", "identity_column": "identity,", "identity_insert": "IDENTITY_INSERT", "cursor": "cursor local for", "cte": "with a as (select", "try_catch": "begin try",
    "transactions": "begin TRAN", "savepoint": "save transaction", "raiserror": "raiserror", "throw": "throw", "waitfor": "waitfor", "goto": "goto", "while_loop": "while", "print": "print", "pivot": "unpivot (",
    "for_xml": "for xml", "for_json": "for json", "openjson": "openjson(", "openxml": "openxml(", "openquery": "OPENROWSET(", "bulk_insert": "bulk insert", "full_text": "freetexttable(", "execute_as": "execute as",
    "use_database": "use [", "sequence": "next value for", "synonym": "create synonym", "iif": "iif(", "try_convert": "try_parse(", "convert": "convert(", "isnull": "isnull(", "getdate": "sysdatetime(", "date_functions": "eomonth(",
    "newid": "newsequentialid(", "max_type": "( max )", "money": "smallmoney", "uniqueidentifier": "uniqueidentifier", "datetime": "smalldatetime", "xml_type": "xml", "hierarchy_spatial": "geometry", "extended_procedure": "xp_a",
    "global_variable": "@@a", "index": "create unique nonclustered index", "permissions": "deny a", "set_options": "set xact_abort",
}


def test_every_construct_is_counted_as_its_pattern_does(spark):
    """Also where comments, strings, names and the mark itself stand between."""
    texts = [*SAMPLES.values(), None, "", "\x01- \x01' \x01[ top 1", "a--b\n'it''s' N'x' [q]]r] \"s\" /* t */ top 2", "n'a' nolock [nolock] \"nolock\" /*/ nolock", "merge/**/into[a]", "with[a]as(select", "'" + "a''" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").coalesce(1)
    pieces = F.regexp_extract_all("body", F.lit(rf"""{sqltext._COMMENT}|{sqltext._STRING}|\[[^\]]*+\]|"[^"]*+"|[^\["'/Nn-]++|[\["'/Nn-]"""), 0)
    plain = F.array_join(F.transform(pieces, lambda t: F.when(t.startswith("--") | t.startswith("/*"), " ").when(t.rlike("^[Nn]?'"), "''").when(t.rlike(r'^[\["].'), "[x]").otherwise(t)), "")
    want = df.select("id", plain.alias("code")).select("id", *[F.regexp_count("code", F.lit(p)).cast("long").alias(k) for k, p in sqltext.CONSTRUCTS.items()])
    got = {r["id"]: r.asDict() for r in sqltext.census(df, "body", "id").collect()}
    assert got == {r["id"]: r.asDict() for r in want.collect()}
    assert all(got[n][k] for n, k in enumerate(SAMPLES)) and set(SAMPLES) == set(sqltext.CONSTRUCTS) == set(sqltext.WORDS)
    assert "contains(__low" in plan(sqltext.census(df, "body", "id")).lower()


class Kept:
    """A state of one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return Kept()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_a_key_has_one_timer_however_many_sessions(spark):
    s, rng = events._Sessions(2_000, 5_000_000), np.random.default_rng(7)
    s.init(Handle())
    times = np.unique(rng.integers(0, 2_000_000, 500))
    rng.shuffle(times)
    rows = pd.DataFrame({"arrived": pd.date_range("2024-01-01", periods=len(times), freq="s"), "at": times})
    assert list(s.handleInputRows((1,), iter([rows[:200], rows[200:]]), None)) == []
    assert len(s.handle.timers) == 1
    want, ordered = [], np.sort(times).tolist()
    for at in ordered:
        want = [*want[:-1], (want[-1][0], at, want[-1][2] + 1)] if want and at - want[-1][1] <= 2_000 else [*want, (at, at, 1)]
    assert [x[:3] for x in s.open.get()] == want and len(want) > 100 and s.handle.timers == [(want[0][1] + 5_002_000) // 1000]
    out = pd.concat(s.handleExpiredTimer((1,), Now(6_000), Now(s.handle.timers[0])))
    due = [w for w in want if (w[1] + 5_002_000) // 1000 <= 6_000]
    assert sorted(zip(out["start"], out["stop"], out["n"], strict=True)) == due
    assert [x[:3] for x in s.open.get() if not x[3]] == want[len(due) :] and len(s.handle.timers) == 2


def test_a_session_that_is_joined_after_it_was_given_out_is_taken_back(spark):
    s = events._Sessions(2_000, 4_000)
    s.init(Handle())
    rows = lambda *x: iter([pd.DataFrame({"arrived": pd.date_range("2024-01-01", periods=len(x), freq="s"), "at": list(x)})])
    assert list(s.handleInputRows((1,), rows(10_000), None)) == []
    assert pd.concat(s.handleExpiredTimer((1,), Now(16), Now(16))).values.tolist() == [[1, "session", 10_000, 10_000, 1]]
    assert list(s.handleExpiredTimer((1,), Now(20), Now(20))) == []
    assert pd.concat(s.handleInputRows((1,), rows(9_000), None)).values.tolist() == [[1, "void", 10_000, 10_000, 1]]
    assert pd.concat(s.handleExpiredTimer((1,), Now(30), Now(16))).values.tolist() == [[1, "session", 9_000, 10_000, 2]]
    assert list(s.handleInputRows((1,), rows(30_000), None)) == [] and s.open.get() == [(30_000, 30_000, 1, False)]


def test_entries_with_the_same_lines_are_followed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "reach", lambda graph, seeds, *a: seen.append(1) or graph.select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit(1).alias("depth")))
    tables, real = [], G.written
    monkeypatch.setattr(G, "written", lambda df: tables.append(real(df)) or tables[-1])
    graph = spark.createDataFrame([(1, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1, "a", 10, 20), (2, "b", 1, 600)], "node long, file string, first int, last int")
    entries = spark.createDataFrame([*[(f"e{k}", "a", 5, 12) for k in range(50)], ("two", "a", 5, 12), ("two", "b", 0, 1), ("none", None, 1, 2), (None, "a", 5, 12)], "entry string, file string, first int, last int")
    marks = spark.createDataFrame([("host", "h", "b", 599)] * 100, "kind string, name string, file string, line int")
    got = {r["entry"]: (r["nodes"], r["host"]) for r in G.workflows(graph, nodes, entries, marks).collect()}
    assert got == {**{f"e{k}": (2, ["h"]) for k in range(50)}, "two": (2, ["h"]), "none": (0, []), None: (0, [])}
    assert max(t.count() for t in tables if "node" in t.columns) == 4 and min(t.count() for t in tables if "kind" in t.columns) == 1


@pytest.mark.parametrize("depth", [None, 2])
def test_edges_of_a_reach_are_made_once(spark, depth):
    """Each round reads the written edges, not what they are made from."""
    from quarry.operators.graph import reach

    made = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(k, k + 1) for k in range(6)], 1).map(lambda x: made.add(1) or x), "src long, dst long")
    found = reach(rows, spark.createDataFrame([(0,)], "seed long"), depth)
    assert found.count() == (depth or 6) and made.value == 6
