"""Queries for graphs, search, estimates, decisions, SQL text, lexers, streams and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import diffs
from quarry.functions import scalars as S
from quarry.operators import decide as D
from quarry.operators import estimate as E
from quarry.operators import gates as G
from quarry.operators import graph as N
from quarry.operators import search as Q
from quarry.plans.registry import query
from quarry.streaming import events as V

#: Each line item is an edge: its part leads one to three parts on within sixteen, and lines of number 7 of every fourth supplier lead back within four.
_EDGES = "e(src, dst) AS (SELECT DISTINCT l_partkey, CASE WHEN l_linenumber = 7 AND l_suppkey % 4 = 0 THEN l_partkey - l_partkey % 4 + CAST(l_quantity AS BIGINT) % 4 ELSE least(l_partkey + 1 + l_suppkey % 3, l_partkey - l_partkey % 16 + 15) END FROM lineitem)"
_CLOSURE = f"WITH RECURSIVE {_EDGES}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"
_NODES = "n(node) AS (SELECT src FROM e UNION SELECT dst FROM e)"
_SCC = f"{_CLOSURE}, {_NODES}, mutual AS (SELECT a.src AS node, min(a.dst) AS least FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1), scc AS (SELECT node, least(node, coalesce(least, node)) AS component FROM n LEFT JOIN mutual USING (node))"
_LAYERS = f"{_SCC}, dag AS (SELECT DISTINCT a.component AS a, b.component AS b FROM e JOIN scc a ON e.src = a.node JOIN scc b ON e.dst = b.node WHERE a.component <> b.component), walk(node, depth) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT dag.a, walk.depth + 1 FROM walk JOIN dag ON dag.b = walk.node), lay AS (SELECT node AS component, max(depth) AS layer FROM walk GROUP BY 1)"


def _edges(t):
    back = F.col("l_partkey") - F.col("l_partkey") % 4 + F.col("l_quantity").cast("long") % 4
    on = F.least(F.col("l_partkey") + 1 + F.col("l_suppkey") % 3, F.col("l_partkey") - F.col("l_partkey") % 16 + 15)
    return t.lineitem.select(F.col("l_partkey").alias("src"), F.when((F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 4 == 0), back).otherwise(on).alias("dst")).distinct()


@query(f"{_CLOSURE} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM c")
def graph_closure(t):
    return N.closure(_edges(t))


@query(f"WITH RECURSIVE {_EDGES}, w(seed, node, depth) AS (SELECT src, dst, 1 FROM e WHERE src % 5 = 1 UNION SELECT seed, e.dst, depth + 1 FROM w JOIN e ON node = e.src WHERE depth < 3) SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1, 2")
def graph_reach(t):
    e = _edges(t)
    return N.reach(e, e.where("src % 5 = 1").select(F.col("src").alias("seed")), depth=3)


@query(f"WITH RECURSIVE {_EDGES}, w(node, path) AS (SELECT 16, [16::BIGINT] UNION SELECT e.dst, list_append(path, e.dst) FROM w JOIN e ON node = e.src WHERE len(path) < 17 AND NOT list_contains(path, e.dst)) SELECT CAST(len(path) - 1 AS INT) AS hops, path FROM w WHERE node = 31 ORDER BY len(path), path LIMIT 1")
def shortest_path(t):
    return N.shortest_path(_edges(t), 16, 31).select("hops", "path")


@query(f"{_SCC} SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM scc")
def graph_scc(t):
    return N.components(_edges(t))


@query(f"{_SCC} SELECT CAST(component AS BIGINT) AS component, CAST(node AS BIGINT) AS node FROM scc WHERE component IN (SELECT component FROM scc GROUP BY 1 HAVING count(*) > 1) OR node IN (SELECT src FROM e WHERE src = dst)")
def graph_cycles(t):
    return N.cycles(_edges(t))


@query(f"{_LAYERS} SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component, CAST(layer AS INT) AS layer FROM scc JOIN lay USING (component)")
def graph_layers(t):
    return N.layers(_edges(t))


@query(f"{_LAYERS} SELECT CAST(layer + 1 AS INT) AS wave, count(*) AS nodes FROM scc JOIN lay USING (component) GROUP BY 1")
def graph_waves(t):
    return N.waves(_edges(t))


@query(f"{_CLOSURE}, {_NODES}, d AS (SELECT dst AS node, count(*) AS direct FROM e WHERE src <> dst GROUP BY 1), r AS (SELECT dst AS node, count(*) AS transitive FROM c WHERE src <> dst GROUP BY 1), b AS (SELECT node, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive FROM n LEFT JOIN d USING (node) LEFT JOIN r USING (node)) SELECT node, direct, transitive, CASE WHEN transitive >= 3 THEN 'High' WHEN transitive > 0 OR direct >= 20 THEN 'Medium' ELSE 'Low' END AS level FROM b")
def blast_radius(t):
    return N.blast_radius(_edges(t))


@query(f"{_CLOSURE}, {_NODES}, r AS (SELECT dst AS node, count(*) AS transitive FROM c WHERE src <> dst GROUP BY 1) SELECT node, CAST(coalesce(transitive, 0) AS BIGINT) AS transitive FROM n LEFT JOIN r USING (node)")
def blast_radius_sketch(t):
    """Sketches are exact for so few dependents."""
    return N.blast_radius(_edges(t), exact=False).select("node", "transitive")


def _trade(t):
    a = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return a.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey").cast("long")).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))


_TRADE = "t AS (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {_TRADE} SELECT a.n_regionkey AS src_owner, b.n_regionkey AS dst_owner, count(*) AS n FROM t JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL")
def edge_lift(t):
    owner = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))
    return N.lift(_trade(t), owner)


@query(f"WITH {_TRADE} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM t UNION ALL SELECT dst FROM t) GROUP BY 1")
def node_degree(t):
    return N.degree(_trade(t))


@query("SELECT l_suppkey AS src, l_partkey AS dst, bool_and(l_returnflag = 'N') AS inferred, count(*) AS n FROM lineitem GROUP BY ALL")
def edge_merge(t):
    return N.merge_parallel(t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "N").alias("inferred")))


TERMS = ["the", "licensed", "token"]
_W = "string_split_regex(lower(text), '[^a-z0-9]+')"
_TF = ", ".join(f"CAST(len(list_filter({_W}, lambda x: x = '{w}')) AS DOUBLE) AS tf{k}" for k, w in enumerate(TERMS))
_IDF = lambda k: f"ln(1 + (cards - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * n / mean))"


@query(f"""WITH a AS (SELECT count(*) AS cards, avg(length(text)) AS mean FROM documents), f AS (SELECT doc_id, length(text) AS n, {_TF} FROM documents WHERE {' OR '.join(f"contains(lower(text), '{w}')" for w in TERMS)}),
d AS (SELECT {', '.join(f'count(*) FILTER (WHERE tf{k} > 0) AS df{k}' for k in range(len(TERMS)))} FROM f),
s AS (SELECT doc_id, ({' + '.join(_IDF(k) for k in range(len(TERMS)))}) * (0.5 + 0.5 * ({' + '.join(f'(tf{k} > 0)::INT' for k in range(len(TERMS)))}) / {len(TERMS)}.0) AS score FROM f, a, d)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_search(t):
    return Q.bm25(t.documents, TERMS, "doc_id", {"text": 1.0}, 20).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT source, word, count(*) AS w FROM (SELECT source, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) >= 4 GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM b GROUP BY 1), g AS (SELECT count(DISTINCT source) AS groups FROM documents),
s AS (SELECT source, word, round(w * ln(1 + groups / df), 6) AS score FROM b JOIN d USING (word), g WHERE df <= greatest(2, 0.6 * groups) OR groups < 4)
SELECT source, word, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 2""")
def tfidf_names(t):
    return Q.tfidf_labels(t.documents.select("source", F.split(F.lower("text"), "[^a-z]+").alias("words")), "source", "words")


@query()
def chunk_sections(t):
    return Q.chunk(t.documents, "doc_id", "text")


@query("SELECT p_name, CAST(CASE WHEN lower(p_name) = 'widget' THEN 0 WHEN ends_with(lower(p_name), 'widget') THEN 1 ELSE 2 END AS INT) AS rank, p_partkey FROM part WHERE contains(lower(p_name), 'widget')")
def entity_lookup(t):
    return Q.lookup(t.part.select("p_partkey", "p_name"), "p_name", "widget")


@query("SELECT l_orderkey, n, least(4 + 1.5 * (n - 1), greatest(8, 4)) AS hours, CAST(round(greatest(1, pow(q / 10.0, 0.1)), 6) AS DOUBLE) AS factor FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")
def finding_hours(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return rows.select("l_orderkey", "n", E.finding_hours(F.col("n"), F.lit(4.0), F.lit(1.5), F.lit(8.0)).alias("hours"), F.round(E.scale(F.col("q")), 6).alias("factor"))


@query("SELECT p_partkey, round((lo + hi + mode) / 3, 6) AS mean, round(sqrt(greatest(lo * lo + hi * hi + mode * mode - lo * hi - lo * mode - hi * mode, 0) / 18), 6) AS sd FROM (SELECT p_partkey, p_size AS lo, p_size * 3.0 AS hi, p_size * 1.5 AS mode FROM part)")
def triangular_moments(t):
    size = F.col("p_size").cast("double")
    mean, sd = S.triangular_moments(size, size * 3, size * 1.5)
    return t.part.select("p_partkey", F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"))


@query("SELECT s_suppkey, round(CASE WHEN sum(x) OVER w > 0 THEN 1000 * x / sum(x) OVER w ELSE 1000.0 / count(*) OVER w END, 6) AS share FROM (SELECT s_suppkey, s_nationkey, greatest(s_acctbal, 0) AS x FROM supplier) WINDOW w AS (PARTITION BY s_nationkey)")
def db_split(t):
    rows = t.supplier.select("s_suppkey", "s_nationkey", F.greatest("s_acctbal", F.lit(0.0)).alias("x"), F.lit(1000.0).alias("total"))
    return E.allocate(rows, ["s_nationkey"], "x", "total").select("s_suppkey", F.round("share", 6).alias("share"))


@query("WITH s AS (SELECT * FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'MACHINERY'), g AS (SELECT c_mktsegment, min(c_acctbal) AS lo, median(c_acctbal) AS mid, max(c_acctbal) AS hi FROM s GROUP BY 1), a AS (SELECT min(c_acctbal) * 0.5 AS alo, median(c_acctbal) AS amid, max(c_acctbal) * 2 AS ahi FROM s) SELECT c_custkey, round(coalesce(lo, alo), 4) AS lo, round(coalesce(mid, amid), 4) AS mid, round(coalesce(hi, ahi), 4) AS hi, lo IS NOT NULL AS has_peers FROM customer LEFT JOIN g USING (c_mktsegment), a WHERE c_custkey % 3 <> 0")
def extrapolate(t):
    sampled = t.customer.where("c_custkey % 3 = 0 and c_mktsegment <> 'MACHINERY'")
    out = E.extrapolate(sampled, t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_acctbal")
    return out.select("c_custkey", *[F.round(c, 4).alias(c) for c in ("lo", "mid", "hi")], "has_peers")


@query()
def monte_carlo(t):
    items = t.part.groupBy(F.col("p_brand").alias("pkg"), F.col("p_size").alias("item")).agg(F.count("*").cast("double").alias("lo"))
    items = items.withColumn("hi", F.col("lo") * 3).withColumn("mode", F.col("lo") * 1.5)
    return E.rollup(E.simulate(items, "pkg", 500), "pkg")


SEVEN = [("orders = 0", "retire", "no orders"), ("balance < 0 and orders < 5", "retain", "in debt, few orders"), ("orders >= 20 and total > 3000000", "refactor", "large and busy"), ("orders >= 15", "replatform", "busy"), ("segment in ('MACHINERY', 'FURNITURE')", "rehost", "stable segment")]


@query("WITH f AS (SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) SELECT c_custkey, " + "CASE " + " ".join(f"WHEN {c} THEN '{d}'" for c, d, _ in SEVEN) + " ELSE 'repurchase' END AS decision, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in SEVEN) + " ELSE 'nothing else' END AS reason FROM f")
def seven_r_case(t):
    sums = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    rows = t.customer.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))
    return D.cascade(rows, SEVEN, ("repurchase", "nothing else")).select("c_custkey", "decision", "reason")


@query("SELECT * FROM (VALUES ('a', '1.0', 'upgrade', '1.2'), ('b', '2.0', 'keep', '2.0'), ('c', '1.0', 'replace', NULL), ('d', '1.0', 'upgrade', '3.0')) v(pkg, used, action, target)")
def package_recommend(t):
    used = t.spark.createDataFrame([("a", "1.0"), ("b", "2.0"), ("c", "1.0"), ("d", "1.0")], "pkg string, used string")
    releases = t.spark.createDataFrame([("a", "1.0", "MIT", False), ("a", "1.1", "GPL", True), ("a", "1.2", "MIT", True), ("b", "2.0", "MIT", True), ("c", "1.0", "MIT", False), ("c", "1.1", "MIT", False), ("d", "1.0", "MIT", False), ("d", "3.0", "GPL", True)], "pkg string, release string, licence string, safe boolean")
    as_version = lambda c: S.version(F.col(c)).alias(c)
    out = D.recommend(used.select("pkg", as_version("used")), releases.select("pkg", as_version("release"), "licence", "safe"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".").alias(c)
    return out.select("pkg", text("used"), "action", F.when(F.col("target").isNotNull(), F.array_join(F.transform("target", lambda x: x.cast("string")), ".")).alias("target"))


@query("SELECT unnest(['q1', 'q2', 'q4']) AS id")
def question_when(t):
    rows = [("q1", {}), ("q2", {"db": ["sql", "pg"]}), ("q3", {"db": ["pg"]}), ("q4", {"db": ["sql"], "os": ["linux", "windows"]}), ("q5", {"cloud": ["yes"]})]
    return D.applicable(t.spark.createDataFrame(rows, "id string, when map<string,array<string>>"), {"db": ["sql"], "os": ["windows"]}).select("id")


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '$.a[1]: value' WHEN 2 THEN '$.b: missing' WHEN 3 THEN '$.a: length' ELSE '$: type' END AS diff FROM part")
def json_diff(t):
    size, k, s = F.col("p_size") % 5, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    first = F.concat(F.lit('{"a": ['), k, F.lit(", "), s, F.lit('], "b": "'), F.col("p_name"), F.lit('"}'))
    second = F.when(size == 0, F.concat(F.lit('{"b": "'), F.col("p_name"), F.lit('", "a": ['), k, F.lit(".0, "), s, F.lit("]}"))).when(size == 1, F.concat(F.lit('{"a": ['), k, F.lit(", "), F.col("p_size") + 1, F.lit('], "b": "'), F.col("p_name"), F.lit('"}')))
    second = second.when(size == 2, F.concat(F.lit('{"a": ['), k, F.lit(", "), s, F.lit("]}"))).when(size == 3, F.concat(F.lit('{"a": ['), k, F.lit('], "b": "'), F.col("p_name"), F.lit('"}'))).otherwise(F.concat(F.lit("["), k, F.lit("]")))
    return t.part.select(F.col("p_partkey").alias("id"), diffs.first_diff(first, second).alias("diff"))


@query("""SELECT 'orders have customers' AS gate, count(*) = 0 AS passed, count(*) AS offenders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'unique customers', count(*) = 0, count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'discounts in range', count(*) = 0, count(*) FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 1, false)
UNION ALL SELECT 'no secrets', count(*) = 0, count(*) FROM documents WHERE regexp_matches(text, 'token = ')""")
def gates(t):
    return G.report(G.covered("orders have customers", t.orders, t.customer, ["o_custkey"], ["c_custkey"]), G.unique("unique customers", t.customer, ["c_custkey"]), G.every("discounts in range", t.lineitem, F.col("l_discount").between(0, 1)), G.no_rows("no secrets", t.documents.where(F.col("text").rlike("token = "))))


@query("SELECT * FROM (VALUES ('a', true, false, 'fixed'), ('b', false, true, 'broken'), ('c', true, NULL, 'new')) v(gate, passed, was, change)")
def baseline_delta(t):
    now = t.spark.createDataFrame([("a", True), ("b", False), ("c", True)], "gate string, passed boolean")
    return G.against_baseline(now, t.spark.createDataFrame([("a", False), ("b", True)], "gate string, passed boolean"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(t):
    return V.windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(t):
    out = V.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


@query("SELECT event_type AS step, count(*) AS runs, count(*) FILTER (WHERE value > 90) AS failed FROM events GROUP BY 1")
def log_stream(t):
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base}/log-{t.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    V.append_log(t.events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("step"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("status")), f"{folder}/in")
    report = V.step_report(V.log_stream(t.spark, f"{folder}/in"))
    return V.drain(report, f"{folder}/out", f"{folder}/state").select("step", "runs", "failed")


_LATE = """WITH a AS (SELECT event_id, user_id, ts AS arrived, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 9 HOUR ELSE ts END AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, coalesce(t < max(t) OVER (PARTITION BY user_id ORDER BY arrived, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 4 HOUR, false) AS late FROM a),
c AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM b WHERE NOT late),
d AS (SELECT user_id, t, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM c), e AS (SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM d GROUP BY user_id, s)
SELECT user_id, 'session' AS kind, start, stop, n FROM e WHERE epoch_ms(stop + INTERVAL 6 HOUR) <= (SELECT epoch_ms(max(arrived)) FROM a) UNION ALL SELECT user_id, 'late', t, t, 1 FROM b WHERE late"""


@query(_LATE)
def late_sessions(t):
    """Events as they arrive in two runs of one stream; every eleventh tells of a time nine hours before."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base}/late-{t.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    arrived = F.col("ts").cast("timestamp")
    rows = t.events.select("user_id", arrived.alias("arrived"), F.when(F.col("event_id") % 11 == 0, arrived - F.expr("INTERVAL 9 HOURS")).otherwise(arrived).alias("at"))
    half = t.events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    V.state_store(t.spark)
    for part in (F.col("arrived") <= F.lit(half).cast("timestamp"), F.col("arrived") > F.lit(half).cast("timestamp")):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        out = V.drain(V.late_sessions(stream, "user_id", "at", "arrived", "2 hours", "4 hours"), f"{folder}/out", f"{folder}/state", "append")
    return V.settled(out, "user_id").withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(max(turn) - min(turn) + 1 AS BIGINT) AS span FROM conversations GROUP BY 1")
def conversation_turns(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), (F.max("turn") - F.min("turn") + 1).alias("span"))


@query("SELECT doc_id, blast, lang FROM (SELECT d.doc_id, d.lang, n AS blast, row_number() OVER (ORDER BY n DESC, d.doc_id) AS k FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= 60")
def review_queue(t):
    impact = t.documents.groupBy("source").agg(F.count("*").alias("blast"))
    open_ = t.documents.join(t.labels, "doc_id", "left_anti").join(impact, "source")
    return open_.select("doc_id", "blast", "lang").orderBy(F.desc("blast"), "doc_id").limit(60)


@query("SELECT doc_id, 'shares text of ' || first AS note FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) WHERE first <> doc_id")
def idempotent_replace(t):
    first = F.min("doc_id").over(Window.partitionBy(F.md5("text")))
    notes = t.documents.select("doc_id", first.alias("first")).where("first <> doc_id").select("doc_id", F.concat(F.lit("shares text of "), F.col("first").cast("string")).alias("note"))
    rows = V.replace_origin(notes.withColumn("origin", F.lit("copies")), notes, "copies")
    return V.replace_origin(rows, notes, "copies").select("doc_id", "note")
