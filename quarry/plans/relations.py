"""Queries for joins, aggregations, windows, top-k and sets on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import aggregates as A
from quarry.operators import joins as J
from quarry.operators import windows as W
from quarry.plans.registry import query


def _of(t, kind):
    return t.events.where(F.col("event_type") == kind)


@query("SELECT p.event_id, p.user_id, e.event_id AS error_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL) e ON p.user_id = e.user_id AND p.ts >= e.ts")
def asof_enclosing(t):
    errors = _of(t, "error").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    found = J.asof(_of(t, "purchase").select("event_id", "user_id", "ts"), errors, "user_id", "ts", ["event_id"], "error_", chunk=F.datediff("ts", F.lit("1970-01-01")))
    return found.select("event_id", "user_id", "error_event_id")


@query("SELECT p.event_id, CASE WHEN e.ts <= p.ts + INTERVAL 2 DAY THEN e.event_id END AS click_event_id FROM (SELECT * FROM events WHERE event_type = 'view') p ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) e ON p.user_id = e.user_id AND p.ts <= e.ts")
def asof_next(t):
    clicks = _of(t, "click").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    near = F.col("f.t") <= F.col("ts") + F.expr("INTERVAL 2 DAY")
    return J.asof(_of(t, "view").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["event_id"], "click_", True, near, F.datediff("ts", F.lit("1970-01-01"))).select("event_id", "click_event_id")


_SECONDS = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"


@query(f"WITH {_SECONDS}, s AS (SELECT user_id, sec AS lo, least(lead(sec, 1, sec + 86400) OVER (PARTITION BY user_id ORDER BY ts, event_id), sec + 86400) AS hi FROM e WHERE event_type = 'signup') SELECT e.event_id, s.lo FROM e JOIN s ON e.user_id = s.user_id AND e.sec >= s.lo AND e.sec < s.hi")
def interval_join(t):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    day = 86_400
    starts = _of(t, "signup").select("user_id", at.alias("lo"), "ts", "event_id")
    following = F.lead("lo").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spans = starts.withColumn("hi", F.least(F.coalesce(following, F.col("lo") + day), F.col("lo") + day)).select("user_id", "lo", "hi")
    return J.interval(t.events.select("event_id", "user_id", at.alias("at")), spans, ["user_id"], "at", "lo", "hi", day).select("event_id", "lo")


@query(f"WITH {_SECONDS} SELECT a.event_id AS view_id, b.event_id AS click_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND abs(a.sec - b.sec) <= 3600")
def band_match(t):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    a = _of(t, "view").select(F.col("event_id").alias("view_id"), "user_id", at.alias("a"))
    b = _of(t, "click").select(F.col("event_id").alias("click_id"), "user_id", at.alias("b"))
    return J.band(a, b, ["user_id"], "a", "b", 3600).select("view_id", "click_id")


OWNERS = [("cold", "team1"), ("large", "team2"), ("large bolt", "team3"), ("blue rod", "team4"), ("small widget", "team5"), ("", "nobody")]


@query("SELECT p_partkey, (SELECT arg_max(owner, length(prefix)) FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in OWNERS) + ") d(prefix, owner) WHERE prefix <> '' AND (p_name = prefix OR starts_with(p_name, prefix || ' '))) AS owner FROM part")
def longest_prefix(t):
    dim = F.broadcast(t.spark.createDataFrame(OWNERS, "prefix string, owner string"))
    return J.longest_prefix(t.part.select("p_partkey", "p_name"), dim, "p_name", "prefix", ["owner"], " ").select("p_partkey", "owner")


@query("SELECT d.doc_id, coalesce(l.quality, 9) AS quality, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1")
def override_review(t):
    rows = t.documents.select("doc_id", "lang", F.lit(9).alias("quality"))
    return J.override(rows, t.labels, "doc_id", ["quality"], "toxic", 1).select("doc_id", "quality", "lang")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def anti_unused(t):
    return t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_used(t):
    big = t.orders.where("o_totalprice > 200000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT n_name, r_name, count(*) AS customers, CAST(round(sum(c_acctbal), 2) AS DECIMAL(18, 2)) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def hash_inner(t):
    dims = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    return t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).cast("decimal(18,2)").alias("balance"))


@query("SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_lookup(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'b_only' WHEN l.doc_id IS NULL THEN 'a_only' ELSE 'both' END AS status FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY 1")
def reconcile_full_outer(t):
    return J.reconcile(t.documents, t.labels, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(DISTINCT s_nationkey) AS writers, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) >= 2")
def multi_writer(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    rows = pairs.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey").cast("long")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return J.shared_writers(rows, "l_partkey", "n_name").select("l_partkey", "writers", F.array_join("names", ",").alias("names"))


WANTED = ["NATION_3", "7", "NATION", "NATION_24", "99", "12"]


@query("WITH w(name) AS (SELECT unnest(" + str(WANTED) + ")), u AS (SELECT split_part(n_name, '_', 2) AS k, min(n_nationkey) AS v FROM nation GROUP BY 1 HAVING count(*) = 1) SELECT name, coalesce(a.n_nationkey, u.v) AS key, CASE WHEN a.n_nationkey IS NOT NULL THEN 'full' WHEN u.v IS NOT NULL THEN 'short' ELSE 'none' END AS matched_by FROM w LEFT JOIN nation a ON a.n_name = w.name LEFT JOIN u ON u.k = w.name")
def priority_lookup(t):
    rows = t.spark.createDataFrame([(w,) for w in WANTED], "name string")
    short = J.unique_keys(t.nation.select(F.substring_index("n_name", "_", -1).alias("k"), "n_nationkey"), "k", "n_nationkey")
    return J.prioritised(rows, [(F.broadcast(t.nation.select("n_name", "n_nationkey")), "name", "full"), (F.broadcast(short), "name", "short")], "key")


CASES = [("^ECONOMY", "budget"), ("(LARGE|MEDIUM)$", "metal"), ("SM", "finish")]


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p_type, '^ECONOMY') THEN 'budget' WHEN regexp_matches(p_type, '(LARGE|MEDIUM)$') THEN 'metal' WHEN regexp_matches(p_type, 'SM') THEN 'finish' ELSE 'other' END AS kind FROM part) GROUP BY 1")
def regex_dimension(t):
    return J.regex_dimension(t.part, "p_type", CASES, "kind", "other").groupBy("kind").agg(F.count("*").alias("n"))


@query()
def fuzzy_names(t):
    asked = t.spark.createDataFrame([("NATON_1",), ("NATION21",), ("NOTION_7",), ("region",)], "asked string")
    return J.similar(asked, t.nation, "asked", "n_name").select("asked", "n_name", F.round("ratio", 4).alias("ratio"), "rank")


@query("SELECT c_nationkey, list_sort(list(DISTINCT s_suppkey))[1:5]::VARCHAR AS candidates FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def role_candidates(t):
    joined = t.customer.select("c_nationkey").distinct().join(t.supplier, F.col("c_nationkey") == F.col("s_nationkey"))
    first = A.capped(joined, ["c_nationkey"], ["s_suppkey"], ["s_suppkey"], 5)
    return first.select("c_nationkey", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["s_suppkey"].cast("string")), ", "), F.lit("]")).alias("candidates"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_by(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def _nearest_sql(p):
    return f"SELECT l_returnflag, count(*) AS n, list_sort(list(l_extendedprice))[CAST(round_even({p} * (count(*) - 1), 0) AS INT) + 1] AS q FROM lineitem GROUP BY 1"


@query(_nearest_sql(0.8))
def nearest_rank(t):
    return A.nearest_rank(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.8)


@query("SELECT c_mktsegment, min(c_acctbal) AS lo, median(c_acctbal) AS mid, max(c_acctbal) AS hi, count(*) AS n FROM customer GROUP BY 1")
def minmedmax(t):
    return A.least_median_greatest(t.customer, ["c_mktsegment"], "c_acctbal")


@query("SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def mode_first(t):
    return A.first_mode(t.part, ["p_brand"], "p_type", "p_partkey")


@query("SELECT lower(o_orderpriority) AS k, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def connections_dedupe(t):
    return t.orders.groupBy(F.lower("o_orderpriority").alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT l_shipmode, stream, CAST(round(sum(mid), 1) AS DECIMAL(18,1)) AS hours FROM (SELECT l_returnflag AS l_shipmode, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'done' END AS stream, (l_quantity + l_quantity * 3) / 2 AS mid FROM lineitem) GROUP BY ALL")
def hours_by_stream(t):
    mid = (F.col("l_quantity") + F.col("l_quantity") * 3) / 2
    return t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode"), F.when(F.col("l_linestatus") == "O", "open").otherwise("done").alias("stream")).agg(F.round(F.sum(mid), 1).cast("decimal(18,1)").alias("hours"))


@query("SELECT o_orderstatus, string_agg(p || '=' || n, ',' ORDER BY p) AS histogram FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def severity_map(t):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "o_orderpriority", F.col("n").cast("string"))))
    return counts.groupBy("o_orderstatus").agg(F.array_join(entries, ",").alias("histogram"))


@query("SELECT p_name, p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || k END AS unique_name FROM (SELECT split_part(p_name, ' ', 1) AS p_name, p_partkey, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_partkey) AS k FROM part)")
def unique_suffix(t):
    return W.unique_suffix(t.part.select(F.substring_index("p_name", " ", 1).alias("p_name"), "p_partkey"), "p_name", "p_partkey")


@query("SELECT o_orderkey, left(o_orderpriority, 1) || 'F' || row_number() OVER (PARTITION BY left(o_orderpriority, 1) ORDER BY o_orderkey) AS id FROM orders")
def seq_id(t):
    axis = F.substring("o_orderpriority", 1, 1)
    rows = t.orders.select("o_orderkey", axis.alias("axis"))
    numbered = W.running_total(rows, ["axis"], ["o_orderkey"], F.lit(1).cast("long"), F.floor(F.col("o_orderkey") / 100_000))
    return numbered.select("o_orderkey", F.concat("axis", F.lit("F"), F.col("__end").cast("string")).alias("id"))


@query("SELECT conv_id, turn, least(coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 3), turn + 3) AS span_end, role FROM conversations")
def conversation_spans(t):
    return W.next_span(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", 3)


@query("SELECT o_orderkey, CAST(floor((e - size) / 500) + 1 AS BIGINT) AS first_slot, CAST(greatest(floor((e - size) / 500) + 1, ceil(e / 500)) AS BIGINT) AS last_slot FROM (SELECT o_orderkey, size, sum(size) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, floor(o_totalprice / 1000) AS size FROM orders))")
def running_cap_sprints(t):
    work = t.orders.withColumn("size", F.floor(F.col("o_totalprice") / 1000))
    return W.running_slots(work, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "size", 500, F.year("o_orderdate") * 12 + F.month("o_orderdate")).select("o_orderkey", "first_slot", "last_slot")


@query("SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def first_per_key(t):
    return W.first_per_key(t.conversations, ["conv_id"], ["turn"]).select("conv_id", "role", "text")


@query("""WITH u AS (SELECT DISTINCT p_brand AS pkg, p_size % 5 AS a, p_partkey % 12 AS b FROM part), r AS (SELECT DISTINCT p_brand AS pkg, p_size % 4 AS a, p_partkey % 15 AS b, p_size AS c FROM part)
SELECT pkg, u.a || '.' || u.b || '.0' AS used, arg_max(r.a || '.' || r.b || '.' || r.c, [r.a, r.b, r.c]) FILTER ([r.a, r.b, r.c] <= [u.a, u.b, 0]) AS latest FROM u LEFT JOIN r USING (pkg) GROUP BY pkg, u.a, u.b""")
def last_version(t):
    used = t.part.select(F.col("p_brand").alias("pkg"), F.concat_ws(".", F.col("p_size") % 5, F.col("p_partkey") % 12, F.lit(0)).alias("used")).distinct()
    releases = t.part.select(F.col("p_brand").alias("pkg"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_partkey") % 15, "p_size").alias("release")).distinct()
    return W.last_version(used, releases, "pkg", "used", "release")


@query("SELECT o_custkey, first_status, last_status FROM (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1) WHERE first_status <> last_status")
def change_detect(t):
    at = F.struct("o_orderdate", "o_orderkey")
    ends = t.orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", at).alias("first_status"), F.max_by("o_orderstatus", at).alias("last_status"))
    return ends.where("first_status <> last_status")


_REVENUE = "r AS (SELECT p_brand, p_partkey, CAST(round(sum(l_extendedprice), 2) AS DECIMAL(18, 2)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _revenue(t):
    sums = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("x"))
    return sums.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey", F.round("x", 2).cast("decimal(18,2)").alias("revenue"))


@query(f"WITH {_REVENUE} SELECT p_brand, p_partkey, revenue, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS k FROM r) WHERE k <= 3")
def topk_group(t):
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("revenue"), "p_partkey"))
    return _revenue(t).withColumn("k", k).where("k <= 3")


@query(f"WITH {_REVENUE} SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY revenue DESC, p_partkey) FILTER (WHERE k <= 5) || CASE WHEN max(k) > 5 THEN ' +' || (max(k) - 5) || ' more' ELSE '' END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS k FROM r) GROUP BY 1")
def cap_more(t):
    rows = _revenue(t)
    first = A.capped(rows, ["p_brand"], [F.desc("revenue"), "p_partkey"], ["p_partkey"], 5)
    n = rows.groupBy("p_brand").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > 5, F.concat(F.lit(" +"), (F.col("n") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return first.join(n, "p_brand").select("p_brand", F.concat(F.array_join(F.transform("items", lambda x: x["p_partkey"].cast("string")), ","), more).alias("shown"))


@query(f"WITH {_REVENUE} SELECT p_partkey, revenue FROM r ORDER BY revenue DESC, p_partkey LIMIT 10")
def topk_global(t):
    return _revenue(t).select("p_partkey", "revenue").orderBy(F.desc("revenue"), "p_partkey").limit(10)


@query("SELECT c_mktsegment, arg_min(c_custkey, (c_acctbal < 0, c_nationkey, c_custkey)) AS pilot FROM customer GROUP BY 1")
def pilot(t):
    return t.customer.groupBy("c_mktsegment").agg(F.min_by("c_custkey", F.struct(F.col("c_acctbal") < 0, "c_nationkey", "c_custkey")).alias("pilot"))


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END AS INT) AS r FROM orders ORDER BY r, o_totalprice DESC, o_orderkey LIMIT 50")
def rank_key(t):
    rank = S.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return t.orders.select("o_orderkey", "o_totalprice", rank.alias("r")).orderBy("r", F.desc("o_totalprice"), "o_orderkey").limit(50).drop("o_totalprice")


@query("SELECT 'customer' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_all(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("supplier"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_keys(t):
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("O").subtract(of("F"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_counts(t):
    dims = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    return t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DECIMAL(18,2)) AS sum_qty, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DECIMAL(18,2)) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    money = lambda c: F.round(F.sum(c), 2).cast("decimal(18,2)")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money(F.col("l_quantity")).alias("sum_qty"), money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))
