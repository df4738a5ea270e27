"""Queries for roll-ups, votes, routing and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import estate as O
from quarry.operators import rollups as U
from quarry.operators import search as Q
from quarry.plans.models import _CLOSURE, _NODES, _edges
from quarry.plans.registry import query
from quarry.plans.scans import _HITS, _hits


@query("SELECT doc_id, CAST(length(regexp_replace(left(t, strpos(t, chr(13) || chr(10))), '[^\\n]', '', 'g')) + 1 AS INT) AS line_no FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS t FROM documents) WHERE contains(t, chr(13) || chr(10))")
def crlf_lines(t):
    mixed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return O.first_crlf(t.documents.select("doc_id", mixed.alias("text")), "doc_id")


@query("SELECT source, CASE WHEN lower(source) = 'src1' OR starts_with(lower(source), 'src1/') THEN 'SRC1' WHEN lower(source) = 'src7' THEN 'src7' END AS excluded, count(*) AS n FROM documents GROUP BY ALL")
def group_exclude(t):
    return O.excluded_by(t.documents, "source", ["SRC1", "src7"]).groupBy("source", "excluded").agg(F.count("*").alias("n"))


_RANKED = "CAST(CASE level WHEN 'block' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS INT)"


@query(f"WITH {_HITS}, d AS (SELECT rule, doc_id, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS k FROM (SELECT DISTINCT rule, doc_id FROM hits)) SELECT h.rule, occurrences, apps, worst, refs FROM (SELECT rule, count(*) AS occurrences, count(DISTINCT source) AS apps, min({_RANKED}) AS worst FROM hits GROUP BY 1) h JOIN (SELECT rule, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS refs FROM d WHERE k <= 8 GROUP BY 1) r ON h.rule = r.rule")
def issue_types(t):
    hits = _hits(t).withColumn("rank", S.rank_of(F.col("level"), ["block", "warn"], 2))
    return O.issue_types(hits, "rule", "source", "rank", "doc_id").withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


@query(f"WITH {_HITS} SELECT source, coalesce(status, 'ready') AS status FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, CASE min({_RANKED}) WHEN 0 THEN 'block' WHEN 1 THEN 'warn' ELSE 'info' END AS status FROM hits GROUP BY 1) USING (source)")
def readiness_per_app(t):
    return O.worst_status(t.documents, _hits(t), "source", "level", ["block", "warn", "info"], "ready")


@query("SELECT source, CAST(sum(n) AS BIGINT) AS total, string_agg(lang || '=' || n, ',' ORDER BY lang) AS kinds FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def repo_totals(t):
    entries = F.transform(F.array_sort(F.map_entries("kinds")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return O.totals_map(t.documents, "source", "lang").withColumn("kinds", F.array_join(entries, ","))


_STRENGTH = "CASE event_type WHEN 'purchase' THEN 'explicit' WHEN 'signup' THEN 'port' WHEN 'click' THEN 'weak' ELSE 'context' END"


@query(f"""WITH e AS (SELECT user_id, {_STRENGTH} AS strength, CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS r FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, strength, count(DISTINCT r) AS n, min(r) AS r, CASE strength WHEN 'explicit' THEN 0 WHEN 'port' THEN 1 WHEN 'weak' THEN 2 ELSE 3 END AS k FROM e GROUP BY ALL),
x AS (SELECT user_id, coalesce(min(r) FILTER (strength = 'explicit') <> min(r) FILTER (strength = 'port'), false) AS clash FROM g GROUP BY 1), a AS (SELECT user_id, list_sort(list(DISTINCT r)) AS roles FROM e GROUP BY 1)
SELECT user_id, CASE WHEN clash OR strength = 'explicit' AND n > 1 THEN 'MIXED' ELSE r END AS role, CASE WHEN clash THEN 'explicit against port' ELSE strength END AS confidence, roles FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rn FROM g) JOIN x USING (user_id) JOIN a USING (user_id) WHERE rn = 1""")
def code_owner(t):
    rows = t.events.where("value is not null").select("user_id", F.expr(_STRENGTH).alias("strength"), F.floor(F.col("value") / 40).cast("string").alias("r"))
    return O.role_vote(rows, "user_id", "strength", "r", ["explicit", "port", "weak", "context"], against=("explicit", "port"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"


@query(rf"SELECT domain, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(h, '^[0-9.]+$') THEN '' ELSE regexp_extract(h, '([^.]+\.(?:(?:co|com|org|net|gov|ac)\.[a-z]{{2}}|[a-z]{{2,}}))$', 1) END AS domain FROM (SELECT {_HOST} AS h FROM pages UNION ALL SELECT unnest(['shop.example.co.uk', '10.0.0.1', 'db01', 'www.example.org']))) GROUP BY 1")
def company_domains(t):
    more = t.spark.createDataFrame([("shop.example.co.uk",), ("10.0.0.1",), ("db01",), ("www.example.org",)], "h string")
    hosts = t.pages.select(S.url_host(F.col("url")).alias("h")).union(more)
    return hosts.groupBy(O.registrable(F.col("h")).alias("domain")).agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS ip FROM documents), p AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: CASE WHEN length(x) <= 3 THEN CAST(x AS INT) ELSE 999 END) AS x FROM a)
SELECT ip, count(DISTINCT doc_id) AS docs, count(*) AS n, min(doc_id) AS first FROM p WHERE list_max(x) <= 255 AND NOT (x[1] IN (0, 10, 127) OR x[1] >= 224 OR x[1] = 172 AND x[2] BETWEEN 16 AND 31 OR x[1] = 192 AND x[2] = 168 OR x[1] = 169 AND x[2] = 254) GROUP BY 1""")
def public_ips(t):
    return U.public_ips(t.documents, "doc_id", "text")


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c) SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS size, string_agg(c_mktsegment || ' (' || n || ')', ', ' ORDER BY k) FILTER (WHERE k <= 3) AS top FROM r GROUP BY 1")
def community_profile(t):
    return O.profile(t.customer, "c_nationkey", "c_mktsegment")


@query("SELECT CAST(l_partkey % 50 AS VARCHAR) AS class, 'p' || l_partkey AS member, count(DISTINCT l_suppkey) AS callers, count(DISTINCT l_orderkey) AS files FROM lineitem WHERE l_suppkey % 3 = 0 OR l_suppkey % 50 <> l_partkey % 50 GROUP BY 1, 2")
def class_usage(t):
    """Parts are called by suppliers; every third supplier has no class."""
    calls = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee"), F.col("l_orderkey").alias("file"))
    parts = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("member"), (F.col("p_partkey") % 50).cast("string").alias("class"))
    owners = parts.union(t.supplier.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), "s_suppkey"), (F.col("s_suppkey") % 50).cast("string")))
    return U.class_usage(calls, owners)


@query("SELECT p_brand, count(*) AS items, count(l_partkey) AS reached, CAST(floor(100 * count(l_partkey) / count(*)) AS BIGINT) AS percent FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.08) ON p_partkey = l_partkey GROUP BY 1")
def test_reach(t):
    hit = t.lineitem.where("l_quantity > 45 and l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return O.reach_share(t.part, hit, "p_brand", "p_partkey")


@query("SELECT l_partkey, count(*) AS sites, list_sort(list(DISTINCT l_returnflag)) AS l_returnflag, list_sort(list(DISTINCT l_linestatus)) AS l_linestatus FROM lineitem GROUP BY 1")
def db_sites(t):
    return U.call_sites(t.lineitem, "l_partkey", "l_returnflag", "l_linestatus")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events) GROUP BY 1")
def build_codes(t):
    return U.diagnostics(t.events.withColumn("day", F.to_date("ts")), "event_type", "user_id", "day")


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (p = '1-URGENT') AS \"n_1-URGENT\", count(*) FILTER (p = '2-HIGH') AS \"n_2-HIGH\", arg_min(t, (k, t)) AS worst, arg_min(p, (k, t)) AS worst_level FROM (SELECT o_orderstatus, o_orderpriority AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS k, 'order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS t FROM orders) GROUP BY 1")
def review_axis(t):
    rows = t.orders.withColumn("title", F.concat(F.lit("order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))
    return U.review_axes(rows, "o_orderstatus", "o_orderpriority", "title", ["1-URGENT", "2-HIGH"])


@query("WITH r AS (SELECT p_partkey, p_type AS name, p_brand || '/' || p_size || '/' || p_type AS path FROM part), n AS (SELECT name, count(DISTINCT path) AS n, count(DISTINCT split_part(path, '/', 1)) AS a FROM r GROUP BY 1) SELECT p_partkey, CASE WHEN n = 1 THEN name WHEN a > 1 THEN name || ' (' || split_part(path, '/', 1) || ')' ELSE name || ' (' || split_part(path, '/', 2) || ')' END AS label FROM r JOIN n USING (name)")
def disambiguate(t):
    rows = t.part.select("p_partkey", F.col("p_type").alias("name"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type").alias("path"))
    return O.disambiguated(rows, "name", "path").select("p_partkey", "label")


@query("WITH r AS (SELECT o_custkey, CAST(o_custkey % 7 AS INT) AS nation FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM r), j AS (SELECT n.*, c_custkey, c_nationkey FROM n LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0) SELECT DISTINCT o_custkey AS k, unnest(list_filter([CASE WHEN c_custkey IS NULL THEN 'UNKNOWN' END, CASE WHEN n > 1 THEN 'DUPLICATE' END, CASE WHEN nation <> c_nationkey THEN 'NATION' END], lambda x: x IS NOT NULL)) AS kind FROM j")
def mapping_check(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 7).cast("int").alias("nation"))
    known = t.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return O.contradictions(rows, known, "k", ["nation"])


_SQUASH = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT conv_id, turn FROM conversations a WHERE turn % 3 = 0 AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn % 3 = 1 AND length(left({_SQUASH('a.text')}, 60)) >= 12 AND contains({_SQUASH('b.text')}, left({_SQUASH('a.text')}, 60)))")
def duplicate_comment(t):
    return O.not_posted(t.conversations.where("turn % 3 = 0"), t.conversations.where("turn % 3 = 1"), "conv_id", "text", "text").select("conv_id", "turn")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 1500 AS INT)) END AS built FROM customer) LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE built IS NULL OR newest > built")
def stale_outputs(t):
    built = F.when(F.col("c_custkey") % 4 > 0, F.expr("timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(c_custkey % 1500 as int))"))
    outputs, inputs = t.customer.select("c_custkey", built.alias("built")), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return O.stale(outputs, inputs, "c_custkey", "built", "o_orderdate").select("c_custkey")


CHECKS = {"price above 0": ("error", "o_totalprice > 0"), "status known": ("error", "o_orderstatus in ('F', 'O')"), "not huge": ("warning", "o_totalprice <= 300000")}


@query("SELECT o_orderkey, level, problem FROM (" + " UNION ALL ".join(f"SELECT o_orderkey, '{level}' AS level, '{name}' AS problem FROM orders WHERE NOT coalesce({ok}, false)" for name, (level, ok) in CHECKS.items()) + ")")
def findings_contract(t):
    return O.contract(t.orders, ["o_orderkey"], CHECKS)


@query("WITH s AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn + 2 END AS stop FROM conversations) SELECT c.conv_id, c.turn, CASE WHEN a.turn IS NOT NULL AND (c.stop IS NULL OR b.turn IS NOT NULL) THEN 'inline' ELSE 'general' END AS route FROM c LEFT JOIN s a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN s b ON b.conv_id = c.conv_id AND b.turn = c.stop")
def post_route(t):
    comments = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("turn") + 2).alias("stop"))
    return O.comment_routes(comments, t.conversations.where("role = 'assistant'"), "conv_id", "turn", "stop").select("conv_id", "turn", "route")


@query("WITH s AS (SELECT conv_id, turn, role AS step, CASE WHEN turn % 3 = 1 THEN 'nowhere' END AS nxt FROM conversations) SELECT conv_id, step, 'duplicate' AS problem FROM s GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT conv_id, step, 'unknown successor' FROM s WHERE nxt = 'nowhere'")
def flow_validate(t):
    steps = t.conversations.select("conv_id", "turn", F.col("role").alias("step"), F.when(F.col("turn") % 3 == 1, "nowhere").alias("nxt"))
    return O.flow_problems(steps, "conv_id", "turn", "step", "nxt").select("conv_id", "step", "problem")


@query("SELECT source, needle, doc_id, CAST(k AS INT) AS k FROM (SELECT source, needle, doc_id, row_number() OVER (PARTITION BY source, needle ORDER BY doc_id) AS k FROM documents, (SELECT unnest(['password', 'license', 'zzzz']) AS needle) WHERE contains(text, needle)) WHERE k <= 3")
def where_found(t):
    needles = t.documents.select("source").distinct().withColumn("needle", F.explode(F.array(F.lit("password"), F.lit("license"), F.lit("zzzz"))))
    return O.where_found(needles, t.documents, "source", "needle", "doc_id", "text").select("source", "needle", "doc_id", "k")


@query("SELECT p_brand, CASE WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END AS word, sum(x) AS weight FROM (SELECT p_brand, unnest(string_split_regex(lower(p_name), '[^a-z]+')) AS w, 3.0::DOUBLE AS x FROM part UNION ALL SELECT p_brand, unnest(string_split_regex(lower(p_type), '[^a-z]+')), 1.0::DOUBLE FROM part) WHERE w NOT IN ('', 'widget') GROUP BY ALL")
def weighted_bag(t):
    return O.weighted_bag(t.part, "p_brand", {"p_name": 3.0, "p_type": 1.0}, ["widget"])


@query("WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), g AS (SELECT conv_id, sum(n) AS total, max(n) AS n FROM c GROUP BY 1) SELECT g.conv_id, CASE WHEN 2 * g.n > total AND g.n >= 2 THEN (SELECT min(role) FROM c WHERE c.conv_id = g.conv_id AND c.n = g.n) END AS role FROM g")
def role_majority(t):
    return O.majority(t.conversations, "conv_id", "role")


_STEPS = "e AS (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt > event_type)"


def _steps(t):
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst > src").distinct()


@query(f"WITH RECURSIVE {_STEPS}, w(seed, node, depth) AS (SELECT src, dst, 1 FROM e WHERE src IN ('click', 'error') UNION SELECT seed, e.dst, depth + 1 FROM w JOIN e ON node = e.src WHERE depth < 8) SELECT seed, node, CAST(min(depth) AS INT) AS depth, min(depth) = 1 AS direct FROM w GROUP BY 1, 2")
def test_map(t):
    return O.test_map(_steps(t), t.spark.createDataFrame([("click",), ("error",)], "seed string"))


@query(f"{_CLOSURE}, {_NODES}, loop AS (SELECT DISTINCT src AS node FROM c WHERE src = dst), free AS (SELECT * FROM e WHERE src NOT IN (SELECT node FROM loop)), w(node, depth) AS (SELECT node, 1 FROM n UNION SELECT free.src, depth + 1 FROM w JOIN free ON free.dst = w.node) SELECT node, CAST(max(depth) AS INT) AS level FROM w GROUP BY 1")
def repo_order(t):
    return O.build_order(_edges(t))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS users, min(l_suppkey) AS first FROM lineitem GROUP BY 1")
def reverse_index(t):
    return O.reverse_index(t.lineitem, "l_suppkey", "l_partkey")


@query("SELECT l_returnflag, l_linestatus, lo, hi, round_even((lo + hi) / 2, 1) AS likely FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) * 1.5 AS lo, sum(l_quantity * 3) * 1.5 AS hi FROM lineitem GROUP BY ALL)")
def range_math(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_quantity") * 3).alias("high"))
    return O.range_sum(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "high", 1.5)


@query("WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, turn, CAST(0 AS BIGINT) AS more FROM n WHERE k <= 2 UNION ALL SELECT conv_id, min(turn), count(*) FROM n WHERE k > 2 GROUP BY 1")
def diff_caps(t):
    return O.diff_capped(t.conversations, "conv_id", "turn", 2)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def draft_decisions(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE 'other' END AS bucket, o_custkey AS name FROM orders), d AS (SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY name) AS k FROM (SELECT DISTINCT * FROM c)) SELECT bucket, (SELECT count(*) FROM c WHERE c.bucket = d.bucket) AS checks, list_sort(list(name)) AS names FROM d WHERE k <= 20 GROUP BY bucket")
def check_summary(t):
    return U.check_buckets(t.orders, "o_custkey", "o_orderstatus", {"passed": ["o"], "failed": ["f"]})


@query("SELECT item_id, doc_id, overlap, CAST(k AS INT) AS k FROM (SELECT item_id, doc_id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, n, doc_id) AS k FROM (SELECT b.item_id, d.doc_id, count(*) AS overlap, any_value(n) AS n FROM (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 6))) AS w FROM benchmark) b JOIN (SELECT doc_id, length(text) AS n, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 6))) AS w FROM documents) d USING (w) GROUP BY 1, 2)) WHERE k <= 10")
def spec_candidates(t):
    return Q.spec_candidates(t.benchmark, t.documents, "item_id", "doc_id", "text")
