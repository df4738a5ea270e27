"""Rule-scan, text and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import rules as R
from quarry.operators.aggregates import capped, complexity, contingency, findings
from quarry.plans.registry import query
from quarry.session import shared_path
from quarry.sources import files

RULES = [
    R.Rule("shout", "warn", "[A-Z]{4,}!!"),
    R.Rule("secret", "block", "(?i)(password|secret|token|api[_-]?key)[ ]*[=:]"),
    R.Rule("address", "info", r"[a-z0-9.]+@[a-z0-9-]+\.[a-z]{2,}", unless_in_line="noreply"),
    R.Rule("licence", "info", "(?i)licen[sc]ed? under"),
    R.Rule("table", "warn", r"[a-z]+ \| [a-z]+", types=("en", "de")),
    R.Rule("number", "info", r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}\.[0-9]{3}", unless_in_file="!!"),
]
_LINES = r"""lines AS (SELECT doc_id, lang, source, text, line, i AS line_no FROM (SELECT doc_id, lang, source, text, regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS ls FROM documents), LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i))"""
_HITS = _LINES + r""", hits AS (
  SELECT doc_id, lang, source, 'shout' AS rule, 'warn' AS level, line_no, line FROM lines WHERE regexp_matches(line, '[A-Z]{4,}!!')
  UNION ALL SELECT doc_id, lang, source, 'secret', 'block', line_no, line FROM lines WHERE regexp_matches(line, '(?i)(password|secret|token|api[_-]?key)[ ]*[=:]')
  UNION ALL SELECT doc_id, lang, source, 'address', 'info', line_no, line FROM lines WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9-]+\.[a-z]{2,}') AND NOT regexp_matches(line, 'noreply')
  UNION ALL SELECT doc_id, lang, source, 'licence', 'info', line_no, line FROM lines WHERE regexp_matches(line, '(?i)licen[sc]ed? under')
  UNION ALL SELECT doc_id, lang, source, 'table', 'warn', line_no, line FROM lines WHERE lang IN ('en', 'de') AND regexp_matches(line, '[a-z]+ \| [a-z]+')
  UNION ALL SELECT doc_id, lang, source, 'number', 'info', line_no, line FROM lines WHERE regexp_matches(line, '[0-9]{3}\.[0-9]{3}\.[0-9]{3}\.[0-9]{3}') AND NOT regexp_matches(text, '!!'))"""


def _hits(t):
    return R.rule_scan(t.documents, RULES, "doc_id", "lang", keep=("source",))


@query(f"WITH {_HITS} SELECT doc_id, lang, rule, level, CAST(line_no AS INT) AS line_no, line FROM hits")
def rule_scan_documents(t):
    return R.rule_scan(t.documents, RULES, "doc_id", "lang")


@query(f"""WITH {_LINES}, near AS (SELECT doc_id, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS around FROM lines)
SELECT doc_id, 'secret_near_address' AS rule, 'block' AS level, CAST(line_no AS INT) AS line_no, line FROM near WHERE regexp_matches(line, '(?i)(password|secret|token)[ ]*[=:]') AND regexp_matches(around, '@[a-z0-9-]+\\.[a-z]')""")
def rule_scan_context(t):
    rule = R.Rule("secret_near_address", "block", "(?i)(password|secret|token)[ ]*[=:]", context=r"@[a-z0-9-]+\.[a-z]")
    return R.rule_scan(t.documents, [rule], "doc_id")


@query(f"WITH {_LINES} SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(length(line)) AS INT) AS longest FROM lines GROUP BY doc_id")
def line_explode(t):
    return R.line_explode(t.documents).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("longest"))


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_matches(text, '(?i)(the|der|le|los) ')")
def file_lacks(t):
    return R.file_lacks(t.documents, "(?i)(the|der|le|los) ").select("doc_id", "source")


@query("SELECT source, min(CASE WHEN regexp_matches(text, '!!') THEN doc_id END) AS first_key, CAST(count(*) FILTER (WHERE regexp_matches(text, '!!')) AS BIGINT) AS n FROM documents GROUP BY source HAVING count(*) FILTER (WHERE regexp_matches(text, '!!')) > 0 AND NOT bool_or(regexp_matches(text, 'AKIA[0-9A-Z]+'))")
def absent_by_source(t):
    return R.absent(t.documents, "source", "!!", "AKIA[0-9A-Z]+", "doc_id")


@query(f"WITH {_LINES} SELECT doc_id, CAST(max(line_no) AS INT) AS line_no, arg_max(line, line_no) AS line FROM lines WHERE regexp_matches(line, '[0-9]') GROUP BY doc_id")
def last_match(t):
    return R.last_match(t.documents, "[0-9]", "doc_id")


WAIVERS = [(1, "secret", "src1*", "known test values", None), (2, "*", "src3", "", None), (3, "*", "src?", "old sources", "2030-01-01"), (4, "shout", "*", "style", "2020-01-01"), (5, "table", "src1?", "tables are fine", None)]
_WAIVED = f"""WITH {_HITS}, w(waiver, rule, g) AS (VALUES (1, 'secret', 'src1*'), (3, '*', 'src?'), (5, 'table', 'src1?')),
matched AS (SELECT doc_id, lang, source, h.rule, level, line_no, min(waiver) AS waiver FROM hits h LEFT JOIN w ON (w.rule = h.rule OR w.rule = '*') AND source GLOB w.g GROUP BY ALL)"""


def _waived(t):
    waivers = R.valid_waivers(t.spark.createDataFrame(WAIVERS, "waiver int, rule string, path string, reason string, expires string"), "2026-01-01").where("valid")
    return R.first_waiver(_hits(t), waivers, "source", ["doc_id", "lang", "source", "rule", "level", "line_no"])


@query(_WAIVED + " SELECT doc_id, source, rule, CAST(line_no AS INT) AS line_no, CAST(waiver AS INT) AS waiver FROM matched")
def waivers_first(t):
    return _waived(t).select("doc_id", "source", "rule", "line_no", "waiver")


@query("SELECT o_orderkey AS waiver, why_not IS NULL AS valid, why_not FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no reason' WHEN o_orderkey % 7 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') < '1998-01-01' THEN 'expired' END AS why_not FROM orders)")
def waiver_valid(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(key.alias("waiver"), F.lit("r").alias("rule"), F.lit("**").alias("path"), F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("for "), "o_orderpriority")).alias("reason"), F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("expires"))
    return R.valid_waivers(rows, "1998-01-01").select("waiver", "valid", "why_not")


@query(_WAIVED + """ SELECT lang, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT rule) AS BIGINT) AS rules, CAST(count(*) FILTER (WHERE waiver IS NOT NULL) AS BIGINT) AS waived,
CAST(count(*) FILTER (WHERE level = 'block' AND waiver IS NULL) AS BIGINT) AS blocking, count(*) FILTER (WHERE level = 'block' AND waiver IS NULL) = 0 AS passed FROM matched GROUP BY lang""")
def readiness_summary(t):
    open_block = (F.col("level") == "block") & F.col("waiver").isNull()
    return _waived(t).groupBy("lang").agg(F.count("*").alias("hits"), F.countDistinct("rule").alias("rules"), F.count("waiver").alias("waived"), F.count_if(open_block).alias("blocking"), (F.count_if(open_block) == 0).alias("passed"))


@query(f"WITH {_HITS} SELECT source, count(*) FILTER (WHERE level = 'block') AS block, count(*) FILTER (WHERE level = 'warn') AS warn, count(*) FILTER (WHERE level = 'info') AS info, count(*) AS total FROM hits GROUP BY source")
def area_pivot(t):
    return contingency(_hits(t), "source", "level", ["block", "warn", "info"])


@query(f"WITH {_HITS} SELECT rule, count(*) AS hits, count(DISTINCT doc_id) AS files FROM hits GROUP BY rule")
def hits_by_rule(t):
    return R.rule_scan(t.documents, RULES, "doc_id", "lang").groupBy("rule").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("files"))


@query(f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY rule, source ORDER BY doc_id, line_no) AS k FROM hits)
SELECT rule, source, count(*) AS occurrences, count(DISTINCT doc_id) AS files, CAST(min(CASE level WHEN 'block' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS INT) AS strongest, string_agg(doc_id || ':' || line_no, ' ' ORDER BY doc_id, line_no) FILTER (WHERE k <= 25) AS evidence FROM r GROUP BY rule, source""")
def findings_rollup(t):
    hits = _hits(t).withColumn("rank", S.rank_of(F.col("level"), ["block", "warn"], 2))
    out = findings(hits, ["rule", "source"], "doc_id", "line_no", "rank")
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["line_no"].cast("string"))), " "))


def _sql_mask(x):
    for pattern, to in S.MASKS:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return x


@query(f"SELECT doc_id, md5(m) AS masked, length(m) AS n FROM (SELECT doc_id, {_sql_mask('text')} AS m FROM documents)")
def mask_secrets(t):
    m = S.mask(F.col("text"))
    return t.documents.select("doc_id", F.md5(m).alias("masked"), F.length(m).cast("long").alias("n"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for k, p in S.SECRET_KINDS.items()) + ") AS kinds FROM documents")
def secret_kinds(t):
    return t.documents.select("doc_id", F.array_join(S.secret_kinds(F.col("text")), ",").alias("kinds"))


@query("SELECT doc_id FROM documents WHERE length(text) >= 4000 AND (list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 OR length(text) / len(string_split(text, chr(10))) > 250)")
def minified_docs(t):
    return t.documents.where(R.minified(t.documents)).select("doc_id")


_URL = r"""u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages)"""


@query(f"WITH {_URL} SELECT page_id, scheme, host, path, CASE scheme WHEN 'https' THEN 443 WHEN 'http' THEN 80 END AS port FROM u")
def url_parts(t):
    u = F.col("url")
    return t.pages.select("page_id", S.url_scheme(u).alias("scheme"), S.url_host(u).alias("host"), S.url_path(u).alias("path"), S.url_port(u).alias("port"))


_KIND = r"""CASE WHEN regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') THEN CASE WHEN regexp_matches(host, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') THEN 'internal' ELSE 'external-ip' END WHEN NOT contains(host, '.') OR regexp_matches(host, '\.(local|internal|lan|corp|intranet|test)$') OR regexp_matches(host, '(^|[.-])(dev|test|uat|staging|qa)([.-]|$)') OR NOT regexp_matches(host, '\.(com|net|org|io|edu|gov|info|biz|dev|app|cloud|[a-z]{2})$') THEN 'internal' ELSE 'external' END"""
HOSTS = ["10.1.2.3", "8.8.8.8", "172.20.0.1", "172.32.0.1", "db01", "api.example.com", "svc.corp", "uat-web.example.com", "x.unknowntld", "192.168.0.9", "a.de"]


@query(f"WITH {_URL} SELECT host, {_KIND} AS kind, count(*) AS n FROM (SELECT host FROM u UNION ALL SELECT unnest({HOSTS})) GROUP BY ALL")
def host_kind(t):
    hosts = t.pages.select(S.url_host(F.col("url")).alias("host")).union(t.spark.createDataFrame([(h,) for h in HOSTS], "host string"))
    return hosts.groupBy("host", S.host_kind(F.col("host")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS plain FROM pages")
def html_plain(t):
    return t.pages.select("page_id", F.md5(S.html_plain(F.col("html"))).alias("plain"))


_REFS = r"refs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS ref FROM pages)"


@query(f"WITH {_REFS}, r AS (SELECT ref, page_id, row_number() OVER (PARTITION BY ref ORDER BY page_id) AS k FROM (SELECT DISTINCT ref, page_id FROM refs)), c AS (SELECT ref, count(*) AS occurrences FROM refs GROUP BY ref) SELECT ref, occurrences, string_agg(CAST(page_id AS VARCHAR), ' ' ORDER BY page_id) FILTER (WHERE k <= 5) AS evidence FROM r JOIN c USING (ref) GROUP BY ref, occurrences")
def endpoints_rollup(t):
    refs = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ref"))
    counts = refs.groupBy("ref").agg(F.count("*").alias("occurrences"))
    first = capped(refs.distinct(), ["ref"], ["page_id"], ["page_id"], 5)
    return counts.join(first, "ref").select("ref", "occurrences", F.array_join(F.transform("items", lambda x: x["page_id"].cast("string")), " ").alias("evidence"))


@query(f"WITH {_URL} SELECT host, CASE scheme WHEN 'https' THEN 443 ELSE 80 END AS port, scheme, count(*) AS occurrences, count(DISTINCT path) AS paths FROM u GROUP BY ALL")
def destinations_rollup(t):
    u = F.col("url")
    return t.pages.groupBy(S.url_host(u).alias("host"), S.url_port(u).alias("port"), S.url_scheme(u).alias("scheme")).agg(F.count("*").alias("occurrences"), F.countDistinct(S.url_path(u)).alias("paths"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


@query(r"SELECT doc_id, round(CASE WHEN m > 0 THEN round_even((d + m) / m, 2) ELSE 0 END, 2) AS per_sentence, round(CASE WHEN l > 0 THEN round_even(d * 1000 / l, 1) ELSE 0 END, 1) AS per_thousand, CAST(m AS BIGINT) AS sentences, CAST(l AS BIGINT) AS lines FROM (SELECT doc_id, len(regexp_extract_all(text, '(?:^|[ \n])(?:the|der|la)(?:[ \n.,!?]|$)')) AS d, len(regexp_extract_all(text, '[.!?]')) AS m, len(regexp_extract_all(text, '\n')) + 1 AS l FROM documents)")
def text_complexity(t):
    n = lambda p: F.regexp_count("text", F.lit(p))
    rows = t.documents.select("doc_id", n(r"(?:^|[ \n])(?:the|der|la)(?:[ \n.,!?]|$)").alias("d"), n("[.!?]").cast("long").alias("sentences"), (n("\n") + 1).cast("long").alias("lines"))
    per, density = complexity(F.col("d"), F.col("sentences"), F.col("lines"))
    return rows.select("doc_id", per.alias("per_sentence"), density.alias("per_thousand"), "sentences", "lines")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS squashed FROM part")
def slugs(t):
    return t.part.select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.squash(F.col("p_type")).alias("squashed"))


@query("SELECT o_orderkey, CASE WHEN p >= 6 THEN 'high' WHEN p >= 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT o_orderkey, (CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END) * (CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END) AS p FROM orders)")
def risk_matrix(t):
    impact = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low")
    likely = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    return t.orders.select("o_orderkey", S.risk(impact, likely).alias("risk"))


#: Licences and the ranks of what they ask for.
LICENCES = [("MIT", 0), ("LGPL-2.1", 1), ("Custom-EULA", 2), ("GPL-3.0-only", 3), ("MPL-2.0", 1), ("Apache-2.0", 0), ("AGPL-3.0", 3)]
_RANK = lambda k: "CASE " + k + " " + " ".join(f"WHEN {m} THEN {r}" for m, (_, r) in enumerate(LICENCES)) + " END"


@query(f"SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN least({_RANK('p_size % 7')}, greatest({_RANK('p_partkey % 7')}, {_RANK('p_partkey // 7 % 7')})) ELSE least(greatest({_RANK('p_size % 7')}, {_RANK('p_partkey % 7')}), {_RANK('p_partkey // 7 % 7')}) END AS INT) AS rank FROM part")
def spdx(t):
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x, _ in LICENCES]), (k % 7 + 1).cast("int"))
    a, b, c = name(F.col("p_size")), name(F.col("p_partkey")), name(F.floor(F.col("p_partkey") / 7))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit(" OR "), b, F.lit(" AND "), c)).otherwise(F.concat(F.lit("("), a, F.lit(" AND "), b, F.lit(") OR "), c))
    return t.part.select("p_partkey", S.spdx_rank(text).cast("int").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, ceil(l_quantity / 7 * 2 - 1e-9) / 2 AS half, CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 25 THEN 'medium' WHEN l_quantity <= 40 THEN 'large' ELSE 'huge' END AS size, round_even((CASE WHEN l_quantity <= 5 THEN 2.0 WHEN l_quantity <= 20 THEN 2 + (l_quantity - 5) * (8.0 - 2) / 15 WHEN l_quantity <= 45 THEN 8 + (l_quantity - 20) * (20.0 - 8) / 25 ELSE 20.0 END) * 2, 0) / 2 AS hours FROM lineitem")
def bands_and_curves(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.half_up(q / 7).alias("half"), S.band(q, [(10, "small"), (25, "medium"), (40, "large")], "huge").alias("size"), S.curve(q, [(5, 2), (20, 8), (45, 20)]).alias("hours"))


NAMES = ["parseHTTPResponse", "order_line_items", "XMLReader2", "getUserById", "SQLQueries", "running", "processes", "glass"]


@query("SELECT * FROM (VALUES ('parseHTTPResponse', 'pars http respons'), ('order_line_items', 'order lin item'), ('XMLReader2', 'xml reader2'), ('getUserById', 'get user by id'), ('SQLQueries', 'sql queri'), ('running', 'runn'), ('processes', 'process'), ('glass', 'glass')) v(name, words)")
def words_and_stems(t):
    rows = t.spark.createDataFrame([(n,) for n in NAMES], "name string")
    return rows.select("name", F.array_join(F.transform(S.identifier_words(F.col("name")), S.stem), " ").alias("words"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'SQL Server' WHEN 1 THEN 'PostgreSQL' WHEN 2 THEN 'file' ELSE 'Oracle' END AS engine, CASE s_suppkey % 4 WHEN 0 THEN 'db' || s_nationkey WHEN 1 THEN 'pg' || s_nationkey || '.local' WHEN 2 THEN 'app' || s_suppkey || '.db' ELSE '(DESCRIPTION=(SERVICE_NAME=orcl' || s_nationkey || '))' END AS host, CASE WHEN s_suppkey % 4 = 0 THEN 'x=' || s_suppkey END AS password FROM supplier""")
def connection_strings(t):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    form = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Server=db"), n, F.lit("; Database=Shop"), k, F.lit(";User Id=sa;PASSWORD=x="), k)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("Host=pg"), n, F.lit(".local;Port=5432;Database=shop"), k))
    text = form.when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("Data Source=app"), k, F.lit(".db"))).otherwise(F.concat(F.lit("Data Source=(DESCRIPTION=(SERVICE_NAME=orcl"), n, F.lit("))")))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), text.alias("cs")).withColumn("m", S.connection(F.col("cs")))
    host = F.coalesce(F.element_at("m", "server"), F.element_at("m", "host"), F.element_at("m", "data source"))
    return rows.select("id", S.connection_engine(F.col("cs")).alias("engine"), host.alias("host"), F.element_at("m", "password").alias("password"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'legacy' WHEN 1 THEN 'modern' WHEN 2 THEN 'standard' WHEN 3 THEN 'modern' WHEN 4 THEN 'legacy' ELSE 'other' END AS class FROM part")
def framework_classes(t):
    size, k = F.col("p_size") % 6, F.col("p_partkey")
    tfm = F.when(size == 0, F.concat(F.lit("net4"), k % 9)).when(size == 1, F.concat(F.lit("net"), k % 6 + 5, F.lit(".0"))).when(size == 2, F.concat(F.lit("netstandard2."), k % 2)).when(size == 3, F.concat(F.lit("netcoreapp3."), k % 2)).when(size == 4, F.concat(F.lit("v4."), k % 8, F.lit(".2"))).otherwise(F.concat(F.lit("uap"), k))
    return t.part.select("p_partkey", S.framework_class(tfm).alias("class"))


@query("""WITH p AS (SELECT p_partkey, p_size % 7 AS form, p_partkey % 60 AS m, p_partkey % 24 AS h, p_size % 7 AS d, lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS clock FROM part)
SELECT p_partkey, CASE form WHEN 0 THEN 'every ' || (m + 2) || ' minutes' WHEN 1 THEN 'daily at ' || clock WHEN 2 THEN 'weekly on day ' || d || ' at ' || clock WHEN 3 THEN 'hourly at minute ' || m WHEN 4 THEN 'monthly on day ' || (h + 1) || ' at ' || clock WHEN 5 THEN 'odd ' || m ELSE (h + 1) || ' d ' || (h % 23 + 1) || ' h ' || (m % 59 + 1) || ' s' END AS words FROM p""")
def schedules(t):
    form, m, h = F.col("p_size") % 7, F.col("p_partkey") % 60, F.col("p_partkey") % 24
    text = F.when(form == 0, F.concat(F.lit("*/"), m + 2, F.lit(" * * * *"))).when(form == 1, F.concat(m, F.lit(" "), h, F.lit(" * * *"))).when(form == 2, F.concat(m, F.lit(" "), h, F.lit(" * * "), F.col("p_size") % 7)).when(form == 3, F.concat(m, F.lit(" * * * *")))
    text = text.when(form == 4, F.concat(m, F.lit(" "), h, F.lit(" "), h + 1, F.lit(" * *"))).when(form == 5, F.concat(F.lit("odd "), m)).otherwise(F.format_string("%d.%02d:00:%02d", h + 1, h % 23 + 1, m % 59 + 1))
    return t.part.select("p_partkey", F.when(form == 6, S.timespan(text)).otherwise(S.cron_text(text)).alias("words"))


#: Settings of each supplier and what is to be done with them; {k} is the key.
SETTINGS = [("S{k}DbPassword", "hunter{k}hunter2", "secret"), ("S{k}ApiUrl", "https://a{k}.example.com", "address"), ("S{k}LogDir", "C:\\logs\\{k}", "path"), ("S{k}Debug", "true", "keep"), ("S{k}Title", "Shop {k}", "review"), ("S{k}ApiKey", "__KEY{k}__", "review")]


@query("SELECT replace(key, '{k}', CAST(s_suppkey AS VARCHAR)) AS key, decision FROM supplier, (VALUES " + ", ".join(f"('{k}', '{d}')" for k, _, d in SETTINGS) + ") v(key, decision)")
def config_decisions(t):
    rows = t.supplier.select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v, _ in SETTINGS])).alias("s"))
    key, value = (F.replace(f"s.{c}", F.lit("{k}"), F.col("s_suppkey").cast("string")) for c in ("key", "value"))
    return rows.select(key.alias("key"), S.config_decision(key, value).alias("decision"))


@query("SELECT conv_id, turn, left(regexp_extract(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^(.*?[.!?])( |$)', 1), 110) AS first FROM conversations")
def first_sentences(t):
    return t.conversations.select("conv_id", "turn", S.first_sentence(F.col("text")).alias("first"))


ROUTES = [(1, "GET", "/en/{id}"), (2, "ANY", "/{lang}/{id}"), (3, "GET", "/de/:page")]


@query(f"WITH {_URL}, p AS (SELECT page_id, string_split(lower(trim(path, '/')), '/') AS s FROM u) SELECT page_id, route FROM p, (VALUES (1, 'en'), (2, NULL), (3, 'de')) r(route, first) WHERE len(s) = 2 AND (first IS NULL OR s[1] = first)")
def route_match(t):
    from quarry.operators.joins import route_match as match

    calls = t.pages.select("page_id", S.route_segments(S.url_path(F.col("url"))).alias("segs"))
    routes = F.broadcast(t.spark.createDataFrame(ROUTES, "route int, verb string, template string").withColumn("tmpl", S.route_segments(F.col("template"))))
    return match(calls, routes, "segs", "tmpl").select("page_id", "route")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def csv_round_trip(t):
    path = shared_path(t.spark)
    files.write_csv(t.conversations.select("conv_id", "turn", "role", "text"), path)
    return files.read_csv(t.spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT doc_id, source, md5(text) AS digest FROM documents")
def json_round_trip(t):
    path = shared_path(t.spark)
    files.write_json(t.documents.select("doc_id", "source", "text"), path)
    return files.read_json(t.spark, path, "doc_id long, source string, text string").select("doc_id", "source", F.md5("text").alias("digest"))
