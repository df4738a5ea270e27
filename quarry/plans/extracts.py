"""Queries for extractors, cards and selections on small sources and on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cards as C
from quarry.operators import decide as D
from quarry.operators import estimate as E
from quarry.operators import extract as X
from quarry.plans.registry import query

#: A line of source for each line item, by its supplier: the kind of file, the line, where {v} is the part and {q} the quantity, and what each catalogue finds there: kind, value, extra.
LINES = [
    ("cs", '[HttpGet("orders/{v}/{id}")] public Order Get{q}(int id) => null;', {"API": [("attribute", "orders/{v}/{id}", "Get")]}),
    ("cs", 'app.MapPost("/p{v}", h);', {"API": [("minimal", "/p{v}", "Post")]}),
    ("js", "app.get('/h{v}', f);", {"API": [("express", "/h{v}", "get")]}),
    ("cs", 'throw new Order{q}Exception("no such order {v}");', {"ERRORS": [("throw", "no such order {v}", "Order{q}Exception")]}),
    ("cs", 'var u = configuration["Api{v}:Url{q}"];', {"CONFIG_READS": [("indexer", "Api{v}:Url{q}", "")]}),
    ("js", "const k = process.env.API_KEY_{v};", {"CONFIG_READS": [("environment", "API_KEY_{v}", "")]}),
    ("cs", "services.AddScoped<IRepo{v}, Repo{q}>();", {"REGISTRATIONS": [("service", "IRepo{v}", "Scoped"), ("implementation", "IRepo{v}", "Repo{q}")]}),
    ("cs", 'RecurringJob.AddOrUpdate("nightly{v}", () => Run(), Cron.Daily);', {"JOBS": [("recurring", "nightly{v}", "Cron.Daily")]}),
    ("js", "fetch('/orders/{v}');", {"UI_TRIGGERS": [("fetch", "/orders/{v}", "")]}),
    ("cs", 'var c = new SqlCommand("x{v}");', {"DATA_ACCESS": [("raw_command", "", "")]}),
    ("cs", "var o = _context.Orders{v}.Find({q});", {"DATA_ACCESS": [("orm", "Orders{v}", "")]}),
    ("txt", "// see https://api{v}.example.com:8443/v1 and http://10.0.0.{q}/x", {}),
    ("Dockerfile", "FROM base/image:{v}", {"BUILD_FACTS": [("base_image", "base/image:{v}", "")]}),
    ("py", 'raise ValueError("bad input {q}")', {"ERRORS": [("raise", "bad input {q}", "ValueError")]}),
    ("java", '@Scheduled(cron = "0 0 {q} * * *")', {"JOBS": [("scheduled", "0 0 {q} * * *", "")]}),
    ("txt", "xmlns=http://www.w3.org/2000/svg ftp://files{v}.corp/in plain text", {}),
]
_FILE = "CASE l_suppkey % " + str(len(LINES)) + " " + " ".join(f"WHEN {m} THEN '/{ext}'" if ext == "Dockerfile" else f"WHEN {m} THEN '.{ext}'" for m, (ext, *_) in enumerate(LINES)) + " END"
_LINE = f"l AS (SELECT 'o' || l_orderkey || file AS path, CAST(row_number() OVER (PARTITION BY l_orderkey, file ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS line, m, v, q FROM (SELECT *, {_FILE} AS file, l_suppkey % {len(LINES)} AS m, CAST(l_partkey AS VARCHAR) AS v, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem))"


def _files(t):
    """A file for each order and kind of source: a line for each of its line items, in their order."""
    snippet = F.lit("")
    for m, (_, text, _) in enumerate(LINES):
        snippet = F.when(F.col("l_suppkey") % len(LINES) == m, text).otherwise(snippet)
    snippet = F.replace(F.replace(snippet, F.lit("{v}"), F.col("l_partkey").cast("string")), F.lit("{q}"), F.col("l_quantity").cast("int").cast("string"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    each = F.array_sort(F.collect_list(F.struct(*order, snippet.alias("line"))))
    rows = t.lineitem.groupBy("l_orderkey", F.expr(_FILE).alias("file")).agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("text"))
    return rows.select(F.concat(F.lit("o"), "l_orderkey", "file").alias("path"), "text")


def _found(catalogue):
    """What LINES say that a catalogue finds, for every line."""
    rows = [(m, *fact) for m, (*_, facts) in enumerate(LINES) for fact in facts.get(catalogue, [])]
    shown = [f"replace(replace({c}, '{{v}}', v), '{{q}}', q) AS {c}" for c in ("value", "extra")]
    return f"WITH {_LINE} SELECT path, line, kind, {', '.join(shown)} FROM l JOIN ({_values('m, kind, value, extra', rows)}) USING (m)"


def _values(columns, rows):
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({columns})"


def _literal(x):
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


def _facts(catalogue):
    return lambda t: X.extract(_files(t), catalogue, "path", "text").select("path", "line", "kind", "value", "extra")


@query(_found("API"))
def ext_api(t):
    return _facts(X.API)(t)


@query(_found("JOBS"))
def ext_jobs(t):
    return _facts(X.JOBS)(t)


@query(_found("ERRORS"))
def ext_errors(t):
    return _facts(X.ERRORS)(t)


@query(_found("CONFIG_READS"))
def ext_config_reads(t):
    return _facts(X.CONFIG_READS)(t)


@query(_found("REGISTRATIONS"))
def ext_registrations(t):
    return _facts(X.REGISTRATIONS)(t)


@query(_found("UI_TRIGGERS"))
def ext_ui_triggers(t):
    return _facts(X.UI_TRIGGERS)(t)


@query(_found("BUILD_FACTS"))
def ext_build_facts(t):
    return _facts(X.BUILD_FACTS)(t)


@query(_found("DATA_ACCESS"))
def ext_data_access(t):
    return _facts(X.DATA_ACCESS)(t)


@query(f"""WITH {_LINE} SELECT path, line, 'api' || v || '.example.com' AS host, 8443 AS port, 'https' AS scheme, 'external' AS kind FROM l WHERE m = 11 UNION ALL SELECT path, line, '10.0.0.' || q, 80, 'http', 'internal' FROM l WHERE m = 11
UNION ALL SELECT path, line, 'files' || v || '.corp', NULL, 'ftp', 'internal' FROM l WHERE m = 15""")
def ext_endpoints(t):
    return X.endpoints(_files(t), "path", "text").drop("url")


_TAG = r"<(a|form|input|button|img|script|table)[ >]"


@query(rf"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '{_TAG}', 1)) AS tag FROM pages) GROUP BY ALL")
def ext_views(t):
    tags = F.explode(F.regexp_extract_all(F.lower("html"), F.lit(_TAG), 1)).alias("tag")
    return t.pages.select("page_id", tags).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS name, CASE p_size % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'console' WHEN 2 THEN 'web application' WHEN 3 THEN 'Web Forms' ELSE 'library' END AS type FROM part")
def project_types(t):
    size = F.col("p_size") % 5
    name = F.regexp_replace("p_name", " ", "_")
    packages = F.when(size == 0, F.array(F.lit("xunit"), name)).when(size == 2, F.array(name, F.lit("Microsoft.AspNetCore.App"))).otherwise(F.array(name))
    files = F.array(F.concat(name, F.lit(".cs")), F.when(size == 1, "Program.cs").when(size == 2, "Startup.cs").when(size == 3, F.concat(name, F.lit(".aspx"))).otherwise("x.cs"))
    rows = t.part.select(F.col("p_partkey").alias("name"), F.when(size == 1, "Exe").otherwise("Library").alias("output"), packages.alias("packages"), files.alias("files"))
    return X.project_type(rows).select("name", "type")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a reference is missing' WHEN 1 THEN 'a package cannot be restored' WHEN 2 THEN 'the sources have compile errors' ELSE 'see the log' END AS why FROM part")
def build_failures(t):
    size = F.col("p_size") % 4
    text = F.when(size == 0, F.concat(F.lit("error CS0246: type "), "p_name", F.lit(" could not be found"))).when(size == 1, F.concat(F.lit("NU1101 unable to find package "), "p_brand")).when(size == 2, F.concat(F.lit("line "), "p_partkey", F.lit(": error CS1002"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.build_failure(text).alias("why"))


@query("SELECT o_orderkey AS id, unnest(list_distinct(['#' || o_custkey, 'ABC-' || o_orderkey % 9, 'X2-' || o_custkey % 3])) AS issue FROM orders")
def linked_issues(t):
    text = F.concat(F.lit("fixes #"), "o_custkey", F.lit(" and ABC-"), F.col("o_orderkey") % 9, F.lit(", not UTF-8 (X2-"), F.col("o_custkey") % 3, F.lit(") again ABC-"), F.col("o_orderkey") % 9)
    return X.linked_issues(t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")


@query("""SELECT p_partkey AS id, 'dbo.roles' || p_size AS "table", p_partkey || '|' || p_name || '''s' AS "values" FROM part UNION ALL SELECT p_partkey, 'dbo.roles' || p_size, '2|b, ' || p_brand FROM part UNION ALL SELECT p_partkey, 't', CAST(p_size AS VARCHAR) FROM part""")
def seed_rows(t):
    text = F.concat(F.lit("INSERT INTO [dbo].[Roles"), "p_size", F.lit("] (id, n) VALUES ("), "p_partkey", F.lit(", N'"), "p_name", F.lit("''s'), (2, 'b, "), "p_brand", F.lit("');\ninsert into t values ("), "p_size", F.lit(")"))
    out = X.insert_rows(t.part.select(F.col("p_partkey").alias("id"), text.alias("text")), "id", "text")
    return out.withColumn("values", F.array_join("values", "|"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 'nation' AS kind, n_name AS title, CAST(least(count(c_custkey), 40) AS INT) AS related FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def entity_cards(t):
    entities = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.lit("nation").alias("kind"), F.col("n_name").alias("title"))
    facts = t.customer.select(F.col("c_nationkey").cast("long").alias("k"), F.lit("customer").alias("label"), F.col("c_name").alias("text"))
    return C.cards(entities, facts, "k", "kind", "title", "label", "text").withColumn("related", F.size("related")).drop("text")


@query(_values("page, level, title, anchor, summary", [("p", 1, "Top", "top", "one two"), ("p", 2, "Sub Part!", "sub-part", "three")]))
def entity_index(t):
    text = "intro\n# Top\none\n\ntwo\n## Sub Part! ##\nthree"
    return C.entity_index(t.spark.createDataFrame([("p", text)], "page string, text string"), "page", "text").drop("section")


@query("WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(text, '[^A-Za-z0-9_]+'))) AS name FROM documents), n(name) AS (VALUES ('that'), ('with'), ('erheheunlikely')) SELECT name, count(doc_id) AS pages, min(doc_id) AS first FROM n LEFT JOIN w USING (name) GROUP BY 1")
def page_mentions(t):
    items = t.spark.createDataFrame([("that",), ("with",), ("erheheunlikely",), ("dup_name",), ("dup_name",), ("the",)], "name string")
    return C.mentions(t.documents, items, "doc_id", "text", "name")


@query("SELECT * FROM (VALUES ('a/x.md', 'a/x.md'), ('y.md', 'b/y.md'), ('x.md', NULL), ('q.md', NULL)) v(link, resolved)")
def anchor_resolve(t):
    links = t.spark.createDataFrame([("a/x.md",), ("y.md",), ("x.md",), ("q.md",)], "link string")
    return C.resolve_links(links, t.spark.createDataFrame([("a/x.md",), ("c/x.md",), ("b/y.md",)], "target string"), "link", "target")


@query(_values("plan, sprint, item, hours", [("p", 1, 1, 5.0), ("p", 1, 3, 2.0), ("p", 1, 4, 3.0), ("p", 2, 1, 5.0), ("p", 2, 2, 6.0), ("p", 2, 4, 2.0)]))
def sprint_lanes(t):
    work = t.spark.createDataFrame([("p", 1, "app", 10.0), ("p", 2, "app", 6.0), ("p", 3, "db", 2.0), ("p", 4, "db", 5.0)], "plan string, item int, lane string, h double")
    done = C.schedule(work, "plan", "item", "lane", "h", {"app": 10.0, "db": 10.0}, [0.5])
    return done.groupBy("plan", "sprint", "item").agg(F.round(F.sum("hours"), 6).alias("hours"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'in debt' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END) AS reasons, NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AS kept FROM customer")
def project_select(t):
    out = C.selected(t.customer, {"in debt": "c_acctbal < 0", "segment": "c_mktsegment = 'MACHINERY'"})
    return out.select("c_custkey", F.array_join("reasons", ",").alias("reasons"), "kept")


@query(_values("repo, branch", [("a", "release"), ("b", "main"), ("c", "master")]))
def live_branch(t):
    rows = [("a", "develop", False, 1, "main"), ("a", "develop", False, 2, "main"), ("a", "release", True, 3, "main"), ("b", "main", True, 1, "x"), ("c", None, None, None, "master")]
    return C.live_branch(t.spark.createDataFrame(rows, "repo string, branch string, protected boolean, at int, usual string"), "repo", "branch", "protected", "at", "usual")


@query("WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS opened, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1), h AS (SELECT o_custkey, ceil((opened * 1.25 + finished * 0.3) * 2 - 1e-9) / 2 AS lo, ceil((opened * 3.0 + finished * 0.7) * 2 - 1e-9) / 2 AS hi FROM c WHERE opened + finished > 0) SELECT o_custkey, lo, hi, (lo + hi) / 2 AS total FROM h")
def hours_calc(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("opened"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    rates = t.spark.createDataFrame([("opened", 1.25, 3.0), ("finished", 0.3, 0.7)], "driver string, lo double, hi double")
    return E.priced(counts, "o_custkey", ["opened", "finished"], rates)


@query("SELECT p_brand, count(*) AS items, sum(CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 30 THEN 2.5 ELSE 6.0 END)::DOUBLE AS hours FROM part GROUP BY 1")
def size_bands(t):
    return E.size_band_hours(t.part, "p_brand", "p_size", [(10, 1.0), (30, 2.5)], 6.0)


@query("SELECT * FROM (VALUES ('a', 'strong', 'db, http'), ('b', 'weak', 'name')) v(app, level, notes)")
def scope_coupling(t):
    rows = [("a", "strong", "http"), ("a", "weak", "name"), ("a", "strong", "db"), ("b", "weak", "name"), ("b", "odd", "x")]
    out = D.strongest(t.spark.createDataFrame(rows, "app string, level string, note string"), "app", ["strong", "medium", "weak"], "level", "note")
    return out.withColumn("notes", F.array_join("notes", ", "))


@query("SELECT * FROM (VALUES (1, 'Low'), (2, 'High'), (3, 'High')) v(id, severity)")
def post_adjust(t):
    rows = [(1, "High", ["using X;", "using Y;"]), (2, "High", ["using X;", "X.Run();"]), (3, "High", [])]
    return D.demoted(t.spark.createDataFrame(rows, "id int, severity string, evidence array<string>"), "evidence", "^using ", "severity", "Low").drop("evidence")


@query("SELECT * FROM (VALUES ('q2', 'green', 'not an option'), ('q9', 'x', 'unknown question')) v(id, answer, problem)")
def intake_validate(t):
    questions = t.spark.createDataFrame([("q1", []), ("q2", ["red", "blue"])], "id string, options array<string>")
    return D.invalid_answers(t.spark.createDataFrame([("q1", "any"), ("q2", "green"), ("q2", "red"), ("q9", "x")], "id string, answer string"), questions)
