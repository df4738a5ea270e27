"""Queries over SQL scripts and C# sources that are written from table rows; the expected facts are computed in SQL from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import lexers
from quarry.operators import codesql as C
from quarry.operators import sqltext as X
from quarry.plans.registry import query
from quarry.session import spread

#: Scripts that one task writes and reads.
SCRIPTS = 2000
#: A script for each part. {k} is its key, {name} its name, {size} its size.
MAIN = """-- part {k}: merge into ghost_{k} (nolock)
CREATE TABLE [stock].[{name} {k}] (id int identity(1,1), note nvarchar(max) DEFAULT 'from ghost_{k}', price money);
  GO
CREATE OR ALTER PROCEDURE stock.Load_{k} @since datetime AS
BEGIN
  /* join dbo.Never_{k}
  */
  WITH recent AS (SELECT TOP (10) o.id FROM dbo.Orders_{k} o, dbo.[Order Details] d WHERE o.id = d.id), b (x) AS (SELECT f(1, recent.id) FROM recent)
  INSERT INTO #work SELECT x, 'update dbo.Fake_{k}' FROM b
  UPDATE TOP (5) o SET total = CASE WHEN 1 = 1 THEN 2 END FROM dbo.Orders_{k} AS o JOIN "sales"."Lines_{k}" l WITH (NOLOCK) ON l.id = o.id
  DELETE FROM x FROM audit.Trail_{k} x WHERE x.id IN (SELECT id FROM #work)
  DELETE audit.Old_{k} OUTPUT deleted.id INTO audit.Gone_{k} WHERE id = {size}
  EXEC @rc = ops.Refresh_{k} @id = 1
  SELECT * INTO archive.Copy_{k} FROM stock.Levels_{k} (NOLOCK) CROSS APPLY dbo.Split(names) s UNION ALL SELECT 1 FROM dbo . Last_{k}
END
"""
#: What is added unless the size is divisible by 3, and what is added too if it leaves 1.
MERGE = """GO
MERGE INTO stock.Levels_{k} AS t USING (SELECT id FROM dbo.Feed_{k}) AS s ON s.id = t.id WHEN MATCHED THEN UPDATE SET t.n = 1 WHEN NOT MATCHED THEN INSERT (id) VALUES (s.id);
EXEC sp_executesql N'select * from hidden_{k}'
"""
BROKEN = "go 2\nSELECT (1 FROM dbo.Lost_{k}\nGO\nSELECT 'open"
#: (object, op, kind, line, owner, whether it needs MERGE).
_OWNER = "'stock.load_{k}'"
FACTS = ", ".join([
    "('stock.{name} {k}', 'create', 'table', 2, NULL, false)", "('stock.load_{k}', 'create', 'procedure', 4, NULL, false)",
    *[f"('{o}', '{op}', NULL, {line}, {_OWNER}, false)" for o, op, line in [
        ("dbo.orders_{k}", "read", 8), ("dbo.order details", "read", 8), ("#work", "temp", 9), ("dbo.orders_{k}", "update", 10), ("dbo.orders_{k}", "read", 10), ("sales.lines_{k}", "read", 10),
        ("audit.trail_{k}", "delete", 11), ("audit.trail_{k}", "read", 11), ("#work", "temp", 11), ("audit.old_{k}", "delete", 12), ("audit.gone_{k}", "insert", 12), ("ops.refresh_{k}", "call", 13),
        ("archive.copy_{k}", "select-into", 14), ("stock.levels_{k}", "read", 14), ("dbo.last_{k}", "read", 14)]],
    *[f"('{o}', '{op}', NULL, {line}, NULL, true)" for o, op, line in [("stock.levels_{k}", "merge", 17), ("dbo.feed_{k}", "read", 17), ("sp_executesql", "call", 18)]],
])
_FACTS = f"SELECT p_partkey AS id, line, lower(replace(owner, '{{k}}', CAST(p_partkey AS VARCHAR))) AS owner, lower(replace(replace(object, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{name}}', p_name)) AS object, op, kind FROM part, (VALUES {FACTS}) v(object, op, kind, line, owner, extra) WHERE NOT extra OR p_size % 3 <> 0"
#: Constructs of each script, and of MERGE.
COUNTS = {"top": "2", "apply": "1", "nolock": "2", "temp_table": "2", "output": "1", "identity_column": "1", "cte": "2", "max_type": "1", "money": "1", "datetime": "1", "merge": "CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END", "dynamic": "CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END"}


def _filled(text: str, **values):
    out = F.lit(text)
    for name, column in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.col(column).cast("string"))
    return out


def _scripts(t):
    size = F.col("p_size") % 3
    body = F.concat(F.lit(MAIN), F.when(size == 0, "").otherwise(MERGE), F.when(size == 1, BROKEN).otherwise(""))
    for name, column in (("k", "p_partkey"), ("name", "p_name"), ("size", "p_size")):
        body = F.replace(body, F.lit(f"{{{name}}}"), F.col(column).cast("string"))
    rows = spread(t.part.select("p_partkey", "p_name", "p_size", F.col("p_partkey").alias("id")), SCRIPTS, "id")
    return rows.select("id", body.alias("body"))


@query(f"SELECT DISTINCT id, object, op FROM ({_FACTS})")
def sql_lineage(t):
    return X.lineage(_scripts(t), "body", "id")


@query(_FACTS)
def sql_facts(t):
    return X.facts(_scripts(t), "id", "body").drop("stmt")


@query("SELECT p_partkey AS id, " + ", ".join(f"CAST({COUNTS.get(k, '0')} AS BIGINT) AS {k}" for k in X.CONSTRUCTS) + " FROM part")
def sql_census(t):
    return X.census(_scripts(t), "body", "id")


@query("SELECT p_partkey AS id, CAST(batch AS INT) AS batch, CAST(line AS INT) AS line_no FROM part, (VALUES (1, 1, 0), (2, 4, 0), (3, 17, 1), (4, 20, 2), (5, 22, 2)) v(batch, line, need) WHERE need = 0 OR need = 1 AND p_size % 3 <> 0 OR need = 2 AND p_size % 3 = 1")
def sql_batches(t):
    return X.batches(_scripts(t), "id", "body").select("id", "batch", F.col("line_no").cast("int").alias("line_no"))


@query("SELECT p_partkey AS id, CAST(batch AS BIGINT) AS batch, line, message FROM part, (VALUES (3, 20, 'parentheses do not match'), (4, 22, 'string without end')) v(batch, line, message) WHERE p_size % 3 = 1")
def sql_errors(t):
    return X.errors(_scripts(t), "id", "body")


@query("""SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'statement' WHEN 1 THEN 'fragment' WHEN 2 THEN 'none' WHEN 3 THEN 'statement' ELSE 'none' END AS kind FROM part""")
def sql_is_sql(t):
    texts = {0: "SELECT a FROM [{name}]", 1: " where x = '{name}'", 2: "select a {name}", 3: "update [{name}] set x = {k}"}
    text = F.lit("Update available: {name}")
    for k, x in texts.items():
        text = F.when(F.col("p_size") % 5 == k, x).otherwise(text)
    for name, column in (("k", "p_partkey"), ("name", "p_name")):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.col(column).cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), X.kind_of(text).alias("kind"))


#: Sources for each supplier: data access, texts for people, object queries. {k} is the key, {n} the nation.
REPO = r'''using System; // "select * from ghost{k}"
class Repo{k} {
  public List<int> Find(int id, string name = "q") {
    var sql = "SELECT a, b " +
        "FROM dbo.T{k} WHERE id = " + id + " AND name = '" + name.Trim('"') + "'";
    if (id > 1) { sql += $" ORDER BY {(id > 2 ? "a" : $"b{id}")} DESC"; }
    var cmd = new SqlCommand(sql);
    var raw = """
      select c from dbo.R{k} /* {n} */
      """;
    /* var gone = "delete from dbo.Gone"; */
    var text = @"delete from dbo.D{k} where p = 'c:\x'";
    var cut = "SELECT a FROM dbo.T{k} WHERE ";
    var later = "UPDATE " + Name(1, "b") + " SET x = " + {n};
  }
}
'''
VIEW = """class View{k} {
  string a = "Select an item from {n}", b = "Update available for {0} items";
  string c = "insert coin {k}", d = "Drop " + name;
}
"""
HQL = 'class Q{k} { void Run() { s.CreateQuery("select o from Order o where o.id = {k}"); } }'
_SCANNED = ", ".join([
    r"""('repo', 4, 6, 3, 'upper', 'value', 'SELECT a, b FROM dbo.T{k} WHERE id =  @p  AND name = '' @p '' ORDER BY @p DESC', 'accepted')""",
    r"""('repo', 8, 10, 0, 'lower', 'value', '      select c from dbo.R{k} /* {n} */', 'accepted')""",
    r"""('repo', 12, 12, 0, 'lower', 'value', 'delete from dbo.D{k} where p = ''c:\x''', 'accepted')""",
    "('repo', 13, 13, 0, 'upper', NULL, NULL, 'parse_error')",
    "('repo', 14, 14, 2, 'upper', 'value', 'UPDATE  @p  SET x =  @p ', 'accepted')",
    "('view', 2, 2, 0, 'mixed', 'value', 'Select an item from {n}', 'no_context')",
    "('view', 2, 2, 1, 'mixed', NULL, NULL, 'parse_error')",
    "('view', 3, 3, 0, 'lower', NULL, NULL, 'parse_error')",
    "('view', 3, 3, 1, 'mixed', NULL, NULL, 'parse_error')",
    "('hql', 1, 1, 0, 'lower', 'value', 'select o from Order o where o.id = {k}', 'object_query')",
])
_SCAN = f"SELECT s_suppkey || '/' || source AS path, line, end_line, holes, keyword_case, reading, replace(replace(sql, '{{k}}', CAST(s_suppkey AS VARCHAR)), '{{n}}', CAST(s_nationkey AS VARCHAR)) AS sql, reason FROM supplier, (VALUES {_SCANNED}) v(source, line, end_line, holes, keyword_case, reading, sql, reason) WHERE source <> 'hql' OR s_nationkey % 2 = 0"


def _sources(t):
    files = F.array(*[F.struct(F.lit(n).alias("source"), _filled(x, k="s_suppkey", n="s_nationkey").alias("code")) for n, x in (("repo", REPO), ("view", VIEW), ("hql", HQL))])
    rows = t.supplier.select("*", F.explode(files).alias("f")).where("f.source <> 'hql' OR s_nationkey % 2 = 0")
    return rows.select(F.concat_ws("/", "s_suppkey", "f.source").alias("path"), "f.code")


@query(_SCAN)
def sql_code_scan(t):
    return C.scan_code(_sources(t), "path", "code").select("path", "line", "end_line", "holes", "keyword_case", "reading", "sql", "reason")


@query(f"SELECT reason, count(*) AS candidates, count(*) FILTER (holes > 0) AS dynamic FROM ({_SCAN}) GROUP BY reason")
def sql_code_reasons(t):
    return C.scan_code(_sources(t), "path", "code").groupBy("reason").agg(F.count("*").alias("candidates"), F.count_if("dynamic").alias("dynamic"))


@query("""WITH f AS (SELECT s_suppkey || '/' || source AS path, s_suppkey, obj, op FROM supplier, (VALUES ('repo', 'dbo.t', 'read'), ('repo', 'dbo.r', 'read'), ('repo', 'dbo.d', 'delete')) v(source, obj, op))
SELECT path, obj || s_suppkey AS object, op FROM f""")
def sql_code_lineage(t):
    found = C.scan_code(_sources(t), "path", "code").where("reason = 'accepted'").select("path", F.concat_ws(":", "path", "pos").alias("id"), "sql")
    facts = X.facts(found.select("id", "sql"), "id", "sql").where("object NOT LIKE '@%'")
    return facts.select(F.substring_index("id", ":", 1).alias("path"), "object", "op").distinct()


#: Wrappers: method W{k} of supplier k hands its name on to W of half its number, unless 3 is what is left of k by 7; its own callers name procedures unless k is divisible by 5.
WRAPPER = """class S{k} {
  void W{k}(int n, string proc) { W{half}(n, {arg}); }
  void Use{k}() {
    W{k}(1, {own});
    W{k}(2, {own});
  }
}
class Names { const string Known = "dbo.Known"; }
"""
_CHAIN = """WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey // 2 AS half FROM supplier WHERE s_suppkey > 0),
found(k, round) AS (SELECT k, 1 FROM s WHERE half = 0 AND k % 7 <> 3 UNION ALL SELECT s.k, round + 1 FROM s JOIN found ON s.half = found.k WHERE s.k % 7 <> 3),
rated AS (SELECT k, round, k // 2 AS half, k % 5 = 0 OR 2 < 0.5 * (2 + (SELECT count(*) FROM s WHERE s.half = found.k)) AS poor FROM found),
alive(k) AS (SELECT k FROM rated WHERE NOT poor AND half = 0 UNION ALL SELECT r.k FROM rated r JOIN alive ON r.half = alive.k WHERE NOT poor)"""


def _wrappers(t):
    known = F.col("s_suppkey") % 2 == 0
    rows = t.supplier.where("s_suppkey > 0").select("*", F.floor(F.col("s_suppkey") / 2).alias("half"), F.when(F.col("s_suppkey") % 7 == 3, 'proc + "x"').otherwise("proc").alias("arg"))
    own = F.when(F.col("s_suppkey") % 5 == 0, "Pick()").when(known, "Known").otherwise(F.concat(F.lit('"dbo.P'), F.col("s_suppkey"), F.lit('"')))
    return rows.withColumn("own", own).select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("path"), _filled(WRAPPER, k="s_suppkey", half="half", arg="arg", own="own").alias("code"))


def _sites(t):
    return C.procedure_sites(_wrappers(t), "path", "code", t.spark.range(1).select(F.lit("W0").alias("method"), F.lit(1).alias("param")))


@query(f"{_CHAIN} SELECT 'W0' AS method, 1 AS param, 0 AS round, true AS kept UNION ALL SELECT 'W' || k, 1, round, k IN (SELECT k FROM alive) FROM rated")
def sql_wrappers(t):
    return _sites(t)[1]


@query(f"""{_CHAIN}, target AS (SELECT k FROM alive UNION ALL SELECT 0)
SELECT 'S' || s.k AS path, line, 'W' || s.k AS callee, CASE WHEN s.k % 5 = 0 THEN NULL WHEN s.k % 2 = 0 THEN 'dbo.Known' ELSE 'dbo.P' || s.k END AS procedure, CASE WHEN s.k % 5 = 0 THEN 'expression' WHEN s.k % 2 = 0 THEN 'constant' ELSE 'literal' END AS how FROM s JOIN target USING (k), (VALUES (4), (5)) v(line)
UNION ALL SELECT 'S' || s.k, 2, 'W' || half, NULL, CASE WHEN s.k % 7 = 3 THEN 'expression' ELSE 'variable' END FROM s JOIN target ON half = target.k WHERE s.k NOT IN (SELECT k FROM alive)""")
def sql_procedure_sites(t):
    return _sites(t)[0]


@query("SELECT s_suppkey || '/repo' AS path, 15 AS loc, 17 AS lines, false AS in_string, true AS outside, [11] AS comments FROM supplier")
def code_lexers(t):
    rows = _sources(t).where("path LIKE '%/repo'")
    bare = lexers.strip_comments("cs", strings=True)(F.col("code"))
    second = F.get(F.split("code", "\n"), 5)
    found = rows.select("path", lexers.lines_of_code()("code").alias("loc"), F.size(F.split(bare, "\n")).alias("lines"), lexers.code_match("ORDER BY")(second).alias("in_string"), lexers.code_match(r"sql \+=")(second).alias("outside"), lexers.multiline(r"/\*\s*var gone.*?\*/")("code").alias("comments"))
    return found
