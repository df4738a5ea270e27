"""Queries over settings and Markdown that are written from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import markdown
from quarry.operators import settings as Y
from quarry.plans.registry import query

#: Settings of each supplier: a base file and one for each environment. {k} is the key, {n} the nation.
BASE = """# settings of {k}
name: s{k}   # its name
db:
  host: "db{n}.corp.example.com"  # main: host
  'port': 5432
  replicas:
    - r{k}
    - name: r2
      at: 'zone # {n}'
service:
  url: https://api{n}.example.com/v1#top
  retries: 3
notes: |
  first {k}
  second
"""
PROD = "db:\n  host: prod{k}.example.com\n  Port: 6000\nextra:\n- {n}\n- - x\n"
DEV = "service:\n  url: http://localhost:80{n}/\n  url: http://localhost:90{n}/\n"
_LEAVES = "('base', 'name', 's{k}', 2), ('base', 'db:host', 'db{n}.corp.example.com', 4), ('base', 'db:port', '5432', 5), ('base', 'db:replicas:0', 'r{k}', 7), ('base', 'db:replicas:1:name', 'r2', 8), ('base', 'db:replicas:1:at', 'zone # {n}', 9), ('base', 'service:url', 'https://api{n}.example.com/v1#top', 11), ('base', 'service:retries', '3', 12), ('base', 'notes', 'first {k}' || chr(10) || 'second', 13), ('prod', 'db:host', 'prod{k}.example.com', 2), ('prod', 'db:Port', '6000', 3), ('prod', 'extra:0', '{n}', 5), ('prod', 'extra:1:0', 'x', 6), ('dev', 'service:url', 'http://localhost:80{n}/', 2), ('dev', 'service:url', 'http://localhost:90{n}/', 3)"
_FILLED = f"f AS (SELECT s_suppkey AS app, env, path, replace(replace(value, '{{k}}', CAST(s_suppkey AS VARCHAR)), '{{n}}', CAST(s_nationkey AS VARCHAR)) AS value, line FROM supplier, (VALUES {_LEAVES}) v(env, path, value, line) WHERE env = 'base' OR env = 'prod' AND s_suppkey % 5 <> 0 OR env = 'dev' AND s_suppkey % 2 = 0)"
_EFFECTIVE = f"""WITH {_FILLED}, e AS (SELECT DISTINCT app, env FROM f WHERE env <> 'base'), a AS (SELECT f.app, e.env, path, value, line, false AS own FROM f LEFT JOIN e USING (app) WHERE f.env = 'base' UNION ALL SELECT app, env, path, value, line, true FROM f WHERE env <> 'base'),
o AS (SELECT app, env, path, value, own AS from_env FROM (SELECT *, row_number() OVER (PARTITION BY app, env, lower(path) ORDER BY own DESC, line DESC) AS k FROM a) WHERE k = 1)"""


def _files(t):
    def filled(text):
        out = F.lit(text)
        for name, column in (("k", "s_suppkey"), ("n", "s_nationkey")):
            out = F.replace(out, F.lit(f"{{{name}}}"), F.col(column).cast("string"))
        return out.alias("text")

    key = F.col("s_suppkey")
    files = [t.supplier.where(when).select(key.alias("app"), F.lit(env).alias("env"), filled(text)) for env, text, when in (("base", BASE, F.lit(True)), ("prod", PROD, key % 5 != 0), ("dev", DEV, key % 2 == 0))]
    return files[0].union(files[1]).union(files[2])


def _leaves(t):
    rows = _files(t).select(F.struct("app", "env").alias("file"), "text")
    return Y.yaml_leaves(rows, "file", "text").select("file.*", "path", "value", F.col("line_no").alias("line"))


@query(f"WITH {_FILLED} SELECT app, env, path, value, CAST(line AS INT) AS line FROM f")
def yaml_settings(t):
    return _leaves(t)


def _effective(t):
    rows = _leaves(t).withColumn("env", F.when(F.col("env") != "base", F.col("env")))
    return Y.overlay(rows, "app", "env", "path", "value", "line")


@query(f"{_EFFECTIVE} SELECT * FROM o")
def config_overlay(t):
    return _effective(t)


@query(f"""{_EFFECTIVE}, c AS (SELECT app, lower(path) AS path, value, CASE WHEN contains(value, '://') THEN 'url' ELSE 'host' END AS class, CASE WHEN contains(value, 'localhost') THEN 'internal' ELSE 'external' END AS kind FROM o WHERE path IN ('db:host', 'service:url'))
SELECT app, path, min(class) AS class, min(kind) AS host_kind, count(DISTINCT value) AS values, count(DISTINCT value) > 1 AS varies FROM c GROUP BY 1, 2""")
def config_map(t):
    return Y.config_map(_effective(t), "app", "env", "path", "value")


#: A page for each document: its number, language and source.
PAGE = "# Document {d}\n\nIn {l}, from\n{s}.\n```sql\n# {d}\n\n- no item\n```\n- one {d}\n  goes on\n- two\n\n| a | {l} |\n|---|---|\n> said {s}\n> twice\n***\n## End ##\n~~~\nopen {d}"
_BLOCKS = "(1, 'heading', 1, NULL, 1, 1, 'Document {d}'), (2, 'paragraph', 0, NULL, 3, 4, 'In {l}, from' || chr(10) || '{s}.'), (3, 'code', 0, 'sql', 5, 9, '# {d}' || chr(10) || chr(10) || '- no item'), (4, 'list', 2, NULL, 10, 12, '- one {d}' || chr(10) || '  goes on' || chr(10) || '- two'), (5, 'table', 2, NULL, 14, 15, '| a | {l} |' || chr(10) || '|---|---|'), (6, 'quote', 2 - 2, NULL, 16, 17, 'said {s}' || chr(10) || 'twice'), (7, 'rule', 0, NULL, 18, 18, ''), (8, 'heading', 2, NULL, 19, 19, 'End'), (9, 'code', 0, NULL, 20, 21, 'open {d}')"


@query(f"SELECT doc_id, block, kind, level, info, line, end_line, replace(replace(replace(text, '{{d}}', CAST(doc_id AS VARCHAR)), '{{l}}', lang), '{{s}}', source) AS text FROM (SELECT doc_id, lang, source FROM documents), (VALUES {_BLOCKS}) v(block, kind, level, info, line, end_line, text)")
def markdown_blocks(t):
    page = F.lit(PAGE)
    for name, column in (("d", "doc_id"), ("l", "lang"), ("s", "source")):
        page = F.replace(page, F.lit(f"{{{name}}}"), F.col(column).cast("string"))
    return markdown.blocks(t.documents.select("doc_id", page.alias("page")), "doc_id", "page")
