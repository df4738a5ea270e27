"""Nested YAML, overlays and Markdown blocks against plain expectations."""

from quarry.functions import markdown
from quarry.operators import settings as Y


def test_yaml_shapes():
    text = "# c\na:\n  'b': \"x: #1\"  # note\n  c:\n  - 1\n  -\n    d: 2\n    e: 'f # g'\n  - - x\n    - y\nempty:\nz: |\n  l1\n   l2\n\nw: >-\n  p\n  q\nu: https://h/p#q\nbad line\n- stray\n\"q k\": v\n"
    assert [(p, v) for p, v, _ in Y.yaml_rows(text)] == [("a:b", "x: #1"), ("a:c:0", "1"), ("a:c:1:d", "2"), ("a:c:1:e", "f # g"), ("a:c:2:0", "x"), ("a:c:2:1", "y"), ("z", "l1\nl2"), ("w", "p q"), ("u", "https://h/p#q"), ("0", "stray"), ("q k", "v")]
    assert Y.yaml_rows(None) == Y.yaml_rows("") == Y.yaml_rows("---\n...\n# x") == []


def test_yaml_lists_of_maps_end_where_they_should():
    assert [(p, v) for p, v, _ in Y.yaml_rows("s:\n  - a: 1\n    b:\n      c: 2\n  - a: 3\nt: 4")] == [("s:0:a", "1"), ("s:0:b:c", "2"), ("s:1:a", "3"), ("t", "4")]
    assert len(Y.yaml_rows("a:\n" * 1 + "".join(" " * k + f"k{k}:\n" for k in range(1, 400)) + " " * 400 + "v: 1")) == 1


def test_overlay(spark):
    rows = [("x", None, "A:b", "1", 1), ("x", None, "a:B", "2", 2), ("x", "prod", "a:b", "3", 1), ("x", "dev", "n", None, 1), ("y", None, "k", "v", 1), ("z", "prod", "k", "v", 1)]
    df = spark.createDataFrame(rows, "app string, env string, path string, value string, line int")
    got = {tuple(r) for r in Y.overlay(df, "app", "env", "path", "value", "line").collect()}
    assert got == {("x", "prod", "a:b", "3", True), ("x", "dev", "a:B", "2", False), ("x", "dev", "n", None, True), ("y", None, "k", "v", False), ("z", "prod", "k", "v", True)}


def test_targets(spark):
    rows = [("https://a.example.com:8/x",), ("db.corp.example.com:5432",), ("Server=x;Database=y",), (r"C:\logs\a.txt",), ("/var/log/x",), ("10.0.0.1",), ("retry",), ("3",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "v string").select(Y.target_class(__import__("pyspark").sql.functions.col("v"))).collect()] == ["url", "host", "connection", "file", "file", "host", "none", "none", "none"]


def test_markdown(spark):
    texts = [(1, "a\nb\n# H\n- x\n\ty\n1. z\n\n    code\n```\nopen"), (2, None), (3, ""), (4, "~~~~ sql x\n```\n~~~\n~~~~~\n---\n#nohead\n|t|\r\n|-|\r\n\r\n>q\n> r")]
    got = {}
    for r in markdown.blocks(spark.createDataFrame(texts, "id int, page string"), "id", "page").orderBy("id", "block").collect():
        got.setdefault(r["id"], []).append((r["kind"], r["level"], r["info"], r["line"], r["end_line"], r["text"]))
    assert got == {
        1: [("paragraph", 0, None, 1, 2, "a\nb"), ("heading", 1, None, 3, 3, "H"), ("list", 2, None, 4, 6, "- x\n\ty\n1. z"), ("paragraph", 0, None, 8, 8, "    code"), ("code", 0, None, 9, 10, "open")],
        4: [("code", 0, "sql", 1, 4, "```\n~~~"), ("rule", 0, None, 5, 5, ""), ("paragraph", 0, None, 6, 6, "#nohead"), ("table", 2, None, 7, 8, "|t|\n|-|"), ("quote", 0, None, 10, 11, "q\nr")],
    }
