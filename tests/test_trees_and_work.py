"""Vendored files and rule-table estimates on small cases."""

from quarry.operators import vendored as V
from quarry.operators import workitems as W
from quarry.operators.workitems import Part


def test_vendored_cases(spark):
    rows = [
        ("Scripts/jquery-3.4.1.min.js", "x"), ("Scripts/app.js", "var a"), ("Scripts/app.intellisense.js", "x"), ("vendor/a.cs", "x"), ("web/vendors-own.js", "x"), ("a.js", "/*! lib */"), ("README.md", "/*! no asset */"),
        ("Scripts/plug/a.js", "/*! a */"), ("Scripts/plug/a.min.js", "x"), ("Scripts/plug/b.js", "/* @license MIT */"), ("Scripts/plug/c.js", "own?"), ("Scripts/plug/deep/d.css", "x"), ("Scripts/plug/deep/e.css", None),
        ("Scripts/mine/a.js", "/*! a */"), ("Scripts/mine/b.js", "x"), ("Scripts/mine/c.js", "x"), ("lib/kit-1.2.0/sub/x.js", "/*! k */"), ("lib/kit-1.2.0/y.css", "z"), ("lib/kit-1.2.0/readme.txt", "z"), ("other/kit-1.2.0/y.css", "z"), ("nifty/nifty.css", "/*! n */"), ("nifty/nifty-icons.css", "x"), ("nifty/else.css", "x"),
    ]
    df = spark.createDataFrame(rows, "path string, head string")
    got = {r["path"]: r["why"] for r in V.vendored(df, spark.createDataFrame([("jQuery",), ("",), (None,)], "package string")).collect()}
    assert got == {
        "Scripts/jquery-3.4.1.min.js": "package", "Scripts/app.intellisense.js": "tooling", "vendor/a.cs": "folder", "a.js": "banner", "Scripts/plug/a.js": "banner", "Scripts/plug/a.min.js": "sibling", "Scripts/plug/b.js": "banner",
        "Scripts/plug/c.js": "library", "Scripts/plug/deep/d.css": "library", "Scripts/plug/deep/e.css": "library", "Scripts/mine/a.js": "banner", "lib/kit-1.2.0/sub/x.js": "banner", "lib/kit-1.2.0/y.css": "library", "lib/kit-1.2.0/readme.txt": "library", "nifty/nifty.css": "banner", "nifty/nifty-icons.css": "sibling",
    }
    assert V.vendored(df.limit(0), spark.createDataFrame([("jQuery",)], "package string")).collect() == []


def test_under_compares_whole_names(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/bc/d",), ("A/B",), ("x",), (None,)], "path string")
    folders = spark.createDataFrame([("a/b/",), ("X",), ("",), (None,)], "folder string")
    assert {r[0] for r in V.under(df, "path", folders, "folder").collect()} == {"a/b/c", "A/B", "x"}


def test_work_items_and_totals(spark):
    facts = spark.createDataFrame([("p", 2, 0, None), ("q", 0, 3, 5), ("r", 0, 0, 0)], "k string, a int, b int, c int")
    parts = [Part("s1", "i1", "a", "a", 1, 2), Part("s1", "i1", "b", "b * 2", 0.5, 1), Part("s2", "i2", "c", "c", 2, 4, "b > 0"), Part("s2", "i3", "one", "1", 8, 16, "a > 1")]
    items = W.work_items(facts, "k", parts)
    assert {tuple(r) for r in items.collect()} == {("p", "s1", "i1", "a", 2.0, 2.0, 4.0), ("p", "s2", "i3", "one", 1.0, 8.0, 16.0), ("q", "s1", "i1", "b", 6.0, 3.0, 6.0), ("q", "s2", "i2", "c", 5.0, 10.0, 20.0)}
    assert {tuple(r) for r in W.totals(items, "k", {"s2": 0.5}).collect()} == {("p", "s1", 1, 2.0, 4.0), ("p", "s2", 1, 4.0, 8.0), ("p", None, 2, 6.0, 12.0), ("q", "s1", 1, 3.0, 6.0), ("q", "s2", 1, 5.0, 10.0), ("q", None, 2, 8.0, 16.0)}


def test_bands(spark):
    df = spark.createDataFrame([("x", 10), ("x", 11), ("x", 99), ("y", None)], "k string, v int")
    assert {tuple(r) for r in W.size_counts(df, "k", "v", [(10, "s"), (20, "m")], "l").collect()} == {("x", 1, 1, 1), ("y", 0, 0, 0)}


def test_databases_without_constructs_or_objects(spark):
    objects = spark.createDataFrame([("a", "V", 10), ("a", "T", 300)], "g string, kind string, lines int")
    constructs = spark.createDataFrame([("b", "cursor", 2), ("b", "odd", 9)], "g string, construct string, n int")
    prices = spark.createDataFrame([("T", "large", 3.0, 4.0)], "kind string, size string, low double, high double")
    levels = spark.createDataFrame([("cursor", "redesign", 1.0, 2.0)], "construct string, level string, low double, high double")
    got = {r["g"]: (r["low"], r["high"], r["objects_low"], r["redesign_high"]) for r in W.database_hours(objects, constructs, prices, levels, "g", 0.5, 0.75).collect()}
    assert got == {"a": (1.6, 2.4, 3.25, 0.0), "b": (1.5, 3.0, 0.0, 4.0)}
