"""Roll-ups on small cases with ties, nulls and nothing at all."""

from pyspark.sql import functions as F

from quarry.operators import rollups as U


def test_public_addresses(spark):
    ips = ["8.8.8.8", "10.0.0.1", "172.15.0.1", "172.16.0.1", "192.168.1.1", "169.254.0.1", "127.0.0.1", "0.1.2.3", "224.0.0.1", "256.1.1.1", "1.1.1.1000", "255.255.255.255", "223.255.255.255"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ips], "ip string").select(U.is_public(F.col("ip"))).collect()]
    assert [x for x, ok in zip(ips, got, strict=True) if ok] == ["8.8.8.8", "172.15.0.1", "223.255.255.255"]
    df = spark.createDataFrame([(2, "8.8.8.8 8.8.8.8"), (1, "x 8.8.8.8"), (3, None), (4, "")], "id int, t string")
    assert [tuple(r) for r in U.public_ips(df, "id", "t").collect()] == [("8.8.8.8", 2, 3, 1)]


def test_callers_outside_the_class(spark):
    calls = spark.createDataFrame([("a", "m", "f1"), ("a", "m", "f2"), ("b", "m", "f1"), ("z", "m", "f3"), ("a", "lost", "f1")], "caller string, callee string, file string")
    owner = spark.createDataFrame([("a", "A"), ("b", "M"), ("m", "M")], "member string, class string")
    assert [tuple(r) for r in U.class_usage(calls, owner).collect()] == [("M", "m", 2, 3)]


def test_worst_finding_of_an_axis(spark):
    df = spark.createDataFrame([("x", "low", "b"), ("x", "high", "z"), ("x", "high", "c"), ("y", None, "q"), ("y", "odd", "p")], "axis string, level string, title string")
    assert {tuple(r) for r in U.review_axes(df, "axis", "level", "title", ["high", "low"]).collect()} == {("x", 3, 2, 1, "c", "high"), ("y", 2, 0, 0, "p", "odd")}


def test_buckets(spark):
    df = spark.createDataFrame([("b", "OK"), ("a", "ok"), ("a", "ok"), ("c", None), ("d", "Err")], "name string, state string")
    assert {(r[0], r[1], tuple(r[2])) for r in U.check_buckets(df, "name", "state", {"good": ["ok"], "bad": ["err"]}, most=1).collect()} == {("good", 3, ("a",)), ("other", 1, ("c",)), ("bad", 1, ("d",))}
    assert U.check_buckets(df.limit(0), "name", "state", {"good": ["ok"]}).collect() == []
