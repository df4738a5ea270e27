"""Roll-ups of addresses, callers, call sites, diagnostics, review findings and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

_IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


def is_public(ip: Column) -> Column:
    """Whether a text is an IPv4 address that is neither private nor of this machine, its link, a group or nobody."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(F.length(p) <= 3, p.cast("int")).otherwise(999))
    own = F.element_at(parts, 1)
    reserved = own.isin(0, 127) | (own >= 224) | ip.startswith("169.254.")
    return F.forall(parts, lambda p: p <= 255) & ~S.private_ip(ip) & ~reserved


def public_ips(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(ip, docs, n, first): each public address with the number of its texts and places, and the smallest key; texts are counted where they are before they meet."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(_IP), 0)).alias("ip")).where(is_public(F.col("ip")))
    each = found.groupBy("ip", key).agg(F.count("*").alias("n"))
    return each.groupBy("ip").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min(key).alias("first"))


def class_usage(calls: DataFrame, owner: DataFrame) -> DataFrame:
    """(class, member, callers, files): how many different members of other classes call each member, and from how many files.

    ``calls`` is (caller, callee, file), ``owner`` (member, class). Callers without a class are outside all; callees without one are left out.
    """
    to = calls.join(owner.select(F.col("member").alias("callee"), F.col("class")), "callee")
    both = to.join(owner.select(F.col("member").alias("caller"), F.col("class").alias("__from")), "caller", "left")
    outside = both.where(~F.col("__from").eqNullSafe(F.col("class")))
    return outside.groupBy("class", F.col("callee").alias("member")).agg(F.countDistinct("caller").alias("callers"), F.countDistinct("file").alias("files"))


def call_sites(sites: DataFrame, name: str, *sets: str) -> DataFrame:
    """(name, sites, <sets>): how many call sites each object has, and the sorted values of some columns there."""
    return sites.groupBy(name).agg(F.count("*").alias("sites"), *[F.array_sort(F.collect_set(c)).alias(c) for c in sets])


def diagnostics(rows: DataFrame, code: str, *place: str) -> DataFrame:
    """(code, n): diagnostics by code; one that is reported more often at the same place counts once."""
    return rows.select(code, *place).distinct().groupBy(code).agg(F.count("*").alias("n"))


def review_axes(findings: DataFrame, axis: str, level: str, title: str, order: list[str]) -> DataFrame:
    """(axis, n, n_<level>..., worst, worst_level): findings of each axis by level, and the title of its worst one, the first by title among equals.

    Levels outside ``order`` come after all others and are counted in n alone. Axes are not ranked against each other.
    """
    rank = F.coalesce(*[F.when(F.col(level) == x, k) for k, x in enumerate(order)], F.lit(len(order)))
    worst = F.min(F.struct(rank.alias("rank"), F.col(title).alias("title"), F.col(level).alias("level")))
    out = findings.groupBy(axis).agg(F.count("*").alias("n"), *[F.count_if(F.col(level) == x).alias(f"n_{x}") for x in order], worst.alias("w"))
    return out.select(axis, "n", *[f"n_{x}" for x in order], F.col("w.title").alias("worst"), F.col("w.level").alias("worst_level"))


def check_buckets(checks: DataFrame, name: str, state: str, buckets: dict[str, list[str]], most: int = 20) -> DataFrame:
    """(bucket, checks, names): checks by what their state amounts to (``other`` for states in no bucket), with the first ``most`` names in order."""
    bucket = F.lit("other")
    for key, states in buckets.items():
        bucket = F.when(F.lower(state).isin([s.lower() for s in states]), key).otherwise(bucket)
    rows = checks.select(bucket.alias("bucket"), F.col(name).alias("name"))
    first = rows.distinct().withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("name"))).where(F.col("k") <= most).groupBy("bucket").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return rows.groupBy("bucket").agg(F.count("*").alias("checks")).join(first, "bucket")
