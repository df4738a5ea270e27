"""Roll-ups with ordered, capped evidence; nearest-rank quantiles; totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, key: list[str], order: list[str], keep: list[str], most: int) -> DataFrame:
    """With ``items``, the first ``most`` rows of each key in order. Ranked before they are collected: a hot key never fills a task."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most)
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", *keep))), lambda x: F.struct(*[x[c].alias(c) for c in keep])).alias("items"))


def findings(hits: DataFrame, key: list[str], file: str, line: str, confidence: str, most: int = 25) -> DataFrame:
    """(key, occurrences, files, strongest, evidence): hits rolled up, with the first ``most`` as evidence."""
    totals = hits.groupBy(*key).agg(F.count("*").alias("occurrences"), F.countDistinct(file).alias("files"), F.min(confidence).alias("strongest"))
    return totals.join(capped(hits, key, [file, line], [file, line], most).withColumnRenamed("items", "evidence"), key)


#: Parts into which a sketch divides the values of a key.
STEPS = 200


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column per rank): the values at places (from 0, as functions of n) of each key's sorted numbers.

    A sketch bounds each place, counts below the bounds and of the values between them make it exact: only the few values
    between bounds are sorted, so a key with most of the rows is no task's burden. Nulls are left out.
    """
    own = [F.col(c).alias(f"__b{k}") for k, c in enumerate(by)]
    names = [f"__b{k}" for k in range(len(by))]
    v = rows.select(*own, F.col(value).alias("__v")).where("__v is not null")
    n, slack = F.count("*"), 2 / STEPS
    cuts = "array(" + ", ".join(f"{k / STEPS}D" for k in range(STEPS + 1)) + ")"
    bounds = v.groupBy(*names).agg(n.alias("n"), F.percentile_approx("__v", F.expr(cuts), F.lit(10_000)).alias("__q"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    place = {name: rank(F.col("n")).cast("long") for name, rank in ranks.items()}
    share = lambda p, d: F.col("__q")[F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor(p / F.greatest(F.col("n") - 1, F.lit(1)) * STEPS + d))).cast("int")]
    sides = [F.struct(F.lit(name).alias("name"), p.alias("at"), F.when(p <= F.col("n") * slack, F.col("__lo")).otherwise(share(p, -2)).alias("lo"), F.when(p >= F.col("n") * (1 - slack), F.col("__hi")).otherwise(share(p, 3)).alias("hi")) for name, p in place.items()]
    asked = bounds.select(*names, "n", F.array(*sides).alias("asked"))
    met = v.join(asked, names) if by else v.crossJoin(F.broadcast(asked))  # one row
    each = met.select(*names, "n", "__v", F.explode("asked").alias("a"))
    below = each.groupBy(*names, "n", "a").agg(F.count_if(F.col("__v") < F.col("a.lo")).alias("below"))
    inside = each.where("__v between a.lo and a.hi").groupBy(*names, "n", "a", "__v").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*names, "n", "a").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.join(below, [*names, "n", "a"]).withColumn("upto", F.col("below") + F.sum("m").over(w)).where("upto > a.at")
    picked = reached.groupBy(*names, "n").agg(*[F.min(F.when(F.col("a.name") == name, F.col("__v"))).alias(name) for name in ranks])
    return picked.select(*[F.col(f"__b{k}").alias(c) for k, c in enumerate(by)], "n", *ranks)


def nearest_rank(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """(by, n, q): the value at index round-half-even(p * (n - 1)) of the sorted values."""
    return at_ranks(rows, by, value, {"q": lambda n: F.bround(p * (n - 1))})


def least_median_greatest(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, lo, mid, hi)."""
    half = {"__a": lambda n: F.floor((n - 1) / 2), "__b": lambda n: F.ceil((n - 1) / 2), "lo": lambda n: F.lit(0), "hi": lambda n: n - 1}
    return at_ranks(rows, by, value, half).select(*by, "n", "lo", ((F.col("__a") + F.col("__b")) / 2).alias("mid"), "hi")


def first_mode(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by, value, n): the most frequent value, the first seen on ties."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(seq).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first")
    return counts.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*by, value, "n")


def contingency(rows: DataFrame, by: str, level: str, levels: list[str]) -> DataFrame:
    """Counts of each level as columns, known in advance so that one pass does."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(level) == x).alias(x) for x in levels], F.count("*").alias("total"))


def complexity(decisions: Column, methods: Column, lines: Column) -> tuple[Column, Column]:
    """(cyclomatic complexity per method, decisions per thousand lines)."""
    per = F.when(methods > 0, F.bround((decisions + methods) / methods, 2)).otherwise(0.0)
    return per, F.when(lines > 0, F.bround(decisions * 1000 / lines, 1)).otherwise(0.0)
