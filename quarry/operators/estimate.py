"""Pricing, allocation, extrapolation and simulation of effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import triangular_inverse
from quarry.operators.aggregates import at_ranks, least_median_greatest
from quarry.session import written


def finding_hours(occurrences: Column, fixed: Column, per: Column, cap: Column) -> Column:
    """A fixed part and one for each further occurrence, up to a cap that is never below the fixed part."""
    return F.when(occurrences <= 0, 0.0).otherwise(F.least(fixed + per * (occurrences - 1), F.greatest(cap, fixed)))


def scale(kloc: Column, base: float = 10.0, power: float = 0.1) -> Column:
    """Diseconomy of scale: never below 1."""
    return F.greatest(F.lit(1.0), F.pow(kloc / base, F.lit(power)))


def allocate(rows: DataFrame, by: list[str], weight: str, total: str) -> DataFrame:
    """With ``share``: the total of each key in proportion to the weights; equal parts if all are 0."""
    w = Window.partitionBy(*by)
    whole = F.sum(weight).over(w)
    part = F.when(whole > 0, F.col(weight) / whole).otherwise(F.lit(1.0) / F.count("*").over(w))
    return rows.withColumn("share", F.col(total) * part)


def extrapolate(sampled: DataFrame, others: DataFrame, by: str, value: str) -> DataFrame:
    """Each unsampled row with its group's least, median and greatest value; without peers, those of all widened to half and double."""
    peers = least_median_greatest(sampled, [by], value).select(by, "lo", "mid", "hi")
    every = least_median_greatest(sampled, [], value).select((F.col("lo") * 0.5).alias("alo"), F.col("mid").alias("amid"), (F.col("hi") * 2).alias("ahi"))
    out = others.join(peers, by, "left").crossJoin(F.broadcast(every))  # one row
    return out.select(*others.columns, F.coalesce("lo", "alo").alias("lo"), F.coalesce("mid", "amid").alias("mid"), F.coalesce("hi", "ahi").alias("hi"), F.col("lo").isNotNull().alias("has_peers"))


def uniform(*parts) -> Column:
    """A number in (0, 1) from a hash: the same for the same parts, wherever it is computed."""
    return (F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal_cdf(z: Column) -> Column:
    """Phi by a rational approximation, off by 7.5e-8 at most."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, "u"))) * F.cos(6.283185307179586 * uniform(*parts, "v"))


def simulate(items: DataFrame, package: str, iterations: int = 4000, rho: float = 0.3, seed: int = 20261006) -> DataFrame:
    """(package, iteration, hours): sums of triangular items (item, lo, mode, hi) whose draws share a normal factor in each iteration."""
    draws = items.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    z = F.sqrt(F.lit(rho)) * normal(seed, F.col("iteration")) + F.sqrt(F.lit(1 - rho)) * normal(seed, F.col("iteration"), F.col("item"))
    hours = triangular_inverse(normal_cdf(z), F.col("lo"), F.col("hi"), F.col("mode"))
    return draws.groupBy(package, "iteration").agg(F.sum(hours).alias("hours"))


def rollup(simulated: DataFrame, package: str) -> DataFrame:
    """(package, p10, p50, p80, p90) by nearest rank, from one pass over the simulation."""
    share = lambda p: lambda n: F.bround(p * (n - 1))
    return at_ranks(written(simulated), [package], "hours", {f"p{round(p * 100)}": share(p) for p in (0.1, 0.5, 0.8, 0.9)}).drop("n")


def priced(counts: DataFrame, key: str, drivers: list[str], rates: DataFrame) -> DataFrame:
    """(key, lo, hi, total): counts of drivers times their rates (driver, lo, hi), ends rounded up to half hours."""
    long = counts.unpivot(key, drivers, "driver", "count").where(F.col("count") > 0)
    sums = long.join(F.broadcast(rates), "driver").groupBy(key).agg(F.sum(F.col("count") * F.col("lo")).alias("lo"), F.sum(F.col("count") * F.col("hi")).alias("hi"))
    up = lambda c: F.ceil(F.col(c) * 2 - 1e-9) / 2
    return sums.select(key, up("lo").alias("lo"), up("hi").alias("hi"), ((up("lo") + up("hi")) / 2).alias("total"))


def contingency(total: Column, share: Column, most: Column) -> Column:
    """A share on top, of a bounded amount."""
    return total + F.least(total * share, most)


def size_band_hours(rows: DataFrame, key: str, lines: str, bands: list[tuple[int, float]], beyond: float) -> DataFrame:
    """(key, items, hours): items priced by the first band of lines that they fit."""
    price = F.lit(beyond)
    for limit, hours in reversed(bands):
        price = F.when(F.col(lines) <= limit, hours).otherwise(price)
    return rows.groupBy(key).agg(F.count("*").alias("items"), F.sum(price).alias("hours"))
