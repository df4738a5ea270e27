"""Estimates from rule tables: work items whose quantities are expressions over facts, sizes by bands, conversion and database hours.

A rule table is small and written by hand; it becomes part of the plan, and all items of all projects are one projection and one explode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A part of a work item: ``quantity`` and ``when`` are SQL expressions over the columns of the facts, ``low`` and ``high`` hours for each unit."""

    stage: str
    item: str
    unit: str
    quantity: str
    low: float
    high: float
    when: str = "true"


def band(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first bound that the value does not exceed, else ``last``; null for null."""
    out = F.lit(last)
    for limit, name in reversed(bounds):
        out = F.when(value <= limit, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def size_counts(rows: DataFrame, key: str, value: str, bounds: list[tuple[float, str]], last: str) -> DataFrame:
    """(key, n_<size>...): how many rows of each key fall into each T-shirt size; sizes without rows are 0."""
    names = [name for _, name in bounds] + [last]
    size = band(F.col(value), bounds, last)
    return rows.groupBy(key).agg(*[F.count_if(size == name).alias(f"n_{name}") for name in names])


def work_items(facts: DataFrame, key: str, parts: list[Part]) -> DataFrame:
    """(key, stage, item, unit, quantity, low, high): the parts with a quantity; those of 0 or null describe what a project does not have and are left out."""
    each = [F.struct(F.lit(p.stage).alias("stage"), F.lit(p.item).alias("item"), F.lit(p.unit).alias("unit"), F.when(F.expr(p.when), F.expr(p.quantity)).cast("double").alias("quantity"), F.lit(float(p.low)).alias("a"), F.lit(float(p.high)).alias("b")) for p in parts]
    rows = facts.select(key, F.explode(F.array(*each)).alias("p")).select(key, "p.*").where("quantity > 0")
    return rows.select(key, "stage", "item", "unit", "quantity", (F.col("quantity") * F.col("a")).alias("low"), (F.col("quantity") * F.col("b")).alias("high"))


def totals(items: DataFrame, key: str, factors: dict[str, float] | None = None) -> DataFrame:
    """(key, stage, items, low, high): hours of each stage and, under a null stage, of all, after ``factors`` for stages, rounded to a hundredth."""
    factor = F.lit(1.0)
    for stage, x in (factors or {}).items():
        factor = F.when(F.col("stage") == stage, x).otherwise(factor)
    rows = items.withColumn("__f", factor)
    out = rows.rollup(key, "stage").agg(F.countDistinct("item").alias("items"), F.round(F.sum(F.col("low") * F.col("__f")), 2).alias("low"), F.round(F.sum(F.col("high") * F.col("__f")), 2).alias("high"), F.grouping(key).alias("__all"))
    return out.where("__all = 0").drop("__all")


def conversion_hours(projects: DataFrame, rates: DataFrame, key: str, kind: str, code: str, markup: str, ui: str, factor: str) -> DataFrame:
    """(key, low, high, redesign_low, redesign_high) of porting projects.

    ``rates`` (kind, rate_low, rate_high, fixed_low, fixed_high, markup_low, markup_high, rest_kind, redesign) are hours for each thousand lines; the kind ``unknown``
    is for kinds that have none. Where a kind has a ``rest_kind`` and the project's lines of interface code are known, only these and the markup
    go by the kind's own rate, and the rest by that of ``rest_kind``. The redesign part is the interface's then, else all of it for kinds marked so.
    """
    own = F.broadcast(rates)  # a price list
    known = projects.join(F.broadcast(rates.select(F.col("kind").alias(kind), F.lit(True).alias("__known"))), kind, "left")
    rows = known.withColumn("__kind", F.when(F.col("__known"), F.col(kind)).otherwise("unknown")).join(own.withColumnRenamed("kind", "__kind"), "__kind")
    rest = rates.select(F.col("kind").alias("rest_kind"), F.col("rate_low").alias("rest_low"), F.col("rate_high").alias("rest_high"))
    rows = rows.join(F.broadcast(rest), "rest_kind", "left")
    k = lambda c: F.coalesce(F.col(c), F.lit(0)) / 1000.0
    split = F.col("rest_low").isNotNull() & F.col(ui).isNotNull()
    shown = F.when(split, F.least(k(ui), k(code))).otherwise(k(code))
    front = [(F.col(f"rate_{x}") * shown + F.col(f"markup_{x}") * k(markup)) * F.col(factor) for x in ("low", "high")]
    back = [(F.col(f"fixed_{x}") + F.when(split, F.col(f"rest_{x}") * (k(code) - shown)).otherwise(0.0)) * F.col(factor) for x in ("low", "high")]
    anew = [F.when(split, f).when(F.col("redesign"), f + b).otherwise(0.0) for f, b in zip(front, back, strict=True)]
    one = lambda c: F.round(c, 1)
    return rows.select(key, one(front[0] + back[0]).alias("low"), one(front[1] + back[1]).alias("high"), one(anew[0]).alias("redesign_low"), one(anew[1]).alias("redesign_high"))


def database_hours(objects: DataFrame, constructs: DataFrame, object_prices: DataFrame, construct_prices: DataFrame, key: str, mechanical: float, redesign: float, bounds=((50, "small"), (200, "medium")), other=(0.25, 0.75)) -> DataFrame:
    """(key, objects_low, objects_high, constructs_low, constructs_high, redesign_low, redesign_high, low, high) of moving databases to another engine.

    ``objects`` (key, kind, lines) are priced by kind and size (``object_prices``: kind, size, low, high; a null size is for all sizes), kinds without a price by ``other``;
    ``constructs`` (key, construct, n) by ``construct_prices`` (construct, level, low, high), those without a price as nothing. What is of the level redesign
    takes the factor ``redesign``, all else ``mechanical``.
    """
    sized = objects.withColumn("size", band(F.col("lines"), list(bounds), "large"))
    prices = F.broadcast(object_prices.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("size", F.lit("*")), F.struct("low", "high")))).alias("prices")))
    price = F.coalesce(F.try_element_at("prices", F.col("size")), F.try_element_at("prices", F.lit("*")), F.struct(F.lit(float(other[0])).alias("low"), F.lit(float(other[1])).alias("high")))
    a = sized.join(prices, "kind", "left").select(key, price.alias("p")).groupBy(key).agg(F.sum("p.low").alias("objects_low"), F.sum("p.high").alias("objects_high"))
    priced = constructs.join(F.broadcast(construct_prices), "construct")
    hours = lambda c, level=None: F.sum(F.when(F.col("level") == level if level else F.lit(True), F.col("n") * F.col(c)).otherwise(0.0))
    b = priced.groupBy(key).agg(hours("low").alias("constructs_low"), hours("high").alias("constructs_high"), hours("low", "redesign").alias("redesign_low"), hours("high", "redesign").alias("redesign_high"))
    out = a.join(b, key, "full_outer").na.fill(0.0)
    total = [F.round((F.col(f"objects_{x}") + F.col(f"constructs_{x}") - F.col(f"redesign_{x}")) * mechanical + F.col(f"redesign_{x}") * redesign, 1).alias(x) for x in ("low", "high")]
    return out.select(key, *[F.round(c, 2).alias(c) for c in out.columns if c != key], *total)
