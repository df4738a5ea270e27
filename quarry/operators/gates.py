"""Quality gates: assertions over tables as rows of (gate, passed, offenders)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_rows(name: str, offenders: DataFrame) -> DataFrame:
    return offenders.agg(F.count("*").alias("offenders")).select(F.lit(name).alias("gate"), (F.col("offenders") == 0).alias("passed"), "offenders")


def every(name: str, rows: DataFrame, holds: Column) -> DataFrame:
    return no_rows(name, rows.where(~F.coalesce(holds, F.lit(False))))


def covered(name: str, rows: DataFrame, by: DataFrame, on: list[str], of: list[str]) -> DataFrame:
    """Every row has a partner."""
    match = reduce(lambda a, b: a & b, [rows[a] == by[b] for a, b in zip(on, of, strict=True)])
    return no_rows(name, rows.join(by, match, "left_anti"))


def unique(name: str, rows: DataFrame, key: list[str]) -> DataFrame:
    return no_rows(name, rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))


def report(*gates: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), gates)


def against_baseline(gates: DataFrame, baseline: DataFrame) -> DataFrame:
    """(gate, passed, was, change)."""
    joined = gates.join(baseline.select("gate", F.col("passed").alias("was")), "gate", "left")
    change = F.when(F.col("was").isNull(), "new").when(F.col("was") & ~F.col("passed"), "broken").when(~F.col("was") & F.col("passed"), "fixed").otherwise("same")
    return joined.select("gate", "passed", "was", change.alias("change"))
