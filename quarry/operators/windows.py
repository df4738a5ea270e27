"""Window-like operators: running numbers, spans, capacities, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def unique_suffix(rows: DataFrame, name: str, seq: str, result: str = "unique_name") -> DataFrame:
    """The name itself for its first row, then with -2, -3 and so on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(seq))
    return rows.withColumn(result, F.when(k == 1, F.col(name)).otherwise(F.concat_ws("-", name, k.cast("string"))))


def next_span(rows: DataFrame, by: list[str], line: str, most: int) -> DataFrame:
    """With ``span_end``: the next row's line, ``most`` further at the latest."""
    following = F.lead(line).over(Window.partitionBy(*by).orderBy(line))
    limit = F.col(line) + most
    return rows.withColumn("span_end", F.least(F.coalesce(following, limit), limit))


def running_total(rows: DataFrame, by: list[str], order: list, size: Column, chunk: Column | None = None) -> DataFrame:
    """With ``__end``: the sum of ``size`` over the key's rows up to this one in order.

    With ``chunk``, a number that never falls along the order, each chunk of a key is summed by itself and starts at the
    sum of the chunks before it: no key is one task.
    """
    rows = rows.withColumn("__size", size).withColumn("__chunk", F.lit(0) if chunk is None else chunk)
    up = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__end", F.sum("__size").over(up(*by, "__chunk").orderBy(*order)))
    if chunk is not None:
        whole = rows.groupBy(*by, "__chunk").agg(F.sum("__size").alias("__sum"))
        start = whole.withColumn("__start", F.sum("__sum").over(up(*by).orderBy("__chunk")) - F.col("__sum")).drop("__sum")
        out = out.join(start, [*by, "__chunk"]).withColumn("__end", F.col("__end") + F.col("__start")).drop("__start")
    return out.drop("__size", "__chunk")


def running_slots(rows: DataFrame, by: list[str], order: list, size: str, capacity: float, chunk: Column | None = None) -> DataFrame:
    """With ``first_slot`` and ``last_slot``: where work goes that fills slots of one capacity in order."""
    out = running_total(rows, by, order, F.col(size), chunk)
    return out.withColumn("first_slot", F.floor((F.col("__end") - F.col(size)) / capacity) + 1).withColumn("last_slot", F.greatest(F.col("first_slot"), F.ceil(F.col("__end") / capacity))).drop("__end")


def last_version(used: DataFrame, releases: DataFrame, on: str, version: str, release: str) -> DataFrame:
    """(on, version, latest): each used version with the latest release of its package that is not above it, or null; versions are texts. Releases of one package are few."""
    rows = used.join(releases, on, "left").withColumn("__ok", S.version(F.col(release)) <= S.version(F.col(version)))
    best = F.max_by(F.when(F.col("__ok"), F.col(release)), F.when(F.col("__ok"), S.version(F.col(release))))
    return rows.groupBy(on, version).agg(best.alias("latest"))

