"""Joins beyond equality: as-of, interval, band, prefix, prioritised and reconciling joins."""


import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str], prefix: str, forward: bool = False, within: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (forward: the first at or after it) of the same ``by``.

    A union and one window: rows are shuffled once by key, and nothing is multiplied. A null key or time matches nothing.
    With ``chunk``, a number that grows with ``at``, a key's rows are spread over its chunks, and what an earlier chunk
    (forward: a later one) ends with is carried into those after it: no key is one task.
    """
    right = right.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    v = F.struct(F.col(at).alias("t"), *[F.col(c) for c in value])
    kinds = lambda d, c: d.select(c.alias("c")).schema[0].dataType
    part = F.lit(0) if chunk is None else chunk
    rows = left.select(by, at, part.alias("chunk"), F.struct(*left.columns).alias("l"), F.lit(None).cast(kinds(right, v)).alias("v"), F.lit(0 if forward else 1).alias("side")).union(
        right.select(by, at, part, F.lit(None).cast(kinds(left, F.struct(*left.columns))), v, F.lit(1 if forward else 0))
    )
    order = Window.partitionBy(by, "chunk").orderBy(F.col(at), F.col("side"))
    if forward:
        found = F.first("v", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    else:
        found = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("f", found).where(F.col("l").isNotNull())
    if chunk is not None:
        edge = right.select(by, part.alias("chunk"), v.alias("v")).groupBy(by, "chunk").agg((F.min_by if forward else F.max_by)("v", "v.t").alias("v"))
        asked = left.select(by, part.alias("chunk")).distinct().join(edge, [by, "chunk"], "left")
        asked = asked.unionByName(edge.join(asked.select(by, "chunk"), [by, "chunk"], "left_anti"))
        w = Window.partitionBy(by).orderBy("chunk")
        carried = F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.join(asked.select(by, "chunk", carried.alias("carried")), [by, "chunk"], "left").withColumn("f", F.coalesce("f", "carried"))
    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    out = out.withColumn("f", F.when(known if within is None else known & within, F.col("f")))
    return out.select("l.*", *[F.col(f"f.{c}").alias(f"{prefix}{c}") for c in ["t", *value]])


def interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, low: str, high: str, bucket: float) -> DataFrame:
    """Points inside [low, high) of the same key. Spans are listed for each bucket that they touch, so the join has an equal key."""
    cell = lambda c: F.floor(c / bucket)
    cut = spans.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    joined = points.withColumn("__cell", cell(F.col(at))).join(cut, [*by, "__cell"])
    return joined.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("__cell")


def band(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, span: float) -> DataFrame:
    """Pairs of the same key with ``other`` within ``span`` of ``at``: each left row meets its own bucket and the two beside it."""
    cell = lambda c: F.floor(c / (2 * span))
    sides = F.explode(F.array_distinct(F.array(cell(F.col(at) - span), cell(F.col(at) + span))))
    joined = left.withColumn("__cell", sides).join(right.withColumn("__cell", cell(F.col(other))), [*by, "__cell"])
    return joined.where(F.abs(F.col(at) - F.col(other)) <= span).drop("__cell")


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str, keep: list[str], separator: str = "/") -> DataFrame:
    """Each row with the longest prefix that is a whole part of its path; an empty prefix never matches.

    Each distinct path is looked up once; repeated rows stay, and a null path has no prefix.
    """
    parts = F.split(F.col("__path"), separator)
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), separator))
    paths = rows.select(F.col(path).alias("__path")).where("__path is not null").distinct()
    dim = prefixes.where(F.col(prefix) != "").select(F.col(prefix).alias("__prefix"), F.struct(F.length(prefix).alias("n"), F.col(prefix), *[c for c in keep]).alias("__dim"))
    best = paths.withColumn("__prefix", F.explode(every)).join(dim, "__prefix").groupBy("__path").agg(F.max_by("__dim", "__dim.n").alias("__dim"))
    return rows.join(best, F.col(path) == F.col("__path"), "left").select(*rows.columns, f"__dim.{prefix}", *[f"__dim.{c}" for c in keep])


def override(rows: DataFrame, reviews: DataFrame, on: str, columns: list[str], verdict: str | None = None, dismissed: str = "dismissed") -> DataFrame:
    """Left join whose right values win where they are there; dismissed rows go."""
    right = reviews.select(on, *[F.col(c).alias(f"__{c}") for c in columns], *([F.col(verdict).alias("__v")] if verdict else []))
    joined = rows.join(right, on, "left")
    if verdict:
        joined = joined.where(F.coalesce(F.col("__v") != dismissed, F.lit(True))).drop("__v")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def prioritised(rows: DataFrame, lookups: list[tuple[DataFrame, str, str]], result: str) -> DataFrame:
    """(rows, result, matched_by): the first lookup (table, row column, name) that has the row's value. Tables are (key, value), keys unique."""
    out, found, names = rows, [], []
    for k, (dim, column, name) in enumerate(lookups):
        out = out.join(dim.toDF(f"__k{k}", f"__v{k}"), F.col(column) == F.col(f"__k{k}"), "left")
        found.append(F.col(f"__v{k}"))
        names.append(F.when(F.col(f"__v{k}").isNotNull(), name))
    return out.select(*rows.columns, F.coalesce(*found).alias(result), F.coalesce(*names, F.lit("none")).alias("matched_by"))


def unique_keys(dim: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that name one value only."""
    return dim.groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n")).where("__n = 1").drop("__n")


def reconcile(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(on, status): both, a_only or b_only."""
    left, right = a.select(on).distinct().withColumn("a", F.lit(True)), b.select(on).distinct().withColumn("b", F.lit(True))
    status = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a_only").otherwise("b_only")
    return left.join(right, on, "full_outer").select(on, status.alias("status"))


def regex_dimension(rows: DataFrame, column: str, cases: list[tuple[str, str]], result: str, fallback: str) -> DataFrame:
    """The result of the first pattern that the value matches; the cases are a hand-written catalogue."""
    out = F.lit(fallback)
    for pattern, name in reversed(cases):
        out = F.when(F.col(column).rlike(pattern), name).otherwise(out)
    return rows.withColumn(result, out)


def route_match(calls: DataFrame, routes: DataFrame, segments: str, template: str) -> DataFrame:
    """Calls with the routes that have as many segments, each equal or a parameter (``*``) on either side."""
    n = lambda c: F.size(F.col(c))
    joined = calls.withColumn("__n", n(segments)).join(routes.withColumn("__n", n(template)), "__n")
    same = F.forall(F.zip_with(segments, template, lambda a, b: (a == b) | (a == "*") | (b == "*")), lambda x: x)
    return joined.where(same).drop("__n")


def similar(left: DataFrame, right: DataFrame, name: str, other: str, cutoff: float = 0.7, most: int = 3) -> DataFrame:
    """(name, other, ratio, rank): up to ``most`` closest names by the matching-blocks ratio.

    The ratio is at most that of the letters both have, so two names that reach the cut-off share one of each one's
    first letters in any fixed order, as many as its length leaves after the share that must agree (a prefix
    filter on multisets of letters, in which the third a is a letter of its own). Pairs meet there and nowhere else, and none is lost.
    Null names match nothing.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)])

    def letters(c: str) -> Column:
        at = F.filter(F.split(F.col(c), ""), lambda x: x != "")
        return F.transform(at, lambda x, k: F.concat(F.lpad(F.size(F.filter(F.slice(at, 1, k + 1), lambda y: y == x)).cast("string"), 6, "0"), x))

    def first(c: str) -> Column:
        n = F.length(c)
        reach = n - F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9) + 1
        rare = F.reverse(F.array_sort("__letters"))  # later repeats first: they are rare
        return F.explode(F.when(n == 0, F.array(F.lit(""))).otherwise(F.slice(rare, 1, F.least(n, reach).cast("int"))))

    a, b = (d.select(c).where(F.col(c).isNotNull()).distinct().withColumn("__letters", letters(c)).withColumn("__p", first(c)) for d, c in ((left, name), (right, other)))
    met = a.join(b.withColumnRenamed("__letters", "__others"), "__p").drop("__p").where(2 * F.least(F.length(name), F.length(other)) >= cutoff * (F.length(name) + F.length(other)) - 1e-9)
    shared = F.size(F.array_intersect("__letters", "__others"))
    met = met.where((2 * shared >= cutoff * (F.length(name) + F.length(other)) - 1e-9)).select(name, other).distinct()
    scored = met.withColumn("ratio", ratio(name, other)).where(F.col("ratio") >= cutoff)
    best = Window.partitionBy(name).orderBy(F.desc("ratio"), F.desc(other))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def shared_writers(rows: DataFrame, item: str, writer: str, least: int = 2) -> DataFrame:
    """(item, writers, names): items that several writers touch."""
    found = rows.select(item, writer).where(F.col(writer).isNotNull()).distinct().groupBy(item).agg(F.count("*").alias("writers"), F.array_sort(F.collect_list(writer)).alias("names"))
    return found.where(F.col("writers") >= least)
