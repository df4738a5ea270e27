"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id), so equal texts lie together. Keys
sampled with chances in proportion to their sizes give quantile boundaries that
cut the order into many ranges; a range that turns out overfull is cut
again at boundaries sampled from its own rows. Shards are runs of ranges with
equal shares of the bytes: exact sums of the ranges and a running sum inside each
range place every row. A group of equal texts stays in one shard; only one of more than
HOT of a shard may be subdivided and go on in the next.

A null text has size 1, as an empty one has. Rows with equal text and id (repeated rows, null ids) have the
same key and are told apart by no column; each still gets its own slot. An
empty table gives an empty table.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.store import new_path, stored

#: Ranges: one for this many bytes, within these limits. The driver holds one row for each.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 256, 16_384
#: Sampled keys for each range.
PER_RANGE = 16
#: A range with this many times its share is subdivided.
OVERFULL = 2.0
#: A group of equal texts is spread if it has more than this part of a shard.
HOT = 1 / 32
LOWEST = -(1 << 63)


def _sampled(rows: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int, int]]:
    """About ``wanted`` (hash, id, weight), each row with a chance in proportion to its size. The same rows for the same table."""
    share = max(1, total // wanted)
    draw = F.pmod(F.xxhash64("h", "id", F.lit(seed)), F.lit(share))
    return [tuple(r) for r in rows.where(draw < F.col("size")).select("h", "id", F.greatest("size", F.lit(share))).collect()]


def _quantiles(sample: list[tuple[int, int, int]], parts: int, whole_groups: bool) -> list[tuple[int, int]]:
    """Keys that cut the sample's weight into ``parts``."""
    sample = sorted(sample)
    goal, seen, found = sum(w for _, _, w in sample) / parts, 0, []
    for h, i, w in sample:
        if seen >= goal * (len(found) + 1):
            key = (h, LOWEST) if whole_groups else (h, i)
            if not found or key > found[-1]:
                found.append(key)
        seen += w
    return found


def _ranged(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """With ``r``, the number of boundaries at or below the row's key. The boundaries are at most MOST_RANGES."""
    hashes, ids = np.array([h for h, _ in bounds], np.int64), np.array([i for _, i in bounds], np.int64)

    def run(batches):
        for batch in batches:
            h, i = batch.column("h").to_numpy(), batch.column("id").to_numpy()
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            r = low.copy()
            split = np.flatnonzero(low < high)
            for x in np.unique(h[split]):
                m = split[h[split] == x]
                r[m] = low[m[0]] + np.searchsorted(ids[low[m[0]] : high[m[0]]], i[m], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r.astype(np.int64))], names=[*batch.schema.names, "r"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", r long")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard), sizes near equal."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    real = F.col(id_col).cast("long")
    rows = docs.select(
        F.coalesce(real, F.lit(LOWEST + 1)).alias("id"), real.alias("real_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
    )
    rows = stored(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES))
    bounds = _quantiles(_sampled(rows, total, ranges * PER_RANGE, 0), ranges, True)
    full = OVERFULL * total / ranges
    for attempt in range(1, 64):
        placed = _ranged(rows, bounds)
        sums = {r["r"]: r for r in placed.groupBy("r").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(F.struct("h", "id")).alias("low"), F.max(F.struct("h", "id")).alias("high")).collect()}
        one = {r for r, s in sums.items() if s["low"][0] == s["high"][0]}  # ranges of one text
        over = {r: s for r, s in sums.items() if s["size"] > (max(full, total / shards * HOT) if r in one else full) and tuple(s["low"]) < tuple(s["high"])}
        if not over:
            break
        large = sum(s["size"] for s in over.values())
        parts = {r: -(-2 * s["size"] // int(full)) for r, s in over.items()}
        drawn: dict[int, list] = {r: [] for r in over}
        for h, i, w in _sampled(placed.where(F.col("r").isin(list(over))), large, PER_RANGE * sum(parts.values()), attempt):
            drawn[bisect.bisect_right(bounds, (h, i))].append((h, i, w))
        more = {k for r, found in drawn.items() for k in _quantiles(found, parts[r], r not in one)}
        more |= {tuple(sums[r]["high"]) if r in one else (sums[r]["high"][0], LOWEST) for r in over}  # so that each attempt cuts
        bounds = sorted(set(bounds) | more)
    order = sorted(sums)
    before_bytes = np.concatenate([[0], np.cumsum([sums[r]["size"] for r in order])]).tolist()
    before_rows = np.concatenate([[0], np.cumsum([sums[r]["n"] for r in order])]).tolist()
    ahead = rows.sparkSession.createDataFrame([(int(r), int(b), int(n)) for r, b, n in zip(order, before_bytes, before_rows, strict=False)], "r long, ahead long, ahead_rows long")
    inside = Window.partitionBy("r").orderBy("h", "id", "real_id")
    cut = sorted({h for h, i in bounds if i != LOWEST})  # texts whose group was subdivided
    spread = F.col("h").isin(cut) if cut else F.lit(False)
    at = placed.join(F.broadcast(ahead), "r").select(
        "real_id", "size", "text_crc32", "r", "h", "id",
        (F.col("ahead_rows") + F.row_number().over(inside) - 1).alias("row"),
        (F.col("ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
    )
    group = Window.partitionBy("r", "h")
    middle = F.when(spread, F.col("at") + F.col("size") / 2).otherwise(F.min("at").over(group) + F.sum("size").over(group) / 2)
    at = at.withColumn("at", middle)
    at = stored(at.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("at") * shards / F.lit(max(total, 1)))).cast("int")), "shards")
    first = at.groupBy("shard").agg(F.min("row").alias("first"))
    return at.join(F.broadcast(first), "shard").select(
        F.col("real_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs``, whose ids name one row each, as Parquet in one folder per shard."""
    placed = shard(docs, shards, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("shard").alias("__shard"))
    docs.join(placed, docs[id_col].eqNullSafe(F.col("__id"))).drop("__id").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)


def new_shards(docs: DataFrame, shards: int = 8) -> str:
    """write_shards() to a new place in the shared folder, which is returned."""
    path = new_path(docs.sparkSession, "shard-files")
    write_shards(docs, path, shards)
    return path


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of the whole ``documents`` table."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
