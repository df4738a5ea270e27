"""Importance resampling of documents towards a target text.

Features are all runs of one to ``width`` consecutive words, hashed into buckets. The
log ratio of a bucket's smoothed shares in the target and in the corpus is its gain,
a document's weight the sum of its features' gains, and Gumbel noise that depends
on the id alone turns the largest scores into a draw without replacement.

1. Identical texts are collapsed by a group over the full text: one row for each distinct
   text, with its multiplicity.
2. Each task adds up its buckets, times the multiplicity; only ``buckets`` sums
   for each task are shuffled, and only the gains (``buckets`` numbers) reach the driver.
3. Features and weight are computed once for each distinct text, and joined
   back to the documents by the SHA-256 of the text.
4. Noise is added for each document, and a range sort numbers the documents.

CRC-32 values are combined from those of the words: appending n bytes is a linear map,
applied as one table for each binary digit of n.

A null text has no words: no features and weight 0, as has a text without words.
A null id has no noise: its score is null and it is never drawn, nor counted among those drawn from.
Repeated rows are documents of their own, with equal scores if id and text are equal; ties of equal ids are ordered
by n_features, and rows that are alike in all take consecutive ranks. An empty corpus gives an empty table; an empty target gives every
unseen bucket the same share. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import flat
from llm.store import stored

#: Words longer than this are hashed one by one.
LONG_WORD = 48
_STEP = np.zeros(256, np.uint32)  # the register after one more byte, the classic table
for _b in range(256):
    _r = _b
    for _ in range(8):
        _r = (_r >> 1) ^ (0xEDB88320 if _r & 1 else 0)
    _STEP[_b] = _r
_WORD = np.array([chr(b).isdigit() or 97 <= b <= 122 or b >= 128 for b in range(128)] + [True] * 128)


def _zeros_tables() -> list[np.ndarray]:
    """Tables [4, 256]: what each byte of a CRC becomes when 1, 2, 4, ... zero bytes follow."""
    one = np.zeros((4, 256), np.uint32)
    for place in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        one[place] = _STEP[value & 0xFF] ^ (value >> np.uint32(8))
    tables = [one]
    while len(tables) < 31:
        last = tables[-1]
        tables.append(np.stack([_moved(last[p], last) for p in range(4)]))
    return tables


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


_ZEROS = _zeros_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC values moved over as many bytes as ``lengths`` says: combine(a, b) is shifted(a, len b) ^ b."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _moved(out[at], _ZEROS[k])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span."""
    lengths = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(lengths <= LONG_WORD)
    k = 0
    while len(at):
        crc[at] = _STEP[(crc[at] ^ data[starts[at] + k]) & 0xFF] ^ (crc[at] >> np.uint32(8))
        k += 1
        at = at[lengths[at] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG_WORD):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]])
    return crc


def feature_crcs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(first word, CRC-32) of the runs of 1, 2, ... words], first word of each row and after the last)."""
    data = flat.lower_ascii(data)
    starts, ends, first = flat.runs(_WORD[data], offsets)
    lengths = ends - starts
    crc = word_crcs(data, starts, ends)
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), lengths) ^ crc
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, found = np.arange(len(crc)), [(np.arange(len(crc)), crc)]
    for k in range(1, width):
        keep = at + k < len(row)
        keep[keep] = row[at[keep]] == row[at[keep] + k]
        at, crc = at[keep], crc[keep]
        crc = shifted(crc, lengths[at + k] + 1) ^ spaced[at + k]
        found.append((at, crc))
    return found, first


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, text, copies) of each distinct text; ``key`` is its SHA-256."""
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies")


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of ``texts``, times their copies, fall into each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                found, first = feature_crcs(data, offsets, width)
                times = np.repeat(copies[start:stop], np.diff(first))
                for at, crc in found:
                    total += np.bincount(crc % buckets, times[at], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text", "copies").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from the counts of both sides, in thousandths of a natural logarithm, rounded down."""
    s, t = [0] * buckets, [0] * buckets
    for into, rows in ((s, corpus), (t, target)):
        for r in rows.collect():  # ``buckets`` rows at most
            into[r["bucket"]] = r["n"]
    big_s, big_t = float(sum(s)) + buckets, float(sum(t)) + buckets
    return np.array([math.floor(1000 * math.log((float(y) + 1) * big_s / ((float(x) + 1) * big_t))) for x, y in zip(s, t, strict=True)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """(key, n_words, n_features, weight) of each text."""

    def run(batches):
        for batch in batches:
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                found, first = feature_crcs(data, offsets, width)
                total = np.zeros(first[-1] + 1, np.int64)
                for at, crc in found:
                    total[at + 1] += gain[crc % len(gain)]
                total = np.cumsum(total)
                n = np.diff(first)
                features = sum(np.maximum(n - k, 0) for k in range(width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(n), pa.array(features), pa.array(total[first[1:]] - total[first[:-1]])], names=["key", "n_words", "n_features", "weight"])

    return texts.select("key", "text").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place``, from 1 in the given order: a range sort, and the counts of its parts summed up."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(parts.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")), "order")
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias("place"))  # a row for each part


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, width: int = 3, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of ``docs``; rank is null unless the document is drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn towards the texts of ``target``.
    """
    texts = stored(collapsed(docs, text_col), "texts")
    wanted = collapsed(target, target_col)
    gain = gains(bucket_counts(texts, width, buckets), bucket_counts(wanted, width, buckets), buckets)
    weight = weights(texts, gain, width)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text_col, 256)).alias("key"))
    rows = rows.join(weight, "key", "left").drop("key").fillna(0, ["n_words", "n_features", "weight"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", F.col("weight") + noise)
    fit = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    rows = rows.select("id", "n_features", "weight", "score", fit.alias("fit"))
    rows = numbered(rows, F.col("fit").desc(), F.col("score").desc_nulls_last(), F.col("id"), F.col("n_features"))
    n = rows.agg(F.count_if("fit")).first()[0]
    rank = F.when(F.col("fit") & (F.col("place") <= percent * n // 100), F.col("place"))
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id is drawn."""
    ids = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(id_col).distinct()
    return docs.join(ids, id_col, "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred of the whole ``documents`` table, drawn towards ``benchmark``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
