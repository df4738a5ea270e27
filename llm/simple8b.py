"""Token ids in Simple-8b words, written and read as self-contained chunks.

A 64-bit word holds a 4-bit selector and a payload: the selector says how many
ids of how many bits follow. Ids are coded in blocks of ``BLOCK``; the word
offset of each block is stored, and the place of each word in its block follows
from the selectors, so all words of a chunk are decoded at once. A value that
needs more than 60 bits is escaped: selector 0, then the value as a raw word.

A chunk's image, little-endian: magic, then the counts of documents, ids and words,
null flags and ids of the documents, lengths of the documents, word offsets of the blocks,
words. Images are the ``image`` column of a Parquet table, so any store that
Spark can write holds them.

Documents are in ascending id order, null ids first, repeated ids in any order. A null text is empty and
has the end id alone; an empty table makes an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import flat, tokens
from llm.store import new_path

#: (ids in a word, bits of each) of selectors 1 to 14. Fixed values of the coding.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 128
MAGIC = b"S8W1"
#: Ids after which a chunk ends, at the next document's end.
CHUNK_IDS = 1 << 18


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end)."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    v = values.astype(np.uint64)
    rows = -(-n // BLOCK)
    bits = np.zeros(rows * BLOCK, np.uint8)
    bits[:n] = _bits(v)
    bits = bits.reshape(rows, BLOCK)
    wide = {1: bits}
    size = 1
    while size * 2 <= 60:
        last = wide[size]
        wide[size * 2] = np.maximum(last, _moved(last, size))
        size *= 2
    choice = np.zeros((rows, BLOCK), np.uint8)
    for s in range(len(SELECTORS), 0, -1):
        count, width = SELECTORS[s - 1]
        base = 1 << (count.bit_length() - 1)
        most = wide[base] if base == count else np.maximum(wide[base], _moved(wide[base], count - base))
        choice[most <= width] = s
    counts = np.array([1, *(c for c, _ in SELECTORS)])
    length = np.minimum(BLOCK, n - np.arange(rows) * BLOCK)
    place, live, picked = np.zeros(rows, np.int64), np.arange(rows), []
    while len(live):
        at = place[live]
        s = choice[live, at]
        picked.append((live, at, s))
        place[live] = at + counts[s]
        live = live[place[live] < length[live]]
    row, at, s = (np.concatenate(x) for x in zip(*picked, strict=True))
    order = np.lexsort((at, row))
    row, at, s = row[order], at[order], s[order]
    words_of = np.where(s == 0, 2, 1)
    ends = np.cumsum(words_of)
    words = np.zeros(ends[-1], np.uint64)
    first = ends - words_of
    source, stop = row * BLOCK + at, row * BLOCK + length[row]
    for k in np.unique(s):
        m = np.flatnonzero(s == k)
        if k == 0:
            words[first[m] + 1] = v[source[m]]
            continue
        count, width = SELECTORS[k - 1]
        word = np.full(len(m), k, np.uint64)
        for j in range(count):
            i = source[m] + j
            fits = i < stop[m]
            word |= np.where(fits, v[np.minimum(i, n - 1)], np.uint64(0)) << np.uint64(4 + width * j)
        words[first[m]] = word
    blocks = np.zeros(rows + 1, np.uint32)
    np.add.at(blocks, row + 1, words_of.astype(np.uint32))
    return words, np.cumsum(blocks, dtype=np.uint32)


def _bits(v: np.ndarray) -> np.ndarray:
    out = np.ones(len(v), np.uint8)
    top = int(v.max()) if len(v) else 0
    for b in range(1, top.bit_length()):
        out += v >= np.uint64(1 << b)
    return out


def _moved(x: np.ndarray, by: int) -> np.ndarray:
    """Each row moved left; beyond the row nothing counts."""
    out = np.zeros_like(x)
    out[:, :-by] = x[:, by:]
    return out


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in _escapes(selector, blocks):
        raw[k + 1] = True
    counts = np.array([1, *(c for c, _ in SELECTORS), 0])
    held = np.where(raw, 0, counts[selector])
    row = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks.astype(np.int64)))
    before = np.cumsum(held) - held
    place = before - before[blocks[:-1].astype(np.int64)][row]
    out = np.zeros(n, np.uint64)
    start, stop = row * BLOCK + place, np.minimum((row + 1) * BLOCK, n)
    for k in np.unique(selector[~raw]):
        m = np.flatnonzero((selector == k) & ~raw)
        if k == 0:
            out[start[m]] = words[m + 1]
            continue
        count, width = SELECTORS[k - 1]
        for j in range(count):
            i = start[m] + j
            fits = i < stop[m]
            out[i[fits]] = (words[m[fits]] >> np.uint64(4 + width * j)) & np.uint64((1 << width) - 1)
    return out


def _escapes(selector: np.ndarray, blocks: np.ndarray) -> list[int]:
    """Words that announce a raw word. Selector 0 right after one may itself be raw, so these few are walked."""
    found, skip = [], -1
    starts = set(blocks.tolist())
    for k in np.flatnonzero(selector == 0).tolist():
        if k != skip or k in starts:
            found.append(k)
            skip = k + 1
    return found


def image(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks = encode(ids)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ids), len(words)], "<u8")
    parts = (head, nulls, names, lengths.astype("<i8"), blocks.astype("<u4"), words.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


def parse(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of an image."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b image")
    at = 4

    def take(kind, n):
        nonlocal at
        x = np.frombuffer(data, kind, n, at)
        at += x.nbytes
        return x

    docs, n, words = (int(x) for x in take("<u8", 3))
    nulls, names, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
    blocks = take("<u4", -(-n // BLOCK) + 1)
    ids = decode(take("<u8", words), blocks, n)
    return [None if z else x for z, x in zip(nulls.tolist(), names.tolist(), strict=True)], lengths, ids


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` to each, and write the images in ascending id order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        names, lengths, ids = [], [], []

        def chunk():
            nonlocal seq, first, names, lengths, ids
            joined = np.concatenate(ids)
            out = pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "first": [first], "n_ids": [len(joined)], "image": [image(names, np.concatenate(lengths), joined)]},
                pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())]),
            )
            seq, first, names, lengths, ids = seq + 1, first + len(joined), [], [], []
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, stop, found, bounds in tokens.blocks(flat.column(batch, "text"), tokenizer, "blank"):
                ends = bounds[1:]
                ids.append(np.insert(found, ends, end_id))
                lengths.append(np.diff(bounds) + 1)
                names += doc_ids[start:stop]
                if sum(map(len, ids)) >= CHUNK_IDS:
                    yield chunk()
        if names:
            yield chunk()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = plain.repartitionByRange("id").sortWithinPartitions("id")
    ranged.mapInArrow(run, "part int, seq int, first long, n_ids long, image binary").write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of each document, or with ``digests`` ids_crc32 in place of ids."""

    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, lengths, ids = parse(data.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                if digests:
                    last = pa.array([zlib.crc32(ids[e - n : e]) for n, e in zip(lengths, ends, strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths.astype(np.int64)), last],
                    names=["id", "start", "n_tokens", "ids_crc32" if digests else "ids"],
                )

    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition written
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    rows = files.join(F.broadcast(parts), "part").select((F.col("first") + F.col("ahead")).alias("base"), "image")
    return rows.mapInArrow(run, "id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))


def op3_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the whole ``documents`` table, written as Simple-8b images and read back."""
    import public_tokenizers

    path = new_path(spark, "simple8b")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_ids(spark, path, digests=True).withColumnRenamed("id", "doc_id")
