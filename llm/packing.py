"""Packing of documents into fixed-length sequences, first-fit decreasing.

Documents are dealt at random (by a hash of the id) into groups of about
``GROUP_BYTES`` of text, and each group is packed by itself: documents
over the capacity give full sequences and a rest; rests go, largest first, into
the first sequence with room, which a tournament tree of the capacities
left finds in logarithmic time. Then the emptiest sequences are cut up to fill
the gaps of the others. What is left of the last sequence is cut at powers of
two, which need no padding.

A null or empty text is a document of the end id alone. Repeated rows and
repeated or null ids are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import flat, tokens

GROUP_BYTES = 8_000_000


class Tournament:
    """Capacities left of the bins in a complete tree whose inner nodes hold the larger child."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.left = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin that has it, and return the bin."""
        left, k = self.left, 1
        while k < self.leaves:
            k *= 2
            if left[k] < size:
                k += 1
        bin_ = k - self.leaves
        left[k] -= size
        k //= 2
        while k:
            top = max(left[2 * k], left[2 * k + 1])
            if left[k] == top:
                break
            left[k] = top
            k //= 2
        return bin_


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset there) of every piece; sequences count from 0."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [(d, s) for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(max(1, len(rest)), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for n, d, s in rest:
        b = tree.first_fit(n)
        if b == len(bins):
            bins.append([])
        bins[b].append((d, s, n))
    used = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -used[b])
    low, high = 0, len(order) - 1
    while low < high:
        to, from_ = order[low], order[high]
        room = capacity - used[to]
        if room == 0:
            low += 1
        elif not bins[from_]:
            high -= 1
        else:
            d, s, n = bins[from_].pop()
            take = min(n, room)
            bins[to].append((d, s, take))
            used[to] += take
            used[from_] -= take
            if take < n:
                bins[from_].append((d, s + take, n - take))
    made = [[(d, s, capacity)] for d, s in full]
    for b in bins:
        size = sum(n for _, _, n in b)
        if not size:
            continue
        if size == capacity:
            made.append(b)
            continue
        room = 0
        for d, s, n in b:
            while n:
                if room == 0:
                    room = 1 << (size.bit_length() - 1)
                    made.append([])
                take = min(n, room)
                made[-1].append((d, s, take))
                s, n, room, size = s + take, n - take, room - take, size - take
    out = []
    for k, pieces in enumerate(made):
        at = 0
        for d, s, n in pieces:
            out.append((d, s, n, k, at))
            at += n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, style: str = "lower", with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` ids.

    A sequence_id is the group's number times 2**32 plus the sequence's number in the group.
    """
    fields = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        group, names, ids = None, [], []

        def packed():
            lengths = [len(x) for x in ids]
            rows = sorted(pack_lengths(lengths, capacity))
            step = 50_000
            for k in range(0, len(rows), step):
                d, s, n, q, at = zip(*rows[k : k + step], strict=True)
                own = [ids[x][y : y + z] for x, y, z in zip(d, s, n, strict=True)]
                columns = [
                    pa.array([names[x] for x in d], pa.int64()),
                    pa.array(s, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    pa.array([lengths[x] for x in d], pa.int64()),
                    pa.array([(group << 32) + x for x in q], pa.int64()),
                    pa.array(at, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int64()))] * with_ids, schema=schema)

        for batch in batches:
            groups, doc_ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for start, stop, found, bounds in tokens.blocks(flat.column(batch, "text"), tokenizer, style):
                for k in range(start, stop):
                    if groups[k] != group:
                        if names:
                            yield from packed()
                        group, names, ids = int(groups[k]), [], []
                    names.append(doc_ids[k])
                    ids.append(np.append(found[bounds[k - start] : bounds[k - start + 1]], np.uint32(end_id)).astype("<u4"))
        if names:
            yield from packed()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    groups = -(-size // GROUP_BYTES)
    plain = plain.select(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(groups)).alias("g"), "id", "text")
    ordered = plain.repartition("g").sortWithinPartitions("g")
    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return ordered.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
