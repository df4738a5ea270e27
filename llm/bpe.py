"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of a stretch of text are laid out as one array of symbols.
An inverted index leads from each mergeable pair's rank to the positions where
the pair stands, and ranks are taken in order: all positions of a rank are
merged together, leftmost first where they overlap, and only the pairs with
their left and right neighbours are looked up again. A pair that arises with a
lower rank goes first, so each piece sees the same merges as when it is encoded
by itself. A piece that is itself a token is that token.

A null text is an empty one, of no ids. Rows come back as they are, repeated
ones too; a null id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import flat, pieces

#: Text whose new pieces are replayed together.
STRETCH_BYTES = 24_000_000
_NONE = np.int64(1 << 40)
_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """Ranks are ids: the vocabulary is a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.size = size
        self.keys = np.fromiter(pairs, np.int64, len(pairs))
        self.values = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], self.values[order]
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.lengths = np.zeros(size, np.int64)
        for token, rank in tokens:
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.table = pieces.PieceTable(self.encode_pieces)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode_pieces(self, found: list[bytes]) -> list:
        """Ids of each piece; one with a contraction is first split by the pattern."""
        parts: list[list[bytes]] = [[p] if p[:1] != b"'" else [x.encode() for x in self.pattern.findall(p.decode())] for p in found]
        todo = list({x for p in parts for x in p if x not in self.ranks})
        done = dict(zip(todo, self.replay(todo), strict=True))
        out = []
        for p in parts:
            ids: list[int] = []
            for x in p:
                whole = self.ranks.get(x)
                ids.extend([whole] if whole is not None else done[x])
            out.append(ids)
        return out

    def replay(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        tok = self.base[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        rank = np.full(n, _NONE)
        has = np.flatnonzero(after >= 0)
        rank[has] = self.rank_of(tok[has], tok[has + 1])
        gone = np.zeros(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places, ranks):
            some = ranks != _NONE
            places, ranks = places[some], ranks[some]
            if len(places) == 0:
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(has, rank[has])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if len(at) == 0:
                continue
            if len(at) > 1:
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():
                    k = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, 0, k))
                    at = at[(k - head) % 2 == 0]
            eaten = after[at]
            tok[at] = r
            gone[eaten] = True
            rank[eaten] = _NONE
            right = after[eaten]
            after[at] = right
            inner = right >= 0
            before[right[inner]] = at[inner]
            rank[at] = _NONE
            a = at[inner]
            rank[a] = self.rank_of(tok[a], tok[right[inner]])
            b = before[at]
            b = b[b >= 0]
            rank[b] = self.rank_of(tok[b], tok[after[b]])
            touched = np.concatenate([a, b])
            add(touched, rank[touched])
        left = ~gone
        counts = np.add.reduceat(left, ends - lengths)
        return [x.tolist() for x in np.split(tok[left], np.cumsum(counts)[:-1])]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, number of bytes of each id)."""
        size = self.lengths[ids]
        return self.bytes[pieces.spread(self.starts[ids], size)], size


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _stretches(batches):
    """Batches in stretches of about STRETCH_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STRETCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids), or with ``digests`` ids_sha256 and decoded_sha256 in place of ids."""

    def run(batches):
        c = coder(path, pattern)
        for held in _stretches(batches):
            c.table.trim()
            noted = []
            for batch in held:
                for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                    starts, ends, first, _ = pieces.split(data, offsets, True)
                    noted.append((batch, start, stop, first, *c.table.note(data, starts, ends)))
            c.table.settle()
            for batch, start, stop, first, keys, back in noted:
                ids, sizes = c.table.resolve(keys, back)
                bounds = pieces.row_ids(ids, sizes, first)
                own = batch.column(0).slice(start, stop - start)
                count = pa.array(np.diff(bounds))
                if digests:
                    raw, widths = c.decode(ids)
                    edges = np.append(0, np.cumsum(widths))[bounds]
                    little = ids.astype("<u4")
                    cut = [(bounds[k], bounds[k + 1], edges[k], edges[k + 1]) for k in range(stop - start)]
                    columns = [own, count, pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b, _, _ in cut]), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for _, _, a, b in cut])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([own, count, lists], names=["id", "n_tokens", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>"
    return plain.mapInArrow(run, f"id long, n_tokens long, {kinds}").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary) from lists of ids; a null list gives no bytes."""

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            out = [c.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def op7_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of the whole ``documents`` table, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
