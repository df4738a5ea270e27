"""Collocations: phrases that occur more often than the counts of their parts explain.

Text is lower-cased in A-Z and cut into pieces at punctuation and line breaks, pieces into words at blanks and tabs.
All runs of one to ``max_words`` words of a piece become rows (language, words, phrase, count), added up
within each block of text first, and are then aggregated by language and phrase. Counts of parts are joined to
the phrases, scores are exact decimals, phrases that a longer one explains go by an anti-join, and
a window ranks what is left of each language.

A run can only reach ``min_count`` if the runs without its first and without its last word do. So one pass
for each length counts the 64-bit hashes of those runs whose parts can still reach it, and
the last pass makes rows of the runs that are left, as text. Hashes only leave runs
out that cannot reach the count, as equal hashes only add up; the counts themselves are those of the texts. What tasks need to know about the
shorter runs is a Bloom filter of at most ``FILTER_BITS`` bits, whatever the corpus: where it is full, more rows are shuffled and the results are the same.

A null text is empty, a null language is ``und``. Empty texts and tables give no phrases. A very long text is a block of its own.
Repeated rows count each time. Ties in score go by count, then by the phrase's UTF-8 bytes, which differ. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import flat
from llm.store import discard, stored

#: Bits of a filter for each frequent run, and of any filter at most (32 MB).
BITS_EACH, FILTER_BITS = 16, 1 << 28
#: Bits of a filter that one row carries.
CHUNK_BITS = 1 << 19
#: Distinct runs that a task holds before it hands their counts on.
HELD = 700_000
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_BLANK = _BREAK.copy()
_BLANK[[9, 32]] = True


class Words:
    """The words of a block of texts, and the hashes of runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tags: np.ndarray):
        """``tags`` holds a number for the language of each row; equal runs of different tags differ."""
        self.data = flat.lower_ascii(data)
        self.starts, self.ends, first = flat.runs(~_BLANK[data], offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.piece = np.cumsum(_BREAK[data])[self.starts] + self.row if len(self.starts) else self.row
        self.word = flat.span_hashes(self.data, self.starts, self.ends)
        self.tag = tags[self.row]

    def runs(self, most: int, filters: list[Filter] = (), twice: bool = False):
        """For 1 to ``most`` words: (first word of each run, hash, second hash or none). With filters, only runs that they pass and whose parts they pass."""
        words = [self.word, flat.span_hashes(255 - self.data, self.starts, self.ends)] if twice else [self.word]
        at, both = np.arange(len(self.starts)), [flat.mix(w ^ self.tag) for w in words]
        for n in range(1, most + 1):
            if n > 1:  # a run of n - 1 words that the next one follows, all in one piece
                last = np.minimum(at[:-1] + n - 1, len(self.piece) - 1)
                keep = np.flatnonzero((at[1:] == at[:-1] + 1) & (at[:-1] + n <= len(self.piece)) & (self.piece[at[:-1]] == self.piece[last]))
                at = at[keep]
                both = [flat.mix(h[keep] ^ (w[at + n - 1] * np.uint64(2 * n + 1) + np.uint64(n))) for h, w in zip(both, words, strict=True)]
            if n <= len(filters):
                keep = filters[n - 1].has(both[0])
                at, both = at[keep], [h[keep] for h in both]
            yield at, both[0], both[-1] if twice else None


def distinct(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of equal runs, their numbers); runs are equal if both hashes are."""
    _, first, back, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if (other[first][back] != other).any():
        _, first, counts = np.unique(np.stack([h, other], 1), axis=0, return_index=True, return_counts=True)
    return first, counts.astype(np.int64)


class Filter:
    """A Bloom filter of hashes with two probes; no hash that was put in is missed."""

    def __init__(self, bits: int, data: bytes):
        self.mask, self.data = np.uint64(bits - 1), np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for p in positions(h, self.mask):
            found &= (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def positions(h: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return h & mask, (h >> np.uint64(32)) & mask


def filter_of(hashes: DataFrame) -> Filter:
    """The filter of the column ``h``: its chunks are made in groups of at most CHUNK_BITS distinct bits; the driver gets FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(1 << 13, 1 << (BITS_EACH * hashes.count()).bit_length()))
    chunk = min(bits, CHUNK_BITS)

    def places(batches):
        for batch in batches:
            p = np.concatenate(positions(batch.column(0).to_numpy().view(np.uint64), np.uint64(bits - 1)))
            yield pa.RecordBatch.from_arrays([pa.array((p // np.uint64(chunk)).astype(np.int32)), pa.array((p % np.uint64(chunk)).astype(np.int32))], names=["chunk", "bit"])

    def filled(key, part):
        on = np.zeros(chunk, bool)
        on[part.column("bit").to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": [np.packbits(on, bitorder="little").tobytes()]})

    rows = hashes.select("h").mapInArrow(places, "chunk int, bit int").distinct().groupBy("chunk").applyInArrow(filled, "chunk int, data binary")
    data = bytearray(bits // 8)
    for r in rows.collect():
        data[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = r["data"]
    return Filter(bits, bytes(data))


def _tags(langs: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, number of each row's name, hash of each row's name)."""
    coded = langs.dictionary_encode()
    names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    return names, index, hashes[index]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every, back = np.unique(keys, return_inverse=True)
    return every, np.bincount(back, counts, len(every)).astype(np.int64)


def frequent(plain: DataFrame, words: int, filters, min_count: int) -> DataFrame:
    """(h,) of the runs of ``words`` words whose hash occurs often enough; ``filters`` is broadcast, with one filter for each shorter length."""

    def run(batches):
        held, size = [], 0

        def handed(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

        for batch in batches:
            _, _, tags = _tags(batch.column(0))
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                *_, (_, h, _) = Words(data, offsets, tags[start:stop]).runs(words, filters.value)
                keys, counts = np.unique(h, return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > HELD:
                    keys, counts = _summed(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [(keys, counts)], len(keys)
                    if size > HELD // 2:
                        yield handed(keys, counts)
                        held, size = [], 0
        if size:
            yield handed(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    counted = plain.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return counted.where(F.col("c") >= min_count).select("h")


def joined(found: Words, at: np.ndarray, words: int) -> pa.Array:
    """The runs of ``words`` words that start at the words ``at``, joined by one space."""
    word = (at[:, None] + np.arange(words)).ravel()
    starts, sizes = found.starts[word], found.ends[word] - found.starts[word]
    room = sizes + (np.arange(len(word)) % words < words - 1)
    to = np.cumsum(room) - room
    out = np.full(room.sum(), 32, np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + inner] = found.data[np.repeat(starts, sizes) + inner]
    bounds = np.append(to[::words], len(out)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(out))


def grams(plain: DataFrame, max_words: int, filters) -> DataFrame:
    """(lang, words, phrase, f) of all runs that the filters pass; rows of 0 words and no phrase hold the number of words of each language."""

    def run(batches):
        for batch in batches:
            names, index, tags = _tags(batch.column(0))
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                found = Words(data, offsets, tags[start:stop])
                lang = index[start:stop][found.row]
                which, counts = np.unique(lang, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in which], pa.string()), pa.array(np.zeros(len(which), np.int32)), pa.nulls(len(which), pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "f"])
                for n, (at, h, other) in enumerate(found.runs(max_words, filters.value, twice=True), 1):
                    first, counts = distinct(h, other)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[at])), pa.array(np.full(len(at), n, np.int32)), joined(found, at, n), pa.array(counts)], names=["lang", "words", "phrase", "f"])

    rows = plain.mapInArrow(run, "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``max_words`` words.

    a is the phrase's count, n the language's words, l and r the counts of the parts at its worst cut,
    and score 1000 * a * n / (l * r), rounded down.
    """
    context = docs.sparkSession.sparkContext
    plain = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    filters, sent = [], context.broadcast([])
    for words in range(1, max_words + 1):
        often = stored(frequent(plain, words, sent, min_count), f"often{words}")
        filters.append(filter_of(often))
        sent = context.broadcast(list(filters))
        discard(often)
    counts = stored(grams(plain, max_words, sent).where((F.col("words") == 0) | (F.col("f") >= min_count)), "phrases")
    return ranked(counts, top)


def ranked(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` phrases of each language from (lang, words, phrase, f), where rows of 0 words hold the words of each language."""
    known = counts.where("words > 0").select("lang", "phrase", "f")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))
    part = lambda start, size: F.array_join(F.slice("parts", start, size), " ")
    k = F.col("k")
    cuts = candidates.select("lang", "phrase", "a", "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("first"), part(k + 1, F.col("words") - k).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.where("words = 0").select("lang", F.col("f").alias("n")), "lang")
    score = F.expr("CAST(1000 * a AS decimal(19,0)) * CAST(n AS decimal(18,0)) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(18,0)))")
    worst = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    longer = candidates.where("words > 2")
    inside = longer.select("lang", part(F.lit(1), F.col("words") - 1).alias("phrase"), "a").union(longer.select("lang", part(F.lit(2), F.col("words") - 1).alias("phrase"), "a"))
    left = worst.join(inside.distinct(), ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "n", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of the whole ``documents`` table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
