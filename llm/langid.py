"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A
letter trigram is the product of its first letter's vector rotated twice, its
second's rotated once and its third's; a run of other characters counts as one
blank letter. A text's profile is the sum of its trigrams' vectors, a
language's prototype the sum over all texts it learns from. The prediction is
the language whose prototype has the largest cosine with the text's profile.

A null text, an empty one and one without letters are ``und`` with score 0, as
is everything when there is nothing to learn from. Equal scores go to the
first language by name. A row with a null id is never learned from and counts
as held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import flat, pieces

DIM = 1024
#: Trigram vectors that a worker keeps: 32 MB.
CACHE = 32_768
_SHIFT = np.uint64(21)
_lower: dict[int, np.ndarray] = {}


def _letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters' code points, 0 for everything else."""
    n = 0x3000 if len(points) == 0 or points.max() < 0x3000 else 0x110000
    if n not in _lower:
        every = np.arange(n, dtype=np.uint32)
        kind = pieces.classes(every) == pieces.LETTER
        table = np.where(kind, every, 0).astype(np.uint64)
        for c in np.flatnonzero(kind).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        _lower[n] = table
    return _lower[n][points]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the trigrams of all rows, row of each)."""
    points, _, rows = pieces.decode(data, offsets)
    letters = np.insert(_letters(points), np.repeat(rows, 2)[1:-1], 0)  # a blank before and after each row
    ends = rows[1:] + 2 * np.arange(1, len(rows))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(np.append(0, ends)))
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0) | (row[1:] != row[:-1])
    letters, row = letters[keep], row[keep]
    if len(letters) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = row[2:] == row[:-2]
    codes = (letters[:-2] << (_SHIFT * np.uint64(2))) | (letters[1:-1] << _SHIFT) | letters[2:]
    return codes[same], row[2:][same]


def _letter_vectors(letters: np.ndarray) -> np.ndarray:
    seeds = letters[:, None] * np.uint64(0x1_0000) + np.arange(DIM // 64, dtype=np.uint64)
    bits = np.unpackbits(flat.mix(flat.mix(seeds + np.uint64(1))).view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


#: Counts of rows and trigrams that are held at once (8 bytes each, and 4 more for the product), and trigrams whose vectors are (4 bytes for each dimension).
COUNTS, TRIGRAMS = 3_000_000, 4096


class Vectors:
    """Vectors of trigrams; the most recent blocks' are kept, in one array that never moves."""

    def __init__(self):
        self.codes, self.slots, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.empty((CACHE, DIM), np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """``codes`` ascending and distinct."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        known[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == codes[at < len(self.codes)]
        if not known.all():
            new = codes[~known]
            mask = (np.uint64(1) << _SHIFT) - np.uint64(1)
            letters, back = np.unique(np.stack([new >> (_SHIFT * np.uint64(2)), (new >> _SHIFT) & mask, new & mask]), return_inverse=True)
            v = _letter_vectors(letters)
            a, b, c = back.reshape(3, -1)
            made = np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]
            if len(self.codes) + len(new) > CACHE:
                out = np.empty((len(codes), DIM), np.int8)
                out[known], out[~known] = self.rows[self.slots[at[known]]], made
                if len(codes) <= CACHE:
                    self.codes, self.slots = codes, np.arange(len(codes))
                    self.rows[: len(codes)] = out
                return out
            first = len(self.codes)
            self.rows[first : first + len(new)] = made
            self.slots = np.insert(self.slots, at[~known], np.arange(first, first + len(new)))
            self.codes = np.insert(self.codes, at[~known], new)
            at = np.searchsorted(self.codes, codes)
        return self.rows[self.slots[at]]


def profiles(data: np.ndarray, offsets: np.ndarray, vectors: Vectors, group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
    """The summed trigram vectors of each row, or with ``group`` of each group of rows."""
    codes, row = trigrams(data, offsets)
    n = groups if group is not None else len(offsets) - 1
    out = np.zeros((n, DIM), np.float32 if group is None else np.float64)
    if len(codes) == 0:
        return out
    if group is not None:
        row = group[row]
    distinct, back = np.unique(codes, return_inverse=True)
    step = min(TRIGRAMS, max(1, COUNTS // max(1, n)))  # trigrams whose counts are held at once
    order = None
    for first in range(0, len(distinct), step):
        last = min(first + step, len(distinct))
        if last - first < len(distinct):
            order = np.flatnonzero((back >= first) & (back < last))
            r, k = row[order], back[order] - first
        else:
            r, k = row, back
        counts = np.bincount(r * (last - first) + k, minlength=n * (last - first)).reshape(n, last - first)
        out += counts.astype(out.dtype) @ vectors.of(distinct[first:last]).astype(out.dtype)
    return out


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) of rows with a language: DIM sums for each language, which is all the driver gets."""

    def run(batches):
        vectors, sums = Vectors(), {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                names, group = np.unique(langs[start:stop].astype(str), return_inverse=True)
                for name, v in zip(names, profiles(data, offsets, vectors, group, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + np.rint(v).astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "x"])

    plain = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = plain.mapInArrow(run, "lang string, dim int, x long").groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in rows})
    found = np.zeros((len(langs), DIM))
    for r in rows:
        found[langs.index(r["lang"]), r["dim"]] = r["x"]
    keep = np.abs(found).sum(axis=1) > 0
    return [x for x, k in zip(langs, keep, strict=True) if k], found[keep]


def _predictor(model: tuple[list[str], np.ndarray]):
    """A function from (bytes, row offsets) to (languages, scores), for one worker."""
    langs = model[0]
    prototypes = (model[1] / np.maximum(1e-300, np.linalg.norm(model[1], axis=1, keepdims=True))).astype(np.float32)

    def start():
        vectors = Vectors()

        def predict_block(data, offsets):
            if not langs:
                return ["und"] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
            found = profiles(data, offsets, vectors)
            size = np.linalg.norm(found, axis=1)
            cosine = (found @ prototypes.T) / np.maximum(size, 1e-9)[:, None]
            best, score = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1).astype(np.float64)
            return [langs[k] if s > 0 else "und" for k, s in zip(best, size, strict=True)], score

        return predict_block

    return start


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), the score being the largest cosine, 0 if negative."""
    start_worker = _predictor(model)

    def run(batches):
        of = start_worker()
        for batch in batches:
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text")):
                names, score = of(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score), learned from the rows that are not held out."""
    model = learn(docs.where(~_held_out(id_col)), lang_col, text_col)
    return predict(docs, model, id_col, text_col).select(id_col, _held_out(id_col).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with all columns as they were: ``und`` rows go.

    Each row is judged by its own text and filtered where it is, whatever its id.
    """
    start_worker = _predictor(learn(docs.where(~_held_out(id_col)), lang_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        of = start_worker()
        for batch in batches:
            text = batch.select([at]).rename_columns(["text"])
            for start, stop, data, offsets in flat.blocks(flat.column(text, "text")):
                names, _ = of(data, offsets)
                yield batch.slice(start, stop - start).filter(pa.array([x != "und" for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of the whole ``documents`` table."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
