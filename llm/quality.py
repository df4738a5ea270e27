"""Quality by the perplexity under a Kneser-Ney model of trusted text.

Symbols are UTF-8 bytes; a word equal to the one before it is one REPEAT
symbol, and a text starts with four START symbols and ends with END. An
interpolated modified Kneser-Ney model of order 5 is counted on all trusted
texts; a trusted text is scored without the counts of its own fold. Everything about it stays in tables sharded by n-gram:

1. one pass emits, for each block of documents (one or a few partitions of the scan), its
   distinct 5-grams and how often each occurs in trusted texts;
2. counts, continuation counts, discounts and back-off weights are aggregates
   of these, order by order, and joins with the asked 5-grams, from order 1 to 5,
   give each its probability;
3. these go back to their blocks, packed: each task makes one row for a block of all that
   it has for it, codes as differences; there the block's documents (compressed
   texts) meet them and are summed up.

Trusted texts fall into FOLDS folds, and all of them calibrate: a language's threshold is a
quantile of its trusted texts' perplexities under the counts of the other folds, times a margin. Perplexities
are compared after adding PRIOR symbols of the language's usual cost, so that a few odd
letters do not condemn a short text. A language without trusted texts takes the
values of all of them; without any, nothing is rejected for its perplexity.
Null and empty texts have no symbols, a null perplexity, and are rejected. A null language
is the language ``und``; a row with a null id is scored but never trusted.
Repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import flat
from llm.store import BROADCAST_ROWS, discard, stored, unused

ORDER = 5
#: Bits of a 5-gram; above them stand the asked variant and, in a block's counts, the fold.
CODE_BITS, TAG_BITS = 8 * ORDER, 8 * ORDER + 4
#: Roles of a document: to be scored only, counted too, or calibrating.
PLAIN, TRAIN, CALIBRATE = 0, 1, 2
REPEAT, START, END = 1, 2, 3
#: Quantile of the trusted texts of a language, and the factor on its perplexity.
QUANTILE, MARGIN = 0.995, 1.15
#: Folds of the trusted texts; a variant of the model leaves out the fold of its number, variant FOLDS none. Symbols of usual cost added to each text.
FOLDS, PRIOR = 5, 200
#: Text whose 5-grams are held at once.
PART_BYTES = 1_000_000
#: 5-grams that a task gathers before it packs them by blocks.
GATHER = 1_000_000
#: Partitions of the scan that make one block, where that leaves TASKS blocks for each core: the fewer the blocks, the fewer 5-grams are repeated in several.
JOINED, TASKS = 4, 2
#: Log-perplexities are counted in steps of this size for the quantiles.
STEP = 1e-4


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row offsets): the bytes with each repeated word as one REPEAT."""
    starts, ends, first = flat.words(data, offsets)
    if len(starts) > 1:
        h = flat.span_hashes(data, starts, ends)
        again = np.append(False, h[1:] == h[:-1])
        again[first[:-1][np.diff(first) > 0]] = False
        if again.any():
            data = data.copy()
            keep = np.ones(len(data) + 1, np.int8)
            s, e = starts[again], ends[again]
            drop = np.zeros(len(data) + 1, np.int32)
            np.add.at(drop, s + 1, 1)
            np.add.at(drop, np.maximum(e, s + 1), -1)
            keep = np.cumsum(drop) == 0
            data[s] = REPEAT
            return data[keep[:-1]], np.append(0, np.cumsum(keep[:-1]))[offsets]
    return data, offsets


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram codes of all rows, offsets): one for each symbol and for the end, none for a row without bytes."""
    data, offsets = symbols(data, offsets)
    sizes = np.diff(offsets)
    some = sizes > 0
    begins = offsets[:-1][some]
    pad = np.full(ORDER - 1, START, np.uint8)
    n = int(some.sum())
    padded = np.insert(data, np.repeat(begins, ORDER - 1), np.tile(pad, n))
    finish = offsets[1:][some] + (ORDER - 1) * np.arange(1, n + 1)
    padded = np.insert(padded, finish, END).astype(np.uint64)
    bounds = np.append(0, np.cumsum(np.where(some, sizes + 1, 0)))
    if n == 0:
        return np.zeros(0, np.int64), bounds
    codes = padded[: len(padded) - ORDER + 1].copy()
    for k in range(1, ORDER):
        codes = (codes << np.uint64(8)) | padded[k : len(padded) - ORDER + 1 + k]
    ends = finish + np.arange(n)  # where each row's END stands
    first = np.append(0, ends[:-1] + 1)
    keep = np.zeros(len(padded) + 1, np.int32)
    keep[first] += 1
    keep[ends - ORDER + 2] -= 1
    return codes[np.cumsum(keep)[: len(codes)] > 0].view(np.int64), bounds


def _counted(tagged: DataFrame) -> DataFrame:
    """(block, code, v, fold, c): each block's distinct 5-grams by asked variant and fold (-1 for none), with their counts in trusted rows."""

    def run(batches):
        block, codes, counts, held, waiting = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            nonlocal codes, counts, held, waiting
            every, back = np.unique(np.concatenate([codes, *(c for c, _ in held)]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, back, np.concatenate([counts, *(n for _, n in held)]))
            codes, counts, held, waiting = every, total, [], 0

        for batch in batches:
            block = batch.column(3)[0].as_py() if batch.num_rows else block
            tag = (batch.column(1).to_numpy().astype(np.int64) << CODE_BITS) | ((batch.column(2).to_numpy().astype(np.int64) + 1) << TAG_BITS)
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text"), PART_BYTES):
                found, bounds = grams(data, offsets)
                c, n = np.unique(found | np.repeat(tag[start:stop], np.diff(bounds)), return_counts=True)
                held.append((c, n))
                waiting += len(c)
                if waiting > 700_000:
                    merged()
        if held:
            merged()
        for k in range(0, len(codes), 100_000):
            part = codes[k : k + 100_000]
            v, fold = ((part >> CODE_BITS) & 15).astype(np.int32), (part >> TAG_BITS).astype(np.int32) - 1
            c = np.where(fold >= 0, counts[k : k + 100_000], 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(part & ((1 << CODE_BITS) - 1)), pa.array(v), pa.array(fold), pa.array(c)], names=["block", "code", "v", "fold", "c"])

    return tagged.select("text", "v", "fold", F.spark_partition_id()).mapInArrow(run, "block int, code long, v int, fold int, c long")


def _discounts(table: DataFrame, variants: list[int]) -> dict[int, list[float]]:
    """D1, D2 and D3+ of each variant from the numbers of n-grams that occur one to four times."""
    row = table.agg(*[F.count_if(F.col(f"c{v}") == k).alias(f"n{v}_{k}") for v in variants for k in (1, 2, 3, 4)]).first()
    out = {}
    for v in variants:
        n = [row[f"n{v}_{k}"] for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        found = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k) if n[k - 1] else k / 2 for k in (1, 2, 3)]
        out[v] = [min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(found, 1)]
    return out


def probabilities(counted: DataFrame, variants: list[int]) -> DataFrame:
    """(code, v, lp): the natural logarithm of each asked 5-gram's probability in the asked variant of the model."""

    def pick(name):
        """The column of the row's variant; an n-gram or context that does not occur in it has null."""
        found = F.when(F.col("v") == variants[0], F.col(f"{name}{variants[0]}"))
        for v in variants[1:]:
            found = found.when(F.col("v") == v, F.col(f"{name}{v}"))
        return F.nullif(found, F.lit(0))

    left = {v: F.sum(F.when(F.col("fold") != v, F.col("c")).otherwise(0)).alias(f"c{v}") for v in variants}
    levels = {ORDER: stored(counted.where("c > 0").groupBy(F.col("code").alias("g")).agg(*left.values()), "counts")}
    mask = {k: (1 << (8 * k)) - 1 for k in range(1, ORDER + 1)}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy(F.col("g").bitwiseAND(mask[k]).alias("g")).agg(*[F.count_if(F.col(f"c{v}") > 0).alias(f"c{v}") for v in variants])
        levels[k] = stored(shorter, "counts")
    asked = {ORDER: stored(counted.select(F.col("code").alias("g"), "v").distinct(), "asked")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.col("g").bitwiseAND(mask[k]).alias("g"), "v").distinct()
    lower = None
    for k in range(1, ORDER + 1):
        d = _discounts(levels[k], variants)
        off = lambda c, v, d=d: F.when(c == 0, 0.0).when(c == 1, d[v][0]).when(c == 2, d[v][1]).otherwise(d[v][2])
        sums = [x for v in variants for x in (F.sum(f"c{v}").alias(f"all{v}"), F.sum(off(F.col(f"c{v}"), v)).alias(f"saved{v}"))]
        context = levels[k].groupBy(F.shiftright("g", 8).alias("h")).agg(*sums)
        rows = asked[k].withColumn("h", F.shiftright("g", 8)).join(levels[k], "g", "left").join(context, "h", "left")
        if lower is None:
            rows = rows.withColumn("q", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", F.col("g").bitwiseAND(mask[k - 1])).join(lower, ["s", "v"])
        own = F.lit(None).cast("double")
        for v in variants:
            own = F.when(F.col("v") == v, F.greatest(F.col(f"c{v}") - off(F.col(f"c{v}"), v), F.lit(0.0))).otherwise(own)
        # an n-gram that does not occur has no own share
        p = F.coalesce((F.coalesce(own, F.lit(0.0)) + pick("saved") * F.col("q")) / pick("all"), F.col("q"))
        lower, last = stored(rows.select(F.col("g").alias("s"), "v", p.alias("q")), "probabilities"), lower
        discard(levels[k], *[] if last is None else [last])
    discard(asked[ORDER])
    return lower.select(F.col("s").alias("code"), "v", F.log("q").alias("lp"))


def _packed(tagged: DataFrame) -> DataFrame:
    """(block, id, lang, role, v, size, z): the documents by the same blocks, those of PART_BYTES in one row with their texts compressed together."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start, stop, data, offsets in flat.blocks(flat.column(batch, "text"), PART_BYTES):
                own = batch.slice(start, stop - start)
                ends = pa.array([0, len(own)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (own.column(0), own.column(1), own.column(3), own.column(4), pa.array(np.diff(offsets)))]
                z = pa.array([zip_.compress(data.tobytes())], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(5).slice(0, 1), *lists, z], names=["block", "id", "lang", "role", "v", "size", "z"])

    plain = tagged.select("id", "lang", "text", "role", "v", F.spark_partition_id())
    return plain.mapInArrow(run, "block int, id array<long>, lang array<string>, role array<int>, v array<int>, size array<long>, z binary")


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit values by their place: all lowest ones first."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    """The values that ``_planes`` got."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _by_block(asked: DataFrame) -> DataFrame:
    """(block, codes, lps): the rows (block, code, lp) of each task, packed into one row for each block and GATHER of them."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        held, waiting = [], 0

        def handed():
            block, code, lp = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((code, block))
            block, code, lp = block[order], code[order], lp[order]
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            codes = [zip_.compress(_planes(np.diff(code[x], prepend=0))) for x in parts]
            lps = [zip_.compress(_planes(lp[x])) for x in parts]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(codes, pa.binary()), pa.array(lps, pa.binary())], names=["block", "codes", "lps"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy().copy() for c in batch.columns])  # the batch can go
                waiting += batch.num_rows
            if waiting >= GATHER:
                yield handed()
                waiting = 0
        if held:
            yield handed()

    return asked.select("block", "code", "lp").mapInArrow(run, "block int, codes binary, lps binary")


def _scored(asked: DataFrame, packed: DataFrame, blocks: int) -> DataFrame:
    """(id, lang, role, n, lp): symbols and log-probability of each document; ``blocks`` is how many blocks there are."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        now, parts, codes, values = None, [], None, None
        for batch in batches:
            block, is_doc = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1, [len(block)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, parts, codes, values = block[a], [], None, None
                own = batch.slice(a, b - a)
                if not is_doc[a]:
                    for c, lp in zip(own.column(2), own.column(3), strict=True):
                        parts.append((np.cumsum(_unplaned(unzip.decompress(c.as_buffer()), np.int64)), _unplaned(unzip.decompress(lp.as_buffer()), np.float64)))
                    continue
                if codes is None:
                    codes = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64)
                    order = np.argsort(codes, kind="stable")
                    codes, values = codes[order], np.concatenate([v for _, v in parts])[order] if parts else np.zeros(0)
                    parts, order = [], None
                lists = own.column(4).flatten()
                for at in range(len(own)):
                    yield scored(unzip, [x[at] for x in lists], codes, values)

    def scored(unzip, docs, codes, values):
        ids, lang, role, variant, size = (x.values for x in docs[:-1])
        raw, offsets = unzip.decompress(docs[-1].as_buffer()), np.append(0, np.cumsum(size.to_numpy()))
        found, bounds = grams(np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets)
        found = found | np.repeat(variant.to_numpy().astype(np.int64) << CODE_BITS, np.diff(bounds))
        at = np.minimum(np.searchsorted(codes, found), max(0, len(codes) - 1))
        if len(found) and (len(codes) == 0 or not (codes[at] == found).all()):
            raise RuntimeError("a block's documents are not those that it was counted on")
        total = np.concatenate([[0.0], np.cumsum(values[at])]) if len(found) else np.zeros(1)
        return pa.RecordBatch.from_arrays([ids, lang, role, pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds]))], names=["id", "lang", "role", "n", "lp"])

    kind = "struct<id:array<bigint>,lang:array<string>,role:array<int>,v:array<int>,size:array<bigint>,z:binary>"
    left = _by_block(asked).select("block", F.lit(False).alias("is_doc"), "codes", "lps", F.lit(None).cast(kind).alias("doc"))
    right = packed.select("block", F.lit(True), F.lit(None).cast("binary"), F.lit(None).cast("binary"), F.struct("id", "lang", "role", "v", "size", "z").cast(kind))
    rows = left.union(right).repartitionById(max(1, blocks), "block").sortWithinPartitions("block", "is_doc")  # a task for each block
    return rows.mapInArrow(run, "id long, lang string, role int, n long, lp double")


def _joined(partitions: int, cores: int) -> int:
    """How many blocks so many partitions of the scan make."""
    return -(-partitions // max(1, min(JOINED, partitions // (TASKS * cores))))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rotate: bool = False, by_row: bool = False) -> DataFrame:
    """(id, lang, role, n, lp) of each row; ``trusted`` has the ids (id_col) of trusted texts.

    With ``rotate`` all trusted texts are counted, and each is scored without its own fold; otherwise all rows are scored without the first fold.
    With ``by_row`` the id is ``row_key`` of the row, so that rows that share an id are told apart.
    """
    ids = stored(trusted.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("trusted")).where("id is not null").distinct(), "trusted")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    few = ids.count() <= BROADCAST_ROWS
    fold = F.when(F.col("trusted"), F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS)).cast("int"))
    role = F.when(fold.isNull(), PLAIN).when(F.lit(rotate) | (fold == 0), CALIBRATE).otherwise(TRAIN)
    variant = F.coalesce(fold, F.lit(FOLDS)) if rotate else F.lit(0)
    tagged = plain.join(F.broadcast(ids) if few else ids, "id", "left").select(row_key("id", "lang", "text").alias("id") if by_row else "id", "lang", "text", role.alias("role"), F.coalesce(fold, F.lit(-1)).alias("fold"), variant.alias("v"))
    if not few or "Exchange" in plain._jdf.queryExecution().sparkPlan().toString():
        plain = tagged = stored(tagged, "tagged")  # so that both passes below see the same partitions
    tagged = tagged.coalesce(_joined(plain.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism))
    counted = stored(_counted(tagged), "grams")
    asked = counted.select("block", "code", "v").join(probabilities(counted, list(range(FOLDS + 1)) if rotate else [0]), ["code", "v"])
    asked = asked.select("block", F.col("code").bitwiseOR(F.shiftleft(F.col("v").cast("long"), CODE_BITS)).alias("code"), "lp")
    last = counted.agg(F.max("block")).first()[0]
    scored = _scored(asked, _packed(tagged), 0 if last is None else last + 1)
    return scored


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", by_row: bool = False) -> DataFrame:
    """(id_col, lang, n_symbols, perplexity, adjusted, threshold, kept) of each row."""
    rows = stored(perplexities(docs, trusted, id_col, text_col, lang_col, rotate=True, by_row=by_row), "perplexities")
    known = rows.where((F.col("role") == CALIBRATE) & (F.col("n") > 0))
    usual = known.groupBy("lang").agg(F.sum("lp").alias("lp"), F.sum("n").alias("n"))
    usual = usual.select("lang", (-F.col("lp") / F.col("n")).alias("usual")), usual.agg((-F.sum("lp") / F.sum("n")).alias("any_usual"))

    def joined(df, one_per_lang, one_row):
        return df.join(F.broadcast(one_per_lang), "lang", "left").crossJoin(F.broadcast(one_row))  # languages; one row

    cost = F.coalesce("usual", "any_usual", F.lit(0.0))
    rows = joined(rows, *usual).withColumn("log", F.when(F.col("n") > 0, (PRIOR * cost - F.col("lp")) / (PRIOR + F.col("n"))))
    bins = rows.where((F.col("role") == CALIBRATE) & (F.col("n") > 0)).groupBy("lang", F.floor(F.col("log") / STEP).alias("bin")).agg(F.count("*").alias("k"))
    limit = F.exp((F.percentile("bin", F.lit(quantile), F.col("k")) + 1) * STEP) * margin
    out = joined(rows, bins.groupBy("lang").agg(limit.alias("own")), bins.groupBy().agg(limit.alias("pooled")))
    out = out.select(F.col("id").alias(id_col), "lang", F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.exp(-F.col("lp") / F.col("n"))).alias("perplexity"), F.exp("log").alias("adjusted"), F.coalesce("own", "pooled").alias("threshold"))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("adjusted") <= F.col("threshold"), F.lit(True)))


def row_key(id_: Column | str, lang: Column | str, text: Column | str) -> Column:
    """A hash of what a row's verdict depends on: rows that share it share the verdict."""
    return F.xxhash64(F.coalesce(F.col(id_).cast("string") if isinstance(id_, str) else id_.cast("string"), F.lit("null")), lang, F.coalesce(text, F.lit("\0null")))


def accepted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns as they were; each row goes by its own text and language, whatever its id."""
    name = unused(docs, "__row")
    keep = classify(docs, trusted, id_col=id_col, text_col=text_col, lang_col=lang_col, by_row=True).where("kept").select(F.col(id_col).alias(name)).distinct()
    keep = stored(keep, "kept")
    own = row_key(docs[id_col].cast("long"), F.coalesce(docs[lang_col].cast("string"), F.lit("und")), docs[text_col])
    return docs.join(F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep, own == F.col(name), "left_semi")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled as of good quality and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of the whole ``documents`` table."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
