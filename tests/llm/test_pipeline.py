import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from llm import quality, queries, store

DATA = "/root/testdata/sf0.001"


def test_stages_are_applied_to_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == columns
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert 0.5 * before < len(ids) <= before and len(set(ids)) == len(ids)
        docs, before = docs.where(docs["doc_id"].isin(ids)), len(ids)
    out = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.collect()} == set(ids)


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_rows_against_plain_stages(spark, tmp_path):
    """Letters, all pairs of sets, and token ids by plain code; the verdicts of quality are those of its operator."""
    draw = random.Random(7)
    words = ["the", "cat", "dog", "House", "runs", "to", "a", "tree", "and", "back", "again", "with", "its", "friend", "über", "été"]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n)) + "."
    rows = [(i, prose(draw.randint(20, 60)), "en") for i in range(60)]
    for i in range(60, 75):  # near copies: one word in a long text
        parts = rows[i - 60][1].split(" ")
        parts[draw.randrange(len(parts))] = "x"
        rows.append((i, " ".join(parts), "en"))
    rows += [(80, rows[3][1], "en"), (81, rows[3][1], None), (82, None, "en"), (83, "", None), (84, "12 + 34 = 46 !?", "en"), (85, "cat", "en"), (86, "Cat", "en"), (87, prose(2000), "en")]
    rows = [(*r, "s", 0, "row", "kept") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string, __kept_id string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    lettered = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    kept = docs.where(docs["doc_id"].isin(list(lettered)))
    good = {r["doc_id"] for r in quality.classify(kept, quality.trusted_ids(labels)).where("kept").collect()}
    sets = {i: shingles(lettered[i]) for i in good}
    root = {i: i for i in good}
    for _ in good:
        for a in good:
            for b in good:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    root[a] = root[b] = min(root[a], root[b])
    want = {i for i in good if root[i] == i}
    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == want and 20 < len(want) < len(good) < len(rows)
    for i, own in pieces.items():
        ids, at = [*coder.encode(lettered[i], add_special_tokens=False).ids, 2], 0
        for start, length, crc in sorted(own):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert all(sum(n for _, n in x) <= 4096 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in used.values())


def test_stages_hand_text_to_python_in_small_batches(spark, tmp_path):
    key, rows_key = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc "), 1000).alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs.where("doc_id < 20"), str(tmp_path))
            found = docs.mapInArrow(sizes, "rows long, bytes long").agg(F.sum("rows"), F.max("bytes")).first()
            assert found[0] == 3000 and found[1] <= store.BATCH_BYTES + 5000
        spark.conf.set(key, "500k")
        store.small_batches(spark)
        assert spark.conf.get(key) == "500k" and spark.conf.get(rows_key) == str(store.READ_ROWS)
    finally:
        spark.conf.unset(key)
        spark.conf.unset(rows_key)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
