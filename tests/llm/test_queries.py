"""Each registered query on a driver's table, against SQL or a plain computation of the same rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from llm import audio, html, queries

DATA = "/root/testdata/sf0.001"
ALL, SQL = queries.queries(), queries.oracle_sql()
NAMES = {int(n[2:].split("_")[0]): n for n in ALL}


def rows(spark, n):
    return [r.asDict() for r in ALL[NAMES[n]](spark, DATA).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = c.execute(SQL[name])
    columns = [d[0] for d in found.description]
    df = ALL[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[k] for k in columns) for r in df.collect()) == sorted(found.fetchall())


def test_op3(spark, texts):
    coder, start = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in rows(spark, 3)}
    for i in sorted(texts):
        ids = [*coder.encode(texts[i]["text"] or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op4(spark, texts):
    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, used, places = {}, {}, {}
    for r in rows(spark, 4):
        got.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(got) == set(texts)
    for i, pieces in got.items():
        ids, at = [*coder.encode(texts[i]["text"] or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used[at] = used.get(at, 0) + 1
        assert at <= 4096
    padding = sum((4096 - n) * k for n, k in used.items() if n & (n - 1))
    assert padding <= 0.02 * sum(n * k for n, k in used.items()) + 4096


def test_op5(spark, texts):
    got = rows(spark, 5)
    held = [r for r in got if r["held_out"] and texts[r["doc_id"]]["lang"]]
    assert {r["doc_id"] for r in got} == set(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held) > 0


def test_op6(spark, texts):
    for r in rows(spark, 6):
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        load = audio.payload(raw)
        media = audio.wav(load)
        _, patches, times, spans = audio.analyse(media)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), audio.summary(patches, times, spans))


def test_op7(spark, texts):
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, 7):
        text = texts[r["doc_id"]]["text"] or ""
        ids = coder.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op8(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = rows(spark, 8)
    assert {r["page_id"] for r in got} == set(pages)
    assert all(r["text"] == html.main_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in got)


def test_op9(spark, texts):
    sizes, counts, slots, where = [0] * 8, [0] * 8, {}, {}
    for r in rows(spark, 9):
        text = texts[r["doc_id"]]["text"]
        data = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(text, set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(counts) == len(texts)
    assert max(sizes) - min(sizes) <= max(0.05 * sum(sizes) / 8, max(len((t["text"] or "").encode()) for t in texts.values()))
    assert sum(len(x) > 1 for x in where.values()) == 0


def test_op10(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, 10)}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert set(got) == set(texts)
    good = [i for i, (q, toxic) in labels.items() if q == 1 and not toxic and i in got]
    poor = [i for i, (q, _) in labels.items() if q == 0 and i in got]
    assert sum(got[i]["kept"] for i in good) >= 0.95 * len(good) and sum(not got[i]["kept"] for i in poor) >= 0.6 * len(poor)
    assert all(r["kept"] == (r["perplexity"] is not None and r["adjusted"] <= r["threshold"]) for r in got.values())
