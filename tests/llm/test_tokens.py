import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from llm import bpe, packing, simple8b

ODD = ["", None, " ", "\n\n", " a", "a ", "don't  stop'S 'tis \n\n x's 's\t's !'s ''s", "x\r\n\r\ny  \n z", "12345 ½ Ⅷ 3'd", "<|endoftext|> a <|startoftext|>", "é İstanbul ΑΣ ΣΑΣ", "日本語 テスト 한국어", "😀😀 a😀b", " x 　y", "hehehe andheheheon aaaaaaa", "w" * 3000, "word " * 5000]


@pytest.fixture
def rows():
    rng = random.Random(4)
    more = ["".join(rng.choice(" \n\t'abcSDtsré1²!😀-") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return list(enumerate(ODD + more))


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (2, 50_257, 2**63):
            v = r.integers(0, top, n, dtype=np.uint64)
            v[r.random(n) < 0.3] = 0
            assert (simple8b.decode(*simple8b.encode(v), n) == v).all()


def test_ids_are_written_in_order_and_read_back(spark, docs_of, rows, tmp_path):
    path = P.path("byte_bpe_50k.json")
    simple8b.write_ids(docs_of(rows[::-1]), str(tmp_path / "ids"), path, 0)
    ids = {r["id"]: r for r in simple8b.read_ids(spark, str(tmp_path / "ids")).collect()}
    sums = {r["id"]: r for r in simple8b.read_ids(spark, str(tmp_path / "ids"), digests=True).collect()}
    t, start = Tokenizer.from_file(path), 0
    for i, text in rows:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert ids[i]["ids"] == want and ids[i]["start"] == sums[i]["start"] == start and sums[i]["n_tokens"] == len(want)
        assert sums[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_null_and_repeated_ids_and_empty_tables(spark, docs_of, tmp_path):
    path = P.path("byte_bpe_50k.json")
    simple8b.write_ids(docs_of([(None, "a"), (1, "b"), (1, "b")]), str(tmp_path / "a"), path, 0)
    got = sorted(((r["id"], r["start"]) for r in simple8b.read_ids(spark, str(tmp_path / "a")).collect()), key=lambda x: x[1])
    assert got == [(None, 0), (1, 2), (1, 4)]
    simple8b.write_ids(docs_of([]), str(tmp_path / "b"), path, 0)
    assert simple8b.read_ids(spark, str(tmp_path / "b"), digests=True).count() == 0
    assert packing.pack(docs_of([]), P.path("word_bpe_49k.json"), 2).count() == 0
    assert bpe.encode(docs_of([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, True).count() == 0


def test_packed_pieces_cover_every_id_once(docs_of, rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 6_000)
    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs_of([*rows, (None, "x")]), path, 2, capacity=64, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    for i, text in [*rows, (None, "x")]:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == want and {r["doc_tokens"] for r in mine} == {len(want)}
        assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 64 or n < 64 and n & (n - 1) == 0 for n in bins.values())


def test_first_fit_takes_the_first_bin_with_room():
    tree = packing.Tournament(4, 10)
    assert [tree.first_fit(x) for x in (7, 6, 4, 3, 4, 10)] == [0, 1, 1, 0, 2, 3]


def test_merge_replay_equals_tiktoken(docs_of, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_of([*rows, (None, "x")])
    lists = bpe.encode(docs, path, P.PATTERN)
    ids = {r["doc_id"]: r["ids"] for r in lists.collect()}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(lists, path, P.PATTERN).collect()}
    sums = {r["doc_id"]: r for r in bpe.encode(docs, path, P.PATTERN, digests=True).collect()}
    for i, text in rows:
        want = known.encode_ordinary(text or "")
        assert ids[i] == want and back[i] == (text or "").encode() and sums[i]["n_tokens"] == len(want)
        assert sums[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert sums[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_table_stays_within_its_limit():
    from llm.pieces import PieceTable

    table = PieceTable(lambda found: [list(x) for x in found], limit=100)
    rng = random.Random(1)
    for _ in range(20):
        words = [bytes(rng.choices(b"abcdef", k=4)) for _ in range(60)]
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.arange(60) * 4
        ids, sizes = table.ids(data, starts, starts + 4)
        assert bytes(ids.astype(np.uint8)) == b"".join(words) and (sizes == 4).all()
    assert len(table.keys) <= 160
