import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import resample


def features(text, width=3):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ws, [" ".join(ws[i : i + k]) for k in range(1, width + 1) for i in range(len(ws) - k + 1)]


def plain(rows, target, percent=5, least=20, seed=42, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count([r[1] for r in rows]), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for r in rows:
        ws, fs = features(r[1])
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in fs)
        score = None
        if r[0] is not None:
            h = int(hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(fs), weight, score, None, len(ws) >= least and r[0] is not None])
    fit = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0], x[1]))
    for rank, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


def texts(n, seed=5):
    draw = np.random.default_rng(seed)
    return [" ".join(draw.choice(["the", "Of", "été", "x1", "日本", "and-so", "ZEBRA", "q" * 60], draw.integers(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 30, 100])
def test_against_a_plain_computation(spark, docs_of, percent):
    rows = [(i, t) for i, t in enumerate(texts(80))]
    rows += [(i + 100, rows[0][1]) for i in range(40)] + [rows[3], rows[3], (500, None), (501, ""), (502, "?! --"), (None, rows[1][1]), (503, "w" * 90_000 + " " + "v " * 30_000)]
    target = texts(5, 9) + [None, ""]
    got = resample.resample(docs_of(rows), docs_of([(i, t) for i, t in enumerate(target)]), percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, target, percent)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5


def test_buckets_of_many_copies_are_as_many_rows_as_of_one(spark, docs_of):
    """Rows of counts grow with tasks and buckets, never with a group's size."""
    one, many = (resample.collapsed(docs_of([(i, "a b c d e") for i in range(n)])) for n in (1, 3000))
    rows = [sorted(map(tuple, resample.bucket_counts(x, 3, 10_000).collect())) for x in (one, many)]
    assert len(rows[0]) == len(rows[1]) == 12 and rows[1] == [(b, 3000 * n) for b, n in rows[0]]


def test_empty_sides(spark, docs_of):
    some = [(i, t) for i, t in enumerate(texts(30))]
    assert resample.resample(docs_of([]), docs_of(some)).collect() == []
    got = resample.resample(docs_of(some), docs_of([]), 50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(some, [], 50)


def test_crcs_of_runs_are_those_of_their_text():
    rows = [t.encode() for t in texts(20)] + [b"", b"a", b"\xff\xfe 0" * 3]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    found, first = resample.feature_crcs(data, offsets, 4)
    lower = bytes(resample.flat.lower_ascii(data))
    for i in range(len(rows)):
        own = re.findall(rb"[0-9a-z\x80-\xff]+", lower[offsets[i] : offsets[i + 1]])
        for k, (at, crc) in enumerate(found, 1):
            here = [int(c) for a, c in zip(at, crc, strict=True) if first[i] <= a < first[i + 1]]
            assert here == [zlib.crc32(b" ".join(own[j : j + k])) for j in range(len(own) - k + 1)]


def test_drawn_rows_keep_their_columns(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(texts(60))])
    got = resample.drawn(docs, docs_of([(0, "zebra of the été")]), percent=20)
    assert got.columns == docs.columns and 0 < got.count() <= 12
