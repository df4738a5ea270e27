import re
from collections import Counter

import numpy as np
import pytest

from llm import phrases


def plain(rows, least, most=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every run of words."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, ws), a in often.items():
        if any(x == lang and len(o) > len(ws) and b >= a and any(o[i : i + len(ws)] == ws for i in range(len(o))) for (x, o), b in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


ROWS = [
    (1, "New York city. new york City; NEW\tYORK  city, new york", "en"),
    (2, "New York city. new york City; NEW\tYORK  city, new york", "en"),
    (2, "New York city. new york City; NEW\tYORK  city, new york", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "a a a a a a a a a a", None),
    (6, "ÉTÉ été Été été\vété été", "fr"),
    (7, "new york city", "fr"),
    (8, " .,;:!?\n\r ", "fr"),
    (9, "x" * 70000 + " y " + "x" * 70000 + " y", "de"),
    (10, "one two three four five six. one two three four five six", "de"),
]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (4, 2000), (2, 3), (1000, 5)])
def test_against_every_run(spark, docs_of, least, top):
    got = phrases.collocations(docs_of(ROWS), least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain(ROWS, least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_random_texts_with_full_filters(spark, docs_of, monkeypatch):
    """A filter whose bits are all set lets everything pass: more rows, the same result."""
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(draw.choice(list("abcdefgh") + ["i.", "j,"], 60)), ["en", "fr", None][i % 3]) for i in range(60)]
    want = plain(rows, 5)
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(rows), 5).collect()) == want
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 13)
    monkeypatch.setattr(phrases, "BITS_EACH", 1 << 30)
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(rows), 5).collect()) == want


def test_filters_of_many_chunks_lose_no_hash(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BITS", 1 << 10)
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    found = phrases.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert found.has(h.view(np.uint64)).all()
    assert found.has(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.1


def test_equal_first_hashes_are_told_apart():
    first, counts = phrases.distinct(np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 5], np.uint64))
    assert sorted(counts) == [1, 1, 2] and len(first) == 3


def test_scores_beyond_64_bits_are_exact(spark):
    big = 9_000_000_000_000
    rows = [("en", 0, None, 10**15), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    (r,) = phrases.ranked(spark.createDataFrame(rows, "lang string, words int, phrase string, f long"), 10).collect()
    assert r["score"] == 1000 * (big - 1) * 10**15 // (big * (big + 7))


def test_no_rows(spark, docs_of):
    assert phrases.collocations(docs_of([])).collect() == []
