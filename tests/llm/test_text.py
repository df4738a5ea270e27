import itertools
import random
import time

import numpy as np
import pytest
import zstandard

from llm import html, langid, quality, sharding

EN, DE = "the cat and the dog went to the house with that thing ", "der hund und die katze gingen in das haus mit dem ding "


def test_languages_are_learned_and_held_out_texts_are_found(docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices((EN if i % 3 else DE).split(), k=30)), "en" if i % 3 else "de") for i in range(120)]
    odd = [(200, None, "en"), (201, "", "en"), (202, "123 !!", "de"), (203, EN * 3000, None), (204, "x", "en"), (None, DE * 5, "de")]
    got = {r["doc_id"]: r for r in langid.language_id(docs_of(rows + odd)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "en", "de"]
    assert got[200]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    df = docs_of(rows + odd)
    kept = langid.identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} | {203, 204, None}


def test_profiles_hold_little_at_once():
    import tracemalloc

    import pyarrow as pa

    from llm import flat

    rng = random.Random(9)
    letters = [chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3C9))]
    texts = pa.array([" ".join("".join(rng.choices(letters, k=6)) for _ in range(400)) for _ in range(1000)])
    tracemalloc.start()
    vectors, found = langid.Vectors(), []
    for _, _, data, offsets in flat.blocks(texts):
        found.append(langid.profiles(data, offsets, vectors))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000
    _, _, data, offsets = next(flat.blocks(texts.slice(990)))  # some of the vectors are kept ones, some new
    assert (np.concatenate(found)[990:] == langid.profiles(data, offsets, langid.Vectors())).all()


def test_language_id_without_anything_to_learn(docs_of):
    assert langid.language_id(docs_of([])).count() == 0
    assert [r["lang_pred"] for r in langid.language_id(docs_of([(1, "abc", None)])).collect()] == ["und"]


def test_profile_is_the_sum_of_bound_letter_vectors():
    data = np.frombuffer("Ab, c".encode(), np.uint8)
    got = langid.profiles(data, np.array([0, len(data)]), langid.Vectors())[0]
    v = dict(zip([0, 97, 98, 99], langid._letter_vectors(np.array([0, 97, 98, 99], np.uint64)).astype(int), strict=True))
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in [(0, 97, 98), (97, 98, 0), (98, 0, 99), (0, 99, 0)])
    assert (got == want).all()


def kneser_ney(trusted, asked):
    """The same model, written plainly."""
    from collections import Counter

    def codes(text):
        out, last, b = [], None, text.encode()
        import re

        for m in re.finditer(rb"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", b):
            word = not m[0][0] in b" \t\n\v\f\r"
            out += [quality.REPEAT] if word and m[0] == last else list(m[0])
            last = m[0] if word else last
        z = [quality.START] * 4 + out + [quality.END]
        return [tuple(z[i : i + 5]) for i in range(len(z) - 4)] if b else []

    tables = {5: Counter(g for t in trusted for g in codes(t))}
    for k in (4, 3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    off = {}
    for k, table in tables.items():
        n = [sum(c == j for c in table.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0), j) if n[j - 1] else j / 2 for j in (1, 2, 3)]
        off[k] = [min(max(x, 0.05 * j), 0.95 * j) for j, x in enumerate(d, 1)]
    sums = {k: Counter() for k in tables}
    saved = {k: Counter() for k in tables}
    for k, table in tables.items():
        for g, c in table.items():
            sums[k][g[:-1]] += c
            saved[k][g[:-1]] += off[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, h = len(g), g[:-1]
        low = p(g[1:])
        if not sums[k][h]:
            return low
        c = tables[k][g]
        return (max(c - off[k][min(c, 3) - 1], 0) if c else 0) / sums[k][h] + saved[k][h] * low / sums[k][h]

    return [(len(codes(t)), sum(np.log(p(g)) for g in codes(t))) for t in asked]


def test_values_go_back_to_their_blocks_packed(spark, monkeypatch):
    """One row for each block and task, from which the codes and the very same doubles are read."""
    draw = np.random.default_rng(3)
    rows = [(int(b), int(c), float(x)) for b, c, x in zip(draw.integers(0, 3, 900), draw.permutation(1 << 20)[:900] << 23, -draw.random(900), strict=True)]
    asked = spark.createDataFrame(rows, "block int, code long, lp double").repartition(2)
    packed = quality._by_block(asked).collect()
    assert len(packed) <= 2 * 3
    monkeypatch.setattr(quality, "GATHER", 100)
    for got in (packed, quality._by_block(asked).collect()):
        unzip = zstandard.ZstdDecompressor()
        back = [(r["block"], int(c), float(x)) for r in got for c, x in zip(np.cumsum(quality._unplaned(unzip.decompress(r["codes"]), np.int64)), quality._unplaned(unzip.decompress(r["lps"]), np.float64), strict=True)]
        assert sorted(back) == sorted(rows)
    assert quality._by_block(asked.limit(0)).count() == 0


def test_perplexities_match_a_plain_model(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(EN.split(), k=rng.randint(1, 25))), "en") for i in range(30)] + [(50, "the the the cat", "en"), (51, "*** $$$ é", "fr"), (52, "", "en"), (53, None, None), (54, "cat " * 4000, "en")]
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r["id"]: r for r in quality.perplexities(docs_of(rows), trusted).collect()}
    import zlib

    train = [t for i, t, _ in rows[:20] if zlib.crc32(str(i).encode()) % quality.FOLDS]
    for (i, _, _), (n, lp) in zip(rows, kneser_ney(train, [t or "" for _, t, _ in rows]), strict=True):
        assert got[i]["n"] == n and got[i]["lp"] == pytest.approx(lp, rel=1e-9, abs=1e-9)


def test_several_partitions_make_one_block(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(EN.split(), k=20)), "en") for i in range(128)]
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    blocks, scored, got = [], quality._scored, []
    monkeypatch.setattr(quality, "_scored", lambda asked, packed, n: (blocks.append(n), scored(asked, packed, n))[1])
    for slices in (64, 1):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), "doc_id long, text string, lang string")
        got.append({r["id"]: (r["n"], r["lp"]) for r in quality.perplexities(docs, trusted, rotate=True).collect()})
    assert blocks == [64 // quality.JOINED, 1]  # on four cores
    assert got[0].keys() == got[1].keys() and all(got[0][i] == pytest.approx(got[1][i], rel=1e-9) for i in got[0])


def test_every_trusted_text_is_counted_and_calibrates(spark, docs_of):
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % quality.FOLDS
    rng = random.Random(4)
    few = [i for i in range(100, 200) if fold(i)][:3]  # a language of which none is in the first fold
    rows = [(i, " ".join(rng.choices(EN.split(), k=30)), "en") for i in range(30)] + [(i, "perro gato casa " * 3 + str(i), "es") for i in few]
    trusted = spark.createDataFrame([(i,) for i in [*range(20), *few]], "doc_id long")
    texts = {i: t for i, t, _ in rows}
    good = [*range(20), *few]
    scored = {r["id"]: r for r in quality.perplexities(docs_of(rows), trusted, rotate=True).collect()}
    for i, t in texts.items():
        train = [texts[j] for j in good if i not in good or fold(j) != fold(i)]
        assert scored[i]["lp"] == pytest.approx(kneser_ney(train, [t])[0][1], rel=1e-9)
        assert scored[i]["role"] == (quality.CALIBRATE if i in good else quality.PLAIN)
    limits = {r["lang"]: r["threshold"] for r in quality.classify(docs_of(rows), trusted).collect()}
    assert len(set(limits.values())) == 2  # the small language has a threshold of its own


def test_junk_is_rejected_and_clean_text_kept(spark, docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(EN.split(), k=40)), "en") for i in range(80)] + [(100, "A$$$ B%%% C### D&&& " * 12, "en"), (101, "the cat", "xx"), (102, None, "en"), (70, None, "en"), (70, "A$$$ B%%% C### D&&& " * 12, "en"), (None, "the dog and the cat", None)]
    df = docs_of(rows)
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    kept = quality.accepted(df, trusted)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {*range(80), 101, None} and kept.where("doc_id = 70").count() == 1
    none = spark.createDataFrame([], "doc_id long")
    assert quality.accepted(df, none).count() == len(rows) - 2
    assert quality.classify(docs_of([]), trusted).count() == 0


def test_shards_are_near_equal_and_keep_groups(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_RANGES", 64)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab é", k=rng.randint(0, 200)))) for i in range(1500)] + [(2000 + i, "same text " * 10) for i in range(700)] + [(3000, None), (3001, ""), (None, "x"), (None, "x")]
    got = sharding.shard(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    where = {r["doc_id"]: r["shard"] for r in got}
    texts = {}
    for i, t in rows:
        if i is not None and i < 2000:
            texts.setdefault(t, set()).add(where[i])
    assert all(len(x) == 1 for x in texts.values())
    assert len({where[2000 + i] for i in range(700)}) > 1
    assert sharding.shard(docs_of([])).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharding.shard(docs_of([(1, "a")])).collect()] == [(4, 0)]


def test_min_cut_is_the_best_labelling():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda keep: sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, keep, strict=True)) + sum(c for i, j, c in ties if keep[i] != keep[j])  # noqa: B023, E731
        assert cost(html.min_cut(scores, ties)) == pytest.approx(min(cost(k) for k in itertools.product([False, True], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="article-page"><header><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href=x>Menu</a></ul></nav><div id="cookie-notice"><p>We use cookies on this site, as all do.</p></div>
<article><header><h1>The  title &amp; more</h1></header><p>First para with <b>bold</b> text.<br>It goes
 on.<p>Second one.</p><div class="ad">Buy now, it is really good for you.</div><ul><li>An item<li>Another</ul><div class="comments"><p>I like this article very much, thanks.</p></div></article>
<aside>Related things to read.</aside><form><label>Name</label></form><footer>&copy; 2020</footer></body></html>"""


def test_wrappers_of_the_whole_page_do_not_lose_its_article():
    text = "First long paragraph of the article, with a sentence.\nSecond long paragraph of it, which ends here as well."
    body = "".join(f"<p>{line}</p>" for line in text.split("\n"))
    menu = "<nav>Menu Home About</nav>"
    for page in (f"<form id=aspnetForm>{menu}<article>{body}</article></form>", f"<form>{menu}<main>{body}</main></form>", f"<div class='with-sidebar'>{menu}<div>{body}</div></div>", f"<div class=page-header><form><article>{body}</article></form></div>"):
        assert html.main_text(f"<html><body>{page}<footer>Imprint</footer></body></html>") == text
    small = f"<div class=sidebar><article><p>A teaser of another page, which is not its text.</p></article></div><form><p>Write to us, we like to read what you think.</p></form><div class=comments><article><p>{'I think so too, thanks. ' * 30}</p></article></div>"
    assert html.main_text(f"<html><body><article>{body}</article>{small}</body></html>") == text


def test_the_cut_decides_where_scores_alone_are_wrong():
    long = "<p>A long paragraph of the story, with words enough to be told from a menu, which ends here as sentences do.</p>"
    page = f"<html><body><div><span>Home</span></div><div>{long}<p>Yes</p>{long}<p>See it now</p>{long}</div></body></html>"
    found = html.blocks_of(page)
    alone = [b.text for b, s in zip(found, html.scores_of(found), strict=True) if s > 0]
    text = html.main_text(page).split("\n")
    assert "Yes" not in alone and "See it now" not in alone and len(alone) == 3
    assert len(text) == 5 and "Yes" in text and "See it now" in text and "Home" not in text


def test_formulas_stay():
    assert html.main_text("<article><p>Area is <math><mi>a</mi><mo>=</mo><mn>2</mn></math> metres, as it was.</p></article>") == "Area is a=2 metres, as it was."


def test_very_long_pages_take_linear_time():
    rng = random.Random(2)
    body = "".join(f"<div><p>{' '.join(rng.choices(['some', 'words', 'of', 'text'], k=rng.choice([1, 2, 3, 12])))}{rng.choice(['', '.'])}</p></div>" for _ in range(50_000))
    began = time.process_time()
    assert len(html.blocks_of(body)) == 50_000 and html.main_text(body)
    assert time.process_time() - began < 30
    n = 50_000
    scores, ties = [rng.uniform(-2, 2) for _ in range(n)], [(k, k + 1, 1.5) for k in range(n - 1)]
    began = time.process_time()
    html.min_cut(scores, ties)
    assert time.process_time() - began < 30


BROKEN = {
    "closed but not opened": "<div>" * 100_000 + "</section>" * 100_000,
    "vetoes in vetoes": "<div class=ad>x " * 100_000,
    "articles in vetoes": "<div class=ad><article>x " * 50_000,
    "open quotes": '<a "' * 100_000,
    "odd quotes": '<a ">' * 100_001,
    "no end": "<a" * 100_000 + "<!",
    "declarations": "<!" * 100_000,
    "notes": "<!-- " * 100_000,
    "items far from their list": "<ul><li>" + "<div>" * 50_000 + "<li></li>" * 50_000,
    "items in other lists": "<dl><dt>" * 50_000 + "<li></li>" * 50_000,
    "names": '<div class="' + "ad " * 100_000 + '">x',
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_broken_pages_take_linear_time(kind):
    began = time.perf_counter()
    html.main_text(BROKEN[kind])
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    ("extra", "kept"),
    [
        ('<div class="alert"><p>Keep this alert, it is of the article.</p></div>', True),
        ('<div class="feedback-loop"><p>Keep the loop, it is of the article.</p></div>', True),
        ('<p id="social-contract">The social contract is a text of the article.</p>', True),
        ("<svg><text>Label in a drawing</text></svg>", True),
        ("<noscript><p>For readers without scripts.</p></noscript>", True),
        ('<div class="ad">Buy this now</div>', False),
        ('<div class="ad-slot"><p>Buy this now, it is good.</p></div>', False),
        ('<section class="comment-list"><p>First! I like this article.</p></section>', False),
        ("<nav><p>Read this next, it is good.</p></nav>", False),
    ],
)
def test_names_inside_an_article(extra, kept):
    body = "Some words of the article here, which are long enough to count. " * 3
    page = f"<html><body><noscript>Enable scripts.</noscript><article><p>{body}</p>{extra}<p>{body}</p></article></body></html>"
    assert (html.main_text(page).count("\n") == 2) == kept and "Enable" not in html.main_text(page)


def test_text_is_that_of_the_least_energy():
    """Blocks of small pages against every labelling."""
    draw = random.Random(4)
    parts = ["<p>Yes</p>", "<p>A longer text, which ends as a sentence does.</p>", "<div class=ad>Buy</div>", "<article><p>In it.</p>", "</article>", "<nav>Home</nav>", "<li><a>link only</a></li>", "<h2>Head</h2>", "<div>", "</div>", "<div class=alert>Doubtful</div>"]
    for _ in range(60):
        page = "".join(draw.choices(parts, k=10))
        found = html.blocks_of(page)
        scores, last, ties = html.scores_of(found), {}, []
        for k, b in enumerate(found):
            ties += [(k - 1, k, html.NEXT)] if k else []
            ties += [(last[b.parent], k, html.SIBLING)] if b.parent in last else []
            last[b.parent] = k
        energy = lambda keep: sum(-s if k else s for s, k in zip(scores, keep, strict=True)) / 2 + sum(c for i, j, c in ties if keep[i] != keep[j])  # noqa: B023, E731
        least = min(itertools.product([False, True], repeat=len(found)), key=energy, default=())
        assert html.main_text(page) in ("\n".join(b.text for b, k in zip(found, keep, strict=True) if k) for keep in itertools.product([False, True], repeat=len(found)) if energy(keep) <= energy(least) + 1e-9)


def test_classifier_is_fitted_on_marked_pages(spark):
    rows = [(k, "u", f"<nav><a href=x>Link number {k}</a></nav><article><p>Paragraph {k} tells a story of some length, and it ends.</p></article>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = html.learn(pages)
    assert w == html.learn(pages.repartition(5)) and w[1] > 0 > w[2]
    assert html.learn(pages.limit(0)) == html.DEFAULT == html.learn(pages.selectExpr("page_id", "url", "'<p>x</p>' html"))


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text alone, with a sentence in it that is long enough."), (5, "u", "<article>" + "<p>Many words are here.</p>" * 3000), (5, "u", "<nav>x</nav>"), (None, "u", "<p>&lt;b&gt; &#233; &nbsp; is decoded once, and so it should be.</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert got[0]["text"] == "The title & more\nFirst para with bold text. It goes on.\nSecond one.\nAn item\nAnother"
    assert [r["text"] for r in got[1:4]] == ["", "", rows[3][2]]
    assert got[4]["text"].count("\n") == 2999 and got[5]["text"] == "" and got[6]["text"] == "<b> é is decoded once, and so it should be."
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(df.limit(0)).count() == 0
