"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A logistic classifier
gives each block a score for being content; a positive score becomes the
capacity of an edge from the source, a negative one of an edge to the sink.
Its weights for length, links, punctuation, tags and position are fitted on the blocks of SAMPLE pages at most (those with the
smallest hashes) that stand in an article or in boilerplate by their elements; without both kinds the default weights hold.
What they say counts for STRUCTURE at most, the containers around a block for a bounded weight on top.
A form or a container named like boilerplate is only vetoed for now: the veto falls if no article stands outside of
vetoed containers and this one holds most of the page's text, or an article inside it; a main inside always counts.
Inside an article only names that consist of nothing but such words and words of layout veto; other names with such a word
take a bounded weight from the score, and the cut decides.
Blocks next to each other, and the next blocks of the same container, are tied
by smoothness edges. The blocks on the source's side of the minimum cut are the text.

A null or empty page has an empty text, as has one in which nothing looks like content. Repeated rows, and
null ids or urls, come back as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of HTML, and words that sites use in class, id and role.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template iframe".split())
OUTSIDE = set("nav footer aside form button select menu dialog search head label input optgroup".split())
INSIDE = set("article main".split())
NOT_TEXT = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus dropdown feedback footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommend recommended related reply replies respond rss search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert complementary contentinfo responses discussion".split())
#: Words of NOT_TEXT that also name parts of articles, and words that only say how something is laid out.
DOUBTFUL = set("alert feedback social tags skip search header copyright reply responses respond discussion recommend recommended related banner form contentinfo complementary".split())
LAYOUT = set("area bar block bottom box button buttons container group inline inner item items label left link links list outer panel right row section slot text top unit wrap wrapper".split())
#: Words of lists of other texts, whose articles are not the page's.
OTHERS = set("comment comments commentlist disqus discussion reply replies respond responses related recommend recommended".split())
TEXT = set("article content story post entry main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_MARK = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_NOTE = re.compile(r"(<!--|<!\[CDATA\[)()")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Weights of containers: of navigation and the like, of an article, of a doubtful name inside an article. Bound of what structure says.
OUT, IN, NAMED, STRUCTURE = -6.0, 4.0, -2.5, 3.0
#: Default weights of structure: constant, log of words, links (and that in an article), sentence end, list item, heading, rights notice, distance from the page's middle.
DEFAULT = (-1.6, 0.7, -4.0, 3.0, 0.8, -0.6, 0.4, -3.0, 0.0)
#: Pages whose blocks the classifier is fitted on at most, blocks of each, steps of the fit, ridge.
SAMPLE, SAMPLE_BLOCKS, FIT_STEPS, RIDGE = 1000, 200, 12, 1.0
#: Smoothness: blocks next to each other, and neighbours in one container.
NEXT, SIBLING = 0.4, 0.6


class Block:
    __slots__ = ("text", "linked", "tag", "parent", "side", "veto", "article", "named")

    def __init__(self, text, linked, tag, parent, side, veto=None, article=0, named=False):
        self.text, self.linked, self.tag, self.parent, self.side, self.veto, self.article, self.named = text, linked, tag, parent, side, veto, article, named


class Veto:
    """A container that is vetoed for now: its number, the vetoed container around it, and the text below it."""

    __slots__ = ("number", "above", "held")

    def __init__(self, number, above):
        self.number, self.above, self.held = number, above, 0


class Element:
    __slots__ = ("tag", "number", "side", "veto", "article", "named")

    def __init__(self, tag, number, side, veto, article, named):
        self.tag, self.number, self.side, self.veto, self.article, self.named = tag, number, side, veto, article, named


def _names(tokens: set[str]) -> bool:
    """Whether one of these names says nothing but that something is no text."""
    for token in tokens:
        words = set(_WORD.findall(token))
        if words & (NOT_TEXT - DOUBTFUL) and words <= NOT_TEXT | LAYOUT or words & {"comment", "comments", "commentlist", "disqus"}:
            return True
    return False


def _side(tag: str, attrs: str, above: int) -> tuple[int, bool, bool]:
    """(-1 in boilerplate, 1 in an article, 0 in neither; whether the element is vetoed until all blocks are known; whether an element of an article has a doubtful name)."""
    if above < 0:
        return above, False, False
    words: set[str] = set()
    role: set[str] = set()
    tokens: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return -1, False, False
        if name in ("class", "id", "role"):
            (role if name == "role" else words).update(_WORD.findall(value))
            if name != "role":
                tokens.update(value.split())
    every = words | role
    if tag in OUTSIDE - {"form"} or tag in ("header", "noscript") and above == 0:
        return -1, False, False
    if above == 1:
        if role & (NOT_TEXT - DOUBTFUL) or _names(tokens):
            return -1, False, False
        return 1, tag == "form", bool(every & NOT_TEXT) and tag not in INSIDE
    veto = tag == "form"
    if tag not in ("html", "body") and every & NOT_TEXT and tag not in INSIDE:
        if role & (NOT_TEXT - {"form"}) or every & OTHERS:
            return -1, False, False
        veto = True
    if veto:
        return above, True, False
    if tag in INSIDE or every & TEXT and tag != "body":
        return 1, False, False
    return above, False, False


def _settle(found: list[Block], vetoes: list[Veto]) -> None:
    """Side -1 for blocks below a veto that stands. A container around others holds what they hold, so the innermost veto without an article below it decides."""
    if not vetoes:
        return
    real = not any(b.side == 1 and b.veto is None for b in found)
    total = sum(len(b.text) for b in found if b.side >= 0)
    for b in found:
        if b.veto is not None and b.side >= 0:
            b.veto.held += len(b.text)
    for v in reversed(vetoes):  # those inside come later
        if v.above is not None:
            v.above.held += v.held
    for b in found:
        if b.veto is not None and not (real and (b.article > b.veto.number or 2 * b.veto.held > total)):
            b.side = -1


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, scripts, styles and comments left out, in time linear in the page.

    A tag whose quote never ends is text, and from then on quotes do not count in the page's tags.
    """
    found: list[Block] = []
    stack = [Element("", 0, 0, None, 0, False)]
    opened: dict[str, int] = {}  # how many of each element are open
    places: dict[str, list[int]] = {tag: [] for tag in CLOSES}  # of the open elements that matter to what this tag closes by itself
    vetoes: list[Veto] = []
    text: list[str] = []
    number, links, linked, at, end = 0, 0, 0, 0, len(page)
    last, quotes = page.rfind(">"), True

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                e = stack[-1]
                parent = stack[-2].number if len(stack) > 1 and e.tag in ("p", "li", "dd", "dt", "td", "th") else e.number
                found.append(Block(joined, min(linked, len(joined)), e.tag, parent, e.side, e.veto, e.article, e.named))
            text.clear()
        linked = 0

    def cut(size):
        for e in stack[size:]:
            opened[e.tag] -= 1
        del stack[size:]
        for kept in places.values():
            while kept and kept[-1] >= size:
                kept.pop()

    def say(piece):
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece)

    while at < end:
        m = _MARK.search(page, at) if at <= last else _NOTE.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            say(page[at:stop])
        if not m:
            break
        at = m.end()
        if m[0] == "<!--" or m[0] == "<![CDATA[":
            closing = page.find("-->" if m[0] == "<!--" else "]]>", at)
            at = closing + 3 if closing >= 0 else end
            if m[0] == "<![CDATA[":
                text.append(" ")
            continue
        if m[2] is None:
            at = page.find(">", at) + 1 or end
            continue
        rest = _REST.match(page, at).end() if quotes else page.find(">", at)
        if rest >= end or rest < 0 or page[rest] != ">":
            quotes = False
            say("<")
            at = stop + 1
            continue
        attrs, at, tag = page[at:rest], rest + 1, m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                flush()
                if opened.get(tag):
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    cut(k)
                    links = 0
            continue
        if tag in RAW and not attrs.endswith("/"):
            if tag in BLOCKS:
                flush()
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            flush()
            links = 0
            if tag in CLOSES:
                near = places[tag]
                while near:
                    name = stack[near[-1]].tag
                    if name != "p" and name not in CLOSES[tag]:
                        break
                    cut(near[-1])
                    if name != "p":
                        break
            else:
                while stack[-1].tag == "p":
                    cut(len(stack) - 1)
            if tag not in VOID:
                number += 1
                above = stack[-1]
                side, veto, named = _side(tag, attrs, above.side)
                inside = tag in INSIDE and side == 1
                around = None if inside and tag == "main" else above.veto
                if veto:
                    around = Veto(number, around)
                    vetoes.append(around)
                for other, kept in places.items():
                    if tag == "p" or tag in CLOSES[other] or tag in SCOPES[other]:
                        kept.append(len(stack))
                opened[tag] = opened.get(tag, 0) + 1
                stack.append(Element(tag, number, side, around, number if inside else above.article, side == 1 and (named or above.named)))
    flush()
    _settle(found, vetoes)
    return found


def structure(b: Block, place: float) -> list[float]:
    """The classifier's view of a block at this place (0 to 1) of its page, whatever contains it."""
    words = b.text.count(" ") + 1
    linked = b.linked / len(b.text)
    return [
        1.0,
        min(6.0, words.bit_length()),
        linked,
        linked * (b.side > 0),
        float(b.text[-1] in ".!?…:;\"'”»)"),
        float(b.tag == "li"),
        float(b.tag[:1] == "h" and b.tag[1:].isdigit()),
        float(("©" in b.text or "All rights reserved" in b.text) and words < 30),
        abs(2 * place - 1),
    ]


def scores_of(found: list[Block], weights=DEFAULT) -> list[float]:
    """The classifier: above 0 for content."""
    out, n = [], max(1, len(found) - 1)
    for k, b in enumerate(found):
        s = sum(w * x for w, x in zip(weights, structure(b, k / n), strict=True))
        out.append(max(-STRUCTURE, min(STRUCTURE, s)) + (OUT if b.side < 0 else IN + NAMED * b.named if b.side > 0 else 0.0))
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton's steps; the default ones if ``y`` has one value only."""
    if len(y) == 0 or y.min() == y.max():
        return DEFAULT
    w = np.zeros(x.shape[1])
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - RIDGE * w
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
    return tuple(np.round(w, 6).tolist())


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights fitted on at most ``sample`` pages, SAMPLE_BLOCKS blocks of each: numbers of that bound are all the driver gets."""

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                found = blocks_of(page)
                n = max(1, len(found) - 1)
                step = -(-len(found) // SAMPLE_BLOCKS) if found else 1
                # links inside an article are no sign against it: that column is for use, not for the fit
                rows += [structure(b, k / n)[:3] + [0.0] + structure(b, k / n)[4:] + [float(b.side > 0)] for k, b in list(enumerate(found))[::step] if b.side]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    hashed = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return DEFAULT
    some = hashed.where(F.col("h") <= last).groupBy("h").agg(F.first("html").alias("html")).select("html")
    rows = sorted(r["x"] for r in some.mapInArrow(run, "x array<double>").collect())
    if not rows:
        return DEFAULT
    every = np.array(rows)
    w = fit(every[:, :-1], every[:, -1])
    return w if w is DEFAULT else (*w[:3], -0.75 * w[2], *w[4:])


def min_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side.

    A node whose capacity outweighs all its ties stays on its own side: its ties become capacities of its
    neighbours. What is left is cut by blocking flows along layers of shortest paths.
    """
    n, eps = len(scores), 1e-9
    cap = list(map(float, scores))
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    held = [0.0] * n
    for i, j, c in ties:
        around[i].append((j, c))
        around[j].append((i, c))
        held[i] += c
        held[j] += c
    side: list = [None] * n
    queue = [i for i in range(n) if abs(cap[i]) > held[i] + eps]
    while queue:
        i = queue.pop()
        if side[i] is not None:
            continue
        side[i] = cap[i] > 0
        for j, c in around[i]:
            if side[j] is None:
                cap[j] += c if side[i] else -c
                held[j] -= c
                if abs(cap[j]) > held[j] + eps:
                    queue.append(j)
    edges: list[list[list]] = [[] for _ in range(n)]  # [to, capacity left, the reverse edge]
    for i, j, c in ties:
        if side[i] is None and side[j] is None:
            a, b = [j, c, None], [i, c, None]
            a[2], b[2] = b, a
            edges[i].append(a)
            edges[j].append(b)
    free = [i for i in range(n) if side[i] is None]
    supply, demand = [max(0.0, c) for c in cap], [max(0.0, -c) for c in cap]
    while True:
        layer = {i: 0 for i in free if supply[i] > eps}
        front, goals = list(layer), [i for i in layer if demand[i] > eps]
        while front and not goals:
            following = []
            for i in front:
                for to, left, _ in edges[i]:
                    if left > eps and to not in layer:
                        layer[to] = layer[i] + 1
                        following.append(to)
            front = following
            goals = [i for i in front if demand[i] > eps]
        if not goals:
            return [x if x is not None else k in layer for k, x in enumerate(side)]
        last = layer[goals[0]]
        tried = dict.fromkeys(layer, 0)
        for start in [i for i in layer if layer[i] == 0]:
            path = [start]
            taken: list[list] = []
            while path and supply[start] > eps:
                i = path[-1]
                if layer[i] == last and demand[i] > eps:
                    flow = min([supply[start], demand[i], *(e[1] for e in taken)])
                    supply[start] -= flow
                    demand[i] -= flow
                    for e in taken:
                        e[1] -= flow
                        e[2][1] += flow
                    full = next((k for k, e in enumerate(taken) if e[1] <= eps), len(taken))
                    del path[full + 1 :], taken[full:]
                    continue
                step = None
                while tried[i] < len(edges[i]):
                    e = edges[i][tried[i]]
                    if e[1] > eps and layer.get(e[0]) == layer[i] + 1 and layer[i] < last:
                        step = e
                        break
                    tried[i] += 1
                if step is not None:
                    path.append(step[0])
                    taken.append(step)
                else:
                    path.pop()
                    if taken:
                        taken.pop()
                        tried[path[-1]] += 1


def main_text(page: str | None, weights=DEFAULT) -> str:
    found = blocks_of(page or "")
    if not found:
        return ""
    ties, last = [], {}
    for k, b in enumerate(found):
        if k:
            ties.append((k - 1, k, NEXT))
        if b.parent in last:
            ties.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    keep = min_cut(scores_of(found, weights), ties)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page."""
    weights = learn(pages, html_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x, weights) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return plain.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of the whole ``pages`` table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
