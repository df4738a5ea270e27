"""Flat pre-tokenisation and a bounded table from distinct pieces to token ids.

The tokenizers at hand split a text with a pattern and then encode each piece
by itself. So a text's ids are those of its pieces, and each distinct piece is
encoded once. Splitting runs on character classes of the whole block at once;
texts for which that could differ from the tokenizer's own splitting are left
to it whole (``odd`` rows).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from llm import flat

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_FEW = 0x3000
_tables: dict[str, np.ndarray] = {}


def classes(points: np.ndarray) -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    kind = "few" if len(points) == 0 or points.max() < _FEW else "all"
    if kind not in _tables:
        n = _FEW if kind == "few" else 0x110000
        found = np.zeros(n, np.uint8)
        text = "".join(map(chr, [*range(min(n, 0xD800)), *range(0xE000, n)]))
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, text):
                lift = 0x800 if m.start() >= 0xD800 else 0
                found[m.start() + lift : m.end() + (0x800 if m.end() > 0xD800 else 0)] = value
        _tables[kind] = found
    return _tables[kind][points]


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, byte position of each and of the end, row offsets in code points)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, np.arange(len(data) + 1), offsets
    first = (data & 0xC0) != 0x80
    places = np.append(np.flatnonzero(first), len(data))
    return points, places, np.searchsorted(places, offsets)


def split(data: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends in bytes, first piece of each row and after the last, code points).

    With ``spaces``, pieces are those of a pattern whose words take one leading
    blank; without, white space is dropped and each number is its own piece. A
    lone apostrophe and the letters after it stay together: whoever encodes the
    piece splits off a contraction.
    """
    points, places, rows = decode(data, offsets)
    n = len(points)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64), points
    kind = classes(points)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    row_edge = np.zeros(n + 1, bool)
    row_edge[rows] = True
    edge |= row_edge
    # a lone apostrophe (no blank before it) joins the letters after it
    quote = np.flatnonzero((points == 39) & edge[:n] & edge[1:])
    quote = quote[quote < n - 1]
    quote = quote[(kind[quote + 1] == LETTER) & ~row_edge[quote + 1]]
    if spaces:
        before = points[quote - 1]
        quote = quote[(quote == 0) | row_edge[quote] | (before != 32)]
    edge[quote + 1] = False
    if spaces:
        # the last of a run of white space before other text: a blank joins that text, anything else stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_edge[1:n])
        edge[last] = True
        edge[last[points[last] == 32] + 1] = False
    else:
        edge[:n] |= kind == NUMBER
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    if not spaces:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return places[starts], places[ends], np.searchsorted(starts, rows), points


class PieceTable:
    """Distinct pieces with their ids. Holds at most ``limit`` pieces: the less used half goes beyond it."""

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self):
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.pending: dict[int, bytes] = {}

    def _shrink(self):
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        start, size = self.start[keep], self.size[keep]
        self.pool = self.pool[spread(start, size)]
        self.keys, self.size, self.used = self.keys[keep], size, self.used[keep] // 2
        self.start = np.cumsum(size) - size

    def trim(self) -> None:
        """Make room; only between blocks whose pieces are resolved."""
        if len(self.keys) > self.limit:
            self._shrink()

    def note(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, key of each piece); new pieces wait for settle()."""
        keys, first, back, counts = np.unique(flat.span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == keys[inner]
        self.used[at[known]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            for k, s, e in zip(keys[new].tolist(), starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True):
                if k not in self.pending:
                    self.pending[k] = raw[s:e]
        return keys, back.astype(np.int32)

    def settle(self) -> None:
        """Encode what waits."""
        if not self.pending:
            return
        keys = np.fromiter(self.pending, np.uint64, len(self.pending))
        found = self.encode(list(self.pending.values()))
        self.pending = {}
        size = np.fromiter(map(len, found), np.int32, len(found))
        joined = np.fromiter((x for ids in found for x in ids), np.uint32, int(size.sum()))
        start = len(self.pool) + np.cumsum(size) - size
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.start = np.insert(self.start, where, start[order])
        self.size = np.insert(self.size, where, size[order])
        self.used = np.insert(self.used, where, 1)
        self.keys = np.insert(self.keys, where, keys[order])
        self.pool = np.concatenate([self.pool, joined])

    def resolve(self, keys: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        place = np.searchsorted(self.keys, keys)[back]
        size = self.size[place]
        return self.pool[spread(self.start[place], size)], size

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As resolve(), for one block."""
        self.trim()
        noted = self.note(data, starts, ends)
        self.settle()
        return self.resolve(*noted)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of every i, in a row."""
    total = np.cumsum(size, dtype=np.int64)
    if len(total) == 0:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(start - total + size, size)


def row_ids(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First id of each row and after the last, from pieces' sizes and rows' first pieces."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[first]


def with_odd(ids: np.ndarray, bounds: np.ndarray, odd: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Put other ids in place of those of some rows."""
    if not odd:
        return ids, bounds
    parts = [odd.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(bounds) - 1)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
