"""Ids of whole texts by the tokenizers library, each distinct piece encoded once per worker."""

from __future__ import annotations

import unicodedata

import numpy as np

from llm import flat, pieces

_encoders: dict[tuple[str, str], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """``style`` "blank": byte-level pieces with a leading blank; "lower": NFC, lower case, white space dropped."""

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.style = style
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.table = pieces.PieceTable(self._encode)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [x.encode() for x in added]
        self.marks = b"<|"
        self.safe: np.ndarray | None = None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, found: list[bytes]) -> list[list[int]]:
        tokenize, letters, lower = self.tokenizer.model.tokenize, self.letters, self.style == "lower"
        out = []
        for p in found:
            if p[:1] == b"'":
                out.append(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids)
                continue
            if lower:
                p = "".join([c.lower() for c in p.decode()]).encode() if max(p) > 127 else p.lower()
            out.append([t.id for t in tokenize(p.decode("latin-1").translate(letters))])
        return out

    def _plain(self, points: np.ndarray) -> np.ndarray:
        """For "lower": whether each code point keeps its place and class under NFC and lower-casing."""
        n = 0x3000 if len(points) == 0 or points.max() < 0x3000 else 0x110000
        if self.safe is None or len(self.safe) < n:
            kind = pieces.classes(np.arange(n, dtype=np.uint32))
            safe = np.zeros(n, bool)
            for c in range(n):
                if 0xD800 <= c < 0xE000:
                    continue
                x = chr(c)
                y = x.lower()
                safe[c] = unicodedata.is_normalized("NFC", x) and not unicodedata.combining(x) and len(y) == 1 and ord(y) < n and kind[ord(y)] == kind[c] and unicodedata.is_normalized("NFC", y) and not 0x1100 <= c < 0x1200
            self.safe = safe
        return self.safe[points]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and after the last)."""
        starts, ends, first, points = pieces.split(data, offsets, self.style == "blank")
        ids, sizes = self.table.ids(data, starts, ends)
        bounds = pieces.row_ids(ids, sizes, first)
        raw, odd = data.tobytes(), set()
        if self.marks in raw:
            at = raw.find(self.marks)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(self.marks, at + 1)
        if self.style == "lower":
            rows = pieces.decode(data, offsets)[2] if len(points) != len(data) else offsets
            bad = np.flatnonzero(~self._plain(points))
            odd |= set((np.searchsorted(rows, bad, side="right") - 1).tolist())
        return pieces.with_odd(ids, bounds, {k: self.whole(raw[offsets[k] : offsets[k + 1]].decode()) for k in odd})


def encoder(path: str, style: str) -> Encoder:
    """One encoder per worker process, so that its table serves all tasks."""
    if (path, style) not in _encoders:
        _encoders[path, style] = Encoder(path, style)
    return _encoders[path, style]


def blocks(values, path: str, style: str):
    """(first row, row after the last, ids, bounds) of the blocks of a text column."""
    e = encoder(path, style)
    for start, stop, data, offsets in flat.blocks(values):
        yield start, stop, *e.block(data, offsets)
