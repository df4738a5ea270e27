"""C# text as tokens: one Arrow pass; everything after it works on rows of tokens."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F

#: Stands in a string's text for a value that is only known at run time.
HOLE = "\x01"
TOKENS = "array<struct<kind:string,value:string,line:int,end_line:int,holes:int,block:int,match:int>>"
#: Tokens that are held as Python objects before they become Arrow columns.
PACKED = 100_000
_TOKEN = re.compile(r"""(?P<note>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?)|(?P<skip>\A[ \t]*\#[^\n]*|\n(?:[ \t]*\#[^\n]*)?|[^\S\n]+)|(?P<str>(?:\$+@?|@\$?)?"(?:"")?)|(?P<char>'(?:\\.|[^'\\\n])+'?)|(?P<id>@?[^\W\d]\w*)|(?P<num>\d\w*(?:\.\d\w*)?)|(?P<op>\+=|\+\+|=>|[=!<>]=|&&|\|\||\?\?|.)""", re.S)
_PLAIN = re.compile(r'[^"\\{}\n]+|\\u[0-9A-Fa-f]{4}|\\.|""|\{\{|\}\}|["{}\n\\]', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": " "}
_ITEM = re.compile(r"\{\d+(?:,\s*-?\d+)?(?::[^{}]*)?\}")


def _hole_end(text: str, at: int) -> int:
    """The place after the brace that closes a hole whose content begins at ``at``; strings and braces inside may nest."""
    depth = 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        if m["str"]:
            at = _string(text, m)[0]
        elif m["op"] in ("{", "}"):
            depth += 1 if m["op"] == "{" else -1
            if depth == 0:
                return at
    return at


def _raw(text: str, at: int, dollars: int) -> tuple[int, str, int]:
    """A raw string whose quotes begin at ``at``: as many quotes end it; its holes open with as many braces as it has dollar signs."""
    quotes = re.compile('"+').match(text, at).end() - at
    close = text.find('"' * quotes, at + quotes)
    end = len(text) if close < 0 else close + quotes
    body = text[at + quotes : close if close >= 0 else len(text)]
    lines = body.split("\n")
    if len(lines) > 1 and not lines[0].strip():
        body = "\n".join(lines[1:-1] if not lines[-1].strip() else lines[1:])
    out, holes, k = [], 0, 0
    while dollars:
        opened = body.find("{" * dollars, k)
        if opened < 0:
            break
        while body.startswith("{", opened + dollars):
            opened += 1
        out += [body[k:opened], HOLE]
        holes += 1
        k = min(len(body), _hole_end(body, opened + dollars) + dollars - 1)
    return end, "".join(out) + body[k:], holes


def _string(text: str, m: re.Match) -> tuple[int, str, int]:
    """(place after it, text with HOLE for run-time values, number of holes) of the string that ``m`` opens."""
    prefix = m["str"].rstrip('"')
    dollars, verbatim = prefix.count("$"), "@" in prefix
    quote = m.start() + len(prefix)
    if text.startswith('"""', quote) and not verbatim:
        return _raw(text, quote, dollars)
    at, out, holes = quote + 1, [], 0
    while at < len(text):
        p = _PLAIN.match(text, at)
        piece, at = p[0], p.end()
        if piece == '""' and verbatim:
            out.append('"')
        elif piece[0] == '"':
            at = p.start() + 1
            break
        elif piece == "\n" and not verbatim:
            at -= 1
            break
        elif piece[0] == "\\" and verbatim:
            out.append("\\")
            at = p.start() + 1
        elif piece[0] == "\\" and len(piece) > 1:
            out.append(chr(int(piece[2:], 16)) if len(piece) == 6 else _ESCAPES.get(piece[1], piece[1]))
        elif dollars and piece in ("{{", "}}"):
            out.append(piece[0])
        elif dollars and piece == "{":
            at = _hole_end(text, at)
            out.append(HOLE)
            holes += 1
        else:
            out.append(piece)
    value = "".join(out)
    if not dollars:
        value, holes = _ITEM.subn(HOLE, value)
    return at, value, holes


def scan(text: str):
    """(kind, begin, end, value, holes) of every stretch of a text: str, char, id, num, op, note (a comment) or skip (blanks and directives)."""
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        end, value, holes = _string(text, m) if m["str"] else (m.end(), m[0], 0)
        yield m.lastgroup, at, end, value, holes
        at = end


def lex(text: str | None) -> list[tuple]:
    """(kind, value, line, end_line, holes, block, match) of the tokens of a text.

    kind is str, char, id, num or op. block is the place of the innermost open bracket's token, -1 outside all; a bracket itself is in the block around it,
    and match is the place of its partner's token, -1 without one. An unclosed string ends with its line, an unclosed raw or verbatim one with the text.
    """
    out, open_, line, text = [], [], 1, text or ""
    for kind, begin, end, value, holes in scan(text):
        end_line = line + text.count("\n", begin, end)
        if kind not in ("skip", "note"):
            match = -1
            if kind == "op" and value in ")]}" and open_:
                match = open_.pop()
                out[match][6] = len(out)
            out.append([kind, value.removeprefix("@") if kind == "id" else value, line, end_line, holes, open_[-1] if open_ else -1, match])
            if kind == "op" and value in "([{":
                open_.append(len(out) - 1)
        line = end_line
    return [tuple(x) for x in out]


def tokens_of(column):
    """The tokens of a column of C# texts as an array; a null text has none."""
    struct = pa.struct([("kind", pa.string()), ("value", pa.string()), *[(name, pa.int32()) for name in ("line", "end_line", "holes", "block", "match")]])

    def packed(counts: list[int], found: list[tuple]) -> pa.Array:
        columns = zip(*found, strict=True) if found else [()] * len(struct)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, struct, strict=True)], fields=list(struct))
        return pa.ListArray.from_arrays(pa.array(list(accumulate(counts, initial=0)), pa.int32()), values)

    @F.arrow_udf(TOKENS)
    def run(text: pa.Array) -> pa.Array:
        done, counts, found = [], [], []
        for x in text:
            tokens = lex(x.as_py())
            counts.append(len(tokens))
            found += tokens
            if len(found) >= PACKED:
                done.append(packed(counts, found))
                counts, found = [], []
        return pa.concat_arrays([*done, packed(counts, found)])

    return run(column)
