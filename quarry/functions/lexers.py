"""Lexers that need state: they run on whole texts in Arrow batches."""


import re

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions.csharp import scan

# One alternative per token, strings first so that comment marks inside them do not count.
_VB = re.compile(r'("(?:[^"\n]|"")*")|(\'[^\n]*|\bREM\b[^\n]*)', re.I)
_WEB = re.compile(r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`)|(<!--.*?(?:-->|$)|@\*.*?(?:\*@|$)|/\*.*?(?:\*/|$)|(?<!:)//[^\n]*)', re.S)
_RULES = {"vb": _VB, "web": _WEB}


def _blank(text: str) -> str:
    """Blanks of the same length; line breaks stay."""
    return re.sub(r"[^\n]", " ", text)


def _stretches(text: str, language: str):
    """(begin, end, is comment) of the literals and comments of a text."""
    if language == "cs":  # raw strings and holes of interpolated ones nest, which no pattern follows
        for kind, begin, end, *_ in scan(text):
            if kind in ("str", "char", "note"):
                yield begin, end, kind == "note"
    else:
        for m in _RULES[language].finditer(text):
            yield *m.span(), m[1] is None


def strip_text(text: str | None, language: str = "cs", strings: bool = False) -> str | None:
    """The text with comments (and string contents) blanked, every character in its place."""
    if text is None:
        return None

    out, at = [], 0
    for begin, end, comment in _stretches(text, language):
        found = text[begin:end]
        if comment:
            found = _blank(found)
        elif strings and len(found) > 1:
            found = found[0] + _blank(found[1:-1]) + found[-1]
        out += [text[at:begin], found]
        at = end
    return "".join(out) + text[at:]


def spans_of(line: str | None, language: str = "cs") -> list[tuple[int, int]]:
    """(start, end) of the string literals of a line."""
    return [(begin, end) for begin, end, comment in _stretches(line or "", language) if not comment]


def strip_comments(language: str = "cs", strings: bool = False):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: strip_text(x, language, strings))

    return run


def code_match(pattern: str, language: str = "cs"):
    """Whether the pattern matches somewhere outside string literals."""
    rx = re.compile(pattern)

    @F.pandas_udf("boolean")
    def run(line: pd.Series) -> pd.Series:
        def one(x):
            spans = spans_of(x, language)
            return any(not any(a < m.start() < b for a, b in spans) for m in rx.finditer(x or ""))

        return line.map(one)

    return run


def multiline(pattern: str):
    """Lines (from 1) on which matches over the whole text start."""
    rx = re.compile(pattern, re.S)

    @F.pandas_udf("array<int>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [(x or "").count("\n", 0, m.start()) + 1 for m in rx.finditer(x or "")])

    return run


def lines_of_code(language: str = "cs"):
    """Lines with something other than comments and blanks."""

    @F.pandas_udf("int")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: sum(1 for line in (strip_text(x, language) or "").split("\n") if line.strip()))

    return run


def block_end(text: str, start: int, language: str = "cs") -> int:
    """The place after the brace that closes the first one at or after ``start``, or -1."""
    depth, code = 0, strip_text(text, language, True)
    for k in range(start, len(code)):
        if code[k] == "{":
            depth += 1
        elif code[k] == "}":
            depth -= 1
            if depth == 0:
                return k + 1
    return -1
