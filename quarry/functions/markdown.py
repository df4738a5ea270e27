"""Markdown as blocks: a table function whose state is the block that is open."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")


class Blocks:
    """Rows (block, kind, level, info, line, end_line, text) of one Markdown text.

    kind is heading, code, table, list, quote, rule or paragraph; level is a heading's level or the number of a list's items or a table's
    lines, else 0. A fence that is never closed runs to the end. A list goes on over indented lines. A null or empty text has no blocks.
    """

    def eval(self, text: str):
        number, lines, at = 0, (text or "").replace("\r\n", "\n").split("\n"), 0
        while at < len(lines):
            line, begin = lines[at], at
            at += 1
            if not line.strip():
                continue
            kind, level, info, body = "paragraph", 0, None, line
            if m := _FENCE.match(line):
                mark = m[1]
                while at < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[at]):
                    at += 1
                kind, info, body = "code", m[2] or None, "\n".join(lines[begin + 1 : at])
                at = min(at + 1, len(lines))
            elif m := _HEADING.match(line):
                kind, level, body = "heading", len(m[1]), m[2] or ""
            elif _RULE.match(line):
                kind, body = "rule", ""
            else:
                kind, goes = self._kind(line)
                while at < len(lines) and lines[at].strip() and goes(lines[at]):
                    at += 1
                body = "\n".join(lines[begin:at])
                if kind == "list":
                    level = sum(bool(_ITEM.match(x)) for x in lines[begin:at])
                elif kind == "table":
                    level = at - begin
                elif kind == "quote":
                    body = "\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[begin:at])
            number += 1
            yield number, kind, level, info, begin + 1, at, body

    @staticmethod
    def _kind(line: str):
        if line.lstrip().startswith("|"):
            return "table", lambda x: x.lstrip().startswith("|")
        if line.lstrip().startswith(">"):
            return "quote", lambda x: x.lstrip().startswith(">")
        if _ITEM.match(line):
            return "list", lambda x: _ITEM.match(x) or x.startswith((" ", "\t"))
        return "paragraph", lambda x: not (_FENCE.match(x) or _HEADING.match(x) or _RULE.match(x) or _ITEM.match(x) or x.lstrip().startswith(("|", ">")))


def blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind, level, info, line, end_line, text) of the blocks of Markdown texts."""
    split = F.udtf(Blocks, returnType="block int, kind string, level int, info string, line int, end_line int, body string")
    found = rows.select(F.col(key), F.col(text).alias("__text")).lateralJoin(split(F.col("__text").outer()))
    return found.drop("__text").withColumnRenamed("body", "text")
