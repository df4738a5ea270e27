"""Settings by path: nested YAML, environment files over base files, and what settings point to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S

_PAIR = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[{"'&*!|>%@`-][^#]*?|-[^\s#][^#]*?)[ \t]*:(?:[ \t]+(.*)|)$""")


def _scalar(text: str) -> str:
    """The value without quotes and the comment after it."""
    text = text.strip()
    if text[:1] in "\"'" and (end := text.find(text[0], 1)) > 0:
        return text[1:end]
    return re.split(r"(?:^|\s)#", text)[0].strip()


def yaml_rows(text: str | None) -> list[tuple[str, str, int]]:
    """(path, value, line) of the leaves of a YAML text; names and places in lists are joined by a colon.

    Block style with a stack of indents; values in flow style ([..], {..}) are kept as text. A block scalar (| or >) is
    its lines, joined by a line break or a blank. Comments, document marks and lines that are no YAML are left out.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[list] = []  # column, kind (map, seq, open for a name without value yet, item of a list), path, number of the last item
    lines = (text or "").split("\n")
    at = 0

    def close(column: int, kinds: tuple[str, ...]) -> list[str]:
        """Leave what ends at this column, and the path of what is around it."""
        while stack and (stack[-1][0] > column or stack[-1][0] == column and stack[-1][1] in kinds):
            stack.pop()
        return stack[-1][2] if stack else []

    while at < len(lines):
        line, number = lines[at].rstrip("\r"), at + 1
        at += 1
        body = line.strip()
        if not body or body.startswith("#") or body in ("---", "..."):
            continue
        column, path = len(line) - len(line.lstrip(" ")), None
        while body.startswith("- ") or body == "-":
            around = close(column, ("item",))
            if not stack or stack[-1][1] != "seq" or stack[-1][0] != column:
                stack.append([column, "seq", around, -1])
            stack[-1][3] += 1
            path = [*stack[-1][2], str(stack[-1][3])]
            stack.append([column, "item", path, 0])
            rest = body[1:].lstrip()
            column, body = column + len(body) - len(rest), rest
        m = _PAIR.match(body)
        if not m:
            if path is not None and body:
                out.append((":".join(path), _scalar(body), number))
            continue
        around = close(column, ("open", "item", "seq"))
        if not stack or stack[-1][1] != "map" or stack[-1][0] != column:
            stack.append([column, "map", around, 0])
        whole, value = [*stack[-1][2], m[1].strip("\"'").strip()], (m[2] or "").strip()
        if re.match(r"^[|>][+-]?\d*(?:\s+#.*)?$", value):
            held = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > column):
                held.append(lines[at].strip())
                at += 1
            out.append((":".join(whole), ("\n" if value[0] == "|" else " ").join(held).strip(), number))
        elif value and not value.startswith("#"):
            out.append((":".join(whole), _scalar(value), number))
        else:
            stack.append([column, "open", whole, 0])
    return out


def yaml_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value, line_no) of the leaves of YAML texts; a null text has none."""

    @F.pandas_udf("array<struct<path:string,value:string,line_no:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [dict(zip(("path", "value", "line_no"), r, strict=True)) for r in yaml_rows(x)])

    return rows.select(key, F.explode(run(F.col(text))).alias("leaf")).select(key, "leaf.*")


def overlay(settings: DataFrame, app: str, env: str, path: str, value: str, line: str) -> DataFrame:
    """(app, env, path, value, from_env): each environment's settings; base rows have a null ``env`` and hold wherever the environment says nothing, and of repeated rows the last line holds.

    Paths are compared without case; an application without environments has its base alone, under a null environment.
    """
    rows = settings.select(app, env, F.lower(path).alias("__path"), path, value, line)
    base, own = rows.where(F.col(env).isNull()), rows.where(F.col(env).isNotNull())
    named = own.select(app, env).distinct()
    spread = base.drop(env).join(named, app, "left").withColumn("from_env", F.lit(False))
    every = spread.unionByName(own.withColumn("from_env", F.lit(True)))
    best = every.groupBy(app, env, "__path").agg(F.max_by(F.struct(path, value, "from_env"), F.struct("from_env", line)).alias("b"))
    return best.select(app, env, f"b.{path}", f"b.{value}", "b.from_env")


def target_class(value: Column) -> Column:
    """What a value points to: url, connection, file, host or none."""
    return (
        F.when(value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), "url").when(value.rlike(r"(?i)\b(server|data source|host)\s*=.*;"), "connection")
        .when(value.rlike(r"^(?:[A-Za-z]:\\|\\\\|/[\w.-]+/)"), "file").when(value.rlike(r"^(?:localhost|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?::[0-9]+)?$"), "host").otherwise("none")
    )


def config_map(effective: DataFrame, app: str, env: str, path: str, value: str) -> DataFrame:
    """(app, path, class, host_kind, values, varies) of the settings that point somewhere in any environment: how many values they take, and whether environments differ."""
    rows = effective.withColumn("class", target_class(F.col(value))).where("class <> 'none'")
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", ""), r"[:/?#].*$", "")
    rows = rows.withColumn("kind", F.when(F.col("class").isin("url", "host"), S.host_kind(bare)))
    found = rows.groupBy(app, F.lower(path).alias("path")).agg(F.min("class").alias("class"), F.min("kind").alias("host_kind"), F.countDistinct(value).alias("values"))
    return found.withColumn("varies", F.col("values") > 1)
