"""Rule scanning: files x rules x lines in one pass.

Rules are a small catalogue written by hand, so they are literals of the plan: a file's rules are those
that its text can match at all, and only lines that one of these matches become hits. Patterns see one line each,
so anchors mean the line's ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``types``: values of the type column it is for (none: all). ``requires`` and ``unless_in_file`` look at the whole file,
    ``context`` at the lines around, the others at the line."""

    id: str
    level: str
    pattern: str
    types: tuple[str, ...] = ()
    unless_in_line: str | None = None
    requires: str | None = None
    unless_in_file: str | None = None
    context: str | None = None


def lines_of(text: str) -> Column:
    """The lines of a text; a final line break ends no further line."""
    return F.split(F.regexp_replace(F.col(text), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")


def line_explode(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: line_no from 1, line. A null text has no lines and gives no row."""
    return files.select("*", F.posexplode(lines_of(text)).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


#: What a line can match though its whole text does not: ends of the text, looks around, possessive parts, both ends of an empty line.
_LINE_ONLY = re.compile(r"\\[AzZG]|\(\?[=!<>]|[+*?}]\+|\^.*\$")


def any_of(patterns: list[str]):
    """A condition on a column: whether any pattern matches. Tried one by one: each has its own fast search, which an alternation has not."""
    return lambda c: reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def _file_level(rule: Rule, kind: str | None, text: str) -> Column | None:
    """Whether a rule can match in the file at all; None if that is not known before its lines."""
    ok = None if _LINE_ONLY.search(rule.pattern) else F.col(text).rlike("(?m)" + rule.pattern)
    if rule.types and kind:
        kinds = F.coalesce(F.col(kind).isin(*rule.types), F.lit(False))
        ok = kinds if ok is None else kinds & ok
    for pattern, wanted in ((rule.requires, True), (rule.unless_in_file, False)):
        if pattern:
            one = F.col(text).rlike(pattern) if wanted else ~F.col(text).rlike(pattern)
            ok = one if ok is None else ok & one
    return ok


def rule_scan(files: DataFrame, rules: list[Rule], key: str, kind: str | None = None, text: str = "text", before: int = 15, after: int = 15, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, keep, rule, level, line_no, line): every line that a rule matches. No shuffle: a file's lines are looked at where they are."""
    columns = [key, *([kind] if kind else []), *keep]
    flags = {f"__f{k}": level for k, r in enumerate(rules) if (level := _file_level(r, kind, text)) is not None}
    lines, contexts = lines_of(text), [r.pattern for r in rules if r.context]

    def around(at: Column) -> Column:
        first = F.greatest(at + 1 - before, F.lit(1))
        return F.array_join(F.slice("__lines", first, at + 1 + after - first + 1), "\n")

    def one(line: Column, at: Column) -> Column:
        near = F.when(any_of(contexts)(line), around(at)) if contexts else F.lit(None).cast("string")
        return F.struct((at + 1).alias("line_no"), line.alias("line"), near.alias("around"))

    held = files.select(*columns, text, *[c.alias(n) for n, c in flags.items()])
    if len(flags) == len(rules):
        held = held.where(reduce(lambda a, b: a | b, [F.col(n) for n in flags]))
    can = [(F.col(f"__f{k}") if f"__f{k}" in flags else F.lit(True), r) for k, r in enumerate(rules)]
    some = lambda line: reduce(lambda a, b: a | b, [flag & line.rlike(r.pattern) for flag, r in can])
    split = held.select(*columns, *flags, lines.alias("__lines"))
    numbered = F.transform("__lines", one)
    if contexts:  # the array outlives the filter only where lines around are looked at
        found = split.select(*columns, *flags, F.explode(F.filter(numbered, lambda x: some(x["line"]))).alias("x")).select(*columns, *flags, "x.*")
    else:
        found = split.select(*columns, *flags, F.posexplode("__lines").alias("line_no", "line")).where(some(F.col("line"))).withColumn("line_no", F.col("line_no") + 1)
    hits = []
    for k, r in enumerate(rules):
        hit = F.col("line").rlike(r.pattern)
        if f"__f{k}" in flags:
            hit = F.col(f"__f{k}") & hit
        if r.unless_in_line:
            hit &= ~F.col("line").rlike(r.unless_in_line)
        if r.context:
            hit &= F.col("around").rlike(r.context)
        hits.append(F.when(hit, F.struct(F.lit(r.id).alias("rule"), F.lit(r.level).alias("level"))))
    return found.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select(*columns, "hit.rule", "hit.level", "line_no", "line")


def file_lacks(files: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Files without any match."""
    return files.where(~F.col(text).rlike(pattern))


def absent(files: DataFrame, group: str, when: str, wants: str, key: str, text: str = "text") -> DataFrame:
    """(group, first_key, n): groups in which ``when`` occurs and ``wants`` never does."""
    seen = files.groupBy(group).agg(F.min(F.when(F.col(text).rlike(when), F.col(key))).alias("first_key"), F.count_if(F.col(text).rlike(when)).alias("n"), F.max(F.col(text).rlike(wants)).alias("wanted"))
    return seen.where("n > 0 and not coalesce(wanted, false)").drop("wanted")


def last_match(files: DataFrame, pattern: str, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line) of the last matching line of each file; each row is a file of its own."""
    numbered = F.transform(lines_of(text), lambda line, at: F.struct((at + 1).alias("line_no"), line.alias("line")))
    last = F.try_element_at(F.filter(numbered, lambda x: x["line"].rlike(pattern)), F.lit(-1))
    return files.select(key, last.alias("x")).where("x is not null").select(key, "x.line_no", "x.line")


def valid_waivers(waivers: DataFrame, today: str) -> DataFrame:
    """With ``valid`` and ``why_not``: a waiver needs a reason, and must not have ended."""
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    ended = F.coalesce(F.col("expires") < F.lit(today), F.lit(False))
    return waivers.withColumn("why_not", F.when(blank, "no reason").when(ended, "expired")).withColumn("valid", F.col("why_not").isNull())


def glob_pattern(glob: Column) -> Column:
    """A glob as an anchored regular expression: * any text, ? any character, [..] one of a set ([!..] none of it); ``.ext`` is ``*.ext``."""
    glob = F.when(glob.rlike(r"^\.[A-Za-z0-9]+$"), F.concat(F.lit("*"), glob)).otherwise(glob)
    quoted = F.regexp_replace(F.regexp_replace(glob, r"([.+(){}^$|\\])", r"\\$1"), r"\[!", "[^")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def first_waiver(hits: DataFrame, waivers: DataFrame, path: str, key: list[str]) -> DataFrame:
    """With ``waiver``, the number of the first valid waiver whose rule (or ``*``) and glob match. Waivers are hand-written: few."""
    small = F.broadcast(waivers.select("waiver", F.col("rule").alias("w_rule"), glob_pattern(F.col("path")).alias("w_path")))
    match = ((F.col("w_rule") == F.col("rule")) | (F.col("w_rule") == "*")) & F.expr(f"{path} rlike w_path")
    joined = hits.join(small, match, "left")
    return joined.groupBy(*key).agg(F.min("waiver").alias("waiver"))


def case_mismatch(references: DataFrame, files: DataFrame, ref: str, path: str) -> DataFrame:
    """References that differ from an existing path in case only."""
    have = files.select(F.col(path).alias("actual"), F.lower(path).alias("low"))
    exact = references.join(have, references[ref] == have["actual"], "left_anti")
    return exact.withColumn("low", F.lower(ref)).join(have, "low").drop("low")


def minified(files: DataFrame, text: str = "text", most: int = 2000, mean: int = 250, least: int = 4000) -> Column:
    """Whether a file is generated or minified: long, with a very long line or very long lines on average."""
    lines = F.split(F.col(text), "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    return (F.length(text) >= least) & ((longest > most) | (F.length(text) / F.size(lines) > mean))
