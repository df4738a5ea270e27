"""Decision rules: features to strategies, with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, cases: list[tuple[str, str, str]], other: tuple[str, str], result: str = "decision", reason: str = "reason") -> DataFrame:
    """The first (condition, decision, reason) that holds; conditions are SQL expressions over the row."""
    out, why = F.lit(other[0]), F.lit(other[1])
    for condition, decision, text in reversed(cases):
        holds = F.coalesce(F.expr(condition), F.lit(False))
        out, why = F.when(holds, decision).otherwise(out), F.when(holds, text).otherwise(why)
    return rows.withColumn(result, out).withColumn(reason, why)


def recommend(used: DataFrame, releases: DataFrame, on: str = "pkg") -> DataFrame:
    """(pkg, used, action, target): keep a safe version; else the lowest safe one above, of the same licence if there is one; else replace.

    ``used`` is (pkg, used); ``releases`` (pkg, release, licence, safe), versions being arrays of numbers.
    """
    own = releases.select(on, F.col("release").alias("used"), F.col("licence").alias("own_licence"), F.col("safe").alias("own_safe"))
    rows = used.join(own, [on, "used"], "left").join(releases, on, "left")
    above = F.col("safe") & (F.col("release") > F.col("used"))
    best = F.min(F.when(above, F.struct((~(F.col("licence") == F.col("own_licence"))).alias("other"), F.col("release").alias("release"))))
    found = rows.groupBy(on, "used").agg(F.max("own_safe").alias("own_safe"), best.alias("best"))
    safe = F.coalesce("own_safe", F.lit(False))
    return found.select(on, "used", F.when(safe, "keep").when(F.col("best").isNotNull(), "upgrade").otherwise("replace").alias("action"), F.when(safe, F.col("used")).otherwise(F.col("best.release")).alias("target"))


def applicable(questions: DataFrame, answers: dict[str, list[str]]) -> DataFrame:
    """Questions whose every condition has one of its values among the answers. ``when`` is a map of lists."""
    given = F.create_map(*[x for k, v in answers.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if answers else F.create_map().cast("map<string,array<string>>")
    holds = F.forall(F.map_entries("when"), lambda e: F.coalesce(F.arrays_overlap(e["value"], F.element_at(given, e["key"])), F.lit(False)))
    return questions.where(F.coalesce(holds, F.lit(True)))


def strongest(signals: DataFrame, key: str, order: list[str], level: str, note: str, other: str = "none") -> DataFrame:
    """(key, level, notes): the strongest level among a key's signals, with what speaks for it."""
    rank = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(level) == name, k).otherwise(rank)
    ranked = signals.withColumn("__rank", rank)
    best = ranked.groupBy(key).agg(F.min("__rank").alias("__best"))
    notes = ranked.join(best, key).where("__rank = __best").groupBy(key, "__best").agg(F.array_sort(F.collect_set(note)).alias("notes"))
    return notes.select(key, F.coalesce(F.get(F.array(*map(F.lit, order)), F.col("__best")), F.lit(other)).alias(level), "notes")


def demoted(findings: DataFrame, evidence: str, pattern: str, severity: str, to: str) -> DataFrame:
    """Findings whose every piece of evidence matches get a lower severity; those without evidence stay."""
    only = (F.size(evidence) > 0) & F.forall(evidence, lambda e: e.rlike(pattern))
    return findings.withColumn(severity, F.when(F.coalesce(only, F.lit(False)), to).otherwise(F.col(severity)))


def invalid_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, answer, problem): answers to no question or with a value that is none of its options (an empty list takes any)."""
    joined = answers.join(questions.withColumnRenamed("options", "__o"), "id", "left")
    problem = F.when(F.col("__o").isNull(), "unknown question").when((F.size("__o") > 0) & ~F.array_contains("__o", F.col("answer")), "not an option")
    return joined.withColumn("problem", problem).where("problem is not null").select("id", "answer", "problem")
