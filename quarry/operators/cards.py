"""Entity cards, mentions, links, and schedules with lanes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cards(entities: DataFrame, facts: DataFrame, key: str, kind: str, title: str, label: str, text: str, most: int = 2400, related: int = 40) -> DataFrame:
    """(id, kind, title, text, related): each entity with its facts as lines, cut to ``most`` characters, and the first other ends of its facts."""
    w = Window.partitionBy(key).orderBy(label, text)
    ranked = facts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= 4 * related)
    lines = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__k", label, text))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: F.concat_ws(": ", x[label], x[text])), "\n")
    ends = F.slice(F.array_distinct(F.transform("f", lambda x: x[text])), 1, related)
    out = entities.join(lines, key, "left")
    return out.select(F.col(key).alias("id"), F.col(kind).alias("kind"), F.col(title).alias("title"), F.substring(F.concat_ws("\n", F.col(title), body), 1, most).alias("text"), F.coalesce(ends, F.array().cast("array<string>")).alias("related"))


def entity_index(pages: DataFrame, key: str, text: str, most: int = 400) -> DataFrame:
    """(key, level, title, anchor, summary): headings of Markdown pages with the first text below each."""
    from quarry.operators.rules import line_explode

    lines = line_explode(pages.select(key, text), text)
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*$", 2)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", head).withColumn("section", F.count_if(head != "").over(w)).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("head") == "") & (F.trim("line") != ""), F.struct("line_no", "line")))), lambda x: x["line"]), " ")
    found = lines.groupBy(key, "section").agg(F.max(F.when(F.col("head") != "", F.length(F.regexp_extract("line", r"^(#+)", 1)))).alias("level"), F.max(F.when(F.col("head") != "", F.col("head"))).alias("title"), F.substring(body, 1, most).alias("summary"))
    anchor = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9 _-]", ""), r"\s+", "-")
    return found.select(key, "section", "level", "title", anchor.alias("anchor"), "summary")


def mentions(pages: DataFrame, items: DataFrame, key: str, text: str, name: str, least: int = 4) -> DataFrame:
    """(name, pages, first): items with the pages that hold their name as a word; unique names of some length only."""
    unique = items.where(F.length(name) >= least).groupBy(name).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    words = pages.select(key, F.explode(F.array_distinct(F.split(text, r"[^A-Za-z0-9_]+"))).alias(name))
    found = words.join(unique, name).groupBy(name).agg(F.count("*").alias("pages"), F.min(key).alias("first"))
    return unique.join(found, name, "left").select(name, F.coalesce("pages", F.lit(0)).alias("pages"), "first")


def resolve_links(links: DataFrame, targets: DataFrame, link: str, target: str) -> DataFrame:
    """Links with the target of that path, or the only one that ends so."""
    suffix = targets.withColumn("__parts", F.split(target, "/")).withColumn("__suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size("__parts")), lambda k: F.array_join(F.slice("__parts", k, F.size("__parts")), "/"))))
    only = suffix.groupBy("__suffix").agg(F.min(target).alias("__only"), F.count("*").alias("__n"), F.max(F.when(F.col("__suffix") == F.col(target), F.col(target))).alias("__exact"))
    joined = links.join(only, F.col(link) == F.col("__suffix"), "left")
    return joined.select(*links.columns, F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__only"))).alias("resolved"))


def schedule(items: DataFrame, plan: str, order: str, lane: str, hours: str, capacities: dict[str, float], onboarding: list[float] | None = None) -> DataFrame:
    """(plan, sprint, item, hours): work of each lane in order into sprints; capacity that a lane leaves goes to the other lanes.

    ``onboarding`` are factors on the capacity of the first sprints. A plan is one estimate's work list, small by nature;
    plans are independent of each other. Work of a lane that has no capacity of its own comes back with a null sprint.
    """
    factors = onboarding or []
    if not any(c > 0 for c in capacities.values()) or any(f <= 0 for f in factors):
        raise ValueError("capacities and factors must be above 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {x: [[r[order], float(r[hours])] for _, r in pdf[pdf[lane] == x].sort_values(order).iterrows()] for x in capacities}
        rows, sprint = [(r[plan], None, r[order], float(r[hours])) for _, r in pdf[~pdf[lane].isin(list(capacities))].iterrows()], 0
        while any(queues.values()):
            factor = factors[sprint] if sprint < len(factors) else 1.0
            sprint += 1
            spare = 0.0
            for own in (True, False):
                for x, queue in queues.items():
                    room = capacities[x] * factor if own else spare
                    while queue and room > 1e-9:
                        take = min(room, queue[0][1])
                        rows.append((pdf[plan].iloc[0], sprint, queue[0][0], take))
                        queue[0][1] -= take
                        room -= take
                        if queue[0][1] <= 1e-9:
                            queue.pop(0)
                    spare = spare + room if own else room
        return pd.DataFrame(rows, columns=[plan, "sprint", order, "hours"]).astype({"sprint": "Int32"})

    kinds = dict(items.dtypes)
    return items.groupBy(plan).applyInPandas(run, f"{plan} {kinds[plan]}, sprint int, {order} {kinds[order]}, hours double")


def selected(rows: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """With ``reasons``, why a row is left out (conditions in SQL by name), and ``kept``, whether there is none."""
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in reasons.items()]))
    return rows.withColumn("reasons", found).withColumn("kept", F.size("reasons") == 0)


def live_branch(merges: DataFrame, repo: str, branch: str, protected: str, at: str, default: str) -> DataFrame:
    """(repo, branch): the most frequent target of merges, protected ones first, else the default."""
    counts = merges.where(F.col(branch).isNotNull()).groupBy(repo, branch).agg(F.count("*").alias("n"), F.max(protected).alias("p"), F.max(at).alias("last"))
    best = counts.groupBy(repo).agg(F.max_by(branch, F.struct("p", "n", "last")).alias("live"))
    usual = merges.groupBy(repo).agg(F.max(default).alias("usual"))
    return usual.join(best, repo, "left").select(repo, F.coalesce("live", "usual").alias(branch))
