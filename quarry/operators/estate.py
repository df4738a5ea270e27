"""Roll-ups, votes, routing and checks over what scans, graphs and reviews found.

Null keys form no group of their own unless said otherwise; ties go to the smaller value; repeated rows count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.aggregates import capped
from quarry.operators.graph import cycles, layers, reach
from quarry.session import written


def first_crlf(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no): the line that ends with the first CR LF of each file that has one."""
    at = F.instr(F.col(text), "\r\n")
    line = F.length(F.substring(F.col(text), F.lit(1), at)) - F.length(F.replace(F.substring(F.col(text), F.lit(1), at), F.lit("\n"), F.lit(""))) + 1
    return files.where(at > 0).select(key, line.alias("line_no"))


def excluded_by(rows: DataFrame, path: str, groups: list[str]) -> DataFrame:
    """With ``excluded``: the first group that the path is or lies below, whatever the case; else null."""
    low = F.lower(path)
    hit = F.coalesce(*[F.when((low == g.lower()) | low.startswith(g.lower() + "/"), F.lit(g)) for g in groups])
    return rows.withColumn("excluded", hit)


def issue_types(hits: DataFrame, key: str, app: str, rank: str, ref: str, most: int = 8) -> DataFrame:
    """(key, occurrences, apps, worst, refs): hits by type, with their first ``most`` references."""
    totals = hits.groupBy(key).agg(F.count("*").alias("occurrences"), F.countDistinct(app).alias("apps"), F.min(rank).alias("worst"))
    first = capped(hits.select(key, ref).distinct(), [key], [ref], [ref], most)
    return totals.join(first, key).select(key, "occurrences", "apps", "worst", F.transform("items", lambda x: x[ref]).alias("refs"))


def worst_status(apps: DataFrame, hits: DataFrame, app: str, level: str, order: list[str], clean: str) -> DataFrame:
    """(app, status): the worst level of each app's hits, in order from the worst; without hits ``clean``."""
    rank = F.coalesce(*[F.when(F.col(level) == x, F.lit(k)) for k, x in enumerate(order)], F.lit(len(order)))
    worst = hits.groupBy(app).agg(F.min(rank).alias("__rank"))
    name = F.coalesce(*[F.when(F.col("__rank") == k, F.lit(x)) for k, x in enumerate(order)], F.lit(clean))
    return apps.select(app).distinct().join(worst, app, "left").select(app, name.alias("status"))


def totals_map(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, total, kinds): rows of each group and of each of its kinds, as a map; kinds are few by nature."""
    counts = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), F.struct(kind, "n"))))).alias("kinds"))


def role_vote(evidence: DataFrame, key: str, strength: str, role: str, order: list[str], mixed: str = "MIXED", against: tuple[str, str] | None = None) -> DataFrame:
    """(key, role, confidence, roles): the role that the strongest class of evidence names, and all roles that any evidence names, in order.

    Several roles of the strongest class are ``mixed``, and so are different roles of the two classes in ``against`` (what is said and
    what a port shows, say), whatever else there is. A key with evidence of none of the classes in ``order`` has no row.
    """
    known = evidence.where(F.col(strength).isin(*order) & F.col(role).isNotNull())
    each = known.groupBy(key, strength).agg(F.countDistinct(role).alias("n"), F.min(role).alias("r"))
    rank = F.coalesce(*[F.when(F.col(strength) == x, F.lit(k)) for k, x in enumerate(order)])
    clash = F.lit(False)
    if against:
        sides = [F.min(F.when(F.col(strength) == x, F.col("r"))) for x in against]
        clash = F.coalesce(sides[0] != sides[1], F.lit(False))
    best = each.groupBy(key).agg(F.min_by(F.struct(strength, "n", "r"), rank).alias("b"), clash.alias("clash"))
    named = known.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles"))
    name = F.when(F.col("clash") | ((F.col(f"b.{strength}") == order[0]) & (F.col("b.n") > 1)), mixed).otherwise(F.col("b.r"))
    return best.join(named, key).select(key, name.alias("role"), F.when(F.col("clash"), F.concat_ws(" against ", F.lit(against[0]), F.lit(against[1])) if against else None).otherwise(F.col(f"b.{strength}")).alias("confidence"), "roles")


def registrable(host: Column) -> Column:
    """The domain that can be registered: two labels, three below a second-level suffix; empty for addresses and single names."""
    return F.when(host.rlike(r"^[0-9.]+$"), "").otherwise(F.regexp_extract(host, r"([^.]+\.(?:(?:co|com|org|net|gov|ac)\.[a-z]{2}|[a-z]{2,}))$", 1))


def profile(rows: DataFrame, group: str, value: str, most: int = 3) -> DataFrame:
    """(group, size, top): the size of each group and its ``most`` frequent values with their counts."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    first = capped(counts.where(F.col(value).isNotNull()), [group], [F.desc("n"), value], [value, "n"], most)
    return counts.groupBy(group).agg(F.sum("n").alias("size")).join(first, group, "left").select(group, "size", F.array_join(F.transform("items", lambda x: F.concat(x[value].cast("string"), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("top"))


def reach_share(items: DataFrame, reached: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, items, reached, percent): how many of an owner's distinct items are reached, in whole percent, rounded down."""
    flagged = items.select(owner, item).distinct().join(reached.select(item).distinct().withColumn("__hit", F.lit(1)), item, "left")
    return flagged.groupBy(owner).agg(F.count("*").alias("items"), F.count("__hit").alias("reached")).withColumn("percent", F.floor(100 * F.col("reached") / F.col("items")))


def disambiguated(rows: DataFrame, name: str, path: str) -> DataFrame:
    """With ``label``: the name, and for a name of several paths the first folder in which they differ."""
    parts = rows.select(name, path).distinct().select(name, path, F.posexplode(F.split(path, "/")).alias("__at", "__part"))
    per = parts.groupBy(name, "__at").agg(F.countDistinct("__part").alias("k"), F.count("*").alias("m"))
    n = rows.select(name, path).distinct().groupBy(name).agg(F.count("*").alias("__n"))
    differs = per.join(n, name).where((F.col("__n") > 1) & ((F.col("k") > 1) | (F.col("m") < F.col("__n")))).groupBy(name).agg(F.min("__at").alias("__first"))
    out = rows.join(differs, name, "left")
    part = F.try_element_at(F.split(path, "/"), F.col("__first") + 1)
    return out.withColumn("label", F.when(part.isNotNull(), F.concat(F.col(name), F.lit(" ("), part, F.lit(")"))).otherwise(F.col(name))).drop("__first")


def contradictions(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind): rows whose key is unknown, is listed twice, or whose values differ from those that are known."""
    right = known.select(F.col(key), F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.withColumn("__n", F.count("*").over(Window.partitionBy(key))).join(right, key, "left")
    kinds = [F.when(F.col("__known").isNull(), "UNKNOWN"), F.when(F.col("__n") > 1, "DUPLICATE"), *[F.when(F.col(c) != F.col(f"__{c}"), c.upper()) for c in columns]]
    return joined.select(key, F.explode(F.array_compact(F.array(*kinds))).alias("kind")).distinct()


def not_posted(new: DataFrame, old: DataFrame, place: str, title: str, body: str, least: int = 12, head: int = 60) -> DataFrame:
    """New comments that no old one at the same place holds already: by the start of the squashed title, if that is long enough to tell."""
    squash = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    posted = old.select(F.col(place).alias("__place"), squash(F.col(body)).alias("__body"))
    needle = F.substring(squash(F.col(title)), 1, head)
    return new.join(posted, (F.col(place) == F.col("__place")) & (F.length(needle) >= least) & F.contains("__body", needle), "left_anti")


def stale(outputs: DataFrame, inputs: DataFrame, out: str, built: str, changed: str) -> DataFrame:
    """Outputs to build again: never built, or older than an input."""
    newest = inputs.groupBy(out).agg(F.max(changed).alias("__newest"))
    return outputs.join(newest, out, "left").where(F.col(built).isNull() | (F.col("__newest") > F.col(built))).drop("__newest")


def contract(rows: DataFrame, key: list[str], checks: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, level, problem) of every check (level, condition in SQL that must hold) that a row fails; an unknown condition fails."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(ok), F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("problem"))) for name, (level, ok) in checks.items()]))
    return rows.select(*key, F.explode(found).alias("x")).select(*key, "x.level", "x.problem")


def comment_routes(comments: DataFrame, shown: DataFrame, file: str, line: str, end: str) -> DataFrame:
    """With ``route``: inline if the line (and the end of a range) is in the diff, else general."""
    lines = shown.select(file, line).distinct()
    first = comments.join(lines.withColumn("__first", F.lit(True)), [file, line], "left")
    both = first.join(lines.select(file, F.col(line).alias(end), F.lit(True).alias("__last")), [file, end], "left")
    inline = F.col("__first").isNotNull() & (F.col(end).isNull() | F.col("__last").isNotNull())
    return both.withColumn("route", F.when(inline, "inline").otherwise("general")).drop("__first", "__last")


def flow_problems(steps: DataFrame, flow: str, seq: str, step: str, following: str) -> DataFrame:
    """(flow, step, problem): steps named twice, and steps that go on to one that is not there. A step without a successor goes to the next."""
    w = Window.partitionBy(flow).orderBy(seq)
    named = steps.withColumn("__to", F.coalesce(F.col(following), F.lead(step).over(w)))
    twice = steps.groupBy(flow, step).agg(F.count("*").alias("n")).where("n > 1").select(flow, step, F.lit("duplicate").alias("problem"))
    have = steps.select(flow, F.col(step).alias("__to")).distinct()
    lost = named.where("__to is not null").join(have, [flow, "__to"], "left_anti").select(flow, step, F.lit("unknown successor").alias("problem"))
    return twice.union(lost)


#: Rows of needles, grouped by key, that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_NEEDLES = 100_000


def where_found(needles: DataFrame, files: DataFrame, key: str, needle: str, path: str, text: str, most: int = 3) -> DataFrame:
    """(key, needle, path, k): the first ``most`` files of the key that hold the needle; none if it is not found.

    A file meets the needles of its key as one array, so its text is read once, where it is, and goes nowhere.
    """
    asked = needles.where(F.col(needle).isNotNull()).groupBy(key).agg(F.collect_set(needle).alias("__needles"))
    total = asked.agg(F.coalesce(F.sum(F.size("__needles")), F.lit(0))).first()[0]
    asked = F.broadcast(asked) if total <= BROADCAST_NEEDLES else asked
    held = F.filter("__needles", lambda n: F.contains(F.col(text), n))
    hits = files.select(key, path, text).join(asked, key).select(key, F.explode(held).alias(needle), path)
    return hits.withColumn("k", F.row_number().over(Window.partitionBy(key, needle).orderBy(path))).where(F.col("k") <= most)


def weighted_bag(rows: DataFrame, group: str, weights: dict[str, float], stop: list[str]) -> DataFrame:
    """(group, word, weight): the words of several columns, each counted by its column's weight; plurals are one with singulars."""
    one = lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w)
    parts = [rows.select(group, F.explode(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: (x != "") & ~x.isin(*stop))).alias("word"), F.lit(float(w)).alias("w")) for c, w in weights.items()]
    return reduce(DataFrame.union, parts).select(group, one(F.col("word")).alias("word"), "w").groupBy(group, "word").agg(F.sum("w").alias("weight"))


def majority(rows: DataFrame, group: str, role: str, least: int = 2) -> DataFrame:
    """(group, role): the role that more than half of a group's rows have, at least ``least``; else null."""
    counts = rows.groupBy(group, role).agg(F.count("*").alias("n"))
    whole = counts.groupBy(group).agg(F.sum("n").alias("all"), F.max_by(role, "n").alias("best"), F.max("n").alias("n"))
    return whole.select(group, F.when((2 * F.col("n") > F.col("all")) & (F.col("n") >= least), F.col("best")).alias("role"))


def test_map(edges: DataFrame, tests: DataFrame, depth: int = 8) -> DataFrame:
    """(seed, node, depth, direct) of what each test reaches within ``depth`` calls."""
    return reach(edges, tests, depth).withColumn("direct", F.col("depth") == 1)


def build_order(edges: DataFrame) -> DataFrame:
    """(node, level) from 1: what depends on nothing first. Nodes on a cycle have level 1, since none of them can wait for the others."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    looped = written(cycles(edges).select("node").distinct())
    free = written(edges.select("src", "dst").distinct().join(looped.withColumnRenamed("node", "src"), "src", "left_anti"))
    each = free.select(F.col("src").alias("node")).union(free.select("dst")).distinct()
    level = layers(free, each.select("node", F.col("node").alias("component"))).select("node", "layer")
    return nodes.join(level, "node", "left").select("node", (F.coalesce("layer", F.lit(0)) + 1).alias("level"))


def reverse_index(uses: DataFrame, user: str, used: str) -> DataFrame:
    """(used, users, first): how many use each object, and the first of them."""
    return uses.select(user, used).distinct().groupBy(used).agg(F.count("*").alias("users"), F.min(user).alias("first"))


def range_sum(rows: DataFrame, by: list[str], low: str, high: str, factor: float = 1.0) -> DataFrame:
    """(by, lo, hi, likely): sums of ranges scaled by a factor; likely is their middle, rounded to a tenth."""
    lo, hi = F.sum(low) * factor, F.sum(high) * factor
    return rows.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi")).withColumn("likely", F.bround((F.col("lo") + F.col("hi")) / 2, 1))


def diff_capped(lines: DataFrame, file: str, seq: str, per_file: int = 500) -> DataFrame:
    """The first ``per_file`` lines of each file, and one row that says how many more there are."""
    k = F.row_number().over(Window.partitionBy(file).orderBy(seq))
    numbered = lines.withColumn("__k", k)
    kept = numbered.where(F.col("__k") <= per_file).select(file, F.col(seq).cast("long").alias(seq), F.lit(0).cast("long").alias("more"))
    more = numbered.where(F.col("__k") > per_file).groupBy(file).agg(F.min(F.col(seq).cast("long")).alias(seq), F.count("*").alias("more"))
    return kept.union(more)
