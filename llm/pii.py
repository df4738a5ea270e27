"""Personal data and the terms that reveal it, in DataFrame functions alone.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers, found by patterns and checked by
range, length and Luhn's rule. Each distinct value is a protected entity. A term is a word of three code points or more with a letter,
lower-cased, and co-occurs with an entity if it is among the ``reach`` words before or after it, up to the next value of the same kind.
With document counts over the whole corpus,

    information(entity) = -ln(df(entity) / N)
    disclosure(entity, term) = ln(df(entity, term) * N / (df(entity) * df(term))) / information(entity)

so a disclosure of 1 means that the term occurs nowhere but near the entity. Pairs that fewer than ``support``
different texts show are no evidence, however often a text is copied. Terms over the threshold ``generalise`` become
their class (``<word>`` or ``<code>``), over ``remove`` they become ``<removed>``, and base spans become
their kind, wherever they stand in the corpus. A term inside a base span is no span of its own.

Places are found without a fold over a growing array: the text between matches is measured, matches become rows, and a window
adds up the lengths within a text. Equal texts (by SHA-256) are worked on once and counted with their copies.
The patterns differ from the plain ones in that a run of characters is tried once, from its start (or from the end of the
last match), and never given back; they find the same matches in linear time.

A null text is empty; texts without personal data or terms have no spans. A null id stays null. Repeated rows each
get the same result. An empty table gives an empty table. Spans of a text are in the order of their starts, then of kinds; a text's spans, and no more,
meet in one group. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.store import keep_ids, stored

#: Kinds in their order, with the pattern of each and what a text must hold to be searched at all. Fixed values.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Kinds of the spans that the method adds.
ADDED = ("remove", "generalise")
#: Everything in ASCII but letters and digits parts words.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PART = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(number: int, gaps: Column, values: Column, reach: int) -> Column:
    """Array of (kind, i, gap, value, near): the i-th match, the code points before it since the last one, and the words around it."""

    def one(value, i):
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        left = words(before)
        near = F.concat(F.slice(left, F.greatest(F.size(left) - reach + 1, F.lit(1)), reach), F.slice(words(after), 1, reach))
        return F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(before).alias("gap"), value.alias("value"), near.alias("near"))

    return F.transform(values, one)


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match is personal data: parts of addresses at most 255, card numbers by length and Luhn's rule, phone numbers by length."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    back = F.reverse(digits)

    def worth(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), worth) % 10 == 0
    ip = F.forall(F.split(value, r"\."), lambda p: p.rlike(_PART))
    card = F.length(digits).between(12, 19) & luhn
    return F.when(kind == 1, True).when(kind == 2, ip).when(kind == 3, card).otherwise(F.length(digits).between(9, 15))


def base_spans(docs: DataFrame, reach: int = 10, text_col: str = "text") -> DataFrame:
    """(key, copies, kind, start, end, value, near) of the personal data of each distinct text; kinds are numbered from 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(text.alias("text")).where(F.col("text").rlike("@|[0-9]"))
    split, none = [], F.array().cast("array<string>")
    for kind, (pattern, needs) in KINDS.items():
        searched = F.col("text").rlike(needs)
        split.append(F.when(searched, F.split("text", pattern, -1)).otherwise(none).alias(f"gaps_{kind}"))
        split.append(F.when(searched, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(none).alias(f"values_{kind}"))
    some = some.select(_key(F.col("text")).alias("key"), *split)
    found = F.concat(*[_matches(n, F.col(f"gaps_{k}"), F.col(f"values_{k}"), reach) for n, k in enumerate(KINDS, 1)])
    some = some.select("key", found.alias("found"))
    each = some.groupBy("key").agg(F.first("found").alias("found"), F.count("*").alias("copies"))
    rows = each.select("key", "copies", F.explode("found").alias("m")).select("key", "copies", "m.*")
    to = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("key", "kind").orderBy("i"))
    rows = rows.withColumn("end", to).where(_valid(F.col("kind"), F.col("value")))
    return rows.select("key", "copies", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "near")


def disclosing_terms(docs: DataFrame, base: DataFrame, generalise: float = 0.95, remove: float = 0.99, support: int = 3, text_col: str = "text") -> DataFrame:
    """(term, disclosure, removed) of the terms over the threshold, each with its largest disclosure of any entity; ``base`` is what ``base_spans`` gives."""
    n = docs.count()
    seen = base.select("key", "copies", "kind", F.lower("value").alias("value"), F.explode("near").alias("term")).distinct()
    seen = seen.where((F.length("term") >= 3) & F.col("term").rlike("[^0-9]"))
    pairs = seen.groupBy("kind", "value", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    entities = base.select("key", "copies", "kind", F.lower("value").alias("value")).distinct().groupBy("kind", "value").agg(F.sum("copies").alias("df_entity"))
    pairs = pairs.join(entities, ["kind", "value"])
    spoken = docs.select(F.explode(F.array_distinct(words(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    information = -F.log(F.col("df_entity") / n)
    disclosure = F.log(F.col("both") * n / (F.col("df_entity") * F.col("df_term"))) / information
    rated = pairs.join(spoken, "term").where(F.col("df_entity") < n).select("term", disclosure.alias("disclosure"))
    return rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise).select("*", (F.col("disclosure") >= remove).alias("removed"))


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, kind, start, end) of every occurrence of the terms in each distinct text; kinds follow those of the base."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(_key(text).alias("key"), text.alias("text"))
    said = keyed.select("key", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    holding = stored(said.join(terms.select("term"), "term", "left_semi").select("key").distinct(), "holding")
    texts = keep_ids(keyed, holding, "key").dropDuplicates(["key"])
    gaps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    inner = F.filter(F.split("text", NO_WORD, -1), lambda w: w != "")
    each = texts.select("key", F.posexplode(F.zip_with(inner, F.slice(gaps, 1, F.size(inner)), lambda w, g: F.struct(w.alias("word"), F.length(g).alias("gap")))).alias("i", "m")).select("key", "i", "m.*")
    to = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("key").orderBy("i"))
    each = each.withColumn("end", to).select("key", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")
    return each.join(terms, "term").select("key", F.when(F.col("removed"), len(KINDS) + 1).otherwise(len(KINDS) + 2).alias("kind"), "start", "end")


def spans_of_texts(docs: DataFrame, text_col: str = "text", reach: int = 10, **thresholds) -> DataFrame:
    """(key, spans) of each distinct text that has any: an array of (start, kind, end) in order."""
    base = stored(base_spans(docs, reach, text_col), "base")
    terms = stored(disclosing_terms(docs, base, text_col=text_col, **thresholds), "terms")
    found = base.select("key", "start", "kind", "end").groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("base"))
    if not terms.isEmpty():
        added = term_spans(docs, terms, text_col).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
        found = found.join(added, "key", "full_outer")
        own = F.coalesce("base", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
        free = F.filter(F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")), lambda a: ~F.exists(own, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
        found = found.select("key", F.concat(own, free).alias("base"))
    return found.select("key", F.array_sort("base").alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), _key(F.col(text_col)).alias("key")).join(spans_of_texts(docs, text_col, **options), "key", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    rows = rows.select("id", spans.alias("found"))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(n).eqNullSafe)).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS, 1)]
    base = F.filter("found", lambda s: s["kind"] <= len(KINDS))
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all columns; in ``text_col`` each span is replaced by its kind, overlapping ones by the first's."""
    names = F.array(*[F.lit(f"<{k}>") for k in (*KINDS, "removed")])
    text = F.col(text_col)

    def put(state, s):
        label = F.when(s["kind"] <= len(KINDS) + 1, F.element_at(names, s["kind"])).when(F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[0-9]"), "<code>").otherwise("<word>")
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), label)
        return F.struct(F.greatest(state["at"], s["end"].cast("int")).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    keyed = docs.withColumn("__key", _key(text)).join(spans_of_texts(docs, text_col, **options).select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")
    return keyed.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(clean)).select(*docs.columns)


def op12_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of the whole ``documents`` table."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
