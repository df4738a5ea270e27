"""Ranked search, label selection and chunking."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bm25(cards: DataFrame, terms: list[str], key: str, fields: dict[str, float], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the best cards. ``fields`` are columns and their boosts; lengths are in characters of the last one.

    Cards without any term as a substring never get tokenised; document frequencies are of the candidates,
    the number of cards and the mean length of all of them. The score is scaled by the share of the terms found.
    """
    body = list(fields)[-1]
    low = {f: F.lower(F.coalesce(f, F.lit(""))) for f in fields}
    any_term = reduce(lambda a, b: a | b, [low[f].contains(term) for term in terms for f in fields])
    # each field is split once, into the asked terms that it holds
    words = [F.when(any_term, F.filter(F.split(low[f], "[^a-z0-9]+"), lambda x: x.isin(*terms))).alias(f"w{k}") for k, f in enumerate(fields)]
    held = cards.select(key, F.length(body).alias("n"), *words)
    times = lambda j, term: F.coalesce(F.size(F.filter(f"w{j}", lambda x: x == term)), F.lit(0))
    tf = [sum((float(boost) * times(j, term) for j, boost in enumerate(fields.values())), F.lit(0.0)).alias(f"tf{k}") for k, term in enumerate(terms)]
    found = held.select(key, "n", *tf)
    stats = found.agg(F.count("*").alias("cards"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    rows = found.where(reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))])).crossJoin(F.broadcast(stats))  # one row
    score, covered = F.lit(0.0), F.lit(0)
    for k in range(len(terms)):
        t, d = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("cards") - d + 0.5) / (d + 0.5))
        score += idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        covered += (t > 0).cast("int")
    rows = rows.select(key, (score * (0.5 + 0.5 * covered / len(terms))).alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), key).limit(limit)


def tfidf_labels(rows: DataFrame, group: str, words: str, most: int = 2) -> DataFrame:
    """(group, word, score, rank): the words that set a group apart; words of most groups are left out."""
    bag = rows.select(group, F.explode(words).alias("word")).where(F.length("word") >= 4).groupBy(group, "word").agg(F.count("*").alias("w"))
    groups = rows.agg(F.countDistinct(group).alias("groups"))
    df = F.count("*").over(Window.partitionBy("word"))  # at most one row of each group
    scored = bag.withColumn("df", df).crossJoin(F.broadcast(groups)).where((F.col("df") <= F.greatest(F.lit(2), 0.6 * F.col("groups"))) | (F.col("groups") < 4))  # one row
    scored = scored.withColumn("score", F.round(F.col("w") * F.log(1 + F.col("groups") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(group, "word", "score", "rank")


def split_sections(text: str, most: int, overlap: int) -> list[str]:
    """Chunks of whole blocks (paragraphs) of at most ``most`` characters; a longer block is cut at sentence ends. The last block
    of a chunk starts the next one again if it is short."""
    blocks = []
    for block in re.split(r"\n+", text):
        block = block.strip()
        while len(block) > most:
            cut = max(block.rfind(x, 0, most) for x in (". ", "! ", "? ")) + 1
            cut = cut if cut > most // 4 else max(block.rfind(" ", 0, most), 0) or most
            blocks.append(block[:cut].strip())
            block = block[cut:].strip()
        if block:
            blocks.append(block)
    chunks, held = [], []
    for block in blocks:
        if held and sum(map(len, held)) + len(held) + len(block) > most:
            chunks.append("\n".join(held))
            held = held[-1:] if len(held[-1]) <= overlap and len(held[-1]) + 1 + len(block) <= most else []
        held.append(block)
    return chunks + ["\n".join(held)] * bool(held)


def chunk(docs: DataFrame, key: str, text: str, most: int = 2400, overlap: int = 400) -> DataFrame:
    """(key, chunk, body)."""

    def run(batches):
        for pdf in batches:
            rows = [(k, i, c) for k, x in zip(pdf[key], pdf[text], strict=True) for i, c in enumerate(split_sections(x or "", most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "body"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, chunk int, body string")


def lookup(entities: DataFrame, name: str, asked: str) -> DataFrame:
    """Entities named so, or ending so, or containing it; exact ones first, then the shorter ones."""
    low, want = F.lower(name), asked.lower()
    rank = F.when(low == want, 0).when(low.endswith(want), 1).when(low.contains(want), 2)
    return entities.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length(name), name)


#: Words of asked texts that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_WORDS = 1_000_000


def spec_candidates(asked: DataFrame, have: DataFrame, ask: str, key: str, text: str, least: int = 7, most: int = 10) -> DataFrame:
    """(ask, key, overlap, k): for each asked text, the ``most`` texts that share most of its words of ``least`` letters or more; ties go to the shorter text, then the smaller key."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) >= least))).alias("w")
    wanted = asked.select(ask, words(text))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
    met = have.select(key, F.length(text).alias("n"), words(text)).join(wanted, "w").groupBy(ask, key).agg(F.count("*").alias("overlap"), F.first("n").alias("n"))
    k = F.row_number().over(Window.partitionBy(ask).orderBy(F.desc("overlap"), "n", key))
    return met.withColumn("k", k).where(F.col("k") <= most).select(ask, key, "overlap", "k")
