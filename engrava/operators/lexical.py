"""Retrieval: phrase BM25, vector top-k, entity channel, reciprocal rank fusion, temporal intent of a query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words of a query that speak of the present, past and future; repeated entries count repeatedly.
CURRENT = "current currently now today latest recent 现在 当前 目前 今天 此刻 现在的 最新的 现在的".split()
PAST = ["previous", "previously", "before", "last", "ago", "yesterday", "earlier", "originally", "initially", "at that time", "back then", *"之前 上次 上次 上次 曾经 过去 原来的 当初 之前 前几天 上次 已经 之前".split()]
FUTURE = ["tomorrow", "upcoming", "next", "will", "plan to", "going to", "future", "scheduled", *"明天 下次 未来 即将 之后 将要 计划 打算".split()]


def intent_of(query: str) -> tuple[str, float]:
    """('current' | 'past' | 'future' | 'any', confidence) of a query text."""
    q = (query or "").lower()
    hits = {k: sum(w in q for w in words) for k, words in (("current", CURRENT), ("past", PAST), ("future", FUTURE))}
    (best, n), (_, second) = sorted(hits.items(), key=lambda x: -x[1])[:2]
    return ("any", 0.0) if n == 0 or n == second else (best, min(1.0, n / 3))


def intents(c: F.Column) -> F.Column:
    """intent_of as a column of many queries."""
    q = F.lower(F.coalesce(c, F.lit("")))
    n = {k: sum((F.when(q.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for k, words in (("current", CURRENT), ("past", PAST), ("future", FUTURE))}
    a, b, f = n["current"], n["past"], n["future"]
    return F.when((a > b) & (a > f), "current").when((b > a) & (b > f), "past").when((f > a) & (f > b), "future").otherwise("any")


def bm25(docs: DataFrame, key: str, columns: list[str], phrases: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows that hold all phrases (of at least three characters) in their columns, case-blind.

    A phrase's frequency is its number of occurrences over all columns; a document's length the number of its trigrams. One
    pass for the statistics (a single row) and one for the scores; nothing is exploded.
    """
    phrases = [p.lower() for p in phrases if len(p) >= 3]
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    dl = sum((F.greatest(F.lit(0), F.length(t) - 2) for t in texts), F.lit(0))
    tf = [sum(((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / F.lit(len(p)) for t in texts), F.lit(0.0)) for p in phrases]
    rows = docs.select(key, dl.cast("double").alias("dl"), *[x.alias(f"tf{i}") for i, x in enumerate(tf)])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1e-9)).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    hit = rows
    for i in range(len(phrases)):
        hit = hit.where(F.col(f"tf{i}") > 0)
    j = hit.join(F.broadcast(stats), F.lit(True))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        raw = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return j.select(key, score.alias("score"))


def top(df: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), key).limit(limit)


def vector_top(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """(key, cosine) of the limit rows nearest to one query vector; a scan with generated code and a bounded heap per task."""
    qn = math.sqrt(sum(x * x for x in query)) or 1.0
    terms = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in query]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    rows = vectors.where(F.size(vector) == len(query)).select(key, F.try_divide(terms, norm * F.lit(qn)).alias("cosine")).where("cosine is not null and not isnan(cosine)")
    return top(rows, "cosine", key, limit)


def entity_channel(mentions: DataFrame, entities: DataFrame, names: list[str]) -> DataFrame:
    """(memory_id, weight): memories that mention one of the named entities, by their summed weight."""
    e = entities.where(F.lower("name").isin([n.lower() for n in names])).select(F.col("id").alias("entity_id"))
    m = mentions.join(e, "entity_id", "left_semi").where("memory_id is not null")
    return m.groupBy("memory_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def fuse(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, rrf) of ranked channels (id, rank): the sum of 1 / (k + rank)."""
    both = channels[0].select("id", "rank")
    for c in channels[1:]:
        both = both.unionAll(c.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


def ranked(df: DataFrame, key: str, score: str, limit: int) -> DataFrame:
    """(id, rank) of the best limit rows. The limit comes first, so the window sees only them."""
    best = top(df, score, key, limit)
    return best.select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(F.col(score).desc(), key)).alias("rank"))
