"""Retrieval queries with fixed query texts; limits are the feature of a ranked list."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.functions import score, text
from engrava.operators import lexical
from engrava.plans.registry import query
from engrava.plans.scoring import ADAPT, DEGREE, with_degree
from engrava.session import load
from engrava.sources import tables
from engrava.sources.tables import NOW

PHRASES = ["checkpoint", "the"]
TAGS = "coalesce(array_to_string(tags, ' '), '')"


def bm25_sql(base: str, key: str, columns: list[str], phrases: list[str]) -> str:
    c = [f"lower(coalesce({x}, ''))" for x in columns]
    dl = " + ".join(f"greatest(0, length({x}) - 2)" for x in c)
    tf = [" + ".join(f"(length({x}) - length(replace({x}, '{p}', ''))) / CAST({len(p)} AS DOUBLE)" for x in c) for p in phrases]
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    s = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    return f"br AS (SELECT {key} AS id, CAST({dl} AS DOUBLE) AS dl, {', '.join(f'{t} AS tf{i}' for i, t in enumerate(tf))} FROM {base}), bs AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(phrases)))} FROM br), bm AS (SELECT id, {s} AS score FROM br, bs WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(phrases)))})"


def memory_docs(spark, sf):
    return tables.memories(spark, sf).withColumn("tag_text", F.array_join("tags", " "))


BM = bm25_sql("m", "id", ["text", "array_to_string(tags, ' ')", "source"], PHRASES)


@query(f", {BM} SELECT id, round(score, 6) AS score FROM bm", "m")
def bm25_memories(spark, sf):
    return lexical.bm25(memory_docs(spark, sf), "id", ["text", "tag_text", "source"], PHRASES).select("id", F.round("score", 6).alias("score"))


@query(f", {bm25_sql('p', 'doc_id', ['title', 'body', 'summary'], ['threshold'])} SELECT id AS doc_id, round(score, 6) AS score FROM bm", "p")
def bm25_wiki(spark, sf):
    return lexical.bm25(tables.pages(spark, sf), "doc_id", ["title", "body", "summary"], ["threshold"]).select("doc_id", F.round("score", 6).alias("score"))


QUERY_VECTOR = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
QV = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY_VECTOR) + "]"


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV}), 6) AS cosine FROM embeddings WHERE len(embedding) = 64 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV}) DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    return lexical.vector_top(load(spark, sf, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 20).select("vec_id", F.round("cosine", 6).alias("cosine"))


EC = "ec AS (SELECT memory_id AS id, sum(coalesce(weight, 0)) AS weight FROM entity_mentions WHERE memory_id IS NOT NULL AND entity_id IN (SELECT id FROM entities WHERE starts_with(lower(name), 'b')) GROUP BY 1)"


def entity_rows(spark, sf):
    e = tables.entities(spark, sf).where(F.lower("name").startswith("b")).select(F.col("id").alias("entity_id"))
    m = tables.mentions(spark, sf).join(e, "entity_id", "left_semi").where("memory_id is not null")
    return m.groupBy(F.col("memory_id").alias("id")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


@query(f"WITH {EC} SELECT id, round(weight, 6) AS weight FROM ec")
def entity_channel(spark, sf):
    return entity_rows(spark, sf).select("id", F.round("weight", 6).alias("weight"))


RRF = f"{BM}, {EC}, ch AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT * FROM bm ORDER BY round(score, 6) DESC, id LIMIT 50) UNION ALL SELECT id, row_number() OVER (ORDER BY round(weight, 6) DESC, id) AS rank FROM (SELECT * FROM ec ORDER BY round(weight, 6) DESC, id LIMIT 50)), rf AS (SELECT id, sum(1.0 / (CAST(60 AS DOUBLE) + rank)) AS rrf FROM ch GROUP BY 1)"


def fused(spark, sf):
    a = lexical.ranked(bm25_memories(spark, sf), "id", "score", 50)
    b = lexical.ranked(entity_channel(spark, sf), "id", "weight", 50)
    return lexical.fuse([a, b])


@query(f", {RRF} SELECT id, round(rrf, 6) AS rrf FROM rf", "m")
def rrf(spark, sf):
    return fused(spark, sf).select("id", F.round("rrf", 6).alias("rrf"))


def hybrid_sql(extra: str = "") -> str:
    mult = f"(1.0 + (0.25 + 0.25 * exp(-greatest(0.0, ({NOW}.0 - coalesce(updated, created)) / 86400.0) / 30.0)) * (1.0 / 3.0))"
    return mult


@query(f", {RRF} SELECT m.id, round(rrf * {hybrid_sql()}, 6) AS score FROM rf JOIN m USING (id) ORDER BY round(rrf * {hybrid_sql()}, 6) DESC, m.id LIMIT 20", "m")
def recall_hybrid(spark, sf, question="what is the latest checkpoint", limit=20):
    """Fused channels, hydrated late, times the temporal multiplier of the question."""
    intent, confidence = lexical.intent_of(question)
    j = fused(spark, sf).join(tables.memories(spark, sf), "id")
    s = F.col("rrf") * score.temporal(intent, confidence, F.coalesce("updated", "created"), NOW)
    return j.select("id", F.round(s, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


@query(f", {DEGREE}, {RRF} SELECT id, round(0.6 * rrf + 0.4 * {ADAPT}, 6) AS score FROM rf JOIN ms USING (id) LEFT JOIN deg USING (id) WHERE importance IS NOT NULL", "ms")
def recall_adaptive(spark, sf):
    m = with_degree(spark, sf).where("importance is not null")
    a = score.adaptive(F.col("importance"), F.col("created"), F.col("recall_count"), F.col("last_recalled"), F.col("degree"), NOW)
    return fused(spark, sf).join(m, "id").select("id", F.round(0.6 * F.col("rrf") + 0.4 * a, 6).alias("score"))


def hits(c: str, tokens: list[str]):
    t = F.lower(F.coalesce(F.col(c), F.lit("")))
    return sum((text.occurrences(t, F.lit(x)) for x in tokens), F.lit(0))


def hits_sql(c: str, tokens: list[str]) -> str:
    return "(" + " + ".join(f"(length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), '{x}', ''))) // {len(x)}" for x in tokens) + ")"


TOK = ["checkpoint", "cursor"]


@query(f"SELECT id, round(({hits_sql('text', TOK)} + 2 * {hits_sql(TAGS, TOK)}) * (0.5 + 0.8 * coalesce(importance, 0)) * (0.7 + 0.6 * coalesce(score, 0)), 6) AS hit FROM m WHERE {hits_sql('text', TOK)} + {hits_sql(TAGS, TOK)} > 0", "m")
def recall_legacy_memories(spark, sf):
    m = memory_docs(spark, sf).withColumn("b", hits("text", TOK)).withColumn("g", hits("tag_text", TOK)).where("b + g > 0")
    s = (F.col("b") + 2 * F.col("g")) * (0.5 + 0.8 * F.coalesce("importance", F.lit(0.0))) * (0.7 + 0.6 * F.coalesce("score", F.lit(0.0)))
    return m.select("id", F.round(s, 6).alias("hit"))


@query(f"SELECT doc_id, round((5 * {hits_sql('title', TOK)} + 3 * {hits_sql('summary', TOK)} + {hits_sql('body', TOK)}) * (0.5 + 1.5 * importance), 6) AS hit FROM p WHERE {hits_sql('body', TOK)} > 0", "p")
def recall_legacy_wiki(spark, sf):
    p = tables.pages(spark, sf).where(hits("body", TOK) > 0)
    s = (5 * hits("title", TOK) + 3 * hits("summary", TOK) + hits("body", TOK)) * (0.5 + 1.5 * F.col("importance"))
    return p.select("doc_id", F.round(s, 6).alias("hit"))


@query(f"SELECT id, round({hits_sql('name', ['lan', 'bos'])} * (0.5 + 1.2 * coalesce(weight, 0) + 0.05 * coalesce(mention_count, 0)), 6) AS hit FROM entities WHERE {hits_sql('name', ['lan', 'bos'])} > 0")
def recall_legacy_entities(spark, sf):
    e = tables.entities(spark, sf).withColumn("h", hits("name", ["lan", "bos"])).where("h > 0")
    return e.select("id", F.round(F.col("h") * (0.5 + 1.2 * F.coalesce("weight", F.lit(0.0)) + 0.05 * F.coalesce("mention_count", F.lit(0))), 6).alias("hit"))


@query(f"SELECT doc_id, 3 * {hits_sql('title', TOK)} + 2 * {hits_sql('summary', TOK)} + {hits_sql('body', TOK)} AS score FROM p WHERE 3 * {hits_sql('title', TOK)} + 2 * {hits_sql('summary', TOK)} + {hits_sql('body', TOK)} > 0", "p")
def wiki_ask(spark, sf):
    p = tables.pages(spark, sf).select("doc_id", (3 * hits("title", TOK) + 2 * hits("summary", TOK) + hits("body", TOK)).cast("long").alias("score"))
    return p.where("score > 0")


@query("SELECT doc_id, round(0.6 * importance + 0.4, 6) AS proxy FROM p ORDER BY importance DESC, created DESC NULLS LAST, doc_id LIMIT 50", "p")
def wiki_proxy_rank(spark, sf):
    return tables.pages(spark, sf).orderBy(F.col("importance").desc(), F.col("created").desc_nulls_last(), "doc_id").limit(50).select("doc_id", F.round(0.6 * F.col("importance") + 0.4, 6).alias("proxy"))


def intent_sql(c: str) -> str:
    n = [" + ".join(f"CAST(contains(lower({c}), '{w}') AS INT)" for w in words) for words in (lexical.CURRENT, lexical.PAST, lexical.FUTURE)]
    return f"SELECT {{k}}, CASE WHEN a > b AND a > f THEN 'current' WHEN b > a AND b > f THEN 'past' WHEN f > a AND f > b THEN 'future' ELSE 'any' END AS intent FROM (SELECT *, {n[0]} AS a, {n[1]} AS b, {n[2]} AS f FROM {{t}})"


@query(intent_sql("coalesce(text, '')").format(k="turn_id", t="t"), "t")
def temporal_intent(spark, sf):
    return tables.turns(spark, sf).select("turn_id", lexical.intents(F.col("text")).alias("intent"))


@query("SELECT id, origin FROM (SELECT id, origin, row_number() OVER (PARTITION BY id ORDER BY pr) AS r FROM (SELECT id, 'bm25' AS origin, 0 AS pr FROM bm UNION ALL SELECT id, 'like', 1 FROM m WHERE contains(lower(text), 'checkpoint'))) WHERE r = 1".replace("SELECT id, origin FROM (SELECT id, origin, row", f", {BM} SELECT id, origin FROM (SELECT id, origin, row", 1), "m")
def lexical_merge(spark, sf):
    """Ids of either channel once, under the first that has them."""
    a = bm25_memories(spark, sf).select("id", F.lit(0).alias("pr"))
    b = tables.memories(spark, sf).where(F.lower("text").contains("checkpoint")).select("id", F.lit(1).alias("pr"))
    return a.unionAll(b).groupBy("id").agg(F.min("pr").alias("pr")).select("id", F.when(F.col("pr") == 0, "bm25").otherwise("like").alias("origin"))


@query(f"SELECT id, round(0.7 * least(1.0, greatest(0.0, importance * (0.25 + 0.75 * pow(0.5, greatest(0.0, ({NOW}.0 - created) / 86400.0) / 7.0)))) + 0.3 * list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV}), 6) AS score FROM m WHERE importance IS NOT NULL AND (ttl IS NULL OR {NOW} - created <= ttl) AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0", "m")
def ltm_search(spark, sf):
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    m = tables.memories(spark, sf).where("importance is not null and embedding is not null").where(F.col("ttl").isNull() | (NOW - F.col("created") <= F.col("ttl"))).where(ok)
    c = text.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in QUERY_VECTOR]))
    return m.select("id", F.round(0.7 * score.item(F.col("importance"), F.col("created"), NOW) + 0.3 * c, 6).alias("score"))
