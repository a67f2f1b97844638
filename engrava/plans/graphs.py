"""Entity graph: extraction, co-occurrence, weights, neighbours, subgraph and boosts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.operators import graph
from engrava.plans.registry import query
from engrava.session import load
from engrava.sources import tables

TOKENS = r"regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,}[A-Za-z]*|[a-z]+[A-Z][A-Za-z]*|[A-Z]{2,5}')"
STOP = ", ".join(f"'{w}'" for w in graph.GENERIC)
DE = f"de AS (SELECT doc_id, name, min(pos) AS pos FROM (SELECT doc_id, unnest(w) AS name, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) WHERE name NOT IN ({STOP}) GROUP BY 1, 2)"
DR = "dr AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM de)"
CO = "co AS (SELECT least(a.name, b.name) AS src, greatest(a.name, b.name) AS dst, count(*) AS n FROM dr a JOIN dr b ON a.doc_id = b.doc_id AND b.k > a.k AND b.k < a.k + 6 GROUP BY 1, 2)"


def names(spark, sf):
    return graph.names(load(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {DE} SELECT name, count(*) AS n FROM de GROUP BY 1")
def entity_counts(spark, sf):
    return names(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DE}, {DR}, {CO} SELECT src, dst, n FROM co")
def cooccurrence(spark, sf):
    return graph.cooccurring(names(spark, sf), "doc_id")


@query(f"WITH {DE} SELECT name, count(*) AS mentions, round(least(CAST(1 AS DOUBLE), CAST(0.55 AS DOUBLE) + (count(*) - 1) * CAST(0.05 AS DOUBLE)), 6) AS weight FROM de GROUP BY 1")
def entity_weights(spark, sf):
    """State after one upsert per mention with a bump of .05: the closed form of the loop."""
    return names(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("mentions")).withColumn("weight", F.round(F.least(F.lit(1.0), 0.55 + (F.col("mentions") - 1) * 0.05), 6))


@query(f"WITH {DE}, {DR}, {CO} SELECT src, dst, round(least(CAST(1 AS DOUBLE), CAST(0.3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (n - 1)), 6) AS weight FROM co")
def relation_weights(spark, sf):
    return cooccurrence(spark, sf).select("src", "dst", F.round(F.least(F.lit(1.0), 0.3 + 0.05 * (F.col("n") - 1)), 6).alias("weight"))


@query(f"WITH {DE}, {DR}, {CO}, e AS (SELECT src, dst, n FROM co WHERE n >= 2) SELECT (SELECT count(DISTINCT name) FROM de) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT CAST(sum(n) AS BIGINT) FROM e) AS weight")
def graph_from_memories(spark, sf):
    e = cooccurrence(spark, sf).where("n >= 2").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("weight"))
    return names(spark, sf).agg(F.count_distinct("name").alias("nodes")).join(e, F.lit(True))


@query("SELECT a.memory_id, a.entity_id AS src, b.entity_id AS dst FROM (SELECT DISTINCT memory_id, entity_id FROM entity_mentions) a JOIN (SELECT DISTINCT memory_id, entity_id FROM entity_mentions) b ON a.memory_id = b.memory_id AND a.entity_id <> b.entity_id")
def neighbours(spark, sf):
    """Both directions of the links that shared memories make, one hop."""
    return graph.linked(tables.mentions(spark, sf))


@query("SELECT kind, count(*) AS n, CAST(sum(mention_count) AS BIGINT) AS mentions FROM (SELECT lower(kind) AS kind, mention_count FROM entities) GROUP BY 1")
def graph_stats(spark, sf):
    return tables.entities(spark, sf).groupBy(F.lower("kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("mention_count").alias("mentions"))


@query("SELECT e.id AS entity_id, count(DISTINCT m.memory_id) AS n, max(m.weight) AS weight FROM entities e JOIN entity_mentions m ON m.entity_id = e.id GROUP BY 1")
def entity_mentions_rebuilt(spark, sf):
    m = tables.mentions(spark, sf).groupBy("entity_id", "memory_id").agg(F.max("weight").alias("weight"))
    m = m.join(tables.entities(spark, sf).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return m.groupBy("entity_id").agg(F.count(F.when(F.col("memory_id").isNotNull(), 1)).alias("n"), F.max("weight").alias("weight"))


@query("SELECT id, CASE WHEN contains(name, '/') AND contains(name, '.') THEN 'path' WHEN starts_with(name, '#') THEN 'tag' WHEN name = upper(name) THEN 'acronym' WHEN regexp_matches(name, '[^\\x00-\\x7F]') THEN 'cjk' ELSE 'concept' END AS guessed FROM entities WHERE name IS NOT NULL")
def edge_kind(spark, sf):
    return tables.entities(spark, sf).where("name is not null").select("id", graph.kind_of(F.col("name")).alias("guessed"))


@query("WITH q AS (SELECT id FROM entities WHERE starts_with(lower(name), 'ba')), mm AS (SELECT DISTINCT memory_id, entity_id FROM entity_mentions WHERE memory_id IS NOT NULL), qm AS (SELECT memory_id, count(*) AS nq FROM mm WHERE entity_id IN (SELECT id FROM q) GROUP BY 1), nb AS (SELECT DISTINCT entity_id FROM mm WHERE memory_id IN (SELECT memory_id FROM qm) AND entity_id NOT IN (SELECT id FROM q)), nm AS (SELECT memory_id, count(*) AS n FROM mm WHERE entity_id IN (SELECT entity_id FROM nb) GROUP BY 1) SELECT memory_id, round(least(1.5, 0.45 + 0.25 * ln(1.0 + n)), 3) AS boost FROM qm JOIN nm USING (memory_id)")
def graph_boost(spark, sf):
    """Memories that mention a query entity and a neighbour of one, by the number of neighbours."""
    q = tables.entities(spark, sf).where(F.lower("name").startswith("ba")).select(F.col("id").alias("entity_id"))
    return graph.boost(tables.mentions(spark, sf), q)


@query("WITH q AS (SELECT id FROM entities WHERE starts_with(lower(name), 'ba')), mm AS (SELECT DISTINCT memory_id, entity_id FROM entity_mentions), x AS (SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS n FROM mm a JOIN mm b ON a.memory_id = b.memory_id AND a.entity_id <> b.entity_id WHERE a.entity_id IN (SELECT id FROM q) GROUP BY 1, 2) SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM x) WHERE r <= 32")
def subgraph(spark, sf, most=32):
    q = tables.entities(spark, sf).where(F.lower("name").startswith("ba")).select(F.col("id").alias("src"))
    x = graph.linked(tables.mentions(spark, sf), q).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "dst"))).where(F.col("r") <= most).select("src", "dst", "n")


@query("WITH g AS (SELECT doc_id, name, title FROM (SELECT p.doc_id, title, unnest(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{4,}'))) AS name FROM p)), c AS (SELECT name FROM g GROUP BY name HAVING count(*) BETWEEN 2 AND 8) SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM g a JOIN g b ON a.name = b.name AND a.doc_id <> b.doc_id WHERE a.name IN (SELECT name FROM c)".replace("WITH g", ", g"), "p")
def page_related(spark, sf):
    """Pages that share a concept which at most eight pages have, both directions."""
    return graph.related(tables.pages(spark, sf), most=8)


@query("WITH g AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{4,}'))) AS name FROM p) SELECT name, 'mentions' AS kind, 0.4 AS weight, count(*) AS n FROM g GROUP BY 1 UNION ALL SELECT lang, 'tagged_with', 0.7, count(*) FROM p WHERE lang IS NOT NULL GROUP BY 1".replace("WITH g", ", g").replace("0.4 AS weight", "CAST(0.4 AS DOUBLE) AS weight").replace("0.7,", "CAST(0.7 AS DOUBLE),"), "p")
def graph_from_wiki(spark, sf):
    p = tables.pages(spark, sf)
    c = graph.concepts(p).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", F.lit("mentions").alias("kind"), F.lit(0.4).alias("weight"), "n")
    t = p.where("lang is not null").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", F.lit("tagged_with").alias("kind"), F.lit(0.7).alias("weight"), "n")
    return c.unionAll(t)


@query("WITH w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_/.:-]*[A-Za-z0-9]'))) AS name FROM m) SELECT w.id AS memory_id, e.id AS entity_id FROM w JOIN entities e ON lower(e.name) = w.name".replace("WITH w", ", w"), "m")
def mention_backfill(spark, sf):
    """Mentions of entities by whole words: an equi-join on the words of a text instead of a substring test of all pairs."""
    w = tables.memories(spark, sf).select(F.col("id").alias("memory_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([A-Za-z][A-Za-z0-9_/.:-]*[A-Za-z0-9])"), 1))).alias("name"))
    return w.join(tables.entities(spark, sf).select(F.col("id").alias("entity_id"), F.lower("name").alias("name")), "name").select("memory_id", "entity_id")
