"""Score queries: every memory's score, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.functions import score
from engrava.operators import scan
from engrava.plans.registry import query
from engrava.sources import tables
from engrava.sources.tables import NOW

AGE = f"greatest(0.0, ({NOW}.0 - created) / 86400.0)"
REC = f"pow(0.5, {AGE} / 30.0)"
IMP = "greatest(0.0, least(1.0, importance))"
CLAMP = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {}))"
USAGE = f"(CASE WHEN recall_count <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ln(1.0 + recall_count) / ln(101.0))) * (0.25 + 0.75 * coalesce(pow(0.5, greatest(0.0, ({NOW}.0 - last_recalled) / 86400.0) / 30.0), 1.0)) END)"
TANH = "((exp(2.0 * ({x})) - 1.0) / (exp(2.0 * ({x})) + 1.0))"
FEED = f"greatest(-0.5, least(0.5, {TANH.format(x='(positive - negative) / 3.0')}))"
V2 = CLAMP.format(f"0.4 * {IMP} + 0.25 * {REC} + 0.25 * {USAGE} + 0.1 * {FEED}")
DEGREE = "deg AS (SELECT memory_id AS id, count(DISTINCT entity_id) AS degree FROM entity_mentions WHERE memory_id IS NOT NULL GROUP BY 1)"
ADAPT = CLAMP.format(f"0.4 * {IMP} + 0.2 * {REC} + 0.25 * {USAGE} + 0.15 * greatest(0.0, least(1.0, ln(1.0 + coalesce(degree, 0)) / ln(9.0)))")


def v2(m):
    return score.blended(F.col("importance"), F.col("created"), F.col("recall_count"), F.col("last_recalled"), F.col("positive"), F.col("negative"), NOW)


@query(f"SELECT id, round({CLAMP.format(f'0.35 * importance + 0.65 * {REC}')}, 6) AS score FROM m WHERE importance IS NOT NULL", "m")
def score_legacy(spark, sf):
    m = tables.memories(spark, sf).where("importance is not null")
    return m.select("id", F.round(score.legacy(F.col("importance"), F.col("created"), NOW), 6).alias("score"))


@query(f"SELECT id, round({V2}, 6) AS score, round({REC}, 6) AS recency, round({USAGE}, 6) AS usage, round({FEED}, 6) AS feedback FROM ms WHERE importance IS NOT NULL", "ms")
def score_v2(spark, sf):
    m = tables.scored_memories(spark, sf).where("importance is not null")
    parts = [score.recency(F.col("created"), NOW), score.usage(F.col("recall_count"), F.col("last_recalled"), NOW), score.feedback(F.col("positive"), F.col("negative"))]
    return m.select("id", F.round(v2(m), 6).alias("score"), *[F.round(p, 6).alias(n) for p, n in zip(parts, ("recency", "usage", "feedback"))])


@query(f"SELECT id, round({V2}, 6) AS new_score FROM ms WHERE importance IS NOT NULL AND abs({V2} - coalesce(score, 0)) > 1e-3", "ms")
def rescore_changed(spark, sf):
    m = tables.scored_memories(spark, sf).where("importance is not null").withColumn("new", v2(None))
    return m.where(F.abs(F.col("new") - F.coalesce("score", F.lit(0.0))) > 1e-3).select("id", F.round("new", 6).alias("new_score"))


@query(f"SELECT id, round({CLAMP.format(f'importance * (0.25 + 0.75 * pow(0.5, {AGE} / 7.0))')}, 6) AS score FROM m WHERE importance IS NOT NULL", "m")
def score_item(spark, sf):
    m = tables.memories(spark, sf).where("importance is not null")
    return m.select("id", F.round(score.item(F.col("importance"), F.col("created"), NOW), 6).alias("score"))


ADJ = CLAMP.format("importance + least(CAST(0.10 AS DOUBLE), 0.10 * recall_count / CAST(5 AS DOUBLE)) - least(CAST(0.15 AS DOUBLE), 0.15 * negative / CAST(3 AS DOUBLE))")


@query(f"SELECT id, round({ADJ}, 6) AS adjusted, round(abs({ADJ} - importance), 6) > 0.05 AS flagged FROM ms WHERE importance IS NOT NULL", "ms")
def signal_adjust(spark, sf):
    m = tables.scored_memories(spark, sf).where("importance is not null")
    a = score.signal_adjusted(F.col("importance"), F.col("recall_count"), F.col("negative"))
    return m.select("id", F.round(a, 6).alias("adjusted"), (F.round(F.abs(a - F.col("importance")), 6) > 0.05).alias("flagged"))


def with_degree(spark, sf):
    degree = tables.mentions(spark, sf).where("memory_id is not null").groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("entity_id").alias("degree"))
    return tables.scored_memories(spark, sf).join(degree, "id", "left").fillna(0, ["degree"])


@query(f", {DEGREE} SELECT id, round({ADAPT}, 6) AS score FROM ms LEFT JOIN deg USING (id) WHERE importance IS NOT NULL", "ms")
def adaptive_score(spark, sf):
    m = with_degree(spark, sf).where("importance is not null")
    a = score.adaptive(F.col("importance"), F.col("created"), F.col("recall_count"), F.col("last_recalled"), F.col("degree"), NOW)
    return m.select("id", F.round(a, 6).alias("score"))


UPD = f"greatest(0.0, ({NOW}.0 - coalesce(updated, created)) / 86400.0)"


@query(f"SELECT id, round(1.0 + (0.25 + 0.25 * exp(-{UPD} / 30.0)) * (2.0 / 3.0), 6) AS current_, round(1.0 + (0.25 + 0.25 * {TANH.format(x=f'least(20.0, ({UPD} - 7.0) / 7.0)')}) * (2.0 / 3.0), 6) AS past_, round(1.0 + (CASE WHEN coalesce(updated, created) > {NOW} THEN 0.4 ELSE -0.3 END) * (2.0 / 3.0), 6) AS future_ FROM m", "m")
def temporal_multiplier(spark, sf):
    m = tables.memories(spark, sf)
    since = F.coalesce("updated", "created")
    return m.select("id", *[F.round(score.temporal(i, 2 / 3, since, NOW), 6).alias(f"{i}_") for i in ("current", "past", "future")])


@query(f"SELECT least(9, CAST(floor(round({V2}, 6) * 10) AS INT)) AS bin, count(*) AS n FROM ms WHERE importance IS NOT NULL GROUP BY 1", "ms")
def score_distribution(spark, sf):
    m = tables.scored_memories(spark, sf).where("importance is not null")
    return m.groupBy(F.least(F.lit(9), F.floor(F.round(v2(None), 6) * 10).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT least(9, CAST(floor(round(score, 6) * 10) AS INT)) AS bin, count(*) AS n FROM m WHERE score >= 0 GROUP BY 1) h ON h.bin = b", "m")
def score_hist_stored(spark, sf):
    h = tables.memories(spark, sf).where("score >= 0").groupBy(F.least(F.lit(9), F.floor(F.round("score", 6) * 10).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return scan.zero_filled(spark.range(10).select(F.col("id").alias("bin")), h, "bin", ["n"])
