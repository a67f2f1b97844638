"""Mutations as functions from old state and changes to new state; incoming items and turns are the changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators import state
from engrava.plans.registry import query
from engrava.session import load
from engrava.sources import tables

OLD = "old AS (SELECT id, kind, importance, created FROM m)"
NEW = "nw AS (SELECT id, kind, importance, created FROM (SELECT memory_id AS id, 'episode' AS kind, max(weight) AS importance, min(epoch_us(created_at)) / 1e6 AS created FROM entity_mentions WHERE memory_id IS NOT NULL GROUP BY 1))"


def changes(spark, sf):
    m = tables.mentions(spark, sf).where("memory_id is not null")
    return m.groupBy(F.col("memory_id").alias("id")).agg(F.max("weight").alias("importance"), F.min(tables.epoch("created_at")).alias("created")).select("id", F.lit("episode").alias("kind"), "importance", "created")


@query(f", {OLD}, {NEW} SELECT coalesce(old.id, nw.id) AS id, coalesce(old.kind, nw.kind) AS kind, coalesce(nw.importance, old.importance) AS importance, coalesce(old.created, nw.created) AS created FROM old FULL JOIN nw ON old.id = nw.id", "m")
def upsert_memories(spark, sf):
    """Kind and creation stay as they were; importance is taken from the change unless it is missing there."""
    old = tables.memories(spark, sf).select("id", "kind", "importance", "created")
    return state.upsert(old, changes(spark, sf), ["id"], keep=["kind", "created"], take=["importance"])


@query(", ch AS (SELECT session_id AS id, count(*) AS message_count, max(created) AS ended FROM t WHERE session_id IS NOT NULL GROUP BY 1) SELECT coalesce(s.id, ch.id) AS id, coalesce(ch.message_count, s.message_count) AS message_count, coalesce(ch.ended, epoch_us(s.ended_at) / 1e6) AS ended FROM sessions s FULL JOIN ch ON s.id = ch.id", "t")
def upsert_sessions(spark, sf):
    ch = tables.turns(spark, sf).where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"), F.max("created").alias("ended"))
    return state.upsert(tables.sessions(spark, sf).select("id", "message_count", "ended"), ch, ["id"], keep=[], take=["message_count", "ended"])


PAIR = "pr AS (SELECT id, matched_id FROM d WHERE matched_id IS NOT NULL)"


@query(", dd AS (SELECT matched_id, count(*) AS n, max(matched_score) AS best FROM d WHERE matched_id IS NOT NULL GROUP BY 1) SELECT m.id, n, best, least(1.0, coalesce(importance, 0) + 0.02 * n) AS importance FROM m JOIN dd ON dd.matched_id = m.id".replace("least(1.0, coalesce(importance, 0) + 0.02 * n)", "round(least(CAST(1 AS DOUBLE), coalesce(importance, 0) + 0.02 * n), 6)"), "m d")
def memory_merge(spark, sf):
    """Memories that rejected duplicates point to gain .02 of importance each, at most 1."""
    d = tables.drops(spark, sf).where("matched_id is not null").groupBy(F.col("matched_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("matched_score").alias("best"))
    m = tables.memories(spark, sf).join(d, "id")
    return m.select("id", "n", "best", F.round(F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.0)) + 0.02 * F.col("n")), 6).alias("importance"))


@query("SELECT m.id FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.memory_id = m.id AND negative > positive AND negative >= 2)", "m s")
def feedback_apply(spark, sf):
    """Memories left after those with mostly down-votes are taken away: an anti-join with the tombstones."""
    gone = tables.signals(spark, sf).where("negative > positive and negative >= 2").select(F.col("memory_id").alias("id"))
    return tables.memories(spark, sf).join(gone, "id", "left_anti").select("id")


@query("SELECT doc_id AS page_id, 2 AS version FROM p", "p")
def fork_versions(spark, sf):
    """The next version of each page: one more than its highest so far."""
    p = tables.pages(spark, sf).select(F.col("doc_id").alias("page_id"))
    return state.next_version(p, p.withColumn("version", F.lit(1)), "page_id")


@query("SELECT id, coalesce(external_id, concat('sha1:', substr(sha1(text), 1, 16))) AS external_id FROM m WHERE text IS NOT NULL", "m")
def import_ids(spark, sf):
    return tables.memories(spark, sf).where("text is not null").select("id", F.coalesce("external_id", F.concat(F.lit("sha1:"), F.substring(F.sha1("text"), 1, 16))).alias("external_id"))


@query("SELECT item_id, CASE WHEN length(trim(coalesce(text, ''))) < 25 THEN 'too_short' WHEN kind = 'episode' AND coalesce(importance, 0) < 0.4 AND length(trim(text)) < 60 THEN 'low_signal' WHEN length(trim(text)) > 1200 THEN 'too_long' ELSE 'pass' END AS verdict FROM (SELECT item_id, min(text) AS text, min(kind) AS kind, min(importance) AS importance FROM incoming_items WHERE item_id IS NOT NULL GROUP BY 1)")
def write_guard(spark, sf):
    i = load(spark, sf, "incoming_items").where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"), F.min("kind").alias("kind"), F.min("importance").alias("importance"))
    return i.select("item_id", state.guard(F.col("text"), F.col("kind"), F.col("importance")).alias("verdict"))
