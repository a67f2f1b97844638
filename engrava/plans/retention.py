"""Retention: time to live, decay, noise, ceilings, digests of sessions, suggestions of the nightly pass."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.plans.registry import query
from engrava.sources import tables
from engrava.sources.tables import NOW

DAY = 86400


@query(f"SELECT id FROM m WHERE ttl IS NULL OR {NOW} - created <= ttl", "m")
def ttl_gc(spark, sf):
    """What remains: an age equal to the time to live is kept."""
    return tables.memories(spark, sf).where(F.col("ttl").isNull() | (NOW - F.col("created") <= F.col("ttl"))).select("id")


@query("SELECT id FROM ms WHERE recall_count = 0 AND kind <> 'digest' ORDER BY score * coalesce(importance, 0), created, id LIMIT 100", "ms")
def low_value(spark, sf):
    m = tables.scored_memories(spark, sf).where("recall_count = 0 and kind <> 'digest'")
    return m.orderBy(F.col("score") * F.coalesce("importance", F.lit(0.0)), "created", "id").limit(100).select("id")


@query("SELECT id FROM m WHERE kind = 'fact' AND importance >= 0.6 ORDER BY importance DESC, created DESC, id LIMIT 3", "m")
def preference_facts(spark, sf):
    return tables.memories(spark, sf).where("kind = 'fact' and importance >= 0.6").orderBy(F.col("importance").desc(), F.col("created").desc(), "id").limit(3).select("id")


#: Acknowledgements; a text of at most SHORT characters that begins with one is noise, a longer one that is one of
#: those of LONG_WORD characters or more, or goes on behind it with a blank; so is one of at most BRIEF characters that aren't all ASCII.
ACKNOWLEDGEMENTS = ["thanks", "thank you", "ok", "okay", "好的", "是", "对", "嗯", "got it", "sure", "yes", "no", "yep", "nope", "继续", "明白", "知道了", "了解了", "let's continue", "继续吧", "go on", "keep going", "next"]
SHORT, BRIEF, LONG_WORD = 6, 4, 4
BEGINS = "^(" + "|".join(ACKNOWLEDGEMENTS) + ")"
IS_ONE = "^(" + "|".join(w for w in ACKNOWLEDGEMENTS if len(w) >= LONG_WORD) + ")( |$)"
BARE = r"regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "\u0027\u0027") + "'"


@query(rf"SELECT id FROM (SELECT id, {BARE} AS x FROM m) WHERE x = '' OR (length(x) <= {SHORT} AND (regexp_matches(x, {quoted(BEGINS)}) OR (length(x) <= {BRIEF} AND regexp_matches(x, '[^\x00-\x7F]')))) OR (length(x) > {SHORT} AND regexp_matches(x, {quoted(IS_ONE)}))", "m")
def prune_noise(spark, sf):
    x = F.col("x")
    m = tables.memories(spark, sf).select("id", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"^\s+|\s+$", "").alias("x"))
    short = (F.length(x) <= SHORT) & (x.rlike(BEGINS) | ((F.length(x) <= BRIEF) & x.rlike(r"[^\x00-\x7F]")))
    return m.where((x == "") | short | ((F.length(x) > SHORT) & x.rlike(IS_ONE))).select("id")


@query(f"SELECT id FROM ms WHERE {NOW} - created >= {30 * DAY} AND round(score * coalesce(importance, 0), 9) <= 0.04 AND recall_count = 0 AND kind <> 'digest'", "ms")
def prune_decayed(spark, sf):
    """A memory that was ever recalled is kept, however low its score."""
    m = tables.scored_memories(spark, sf).where((NOW - F.col("created") >= 30 * DAY) & (F.col("recall_count") == 0) & (F.col("kind") != "digest"))
    return m.where(F.round(F.col("score") * F.coalesce("importance", F.lit(0.0)), 9) <= 0.04).select("id")


CEILING = "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY score * coalesce(importance, 0), created, id) AS r FROM ms WHERE recall_count = 0 AND kind <> 'digest') WHERE r <= (SELECT count(*) FROM ms) - {0}"


def over_ceiling(spark, sf, ceiling):
    """Of the memories never recalled that are no digest, the lowest-valued, as many as the store is over the ceiling.

    Those that stay are at most ceiling rows: they are found by an ordered limit and left out, so no task ranks the surplus.
    """
    m = tables.scored_memories(spark, sf)
    can_go = m.where("recall_count = 0 and kind <> 'digest'").select("id", (F.col("score") * F.coalesce("importance", F.lit(0.0))).alias("value"), "created")
    n = m.agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("recall_count") == 0) & (F.col("kind") != "digest")).alias("can_go")).first()
    stay = n["can_go"] - max(0, n["all"] - ceiling)
    if stay <= 0:
        return can_go.select("id")
    if stay >= n["can_go"]:
        return can_go.select("id").limit(0)
    best = can_go.orderBy(F.col("value").desc_nulls_first(), F.col("created").desc_nulls_first(), F.col("id").desc()).limit(stay).select("id")
    return can_go.select("id").join(best, "id", "left_anti")


@query(CEILING.format(8000), "ms")
def enforce_ceiling(spark, sf):
    return over_ceiling(spark, sf, 8000)


@query(CEILING.format(1500), "ms")
def enforce_low_ceiling(spark, sf):
    """As enforce_ceiling, at a ceiling that small stores are over."""
    return over_ceiling(spark, sf, 1500)


STALE = f"created < {NOW - 90 * DAY} AND score < 0.2 AND coalesce(importance, 0) < 0.3"
LOW = "recall_count = 0 AND round(score + 0.5 * coalesce(importance, 0), 9) < 0.3"


def stale():
    return (F.col("created") < NOW - 90 * DAY) & (F.col("score") < 0.2) & (F.coalesce("importance", F.lit(0.0)) < 0.3)


def low():
    return (F.col("recall_count") == 0) & (F.round(F.col("score") + 0.5 * F.coalesce("importance", F.lit(0.0)), 9) < 0.3)


@query(f"SELECT id FROM m WHERE {STALE}", "m")
def cognitive_stale(spark, sf):
    return tables.memories(spark, sf).where(stale()).select("id")


@query(f"SELECT id FROM ms WHERE {LOW} AND NOT ({STALE})", "ms")
def cognitive_low_value(spark, sf):
    return tables.scored_memories(spark, sf).where(low() & ~stale()).select("id")


@query(f"SELECT id, CASE WHEN {STALE} THEN 'stale' ELSE 'low_value' END AS action FROM ms WHERE {STALE} OR ({LOW})", "ms")
def cognitive_actions(spark, sf):
    return tables.scored_memories(spark, sf).where(stale() | low()).select("id", F.when(stale(), "stale").otherwise("low_value").alias("action"))


DIGEST_AGE, DIGEST_CHARS, FINGERPRINT = 14 * DAY, 600, 60
DIGEST = f""", a AS (SELECT coalesce(session_id, '_orphan') AS session_id, id, text, row_number() OVER (PARTITION BY coalesce(session_id, '_orphan') ORDER BY coalesce(score, 0) * coalesce(importance, 0) DESC, id) AS r
    FROM ms WHERE {NOW} - created >= {DIGEST_AGE} AND recall_count = 0 AND kind <> 'digest'),
n AS (SELECT session_id, min(id) FILTER (r = 1) AS kept, count(*) - 1 AS digested FROM a GROUP BY 1),
x AS (SELECT session_id, r, replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10), ' ') AS x FROM a WHERE r > 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, lower(substr(x, 1, {FINGERPRINT})) ORDER BY r) AS k FROM x WHERE x <> '') WHERE k = 1),
b AS (SELECT session_id, string_agg('• ' || x, chr(10) ORDER BY r) AS body FROM f GROUP BY 1)
SELECT session_id, kept, digested, CASE WHEN length(body) > {DIGEST_CHARS} THEN regexp_replace(substr(body, 1, {DIGEST_CHARS} - 1), '\s+$', '') || '…' ELSE body END AS digest FROM n JOIN b USING (session_id)"""


@query(DIGEST, "ms")
def session_digest(spark, sf):
    """Of each session's aged memories that were never recalled the best one stays; the others become one digest text.

    A digest has a line for each different beginning and ends at DIGEST_CHARS characters, so a session of any size needs its
    first lines only: copies of a beginning are combined first, and lines are ranked with a limit.
    """
    m = tables.scored_memories(spark, sf).where((NOW - F.col("created") >= DIGEST_AGE) & (F.col("recall_count") == 0) & (F.col("kind") != "digest"))
    order = F.struct((-F.coalesce("score", F.lit(0.0)) * F.coalesce("importance", F.lit(0.0))).alias("v"), F.col("id").alias("i"))
    m = m.select(F.coalesce("session_id", F.lit("_orphan")).alias("session_id"), "id", order.alias("o"), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), "\n", " ").alias("x"))
    kept = m.groupBy("session_id").agg(F.min_by("id", "o").alias("kept"), (F.count(F.lit(1)) - 1).alias("digested"))
    rest = m.where("x <> ''").join(kept.select(F.col("kept").alias("id")), "id", "left_anti")
    first = rest.groupBy("session_id", F.lower(F.substring("x", 1, FINGERPRINT)).alias("f")).agg(F.min("o").alias("o"), F.min_by("x", "o").alias("x"))
    lines = first.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("o"))).where(F.col("r") <= DIGEST_CHARS // 3 + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda p: F.concat(F.lit("• "), p["x"])), "\n")
    digest = lines.groupBy("session_id").agg(body.alias("body"))
    text = F.when(F.length("body") > DIGEST_CHARS, F.concat(F.regexp_replace(F.substring("body", 1, DIGEST_CHARS - 1), r"\s+$", ""), F.lit("…"))).otherwise(F.col("body"))
    return kept.join(digest, "session_id").select("session_id", "kept", "digested", text.alias("digest"))
