"""Listing, paging, lookup and filter queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.operators import scan
from engrava.plans.registry import query
from engrava.sources import tables
from engrava.sources.tables import NOW


@query("SELECT id, kind, importance FROM m WHERE kind = 'fact' AND score >= 0.3 AND created >= 1767225600 AND contains(lower(text), 'checkpoint') ORDER BY created DESC, id LIMIT 50", "m")
def list_memories(spark, sf, kind="fact", least=0.3, since=1767225600, needle="checkpoint", limit=50):
    m = scan.where_all(tables.memories(spark, sf), F.col("kind") == kind, F.col("score") >= least, F.col("created") >= since, scan.contains_all_case("text", needle))
    return scan.newest(m, limit, F.col("created").desc(), F.col("id")).select("id", "kind", "importance")


@query("SELECT id, created FROM m WHERE created < 1767225600 ORDER BY created DESC, id DESC LIMIT 100", "m")
def memories_page(spark, sf):
    return scan.keyset(tables.memories(spark, sf), "created", "id", (1767225600.0, ""), 100).select("id", "created")


@query("SELECT id, source, message_count FROM sessions ORDER BY coalesce(ended_at, started_at) DESC NULLS LAST, id LIMIT 50")
def list_sessions(spark, sf):
    s = tables.sessions(spark, sf)
    return s.orderBy(F.coalesce("ended", "started").desc_nulls_last(), "id").limit(50).select("id", "source", "message_count")


@query("SELECT doc_id, title, scope FROM p WHERE importance >= 0.5 AND (contains(lower(title), 'a') OR contains(lower(summary), 'a')) ORDER BY importance DESC, doc_id LIMIT 50", "p")
def list_wiki(spark, sf):
    p = tables.pages(spark, sf).where(F.col("importance") >= 0.5).where(scan.contains_all_case("title", "a") | scan.contains_all_case("summary", "a"))
    return p.orderBy(F.col("importance").desc(), "doc_id").limit(50).select("doc_id", "title", "scope")


@query("SELECT id, name, weight FROM entities ORDER BY weight DESC NULLS LAST, id LIMIT 50")
def top_entities(spark, sf):
    return tables.entities(spark, sf).orderBy(F.col("weight").desc_nulls_last(), "id").limit(50).select("id", "name", "weight")


@query("SELECT agent_id, external_id, arg_max(id, (updated, id)) AS id FROM m WHERE agent_id IS NOT NULL AND coalesce(external_id, '') <> '' GROUP BY 1, 2", "m")
def find_by_external(spark, sf):
    """Newest memory of every (agent, external id): the lookup for all keys at once."""
    m = tables.memories(spark, sf).where("agent_id is not null and coalesce(external_id, '') <> ''")
    return m.groupBy("agent_id", "external_id").agg(F.max_by("id", F.struct("updated", "id")).alias("id"))


@query("SELECT id, kind, source, at_s FROM d WHERE kind = 'duplicate' ORDER BY at_s DESC, id LIMIT 100", "d")
def audit_history(spark, sf):
    return tables.drops(spark, sf).where("kind = 'duplicate'").orderBy(F.col("at_s").desc(), "id").limit(100).select("id", "kind", "source", "at_s")


@query("SELECT id, lower(split_part(coalesce(source, 'unknown'), '/', 1)) AS bucket FROM m", "m")
def source_buckets(spark, sf):
    return tables.memories(spark, sf).select("id", scan.bucket().alias("bucket"))


@query("SELECT doc_id FROM p WHERE scope = 'global' OR list_contains(string_split(scope, ','), 'claude')", "p")
def scope_filter(spark, sf):
    return tables.pages(spark, sf).where(F.col("scope").isin("global", "all") | F.array_contains(F.split("scope", ","), "claude")).select("doc_id")


@query("SELECT id FROM m WHERE (agent_id IS NULL AND user_id IS NULL) OR ((agent_id IS NULL OR agent_id = 'agent-1') AND (user_id IS NULL OR user_id = 'u1'))", "m")
def namespace_visible(spark, sf):
    return tables.memories(spark, sf).where(scan.visible("agent-1", "u1")).select("id")


@query("SELECT doc_id, substr(text, 1, 800) AS body, substr(text, 1, 240) AS preview FROM documents WHERE text IS NOT NULL")
def tiered_payload(spark, sf):
    return tables.documents(spark, sf).where("text is not null").select("doc_id", *scan.tiered(1))


@query("SELECT count(DISTINCT memory_id) AS cited, (SELECT count(*) FROM m) AS total FROM ev", "ev")
def evidence_coverage(spark, sf):
    cited = tables.evidence(spark, sf).agg(F.count_distinct("memory_id").alias("cited"))
    return cited.join(tables.memories(spark, sf).agg(F.count(F.lit(1)).alias("total")), F.lit(True))


GRAN = f"CASE WHEN coalesce(importance, 0) >= 0.7 THEN 'core' WHEN kind = 'episode' AND created >= {NOW} - 86400 * 30 THEN 'scratch' ELSE 'working' END"


@query(f"SELECT {GRAN} AS granularity, count(*) AS n FROM m GROUP BY 1", "m")
def granularity(spark, sf):
    g = F.when(F.coalesce("importance", F.lit(0.0)) >= 0.7, "core").when((F.col("kind") == "episode") & (F.col("created") >= NOW - 86400 * 30), "scratch").otherwise("working")
    return tables.memories(spark, sf).groupBy(g.alias("granularity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN score >= 0.5 THEN 'active' WHEN score >= 0.15 THEN 'decayed' WHEN score = 0 THEN 'forgotten' ELSE 'archived' END AS status, count(*) AS n FROM m GROUP BY 1", "m")
def status_distribution(spark, sf):
    s = F.when(F.col("score") >= 0.5, "active").when(F.col("score") >= 0.15, "decayed").when(F.col("score") == 0, "forgotten").otherwise("archived")
    return tables.memories(spark, sf).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, length(text) AS n FROM m WHERE length(text) > 280 ORDER BY n DESC, id LIMIT 80", "m")
def compressible(spark, sf):
    return tables.memories(spark, sf).where(F.length("text") > 280).select("id", F.length("text").alias("n")).orderBy(F.col("n").desc(), "id").limit(80)


@query("SELECT memory_id, entity_id, weight FROM (SELECT memory_id, id AS entity_id, m.weight, row_number() OVER (PARTITION BY id ORDER BY m.weight DESC NULLS LAST, memory_id) AS rn FROM (SELECT memory_id, entity_id, max(weight) AS weight FROM entity_mentions WHERE memory_id IS NOT NULL GROUP BY 1, 2) m JOIN entities e ON e.id = m.entity_id) WHERE rn <= 10")
def memories_for_entity(spark, sf, top=10):
    """The memories of every entity, heaviest first, top of each."""
    m = tables.mentions(spark, sf).where("memory_id is not null").groupBy("memory_id", "entity_id").agg(F.max("weight").alias("weight"))
    m = m.join(tables.entities(spark, sf).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    w = Window.partitionBy("entity_id").orderBy(F.col("weight").desc_nulls_last(), "memory_id")
    return m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("memory_id", "entity_id", "weight")


@query("SELECT id, recall_count, positive, negative FROM ms ORDER BY recall_count DESC, id LIMIT 50", "ms")
def top_signals(spark, sf):
    return tables.scored_memories(spark, sf).orderBy(F.col("recall_count").desc(), "id").limit(50).select("id", "recall_count", "positive", "negative")


@query("SELECT session_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC, turn_id DESC) AS r FROM t WHERE session_id IS NOT NULL) WHERE r <= 16", "t")
def short_term_window(spark, sf, capacity=16):
    w = Window.partitionBy("session_id").orderBy(F.col("turn_no").desc(), F.col("turn_id").desc())
    t = tables.turns(spark, sf).where("session_id is not null").withColumn("r", F.row_number().over(w))
    return t.where(F.col("r") <= capacity).select("session_id", "turn_id")


@query("SELECT session_id, turn_id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY turn_no, turn_id) - 1) // 8 AS INT) AS batch FROM t WHERE session_id IS NOT NULL", "t")
def batches(spark, sf, size=8):
    w = Window.partitionBy("session_id").orderBy("turn_no", "turn_id")
    return tables.turns(spark, sf).where("session_id is not null").select("session_id", "turn_id", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("batch"))


@query("SELECT session_id, min(created) AS first_at, max(created) AS last_at, count(*) AS n FROM t WHERE session_id IS NOT NULL GROUP BY 1", "t")
def session_span(spark, sf):
    return tables.turns(spark, sf).where("session_id is not null").groupBy("session_id").agg(F.min("created").alias("first_at"), F.max("created").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, substr(arg_min(text, turn_no) FILTER (role = 'user' AND coalesce(text, '') <> ''), 1, 80) AS title, arg_max(text, turn_no) FILTER (role = 'assistant' AND coalesce(text, '') <> '') AS outcome FROM t WHERE session_id IS NOT NULL GROUP BY 1", "t")
def session_title_outcome(spark, sf):
    said = F.coalesce("text", F.lit("")) != ""
    t = tables.turns(spark, sf).where("session_id is not null")
    first = F.min_by("text", F.when((F.col("role") == "user") & said, F.col("turn_no")))
    last = F.max_by("text", F.when((F.col("role") == "assistant") & said, F.col("turn_no")))
    return t.groupBy("session_id").agg(F.substring(first, 1, 80).alias("title"), last.alias("outcome"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    from engrava.session import load

    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT id, isoyear(created_at) AS iso_year, weekofyear(created_at) AS iso_week FROM m", "m")
def iso_week(spark, sf):
    return tables.memories(spark, sf).select("id", F.expr("extract(YEAROFWEEK FROM created_at)").cast("long").alias("iso_year"), F.weekofyear("created_at").cast("long").alias("iso_week"))


