"""Dashboard aggregates. Conditional aggregates share one pass over a table; every result is small."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.operators import scan
from engrava.plans.registry import query
from engrava.session import load
from engrava.sources import tables
from engrava.sources.tables import NOW

DAY = 86400


def n():
    return F.count(F.lit(1)).alias("n")


@query("SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM m) AS memories, (SELECT count(*) FROM p) AS pages, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM entity_mentions) AS mentions, (SELECT round(avg(score), 4) FROM m) AS avg_score, (SELECT round(avg(importance), 4) FROM p) AS avg_page_importance", "m p")
def store_stats(spark, sf):
    m = tables.memories(spark, sf).agg(F.count(F.lit(1)).alias("memories"), F.round(F.avg("score"), 4).alias("avg_score"))
    p = tables.pages(spark, sf).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("importance"), 4).alias("avg_page_importance"))
    one = [load(spark, sf, t).agg(F.count(F.lit(1)).alias(a)) for t, a in (("sessions", "sessions"), ("entities", "entities"), ("entity_mentions", "mentions"))]
    out = m
    for x in (p, *one):  # one row each
        out = out.join(x, F.lit(True))
    return out


@query(f"SELECT count(*) AS total, count(*) FILTER (created >= {NOW - DAY}) AS today, count(*) FILTER (score >= 0.3 AND created >= {NOW - 7 * DAY}) AS active, count(*) FILTER (score < 0.3) AS decayed, round(avg(score), 4) AS avg_score, round(100.0 * count(*) FILTER (score < 0.3) / CAST(count(*) AS DOUBLE), 4) AS decay_pct FROM m", "m")
def overview_kpis(spark, sf):
    m = tables.memories(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("created") >= NOW - DAY).alias("today"), F.count_if((F.col("score") >= 0.3) & (F.col("created") >= NOW - 7 * DAY)).alias("active"), F.count_if(F.col("score") < 0.3).alias("decayed"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.lit(100.0) * F.count_if(F.col("score") < 0.3) / F.count(F.lit(1)), 4).alias("decay_pct"))


@query(f"SELECT count(*) FILTER (created >= {NOW - DAY}) AS extracted, count(*) FILTER (score >= 0.3 AND created >= {NOW - 7 * DAY}) AS active, count(*) FILTER (score < 0.3) AS decayed, count(*) FILTER (score > 0 AND score < 0.15) AS archived, count(*) FILTER (score = 0) AS forgotten FROM m", "m")
def lifecycle_stages(spark, sf):
    s, c = F.col("score"), F.col("created")
    return tables.memories(spark, sf).agg(F.count_if(c >= NOW - DAY).alias("extracted"), F.count_if((s >= 0.3) & (c >= NOW - 7 * DAY)).alias("active"), F.count_if(s < 0.3).alias("decayed"), F.count_if((s > 0) & (s < 0.15)).alias("archived"), F.count_if(s == 0).alias("forgotten"))


@query("SELECT m.id, length(text) AS n, ev.memory_id IS NOT NULL AS in_wiki FROM m LEFT JOIN (SELECT DISTINCT memory_id FROM ev) ev ON ev.memory_id = m.id WHERE length(text) > 280 ORDER BY n DESC, m.id LIMIT 30", "ev")
def compression(spark, sf):
    top = tables.memories(spark, sf).where(F.length("text") > 280).select("id", F.length("text").alias("n")).orderBy(F.col("n").desc(), "id").limit(30)
    cited = tables.evidence(spark, sf).select(F.col("memory_id").alias("id"), F.lit(True).alias("cited")).distinct()
    return top.join(cited, "id", "left").select("id", "n", F.coalesce("cited", F.lit(False)).alias("in_wiki"))


@query("SELECT kind, count(*) AS n FROM m GROUP BY 1", "m")
def kind_distribution(spark, sf):
    return tables.memories(spark, sf).groupBy("kind").agg(n())


@query(f"SELECT CAST(g.d AS BIGINT) AS day, coalesce(c.n, 0) AS n FROM (SELECT unnest(range({NOW // DAY - 6}, {NOW // DAY + 1})) AS d) g LEFT JOIN (SELECT CAST(floor(created / 86400) AS BIGINT) AS d, count(*) AS n FROM m GROUP BY 1) c USING (d)", "m")
def daily_trend(spark, sf):
    """Memories of each of the last seven UTC days, as days since 1970."""
    c = tables.memories(spark, sf).where(F.col("created") >= (NOW // DAY - 6) * DAY).groupBy(F.floor(F.col("created") / DAY).cast("long").alias("day")).agg(n())
    return scan.zero_filled(spark.range(NOW // DAY - 6, NOW // DAY + 1).select(F.col("id").alias("day")), c, "day", ["n"])


@query("SELECT CAST(h AS BIGINT) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT CAST(floor(created / 3600) AS BIGINT) % 24 AS hh, count(*) AS n FROM m GROUP BY 1) c ON c.hh = h", "m")
def hourly_ingest(spark, sf):
    c = tables.memories(spark, sf).groupBy((F.floor(F.col("created") / 3600).cast("long") % 24).alias("hour")).agg(n())
    return scan.zero_filled(spark.range(24).select(F.col("id").alias("hour")), c, "hour", ["n"])


@query("SELECT CAST(sum(recall_count) AS BIGINT) AS recalls, count(*) AS memories FROM s WHERE last_recalled >= 1767225600", "s")
def recall_throughput(spark, sf, since=1767225600):
    return tables.signals(spark, sf).where(F.col("last_recalled") >= since).agg(F.sum("recall_count").alias("recalls"), F.count(F.lit(1)).alias("memories"))


@query("SELECT lower(split_part(coalesce(source, 'unknown'), '/', 1)) AS bucket, count(*) AS n FROM m GROUP BY 1", "m")
def source_breakdown(spark, sf):
    return tables.memories(spark, sf).groupBy(scan.bucket().alias("bucket")).agg(n())


@query("SELECT (SELECT count(*) FROM p) AS pages, (SELECT round(avg(importance), 6) FROM p) AS avg_importance, (SELECT CAST(sum(length(body)) AS BIGINT) FROM p) AS chars, (SELECT count(DISTINCT memory_id) FROM ev) AS cited", "ev")
def wiki_health(spark, sf):
    p = tables.pages(spark, sf).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.sum(F.length("body")).alias("chars"))
    return p.join(tables.evidence(spark, sf).agg(F.count_distinct("memory_id").alias("cited")), F.lit(True))


AGE = f"(({NOW} - created) / 86400.0)"


@query(f"SELECT CASE WHEN {AGE} < 1 THEN '1d' WHEN {AGE} < 7 THEN '7d' WHEN {AGE} < 30 THEN '30d' WHEN {AGE} < 90 THEN '90d' ELSE 'older' END AS age, count(*) AS n, round(avg(score), 3) AS avg_score, round(avg(pow(0.5, greatest(0.0, {AGE}) / 30.0)), 3) AS avg_recency FROM m GROUP BY 1", "m")
def decay_stats(spark, sf):
    a = (F.lit(float(NOW)) - F.col("created")) / DAY
    b = F.when(a < 1, "1d").when(a < 7, "7d").when(a < 30, "30d").when(a < 90, "90d").otherwise("older")
    return tables.memories(spark, sf).groupBy(b.alias("age")).agg(n(), F.round(F.avg("score"), 3).alias("avg_score"), F.round(F.avg(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), a) / 30.0)), 3).alias("avg_recency"))


STAGE = "CASE o_orderkey % 5 WHEN 0 THEN 'score' WHEN 1 THEN 'cluster' WHEN 2 THEN 'distill' WHEN 3 THEN 'wiki' ELSE 'graph' END"


def runs(spark, sf):
    """pipeline_runs, from orders: a stage, a start, and an end that unfinished runs don't have."""
    k = F.pmod("o_orderkey", F.lit(5))
    stage = F.when(k == 0, "score").when(k == 1, "cluster").when(k == 2, "distill").when(k == 3, "wiki").otherwise("graph")
    start = tables.epoch("o_orderdate").cast("long")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), stage.alias("stage"), start.alias("started"), F.when(F.col("o_orderstatus") != "P", start + F.pmod("o_orderkey", F.lit(900))).alias("finished"))


RUNS = f"r AS (SELECT o_orderkey AS id, {STAGE} AS stage, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS started, CASE WHEN o_orderstatus <> 'P' THEN CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) + o_orderkey % 900 END AS finished FROM orders)"


@query(f"WITH {RUNS} SELECT stage, CAST(floor(avg((finished - started) * 1000)) AS BIGINT) AS avg_ms, count(*) AS n FROM r WHERE finished IS NOT NULL GROUP BY 1")
def pipeline_latency(spark, sf):
    r = runs(spark, sf).where("finished is not null")
    return r.groupBy("stage").agg(F.floor(F.avg((F.col("finished") - F.col("started")) * 1000)).cast("long").alias("avg_ms"), n())


@query(f"WITH {RUNS} SELECT stage, id, started FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY started DESC, id DESC) AS k FROM r) WHERE k <= 5")
def pipeline_latest(spark, sf):
    w = Window.partitionBy("stage").orderBy(F.col("started").desc(), F.col("id").desc())
    return runs(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 5").select("stage", "id", "started")


@query("SELECT source, n, message_count, grouping_id AS lv FROM (SELECT source, count(*) AS n, CAST(sum(message_count) AS BIGINT) AS message_count, CAST(grouping(source) AS INT) AS grouping_id FROM sessions GROUP BY ROLLUP(source))")
def session_counts(spark, sf):
    s = tables.sessions(spark, sf).rollup("source").agg(n(), F.sum("message_count").alias("message_count"), F.grouping("source").cast("int").alias("lv"))
    return s.select("source", "n", "message_count", "lv")


@query(f"SELECT bucket, n, last_at, CASE WHEN last_at >= {NOW - DAY} THEN 'fresh' WHEN last_at >= {NOW - 7 * DAY} THEN 'stale' ELSE 'silent' END AS health FROM (SELECT lower(split_part(coalesce(source, 'unknown'), '/', 1)) AS bucket, count(*) AS n, max(created) AS last_at FROM m GROUP BY 1)", "m")
def source_health(spark, sf):
    """Counts of a source's parts are summed and its newest row counts."""
    s = tables.memories(spark, sf).groupBy(scan.bucket().alias("bucket")).agg(n(), F.max("created").alias("last_at"))
    return s.withColumn("health", F.when(F.col("last_at") >= NOW - DAY, "fresh").when(F.col("last_at") >= NOW - 7 * DAY, "stale").otherwise("silent"))


@query("SELECT l_returnflag AS kind, count(*) AS calls, CAST(sum(l_quantity) AS DOUBLE) AS tokens, round(sum(l_extendedprice), 2) AS cost, count(*) FILTER (l_returnflag = 'R') AS failures FROM lineitem GROUP BY 1")
def llm_audit_stats(spark, sf):
    """The call log, from lineitem: quantity stands for tokens, price for cost, flag R for a failed call."""
    a = load(spark, sf, "lineitem")
    return a.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.sum("l_quantity").alias("tokens"), F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.count_if(F.col("l_returnflag") == "R").alias("failures"))


@query("SELECT source, kind, count(*) AS n, max(at_s) AS last_at, CAST(grouping(source) AS INT) AS lv FROM d GROUP BY GROUPING SETS ((source, kind), (kind))", "d")
def guard_summary(spark, sf):
    tables.drops(spark, sf).select("source", "kind", "at_s").createOrReplaceTempView("engrava_drops")
    return spark.sql("SELECT source, kind, count(*) AS n, max(at_s) AS last_at, CAST(grouping(source) AS INT) AS lv FROM engrava_drops GROUP BY GROUPING SETS ((source, kind), (kind))")


@query("SELECT 'sessions' AS name, count(*) AS n FROM sessions UNION ALL SELECT 'memories', count(*) FROM memories UNION ALL SELECT 'turns', count(*) FROM turns UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'entity_mentions', count(*) FROM entity_mentions UNION ALL SELECT 'write_guard_drops', count(*) FROM write_guard_drops")
def storage_breakdown(spark, sf):
    out = None
    for t in ("sessions", "memories", "turns", "entities", "entity_mentions", "write_guard_drops"):
        one = load(spark, sf, t).agg(n()).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"SELECT id, part FROM (SELECT id, 'highlight' AS part FROM (SELECT id FROM m WHERE created >= {NOW - 60 * DAY} ORDER BY importance DESC NULLS LAST, score DESC, created DESC, id LIMIT 10) UNION ALL SELECT id, 'lowlight' FROM (SELECT id FROM m WHERE created >= {NOW - 60 * DAY} ORDER BY importance NULLS LAST, score, created, id LIMIT 6))", "m")
def weekly_report(spark, sf, since=NOW - 60 * DAY):
    m = tables.memories(spark, sf).where(F.col("created") >= since)
    high = m.orderBy(F.col("importance").desc_nulls_last(), F.col("score").desc(), F.col("created").desc(), "id").limit(10).select("id", F.lit("highlight").alias("part"))
    low = m.orderBy(F.col("importance").asc_nulls_last(), "score", "created", "id").limit(6).select("id", F.lit("lowlight").alias("part"))
    return high.unionAll(low)


@query(", k AS (SELECT session_id, kind, count(*) AS c FROM m WHERE session_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT session_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY c DESC, kind) AS r FROM k) WHERE r = 1), tg AS (SELECT session_id, lower(unnest(tags)) AS tag FROM m WHERE session_id IS NOT NULL), tc AS (SELECT session_id, tag, count(*) AS c FROM tg WHERE tag IS NOT NULL GROUP BY 1, 2), bt AS (SELECT session_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY c DESC, tag) AS r FROM tc) WHERE r = 1) SELECT m.session_id, count(*) AS size, min(b.kind) AS kind, min(bt.tag) AS tag, round(avg(importance), 6) AS avg_importance FROM m JOIN b USING (session_id) LEFT JOIN bt USING (session_id) GROUP BY 1", "m")
def cluster_summary(spark, sf):
    """Of the memories of each session: size, commonest kind and tag (ties: the first), mean importance."""
    m = tables.memories(spark, sf).where("session_id is not null")

    def commonest(rows, c):
        w = Window.partitionBy("session_id").orderBy(F.col("c").desc(), c)
        return rows.groupBy("session_id", c).agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.row_number().over(w)).where("r = 1").select("session_id", c)

    tag = commonest(m.select("session_id", F.explode("tags").alias("tag")).where("tag is not null").withColumn("tag", F.lower("tag")), "tag")
    base = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("importance"), 6).alias("avg_importance"))
    return base.join(commonest(m, "kind"), "session_id").join(tag, "session_id", "left").select("session_id", "size", "kind", "tag", "avg_importance")


@query("SELECT memory_id, recall_count, positive, negative, last_recalled FROM s", "s")
def signal_fold(spark, sf):
    return tables.signals(spark, sf)


@query("SELECT session_id, count(*) AS lines, CAST(max(length(coalesce(text, ''))) AS BIGINT) AS peak, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total, arg_max(length(coalesce(text, '')), turn_no) AS final, CASE WHEN sum(length(coalesce(text, ''))) >= 5 * 2000 THEN 'critical' WHEN sum(length(coalesce(text, ''))) >= 2 * 2000 THEN 'high' WHEN sum(length(coalesce(text, ''))) >= 2000 THEN 'warning' ELSE 'ok' END AS severity FROM t WHERE session_id IS NOT NULL GROUP BY 1", "t")
def session_token_audit(spark, sf, window=2000):
    size = F.length(F.coalesce("text", F.lit("")))
    t = tables.turns(spark, sf).where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.max(size).cast("long").alias("peak"), F.sum(size).alias("total"), F.max_by(size, "turn_no").cast("long").alias("final"))
    x = F.col("total")
    return t.withColumn("severity", F.when(x >= 5 * window, "critical").when(x >= 2 * window, "high").when(x >= window, "warning").otherwise("ok"))
