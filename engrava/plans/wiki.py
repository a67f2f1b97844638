"""Pages, near-duplicates among memories and greedy groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.functions import text
from engrava.operators import nearvec, pages, setpairs
from engrava.plans.registry import query
from engrava.session import load
from engrava.sources import tables


def label_sql(table) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(x, '{p}') AS INT)" for _, p in table) + ")"


CL = f", c0 AS (SELECT doc_id, lower(concat_ws(' ', title, summary, body)) AS x FROM p), c AS (SELECT doc_id, {label_sql(pages.SECURITY)} AS sec, {label_sql(pages.UNIVERSAL)} AS uni, {label_sql(pages.PERSONAL)} AS per, CAST(regexp_matches(x, '{dict(pages.SECURITY)['incidents']}') AS INT) AS inc, regexp_matches(x, '{dict(pages.UNIVERSAL)['best-practice']}') AS practice FROM c0), g AS (SELECT *, sec >= 1 AND per < 2 AND ((sec >= 2 AND uni >= 1) OR uni >= 2 OR practice) AS auto_global FROM c)"


@query(f"{CL} SELECT doc_id, auto_global, CASE WHEN per >= 2 THEN 'personal' WHEN sec > 0 AND inc > 0 AND NOT auto_global THEN 'security-incident' WHEN sec > 0 THEN 'security-rule' WHEN uni > 0 THEN 'best-practice' ELSE 'general' END AS page_kind, round(greatest(CAST(0.05 AS DOUBLE), least(CAST(0.99 AS DOUBLE), CAST(0.38 AS DOUBLE) + 0.09 * least(sec, 5) + 0.08 * least(uni, 4) + 0.03 * least(inc, 2) - 0.16 * least(per, 3) + CASE WHEN auto_global THEN 0.08 ELSE 0 END)), 3) AS confidence FROM g", "p")
def classify_pages(spark, sf):
    return pages.classified(tables.pages(spark, sf)).select("doc_id", "auto_global", "page_kind", "confidence")


@query(f"{CL} SELECT doc_id, CASE WHEN auto_global THEN 'global' ELSE p.scope END AS scope FROM g JOIN p USING (doc_id)", "p")
def route_scope(spark, sf):
    return pages.classified(tables.pages(spark, sf)).select("doc_id", F.when(F.col("auto_global"), "global").otherwise(F.col("scope")).alias("scope"))


@query(f"{CL} SELECT doc_id, CASE WHEN auto_global THEN 'keep' ELSE 'rescope' END AS decision FROM g JOIN p USING (doc_id) WHERE p.scope = 'global'", "p")
def reclassify_legacy(spark, sf):
    p = tables.pages(spark, sf).where("scope = 'global'")
    return pages.classified(p).select("doc_id", F.when(F.col("auto_global"), "keep").otherwise("rescope").alias("decision"))


@query("SELECT doc_id, array_to_string(string_split(scope, ','), '|') AS scopes FROM p", "p")
def source_scope(spark, sf):
    return tables.pages(spark, sf).select("doc_id", F.array_join(pages.scopes(F.col("scope")), "|").alias("scopes"))


@query("WITH s AS (SELECT doc_id, unnest(regexp_extract_all(concat(chr(10), text), '\\n## ([^\\n]*)', 1)) AS title FROM documents WHERE text IS NOT NULL) SELECT doc_id, trim(title) AS title FROM s")
def wiki_import_split(spark, sf):
    return pages.sections(load(spark, sf, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "title")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, sum(least(length(body), 800) + 280) OVER (PARTITION BY lang ORDER BY importance DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM p) WHERE total <= 12000", "p")
def digest_budget(spark, sf, budget=12_000):
    """Of each language the most important pages whose bodies fit into the budget."""
    p = tables.pages(spark, sf).withColumn("size", F.least(F.length("body"), F.lit(800)) + 280)
    return pages.within_budget(p, "lang", "size", budget, F.col("importance").desc(), F.col("doc_id")).select("lang", "doc_id")


@query("SELECT kind, count(*) AS n, round(avg(importance), 6) AS importance, string_agg(id, ',' ORDER BY r) FILTER (r <= 8) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY importance DESC, id) AS r FROM m WHERE importance >= 0.35 AND length(text) >= 20) GROUP BY 1", "m")
def kind_pages(spark, sf):
    m = tables.memories(spark, sf).where((F.col("importance") >= 0.35) & (F.length("text") >= 20))
    w = Window.partitionBy("kind").orderBy(F.col("importance").desc(), "id")
    top = m.withColumn("r", F.row_number().over(w)).where("r <= 8").groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("evidence"))
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("importance")).join(top, "kind")


@query(r"SELECT id, CASE WHEN length(trim(text)) < 16 THEN 'noise' WHEN coalesce(importance, 0) < 0.2 THEN 'importance' WHEN starts_with(text, 'user:') THEN 'transcript' WHEN kind = 'episode' AND coalesce(importance, 0) < 0.35 THEN 'weak_episode' ELSE 'keep' END AS verdict FROM m WHERE text IS NOT NULL", "m")
def consolidate_prefilter(spark, sf):
    i = F.coalesce("importance", F.lit(0.0))
    v = F.when(F.length(F.trim("text")) < 16, "noise").when(i < 0.2, "importance").when(F.col("text").startswith("user:"), "transcript").when((F.col("kind") == "episode") & (i < 0.35), "weak_episode").otherwise("keep")
    return tables.memories(spark, sf).where("text is not null").select("id", v.alias("verdict"))


@query("SELECT doc_id FROM p WHERE len(string_split(title, ' / ')) > 2 OR NOT regexp_matches(body, '\\n- ') OR title = ''", "p")
def retire_pages(spark, sf):
    p = tables.pages(spark, sf)
    return p.where((F.size(F.split("title", " / ")) > 2) | ~F.col("body").rlike("\n- ") | (F.col("title") == "")).select("doc_id")


@query("SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(body, '\\n- ([^\\n]*)', 1), lambda x: substr(lower(x), 1, 60)))) AS bullets FROM p", "p")
def bullet_floor(spark, sf):
    b = F.transform(F.regexp_extract_all("body", F.lit(r"\n- ([^\n]*)"), 1), lambda x: F.substring(F.lower(x), 1, 60))
    return tables.pages(spark, sf).select("doc_id", F.size(F.array_distinct(b)).cast("long").alias("bullets"))


@query("SELECT doc_id, string_agg(memory_id, ',' ORDER BY memory_id) AS evidence FROM ev GROUP BY 1", "ev")
def page_merge(spark, sf):
    """Evidence of each page as one ordered set."""
    return tables.evidence(spark, sf).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("memory_id")), ",").alias("evidence"))


PT = ", pt AS (SELECT doc_id AS id, scope, unnest(list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+|[一-鿿]'))) AS token FROM p WHERE summary <> ''), pn AS (SELECT id, count(*) AS n FROM pt GROUP BY 1), pp AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM pt a JOIN pt b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)"


@query(f"{PT} SELECT a, b, round(common / CAST(x.n + y.n - common AS DOUBLE), 6) AS score FROM pp JOIN pn x ON x.id = a JOIN pn y ON y.id = b WHERE common >= 0.45 * (x.n + y.n - common) - 1e-9", "p")
def contradictions(spark, sf):
    """Pairs of pages whose key facts overlap by at least .45."""
    return fact_pairs(spark, sf, "id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "score")


def fact_pairs(spark, sf, *columns):
    """(a, b, score): contradicting pages with the columns of each."""
    p = tables.pages(spark, sf).where("summary <> ''").withColumn("id", F.col("doc_id"))
    pairs = setpairs.set_pairs(p.select(F.struct(*columns).alias("who"), text.fact_tokens("summary").alias("tokens")), 0.45)
    return pairs.select("a", "b", F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("score"))


@query(f"{PT}, cc AS (SELECT a, b, round(common / CAST(x.n + y.n - common AS DOUBLE), 6) AS score FROM pp JOIN pn x ON x.id = a JOIN pn y ON y.id = b WHERE common >= 0.45 * (x.n + y.n - common) - 1e-9), cs AS (SELECT a AS doc_id, b AS partner_id, score FROM cc UNION ALL SELECT b, a, score FROM cc) SELECT cs.doc_id, o.title, o.summary, o.importance, o.scope, partner_id, q.title AS partner_title, q.summary AS partner_summary, q.importance AS partner_importance, q.scope AS partner_scope, score FROM cs JOIN p o ON o.doc_id = cs.doc_id JOIN p q ON q.doc_id = partner_id", "p")
def contradiction_list(spark, sf):
    """Every page that contradicts others with each of its partners: both sides list the other, with its head and their overlap."""
    about = ("title", "summary", "importance", "scope")
    c = fact_pairs(spark, sf, "id", *about).select("score", F.explode(F.array(F.struct(F.col("a").alias("o"), F.col("b").alias("q")), F.struct(F.col("b").alias("o"), F.col("a").alias("q")))).alias("c"))
    return c.select(F.col("c.o.id").alias("doc_id"), *[f"c.o.{x}" for x in about], F.col("c.q.id").alias("partner_id"), *[F.col(f"c.q.{x}").alias(f"partner_{x}") for x in about], "score")


MT = ", mt AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]'))) AS token FROM m WHERE text IS NOT NULL), mn AS (SELECT id, count(*) AS n FROM mt GROUP BY 1), rare AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM mt a JOIN mt b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)"


@query(f"{MT} SELECT a, b FROM rare JOIN mn x ON x.id = a JOIN mn y ON y.id = b WHERE common >= 0.92 * (x.n + y.n - common) - 1e-9", "m")
def merge_suggestions(spark, sf):
    t = tables.memories(spark, sf).where("text is not null").select("id", F.explode(text.fact_tokens("text")).alias("token"))
    return pages.token_pairs(t, 0.92).select("a", "b")


@query("SELECT id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard FROM (SELECT id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')) AS x, list_distinct(regexp_extract_all(lower(coalesce(array_to_string(tags, ' '), '')), '[a-z0-9]+|[一-鿿]')) AS y FROM m WHERE text IS NOT NULL) WHERE len(x) + len(y) > 0", "m")
def jaccard(spark, sf):
    """Overlap of each memory's words with the words of its tags."""
    m = tables.memories(spark, sf).where("text is not null").select("id", text.fact_tokens("text").alias("x"), text.fact_tokens(F.array_join("tags", " ")).alias("y"))
    return m.where(F.size("x") + F.size("y") > 0).select("id", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


SH = ", x AS (SELECT id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM m WHERE source IS NOT NULL AND length(text) >= 25), sh AS (SELECT id, source, list_distinct(list_transform(range(1, greatest(2, length(t) - 3)), lambda i: substr(t, i, 5))) AS s FROM x)"


@query(f"{SH} SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.source = b.source AND a.id < b.id WHERE len(a.s) >= 0.85 * len(b.s) AND len(b.s) >= 0.85 * len(a.s) AND len(list_intersect(a.s, b.s)) >= 0.85 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9", "m")
def shingle_neardups(spark, sf):
    """Memories of one source whose sets of five-character shingles overlap by at least .85: the prefix filter over shingles tagged with the source."""
    m = tables.memories(spark, sf).where("source is not null and length(text) >= 25")
    t = text.shingled(m, ["id", "source"], "text").select("id", F.xxhash64("source", "g").alias("token"))
    return pages.token_pairs(t, 0.85).select("a", "b")


def greedy(pdf: pd.DataFrame, near: float, most: int) -> pd.DataFrame:
    """Rows in order of importance join the first group whose mean vector is near enough and that has room."""
    pdf = pdf.sort_values(["importance", "id"], ascending=[False, True])
    x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)
    means, sizes, number, used, groups = np.empty((64, x.shape[1])), np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int64), 0, 0
    out = []
    for i, v in zip(pdf["id"], x):
        fits = np.nonzero((means[:used] @ v >= near) & (sizes[:used] < most))[0]
        if len(fits):
            at = fits[0]
            means[at] = (means[at] * sizes[at] + v) / (sizes[at] + 1)
            sizes[at] += 1
        else:
            if used == len(means):  # full groups go, the order of the others stays
                have = np.nonzero(sizes[:used] < most)[0]
                used, room = len(have), np.zeros(max(64, 2 * len(have)), dtype=np.int64)
                means = np.concatenate([means[have], np.empty((len(room), x.shape[1]))])
                sizes, number = np.concatenate([sizes[have], room]), np.concatenate([number[have], room])
            at = used
            means[at], sizes[at], number[at] = v, 1, groups
            used, groups = used + 1, groups + 1
        out.append((i, int(number[at])))
    return pd.DataFrame(out, columns=["id", "group_no"])


def usable(spark, sf):
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return tables.memories(spark, sf).where(F.col("embedding").isNotNull() & ok)


@query()
def clusters(spark, sf, near=0.35, most=15):
    """Greedy groups of a session's memories. The order decides, so a session is one task; memories without session are one more."""
    m = usable(spark, sf).select("session_id", "id", F.coalesce("importance", F.lit(0.0)).alias("importance"), "embedding")
    return m.groupBy("session_id").applyInPandas(lambda key, pdf: greedy(pdf, near, most).assign(session_id=key[0])[["session_id", "id", "group_no"]], "session_id string, id string, group_no long")


@query()
def embedding_neardups(spark, sf):
    """Memories with a more important near copy (cosine of at least .92) of their kind."""
    return nearvec.losers(usable(spark, sf).select("id", "kind", "importance", "embedding"))


@query()
def stage0_dedupe(spark, sf, near=0.85):
    """The survivors of all memories: those without a more important near copy of their kind, in whatever session."""
    return nearvec.survivors(usable(spark, sf).select("id", "kind", "importance", "embedding"), near)


@query("SELECT session_id, string_agg(id, ',' ORDER BY r) FILTER (r <= 5) AS bullets, round(greatest(CAST(0.35 AS DOUBLE), avg(coalesce(importance, 0)) FILTER (r <= 5)), 6) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(importance, 0) DESC, id) AS r FROM m WHERE session_id IS NOT NULL) GROUP BY 1", "m")
def rule_wiki(spark, sf):
    """A page of each session by rule: its five most important memories, importance their mean, .35 at least."""
    m = tables.memories(spark, sf).where("session_id is not null").withColumn("i", F.coalesce("importance", F.lit(0.0)))
    w = Window.partitionBy("session_id").orderBy(F.col("i").desc(), "id")
    t = m.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("session_id")
    return t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("bullets"), F.round(F.greatest(F.lit(0.35), F.avg("i")), 6).alias("importance"))


@query("SELECT tag, min(id) AS a, max(id) AS b FROM (SELECT tag, id, row_number() OVER (PARTITION BY tag ORDER BY created DESC, id) AS r FROM (SELECT id, created, lower(unnest(tags)) AS tag FROM m WHERE length(text) > 120) WHERE tag IS NOT NULL) WHERE r <= 2 GROUP BY tag HAVING min(id) <> max(id)", "m")
def pulse_pairs(spark, sf):
    """Of each tag the two newest long memories."""
    t = tables.memories(spark, sf).where(F.length("text") > 120).select("id", "created", F.explode("tags").alias("tag")).where("tag is not null").withColumn("tag", F.lower("tag"))
    w = Window.partitionBy("tag").orderBy(F.col("created").desc(), "id")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("tag").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")


def topic_sql(c: str) -> str:
    """SQL of text.topic_tokens."""
    stop = ", ".join(f"'{w}'" for w in text.TOPIC_STOPWORDS)
    spans = f"regexp_extract_all(lower(coalesce({c}, '')), '[一-鿿]{{2,}}')"
    return f"list_distinct(list_concat(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9_.+-]{{2,}}'), lambda w: w NOT IN ({stop})), list_concat(list_filter({spans}, lambda s: length(s) <= 8), flatten(list_transform({spans}, lambda s: list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))))))"


@query(f"SELECT doc_id, memory_id, overlap, step FROM (SELECT doc_id, memory_id, overlap, CASE WHEN cited THEN 'cited' ELSE 'recovered' END AS step, CASE WHEN bool_or(cited) OVER w THEN cited WHEN max(overlap) OVER w > 0 THEN 5 * overlap >= 3 * max(overlap) OVER w ELSE count(*) OVER w = 1 END AS taken FROM (SELECT ev.doc_id, ev.memory_id, substr(md5(CAST(ev.doc_id AS VARCHAR)), 1, 4) = substr(ev.memory_id, 1, 4) AS cited, len(list_intersect(a, b)) AS overlap FROM ev JOIN (SELECT doc_id, {topic_sql('body')} AS a FROM p) x ON x.doc_id = ev.doc_id JOIN (SELECT id, {topic_sql('text')} AS b FROM m) y ON y.id = ev.memory_id) WINDOW w AS (PARTITION BY doc_id)) WHERE taken", "ev")
def evidence_recovery(spark, sf):
    """The evidence of each page: valid cited ids, else memories within its reach whose topics overlap by 60 % of the best at least.

    The tables have no citations. Memories within reach are those of tables.evidence(), cited are those with one more hash digit in common.
    """
    p, m = tables.evidence_sides(spark, sf)
    p = p.select("k", "doc_id", F.substring("digits", 1, 4).alias("cites"), text.topic_tokens("body").alias("tokens"))
    m = m.select("k", "memory_id", F.substring("memory_id", 1, 4).alias("cites"), text.topic_tokens("text").alias("tokens"))
    return pages.recovered(p, m)


@query(r"SELECT id, length(trim(coalesce(text, ''))) < 16 AS noise, coalesce(importance, 0) < 0.2 AS would_drop FROM m", "m")
def consolidation_preview(spark, sf):
    return tables.memories(spark, sf).select("id", (F.length(F.trim(F.coalesce("text", F.lit("")))) < 16).alias("noise"), (F.coalesce("importance", F.lit(0.0)) < 0.2).alias("would_drop"))
