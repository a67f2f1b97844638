"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.functions import text
from engrava.functions.text import STOPWORDS
from engrava.plans.registry import query
from engrava.session import load
from engrava.sources import tables

NORM = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"SELECT id, {NORM} AS text FROM m", "m")
def norm_text(spark, sf):
    return tables.memories(spark, sf).select("id", text.norm("text").alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS n, coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))), 'string_agg', ' '), '') AS words FROM documents")
def word_tokens(spark, sf):
    w = text.words("text")
    return load(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(w)), " ").alias("words"))


@query("SELECT id, coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[一-鿿]'))), 'string_agg', ' '), '') AS tokens FROM m", "m")
def token_sets(spark, sf):
    return tables.memories(spark, sf).select("id", F.array_join(F.array_sort(text.fact_tokens("text")), " ").alias("tokens"))


@query(f"SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({STOP})))) AS n FROM eval_items")
def query_tokens(spark, sf):
    return load(spark, sf, "eval_items").select("item_id", F.size(text.query_tokens("question", 1000)).cast("long").alias("n"))


HASH = "WITH w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM m), h AS (SELECT id, CAST(concat('0x', substr(md5(w), 29, 4)) AS INT) AS lo FROM w), c AS (SELECT id, lo % 64 AS i, sum(CASE WHEN (lo // 256) % 2 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) AS v FROM h GROUP BY 1, 2), q AS (SELECT id, sqrt(sum(v * v)) AS q FROM c GROUP BY 1) SELECT id, CAST(i AS INT) AS cell, round(v / q, 6) AS v FROM c JOIN q USING (id) WHERE v <> 0"


@query(HASH.format().replace("WITH w", ", w"), "m")
def hash_embedding(spark, sf):
    """Non-zero cells of the hashed embedding of every memory."""
    return text.hash_cells(tables.memories(spark, sf), "id", "text").select("id", "cell", F.round("v", 6).alias("v"))


@query("SELECT a.id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.e AS DOUBLE[])), 6) AS cosine FROM m a, (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b WHERE len(a.embedding) = 64 AND len(list_filter(a.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(a.embedding, lambda x: x <> 0)) > 0", "m")
def cosine(spark, sf):
    """Cosine of every usable memory to one query vector."""
    q = load(spark, sf, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    m = tables.memories(spark, sf)
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return m.where(F.col("embedding").isNotNull() & ok).join(q, F.lit(True)).select("id", F.round(text.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '-', 'g'), '-') AS slug FROM p", "p")
def slugify(spark, sf):
    return tables.pages(spark, sf).select("doc_id", text.slugify("title", 10_000).alias("slug"))


@query("SELECT id, CASE WHEN length(trim(text)) > 60 THEN concat(rtrim(substr(trim(text), 1, 59)), '…') ELSE trim(text) END AS clip FROM m WHERE text IS NOT NULL", "m")
def clip(spark, sf):
    return tables.memories(spark, sf).where("text is not null").select("id", text.clip("text", 60).alias("clip"))


@query("SELECT id, substr(sha1(text), 1, 16) AS prompt_hash, sha256(text) AS full_hash FROM m WHERE text IS NOT NULL", "m")
def prompt_hash(spark, sf):
    return tables.memories(spark, sf).where("text is not null").select("id", F.substring(F.sha1("text"), 1, 16).alias("prompt_hash"), F.sha2("text", 256).alias("full_hash"))


@query("SELECT turn_id, regexp_replace(text, '(?is)<private>.*?</private>', '[private]', 'g') AS text FROM t WHERE text IS NOT NULL", "t")
def strip_private(spark, sf):
    return tables.turns(spark, sf).where("text is not null").select("turn_id", text.strip_private("text").alias("text"))


# The oracle's dialect has no look-behind; capturing what stands before gives the same result.
@query(r"""SELECT doc_id, regexp_replace(text, '(^|[\s,;{(])(?:[A-Za-z][A-Za-z0-9_]{2,}|["'']?(?i:api[_-]?key|secret|token|password|passwd|access[_-]?key)["'']?)\s*[:=]\s*["'']?[A-Za-z0-9_\-.~+/]{40,}=*["'']?', '\1[REDACTED:env_value]', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def redact(spark, sf):
    return load(spark, sf, "documents").where("text is not null").select("doc_id", text.redact("text").alias("text"))


@query()
def redact_counts(spark, sf):
    c = load(spark, sf, "documents").where("text is not null").select(F.explode(text.redact_counts("text")).alias("x"))
    return c.groupBy("x.kind").agg(F.sum("x.n").alias("n"))


DENSITY = r"""least(CAST(1 AS DOUBLE), CASE WHEN regexp_matches(x, 'https?://\S+') THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(x, '[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(x, '\d{2,}') THEN 0.10 ELSE 0 END + CASE WHEN length(regexp_replace(x, '[^一-鿿]', '', 'g')) >= 6 OR len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) >= 8 THEN 0.20 ELSE 0 END + CASE WHEN regexp_matches(x, '[（）()\[\]【】{}「」『』]') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(x, 'TODO|FIXME|BUG|决定|结论|约束|不要|always|never') THEN 0.10 ELSE 0 END)"""


@query(f"SELECT id, round(CASE WHEN x = '' THEN 0.0 ELSE {DENSITY} END, 6) AS density FROM (SELECT id, trim(coalesce(text, '')) AS x FROM m)", "m")
def info_density(spark, sf):
    return tables.memories(spark, sf).select("id", F.round(text.info_density("text"), 6).alias("density"))


@query("SELECT id, fp, keep FROM (SELECT id, substr(lower(text), 1, 60) AS fp, row_number() OVER (PARTITION BY substr(lower(text), 1, 60) ORDER BY created, id) = 1 AS keep FROM m WHERE text IS NOT NULL)", "m")
def fingerprint_dedupe(spark, sf):
    """The first memory of each fingerprint of sixty characters is kept."""
    fp = F.substring(F.lower("text"), 1, 60)
    w = Window.partitionBy("fp").orderBy("created", "id")
    return tables.memories(spark, sf).where("text is not null").select("id", "created", fp.alias("fp")).select("id", "fp", (F.row_number().over(w) == 1).alias("keep"))


@query("SELECT session_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no, turn_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY session_id, substr(lower(x), 1, 60) ORDER BY turn_no, turn_id) AS f FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM t WHERE role = 'user' AND session_id IS NOT NULL) WHERE length(x) BETWEEN 12 AND 240 AND NOT regexp_matches(lower(x), '^(hi|hello|hey|thanks|ok)\\b')) WHERE f = 1) WHERE k <= 6", "t")
def session_facts(spark, sf, most=6):
    """Up to six facts a session: user turns of 12 to 240 characters, no greetings, each fingerprint once."""
    x = text.norm("text")
    t = tables.turns(spark, sf).where("role = 'user' and session_id is not null").withColumn("x", x)
    t = t.where(F.length("x").between(12, 240) & ~F.lower("x").rlike(r"^(hi|hello|hey|thanks|ok)\b")).withColumn("fp", F.substring(F.lower("x"), 1, 60))
    t = t.withColumn("f", F.row_number().over(Window.partitionBy("session_id", "fp").orderBy("turn_no", "turn_id"))).where("f = 1")
    return t.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_no", "turn_id"))).where(F.col("k") <= most).select("session_id", "turn_id")


NOISY = r"^(ok|okay|thanks|thank you|yes|no|sure|done|got it|great)[.!]?$"


@query(rf"SELECT turn_id, regexp_matches(lower(trim(coalesce(text, ''))), '{NOISY}') AS is_ack, length(trim(coalesce(text, ''))) < 16 AS is_short, starts_with(trim(coalesce(text, '')), '{{') AS is_raw FROM t", "t")
def noise_predicates(spark, sf):
    x = F.trim(F.coalesce("text", F.lit("")))
    return tables.turns(spark, sf).select("turn_id", F.lower(x).rlike(NOISY).alias("is_ack"), (F.length(x) < 16).alias("is_short"), x.startswith("{").alias("is_raw"))


@query(rf"SELECT turn_id FROM t WHERE length(trim(coalesce(text, ''))) >= 16 AND NOT regexp_matches(lower(trim(text)), '{NOISY}') AND NOT starts_with(trim(text), '{{')", "t")
def noise_filter(spark, sf):
    x = F.trim(F.coalesce("text", F.lit("")))
    return tables.turns(spark, sf).where((F.length(x) >= 16) & ~F.lower(x).rlike(NOISY) & ~x.startswith("{")).select("turn_id")


@query(r"SELECT turn_id, regexp_extract(text, '(?i)my name is ([A-Za-z]+)', 1) AS name, regexp_extract(text, '(?i)prefers? ([^ .,]+)', 1) AS likes FROM t WHERE regexp_matches(text, '(?i)my name is [A-Za-z]+|prefers? [^ .,]+')", "t")
def reflect_facts(spark, sf):
    t = tables.turns(spark, sf).where(F.col("text").rlike("(?i)my name is [A-Za-z]+|prefers? [^ .,]+"))
    return t.select("turn_id", F.regexp_extract("text", "(?i)my name is ([A-Za-z]+)", 1).alias("name"), F.regexp_extract("text", "(?i)prefers? ([^ .,]+)", 1).alias("likes"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), 'https?://\S+', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), '[#>*|\-\s]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def clean_noise(spark, sf):
    t = F.col("text")
    for p in (r"(?s)```.*?```", r"https?://\S+", r"`[^`\n]*`", r"[#>*|\-\s]+"):
        t = F.regexp_replace(t, p, " ")
    return load(spark, sf, "documents").where("text is not null").select("doc_id", F.trim(t).alias("text"))


@query()
def extract_json(spark, sf):
    """Fields of the sessions' metadata, read leniently: broken JSON gives null."""
    s = load(spark, sf, "sessions")
    return s.select("id", F.expr("try_parse_json(metadata) is not null").alias("valid"), F.regexp_count(F.coalesce("metadata", F.lit("")), F.lit('"[A-Za-z_]+"\\s*:')).alias("keys"))
