"""Graph operators: names in texts, co-occurrence in a window, links through shared memories, boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Capital words that are no names.
GENERIC = "User Users Assistant Outcome Task Issue File Code Title Note Source Target Message Context Result Step List Section Project Path Line Type Example Test Tests Status The This That When Learned Decided Asked Open Plan Keep Fixed Merged Measured Reflection Known Each Sessions Someone What".split()


def names(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, pos): the different proper-noun-like words of a text with their first place."""
    w = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([A-Z][a-z]{2,}[A-Za-z]*|[a-z]+[A-Z][A-Za-z]*|[A-Z]{2,5})"), 1)
    return docs.select(key, F.posexplode(w).alias("pos", "name")).where(~F.col("name").isin(GENERIC)).groupBy(key, "name").agg(F.min("pos").alias("pos"))


def cooccurring(named: DataFrame, key: str, window: int = 6) -> DataFrame:
    """(src, dst, n): in how many texts two names are fewer than window places apart, counting each text's different names in order.

    Each name is paired only with the window - 1 after it, so a long text gives a bounded number of pairs per name.
    """
    w = Window.partitionBy(key).orderBy("pos")
    ahead = named.select("name", *[F.lead("name", i).over(w).alias(f"n{i}") for i in range(1, window)])
    pairs = ahead.select("name", F.explode(F.array(*[f"n{i}" for i in range(1, window)])).alias("other")).where("other is not null")
    return pairs.groupBy(F.least("name", "other").alias("src"), F.greatest("name", "other").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def linked(mentions: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(memory_id, src, dst) of entities that share a memory; src only from sources (src), if given."""
    m = mentions.where("memory_id is not null and entity_id is not null").select("memory_id", "entity_id").distinct()
    a = m.select("memory_id", F.col("entity_id").alias("src"))
    if sources is not None:
        a = a.join(sources, "src", "left_semi")
    return a.join(m.select("memory_id", F.col("entity_id").alias("dst")), "memory_id").where("src <> dst")


def kind_of(name: F.Column) -> F.Column:
    return F.when(name.contains("/") & name.contains("."), "path").when(name.startswith("#"), "tag").when(name == F.upper(name), "acronym").when(name.rlike(r"[^\x00-\x7F]"), "cjk").otherwise("concept")


def boost(mentions: DataFrame, asked: DataFrame) -> DataFrame:
    """(memory_id, boost) of memories with an asked entity (entity_id) and some of its neighbours."""
    m = mentions.where("memory_id is not null").select("memory_id", "entity_id").distinct()
    have = m.join(asked, "entity_id", "left_semi").select("memory_id").distinct()
    near = m.join(have, "memory_id", "left_semi").join(asked, "entity_id", "left_anti").select("entity_id").distinct()
    n = m.join(near, "entity_id", "left_semi").groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(have, "memory_id", "left_semi").select("memory_id", F.round(F.least(F.lit(1.5), 0.45 + 0.25 * F.log1p(F.col("n").cast("double"))), 3).alias("boost"))


def concepts(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("([A-Z][a-z]{4,})"), 1))).alias("name"))


def related(pages: DataFrame, most: int = 8) -> DataFrame:
    """(src, dst): pages that share a concept of at most most pages. Common concepts are left out before the join."""
    g = concepts(pages)
    rare = g.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where(F.col("c").between(2, most)).select("name")
    g = g.join(rare, "name", "left_semi")
    return g.select("name", F.col("doc_id").alias("src")).join(g.select("name", F.col("doc_id").alias("dst")), "name").where("src <> dst").select("src", "dst").distinct()
