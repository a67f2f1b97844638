"""Export and import of a store as a folder of JSON lines and an index; writing is idempotent by external id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.operators import state


def export(memories: DataFrame, pages: DataFrame, path: str, agent: str | None = None, least: float = 0.0) -> None:
    """memories.jsonl, pages.jsonl and index.md below path; the memories of one agent, the pages of at least an importance."""
    m = memories if agent is None else memories.where(F.col("agent_id").isNull() | (F.col("agent_id") == agent))
    m.drop("embedding").write.mode("overwrite").json(f"{path}/memories")
    kept = pages.where(F.col("importance") >= least)
    kept.write.mode("overwrite").json(f"{path}/pages")
    line = F.concat(F.lit("- "), F.regexp_replace("title", r"\s+", " "))
    kept.orderBy(F.col("importance").desc(), "doc_id").select(line.alias("value")).write.mode("overwrite").text(f"{path}/index")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The memories of a bundle; one without an external id gets one from its text, so a second import changes nothing."""
    m = spark.read.schema(schema).json(f"{path}/memories")
    return m.withColumn("external_id", F.coalesce("external_id", F.concat(F.lit("sha1:"), F.substring(F.sha1("text"), 1, 16))))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store after an import: rows of equal (agent_id, external_id) are one."""
    cols = [c for c in old.columns if c not in ("agent_id", "external_id")]
    return state.upsert(old, new, ["agent_id", "external_id"], keep=[c for c in cols if c in ("id", "kind", "created_at", "ttl")], take=[c for c in cols if c not in ("id", "kind", "created_at", "ttl")])
