"""The client's verbs over a store in a folder: every write is an appended event, every read folds the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.functions import score, text
from engrava.operators import lexical, scan, state

MEMORY = "id string, kind string, text string, importance double, source string, tags array<string>, agent_id string, user_id string, external_id string, ttl double, created double, updated double"
SIGNAL = "memory_id string, vote double, at double"


class Store:
    """Memories and signals below a path. `now` is the caller's; appends are atomic, so writers need no lock."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def remember(self, rows: DataFrame, now: float) -> DataFrame:
        """Write candidates that pass the guard, secrets taken out; gives what was rejected and why."""
        r = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in ("kind", "text", "importance", "source", "tags", "agent_id", "user_id", "external_id", "ttl")])
        r = r.withColumn("verdict", state.guard(F.col("text"), F.col("kind"), F.col("importance")))
        clean = text.redact(text.strip_private(F.col("text")))
        key = F.coalesce("external_id", F.concat(F.lit("sha1:"), F.substring(F.sha1(clean), 1, 16)))
        ok = r.where("verdict = 'pass'").withColumn("external_id", key).withColumn("text", clean)
        ok = ok.withColumn("id", F.md5(F.concat_ws("\u0001", F.coalesce("agent_id", F.lit("")), F.coalesce("user_id", F.lit("")), "external_id")))
        self._append(ok.withColumn("created", F.lit(float(now))).withColumn("updated", F.lit(float(now))).selectExpr(*[f"cast({f.split()[0]} as {f.split(None, 1)[1]}) as {f.split()[0]}" for f in MEMORY.split(", ")]), "memories")
        return r.where("verdict <> 'pass'").select("verdict", text.redact(F.substring("text", 1, 80)).alias("preview"))

    def memories(self, now: float, agent: str | None = None, user: str | None = None) -> DataFrame:
        """The last version of each living memory with its first creation, its signals and its score."""
        w = Window.partitionBy("id")
        m = self._read("memories", MEMORY).withColumn("created", F.min("created").over(w)).withColumn("kind", F.min_by("kind", "updated").over(w))
        m = m.withColumn("_r", F.row_number().over(w.orderBy(F.col("updated").desc()))).where("_r = 1").drop("_r")
        gone = self._read("deleted", "id string").distinct()
        m = m.join(gone, "id", "left_anti").where(F.col("ttl").isNull() | (F.lit(float(now)) - F.col("created") <= F.col("ttl"))).where(scan.visible(agent, user))
        s = self._signals()
        m = m.join(s, "id", "left").fillna(0, ["recall_count", "positive", "negative"])
        return m.withColumn("score", score.blended(F.coalesce("importance", F.lit(0.0)), F.col("created"), F.col("recall_count"), F.col("last_recalled"), F.col("positive"), F.col("negative"), now))

    def _signals(self) -> DataFrame:
        v = F.col("vote")
        return self._read("signals", SIGNAL).groupBy(F.col("memory_id").alias("id")).agg(F.count_if(v == 0).alias("recall_count"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.max(F.when(v == 0, F.col("at"))).alias("last_recalled"))

    def recall(self, query: str, now: float, limit: int = 10, agent: str | None = None, user: str | None = None) -> DataFrame:
        """(id, text, hit): best lexical matches times their temporal fit and score; reading records nothing, see used."""
        words = [w for w in query.lower().split() if len(w) >= 3 and w not in text.STOPWORDS]
        m = self.memories(now, agent, user)
        tokens = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        low = F.lower(F.coalesce("text", F.lit("")))
        found = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
        intent, sure = lexical.intent_of(query)
        hit = found * (F.lit(0.7) + 0.6 * F.col("score")) * score.temporal(intent, sure, F.col("updated"), now)
        return m.where(found > 0).select("id", "text", F.round(hit, 6).alias("hit")).orderBy(F.col("hit").desc(), "id").limit(limit)

    def used(self, ids: DataFrame, now: float) -> None:
        """Record a recall of memories (id)."""
        self._append(ids.select(F.col("id").alias("memory_id"), F.lit(0.0).alias("vote"), F.lit(float(now)).alias("at")), "signals")

    def feedback(self, ids: DataFrame, vote: int, now: float) -> None:
        """An up-vote (1) or a down-vote (-1) of memories (id)."""
        self._append(ids.select(F.col("id").alias("memory_id"), F.lit(float(vote)).alias("vote"), F.lit(float(now)).alias("at")), "signals")

    def forget(self, ids: DataFrame) -> None:
        self._append(ids.select("id"), "deleted")

    def list(self, now: float, limit: int = 50, **only: str) -> DataFrame:
        m = self.memories(now)
        for c, v in only.items():
            m = m.where(F.col(c) == v)
        return m.orderBy(F.col("created").desc(), "id").limit(limit)
