"""Transcript readers: event-stream, message, history and plain JSON lines, flat JSON, markdown day logs. All give turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN = ["session_id", "turn_no", "role", "text", "at", "source", "file"]
PART = "array<struct<type:string,text:string,thinking:string,command:string,result:string>>"


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, pos, line) of JSON-lines files below a folder; a line that isn't JSON is dropped by the reader that parses it."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * 1_000_000_000 + F.monotonically_increasing_id() % 1_000_000_000).alias("pos"), F.col("value").alias("line"))


def when(c: F.Column) -> F.Column:
    """Seconds from a JSON time: a number (over 1e12: milliseconds), a numeric string or an ISO time; else null."""
    x = F.try_to_number(c, F.lit("9999999999999999.999999")).cast("double")
    return F.when(x > 1e12, x / 1000).when(x.isNotNull(), x).otherwise(F.unix_micros(F.try_to_timestamp(c)) / 1e6)


def content(c: F.Column) -> F.Column:
    """Text of a content field that is a string or a list of typed parts; thinking and tool parts are cut short."""
    parts = F.from_json(c, PART)
    texts = F.transform(parts, lambda p: F.coalesce(p["text"], F.substring(p["thinking"], 1, 400), F.substring(p["command"], 1, 200), F.substring(p["result"], 1, 300), F.lit("")))
    return F.when(F.substring(F.trim(c), 1, 1) == "[", F.trim(F.array_join(F.filter(texts, lambda x: x != ""), "\n"))).otherwise(c)


def turns(rows: DataFrame, source: str) -> DataFrame:
    """Turns of (file, pos, session_id, role, text, at): numbered in each session by their order in the file; empty ones are left out."""
    rows = rows.where("text is not null and trim(text) <> '' and role is not null").withColumn("session_id", F.coalesce("session_id", F.md5("file")))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("file", "pos")) - 1
    return rows.select("session_id", n.cast("int").alias("turn_no"), F.lower("role").alias("role"), F.trim("text").alias("text"), "at", F.lit(source).alias("source"), "file")


def j(path: str) -> F.Column:
    return F.get_json_object("line", path)


def codex(spark: SparkSession, path: str) -> DataFrame:
    """Event streams: the session's id stands in a first event's payload; messages of user and assistant follow."""
    rows = lines(spark, path)
    sid = F.first(F.coalesce(j("$.payload.id"), j("$.payload.session_id"), j("$.session_id")), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    role = F.coalesce(j("$.payload.role"), j("$.role"), F.when(j("$.type") == "user_message", "user").when(j("$.type") == "agent_message", "assistant"))
    text = content(F.coalesce(j("$.payload.content"), j("$.payload.message"), j("$.content"), j("$.text"), j("$.message")))
    return turns(rows.select("file", "pos", sid.alias("session_id"), role.alias("role"), text.alias("text"), when(F.coalesce(j("$.timestamp"), j("$.ts"))).alias("at")), "codex")


def claude(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a message of role and content."""
    rows = lines(spark, path)
    return turns(rows.select("file", "pos", F.coalesce(j("$.sessionId"), j("$.session_id")).alias("session_id"), F.coalesce(j("$.message.role"), j("$.role")).alias("role"), content(F.coalesce(j("$.message.content"), j("$.content"))).alias("text"), when(j("$.timestamp")).alias("at")), "claude")


def claude_history(spark: SparkSession, path: str) -> DataFrame:
    """Prompt histories: of each file only the session with the most lines counts."""
    rows = lines(spark, path).select("file", "pos", j("$.sessionId").alias("session_id"), F.lit("user").alias("role"), F.coalesce(j("$.display"), j("$.prompt"), j("$.text")).alias("text"), when(j("$.timestamp")).alias("at"))
    size = rows.groupBy("file", "session_id").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("file").agg(F.max_by("session_id", F.struct("n", "session_id")).alias("session_id"))
    return turns(rows.join(best, ["file", "session_id"], "left_semi"), "claude")


def hermes(spark: SparkSession, path: str) -> DataFrame:
    """Plain lines of role (or speaker) and content."""
    rows = lines(spark, path)
    return turns(rows.select("file", "pos", j("$.session_id").alias("session_id"), F.coalesce(j("$.role"), j("$.speaker")).alias("role"), content(F.coalesce(j("$.content"), j("$.text"))).alias("text"), when(F.coalesce(j("$.ts"), j("$.timestamp"))).alias("at")), "hermes")


def openclaw(spark: SparkSession, path: str) -> DataFrame:
    """Only message events count; content parts are flattened with limits."""
    rows = lines(spark, path)
    sid = F.max(F.when(j("$.type") == "session", j("$.id"))).over(Window.partitionBy("file"))
    e = rows.select("file", "pos", sid.alias("session_id"), j("$.type").alias("type"), j("$.message.role").alias("role"), content(j("$.message.content")).alias("text"), when(F.coalesce(j("$.message.timestamp"), j("$.timestamp"))).alias("at"))
    return turns(e.where("type = 'message'").drop("type"), "openclaw")


def flat(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files: a list of messages, or an object with messages or conversation."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    body = F.coalesce(j("$.messages"), j("$.conversation"), F.col("line"))
    item = "array<struct<role:string,content:string,text:string,message:string,ts:string,timestamp:string>>"
    e = df.select("file", F.coalesce(j("$.session_id"), j("$.id")).alias("session_id"), F.posexplode(F.from_json(body, item)).alias("pos", "m"))
    return turns(e.select("file", "pos", "session_id", F.col("m.role").alias("role"), F.coalesce("m.content", "m.text", "m.message").alias("text"), when(F.coalesce("m.ts", "m.timestamp")).alias("at")), "codex")


def daily(spark: SparkSession, path: str) -> DataFrame:
    """Markdown day logs: one reflection each; its time is the date in the file's name, else the file's."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    at = F.coalesce(F.try_to_timestamp(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")), F.col("_metadata.file_modification_time"))
    return turns(df.select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("session_id"), F.lit("reflection").alias("role"), F.col("value").alias("text"), (F.unix_micros(at) / 1e6).alias("at")), "openclaw")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"codex": codex, "codex_flat": flat, "claude": claude, "claude_history": claude_history, "hermes": hermes, "openclaw": openclaw, "openclaw_daily": daily}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Turns of a registered kind of transcript."""
    return READERS[kind](spark, path)


def register(kind: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[kind] = reader
