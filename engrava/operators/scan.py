"""Scans: optional predicates, keyset pages, zero-filled series. Every limit here is the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, *predicates: F.Column | None) -> DataFrame:
    """Rows for which all given predicates hold; None is no predicate. Reaches the scan."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def bucket(source: str = "source") -> F.Column:
    """A source without what follows its first slash, in lower case."""
    return F.lower(F.split_part(F.coalesce(F.col(source), F.lit("unknown")), F.lit("/"), F.lit(1)))


def contains_all_case(column: str, needle: str) -> F.Column:
    return F.lower(F.col(column)).contains(needle.lower())


def newest(df: DataFrame, limit: int, *order: F.Column) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def keyset(df: DataFrame, at: str, key: str, before: tuple | None, limit: int) -> DataFrame:
    """The page of rows behind (at, key) in descending order; rows that share a time are told apart by key, so none is lost."""
    if before is not None:
        t, k = before
        df = df.where((F.col(at) < F.lit(t)) | ((F.col(at) == F.lit(t)) & (F.col(key) < F.lit(k))))
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit)


def visible(agent: str | None, user: str | None) -> F.Column:
    """Rows of a namespace: those without any owner, and those whose owners are the given ones or missing."""
    own = F.lit(True)
    if agent is not None:
        own = own & (F.col("agent_id").isNull() | (F.col("agent_id") == agent))
    if user is not None:
        own = own & (F.col("user_id").isNull() | (F.col("user_id") == user))
    return (F.col("agent_id").isNull() & F.col("user_id").isNull()) | own


def tiered(level: int, text: str = "text", preview: int = 240, middle: int = 800) -> tuple[F.Column, F.Column]:
    """(body, preview) of a payload level: 0 none, 1 the first characters, 2 all."""
    body = {0: F.lit(None).cast("string"), 1: F.substring(text, 1, middle)}.get(level, F.col(text))
    return body.alias("body"), F.substring(text, 1, preview).alias("preview")


def zero_filled(series: DataFrame, counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Every key of a short series, 0 where there is no count."""
    return series.join(counts, key, "left").select(key, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
