"""State transitions: new_state = f(old_state, changes). No row is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], take: list[str]) -> DataFrame:
    """Rows of both by key: columns of keep stay as they were where they were, those of take are replaced unless missing."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cols = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in [*keys, *keep]] + [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in take]
    return o.join(n, on, "full").select(*cols)


def next_version(rows: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    top = versions.groupBy(key).agg(F.max("version").alias("top"))
    return rows.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + 1).alias("version"))


def guard(text: F.Column, kind: F.Column, importance: F.Column, least: int = 25, most: int = 1200) -> F.Column:
    """Why a candidate isn't written: the first reason that holds, or 'pass'."""
    x = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(x) < least, "too_short").when((kind == "episode") & (F.coalesce(importance, F.lit(0.0)) < 0.4) & (F.length(x) < 60), "low_signal").when(F.length(x) > most, "too_long").otherwise("pass")
