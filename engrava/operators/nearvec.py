"""Vectors that are near copies, by exact cosines of all of a kind, in tiles. Pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.session import cut


def losers(vectors: DataFrame, near: float = 0.92, tile: int = 65536) -> DataFrame:
    """(id, kept_id): vectors (id, kind, importance, embedding, all usable) with a near copy of their kind that is more important (ties: smaller id).

    Equal vectors are one class of which the best goes on. The rest of a kind are all compared, by exact cosines: in tiles, each of
    which meets each other one of its kind in a task; kept_id is the most important near copy. A tile pair gives a row for a vector at most.
    """
    v = vectors.withColumn("i", F.coalesce("importance", F.lit(0.0))).withColumn("h", F.xxhash64("kind", "embedding"))
    w = Window.partitionBy("h", "kind", "embedding").orderBy(F.col("i").desc(), F.col("id"))
    v = v.select("id", "kind", "i", "h", "embedding").repartition("h").withColumn("first", F.first("id").over(w))
    same = v.where("id <> first").select("id", F.col("first").alias("kept_id"))
    tiles = vectors.groupBy(F.col("kind").alias("of")).agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    own = v.where("id = first").join(F.broadcast(tiles), F.col("kind").eqNullSafe(F.col("of"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    own = own.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    placed = own.select("kind", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), "i", "id", "embedding")
    j = placed.groupBy("kind", "x", "y").applyInArrow(lambda t: better(t, near), "id string, kept_id string, i double")
    return j.groupBy("id").agg(F.min_by("kept_id", F.struct(-F.col("i"), "kept_id")).alias("kept_id")).unionAll(same)


def better(t: pa.Table, near: float, rows: int = 1024, columns: int = 8192) -> pa.Table:
    """(id, kept_id, i): the rows of two tiles (left or not; all left if it's one) with a near row of the other before them, and the first such."""
    e = t["embedding"].combine_chunks()
    x = e.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    i, left = t["i"].to_numpy(), t["left"].to_numpy()
    order = np.lexsort((np.array([k.encode() for k in t["id"].to_pylist()], dtype=object), -i))
    x, left = x[order].astype(np.float64), left[order]
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    f = (x / n[:, None]).astype(np.float32)
    kept = np.full(len(t), -1, dtype=np.int64)
    for a, b in [(left, ~left), (~left, left)] if not left.all() else [(left, left)]:
        targets, others = np.flatnonzero(a), np.flatnonzero(b)
        for s in range(0, len(targets), rows):
            r = targets[s : s + rows]
            end = int(np.searchsorted(others, r[-1]))
            for k in range(0, end, columns):  # from the most important: a row is done with the first near one
                r = r[kept[r] < 0]
                c = others[k : min(k + columns, end)]
                if not len(r):
                    break
                cos = f[r] @ f[c].T
                hit = np.flatnonzero(cos.max(axis=1) >= near - 1e-5)
                maybe = (cos[hit] >= near - 1e-5) & (c[None, :] < r[hit, None])
                while len(hit):
                    first = maybe.argmax(axis=1)
                    some = maybe[np.arange(len(hit)), first]
                    hit, maybe, first = hit[some], maybe[some], first[some]
                    p, q = r[hit], c[first]
                    yes = np.einsum("ij,ij->i", x[p], x[q]) / (n[p] * n[q]) >= near
                    kept[p[yes]] = q[yes]
                    maybe[np.arange(len(hit)), first] = False
                    hit, maybe = hit[~yes], maybe[~yes]
    lost = np.flatnonzero(kept >= 0)
    id_, kept_id = t["id"].take(pa.array(order[lost])), t["id"].take(pa.array(order[kept[lost]]))
    return pa.table({"id": id_, "kept_id": kept_id, "i": i[order[kept[lost]]]})


#: Rows of a tile of survivors().
TILE = 32768


def survivors(vectors: DataFrame, near: float = 0.85, tile: int = TILE) -> DataFrame:
    """(id): vectors (id, kind, importance, embedding, all usable) without a near copy of their kind that is more important (ties: smaller id).

    Going through a kind by importance, a memory joins the group of any earlier member it's near to, and each earlier memory is
    a member of some group: so a group's first are those with nothing near before them. All rows of a kind are compared,
    by exact cosines; equal vectors are one class of which the best goes on, tiles of a kind are compared in pairs.
    """
    v = vectors.withColumn("i", F.coalesce("importance", F.lit(0.0))).withColumn("h", F.xxhash64("kind", "embedding"))
    best = v.groupBy("kind", "h", "embedding").agg(F.min(F.struct((-F.col("i")).alias("i"), "id")).alias("b")).select("kind", "embedding", (-F.col("b.i")).alias("i"), "b.id")
    best = cut(best)
    tiles = best.groupBy(F.col("kind").alias("of")).agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    own = best.join(tiles, F.col("kind").eqNullSafe(F.col("of"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    own = own.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    placed = own.select("kind", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), "i", "id", "embedding")

    def worse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "id"], ascending=[False, True])
        u = np.stack([np.asarray(e, dtype=np.float64) for e in pdf["embedding"]])
        u /= np.abs(u).max(axis=1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        left, lost, f = pdf["left"].to_numpy(), np.zeros(len(pdf), dtype=bool), u.astype(np.float32)
        sides = [(left, ~left), (~left, left)] if not left.all() else [(left, left)]
        for a, b in sides:  # rows of a that come after a near row of b
            rows, cols = np.nonzero(a)[0], np.nonzero(b)[0]
            for s in range(0, len(rows), 512):
                r = rows[s : s + 512]
                c = cols[: np.searchsorted(cols, r[-1])]
                x, y = np.nonzero(f[r] @ f[c].T >= near - 1e-5)
                x, y = r[x], c[y]
                x, y = x[y < x], y[y < x]
                for k in range(0, len(x), 1 << 16):
                    i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    lost[i[np.round(np.einsum("ij,ij->i", u[i], u[j]), 9) >= near]] = True
        return pdf[["id"]][lost]

    out = placed.groupBy("kind", "x", "y").applyInPandas(worse, "id string")
    return best.select("id").join(out, "id", "left_anti")


def embed(df: DataFrame, column: str, embedder: Callable[[list[str]], list[list[float]]], to: str = "embedding") -> DataFrame:
    """The frame with vectors of a text column by any function of a list of texts; it is called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=np.float32) for v in embedder(t.fillna("").tolist())])

    return df.withColumn(to, run(column))


def apply_model(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], to: str = "answer") -> DataFrame:
    """The frame with a model's answers to a prompt column; an error becomes an empty answer of that batch."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(t.fillna("").tolist()))
        except Exception:  # noqa: BLE001
            return pd.Series([""] * len(t))

    return df.withColumn(to, run(prompt))
