"""What the operators of this subpackage share: latest versions of records, text keys, exact similarity, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.session import cut, shared_dir

#: Similarity of two texts: sets of all substrings of so many characters; shorter texts than MIN_CHARS are never compared.
GRAM, MIN_CHARS = 5, 40


def latest(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """One row per key, that of the greatest version (ties: the greatest values, so the choice is deterministic).

    Rows without a key are dropped: they can't be addressed in a result. Aggregates combine map-side.
    """
    rest = [c for c in columns if c not in (key, version)]
    best = F.max(F.struct(F.col(version).alias("v"), *[F.col(c).alias(c) for c in rest]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def norm_text(c) -> F.Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def text_key(c) -> F.Column:
    """64-bit key of a text. Collisions only add candidates: texts themselves are compared later."""
    return F.xxhash64(c)


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))


def jaccard(a: frozenset, b: frozenset) -> float:
    """Common elements by different elements in both; two empty sets have 0."""
    common = len(a & b)
    both = len(a) + len(b) - common
    return common / both if both else 0.0


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all grams of all texts end to end, and where each text's begin; every text has at least GRAM characters."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(cp) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += cp[k : k + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    keep = np.ones(n, dtype=bool)
    for k in range(1, GRAM):
        bad = ends[:-1] - k
        keep[bad[bad < n]] = False
    starts = np.concatenate([[0], np.cumsum(lengths - GRAM + 1)[:-1]])
    return h[keep], starts


def minhash(texts: list[str], symbols: int, seed: int = 11) -> np.ndarray:
    """len(texts) x symbols minimum hashes over each text's grams, whole texts; 32 bits each."""
    if not texts:
        return np.zeros((0, symbols), dtype=np.uint32)
    h, starts = gram_hashes(texts)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**31, size=symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**32, size=symbols, dtype=np.uint64)
    out = np.empty((len(texts), symbols), dtype=np.uint32)
    for k in range(symbols):
        x = h * np.uint32(a[k] & np.uint64(0xFFFFFFFF))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += np.uint32(b[k])
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of the frame's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def rows_of(df: DataFrame) -> int:
    """The number of rows of a cut frame, counted where they lie: an aggregate would take a shuffle."""
    return df._jdf.queryExecution().toRdd().count()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def free(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files of what has ended stay on disk until it does."""
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node of the component.

    Alternates the large-star and small-star steps until nothing moves (logarithmically many rounds). Each round combines
    map-side and ends in a reliable checkpoint; the driver sees only a count and a checksum. A hot node is the key of an
    aggregate and of one join row, never a collected list. Null ends and loops are ignored; no edges, no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    hang, before = cut(e.distinct()), None
    for _ in range(most_rounds):
        state = hang.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        # large star: a node's larger neighbours hang on the smallest of its neighbourhood
        both = hang.unionAll(hang.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("low"))
        up = hang.select(F.col("root").alias("u"), F.col("node").alias("v")).join(low.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), F.col("low").alias("root")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = up.groupBy("node").agg(F.min("root").alias("low"))
        j = up.join(low, "node")
        down = j.select("node", F.col("low").alias("root")).unionAll(j.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")))
        hang = cut(down.where("node <> root").distinct())
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return hang.unionAll(hang.select(F.col("root").alias("node"), "root").distinct())
