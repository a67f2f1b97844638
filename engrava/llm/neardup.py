"""Problem 3: near-duplicates with small edits. Multi-index Hamming join over signatures of minimum hashes, exact verification."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engrava.llm.common import MIN_CHARS, components, grams, jaccard, minhash, norm_text, remove, scratch
from engrava.session import cut

#: Similarity from which two texts are linked.
THRESHOLD = 0.70
#: A signature has CHUNKS chunks of WIDTH symbols. A chunk has WIDTH keys, in each of which one symbol is left open, so that it
#: is found in spite of one error. Two signatures that differ in fewer than 2 * CHUNKS symbols have a chunk with one error at most
#: (pigeonhole), so all of these are found; others are found with the probability that there is such a chunk.
CHUNKS, WIDTH = 10, 4
#: One half of a chunk with one error is whole, so chunks are shuffled by their halves, of BITS a symbol, and a task makes the keys.
BITS = 14
#: So many symbols are carried, 4 bits each, and pairs that differ in more than RADIUS of them are left out: at similarity
#: 0.70 the expected distance is 13.5 with a deviation of 3.1.
CARRIED, RADIUS = 48, 26
#: Rows of which a task makes keys at once (more only if they share a half), and pairs it gives at once.
ROWS, PAIRS = 1 << 18, 1 << 20

WORDS = CARRIED // 16


def chunk_keys(symbols: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Keys of chunks of width symbols of 16 bits, width a chunk: the key's number, then the chunk's symbols but one, which is left open."""
    n, chunks = len(symbols), symbols.shape[1] // width
    low = (symbols & np.uint32(0xFFFF)).astype(np.int64).reshape(n, chunks, width)
    keys = np.broadcast_to(np.arange(chunks * width, dtype=np.int64).reshape(chunks, width), (n, chunks, width)).copy()
    for open_ in range(width):
        for w in range(width):
            if w != open_:
                keys[:, :, open_] = (keys[:, :, open_] << 16) | low[:, :, w]
    return keys.reshape(n, chunks * width)


def halves(symbols: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Two longs a chunk, one for each half: 2 bits of the table, 5 of the half's number, its symbols, the other half's symbols."""
    n = len(symbols)
    low = (symbols & np.uint32((1 << BITS) - 1)).astype(np.int64).reshape(n, CHUNKS * 2, WIDTH // 2)
    own = (low[:, :, 0] << BITS) | low[:, :, 1]
    other = own.reshape(n, CHUNKS, 2)[:, :, ::-1].reshape(n, CHUNKS * 2)
    number = (tables.astype(np.int64)[:, None] << 5) | np.arange(CHUNKS * 2, dtype=np.int64)
    return (((number << 2 * BITS) | own) << 2 * BITS) | other


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid; halves: those of the chunks; s0..: the carried symbols, 4 bits each."""
    for b in batches:
        for i in range(0, len(b), 4096):
            part = b.slice(i, 4096)
            m = minhash(part["t"].to_pylist(), max(CHUNKS * WIDTH, CARRIED))
            of = {t: zlib.crc32(t.encode()) & 3 for t in part["tbl"].unique().to_pylist()}
            h = halves(m[:, : CHUNKS * WIDTH], np.array([of[t] for t in part["tbl"].to_pylist()]))
            lists = pa.ListArray.from_arrays(np.arange(0, h.size + 1, h.shape[1], dtype=np.int32), h.ravel())
            columns = {"cid": part["cid"], "halves": lists, **{k: pa.array(v) for k, v in carried(m).items()}}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


SIGNED = "cid long, halves array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


def open_keys(h: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(2, n) each: the two keys of halves that leave a symbol of the other half open, and that symbol.

    Chunks with one error have one key in common, that which leaves it open; equal chunks have all four. These are to meet under the
    last only, so there each row has a number of its own instead of the symbol (from start), and pairs of equal symbols are passed over.
    """
    second = (h >> 4 * BITS) & 1 == 1
    s = np.stack([(h >> BITS * w) & ((1 << BITS) - 1) for w in (3, 2, 1, 0)], axis=1)
    s[second] = s[second][:, [2, 3, 0, 1]]
    keys = chunk_keys(s) | (h >> (4 * BITS + 1) << 50)[:, None]
    row, first = np.arange(len(h)), np.where(second, 0, 2)
    left = np.stack([s[row, first], np.where(second, s[:, 1], -1 - start - row)])
    return np.stack([keys[row, first], keys[row, first + 1]]), left


def meet(h: np.ndarray, cid: np.ndarray, carry: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of cid whose chunks are equal but for one symbol at most, within RADIUS, once a chunk; h: all rows of each half in it."""
    n = len(h)
    parts = [open_keys(h[i : i + ROWS], i) for i in range(0, n, ROWS)]
    key, left = (np.concatenate(x, axis=1).ravel() for x in zip(*parts))
    order = np.argsort(key)
    key, i = key[order], 0
    while i < 2 * n:
        j = min(i + ROWS, 2 * n)
        if j < 2 * n:  # rows of a key stay together
            j = int(np.searchsorted(key, key[j])) if key[j] != key[i] else int(np.searchsorted(key, key[j], side="right"))
        k, row, free = key[i:j], order[i:j] % n, left[order[i:j]]
        ids, words = cid[row], np.stack([w[row] for w in carry], axis=1)
        begin, step = np.flatnonzero(k[1:] == k[:-1]), 1
        while len(begin):
            a = begin[free[begin] != free[begin + step]]
            x = words[a] ^ words[a + step]
            x |= (x >> 1) & 0x7777777777777777
            x |= (x >> 2) & 0x3333333333333333
            a = a[np.bitwise_count(x & 0x1111111111111111).sum(axis=1) <= RADIUS]
            a = a[ids[a] != ids[a + step]]
            if len(a):
                yield np.minimum(ids[a], ids[a + step]), np.maximum(ids[a], ids[a + step])
            step += 1
            begin = begin[begin + step < len(k)]
            begin = begin[k[begin] == k[begin + step]]
        i = j


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid_a, cid_b) of rows (h, cid, s0..) sorted by h: pairs that meet, several times if they do in several chunks."""

    def found(h: np.ndarray, cid: np.ndarray, *carry: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs, n = [], 0
        for a, b in meet(h, cid, list(carry)):
            pairs.append((a, b))
            n += len(a)
            if n >= PAIRS:
                yield written(pairs)
                pairs, n = [], 0
        if pairs:
            yield written(pairs)

    def written(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs)], names=["cid_a", "cid_b"])

    parts, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        parts.append([c.to_numpy() for c in batch.columns])
        n += len(batch)
        if n < ROWS or parts[0][0][0] >> 2 * BITS == parts[-1][0][-1] >> 2 * BITS:
            continue
        held, parts = [np.concatenate(x) for x in zip(*parts)], []
        whole = np.searchsorted(held[0], held[0][-1] >> 2 * BITS << 2 * BITS)  # the last half may go on in the next batch
        yield from found(*[x[:whole] for x in held])
        parts, n = [[x[whole:].copy() for x in held]], len(held[0]) - whole
    if parts:
        held, parts = [np.concatenate(x) for x in zip(*parts)], []
        yield from found(*held)


def carried(m: np.ndarray) -> dict:
    """s0..: the carried symbols of minimum hashes, 4 bits each."""
    nibbles = ((m[:, :CARRIED] >> np.uint32(8)) & np.uint32(0xF)).astype(np.uint8)
    if nibbles.shape[1] < CARRIED:
        nibbles = np.pad(nibbles, ((0, 0), (0, CARRIED - nibbles.shape[1])))
    packed = (nibbles[:, 0::2] | (nibbles[:, 1::2] << 4)).astype(np.uint8)
    words = np.ascontiguousarray(packed).view(np.int64)
    return {f"s{i}": words[:, i] for i in range(WORDS)}


def distance(a: str, b: str):
    """Number of carried symbols in which rows a and b differ, inside the JVM's generated code."""
    parts = []
    for i in range(WORDS):
        x = f"({a}.s{i} ^ {b}.s{i})"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        parts.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {0x1111111111111111})")
    return F.expr(" + ".join(parts))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact similarity of two normalised texts."""
    seen: dict[str, frozenset] = {}

    def of(t: str) -> frozenset:
        if t not in seen:
            if len(seen) > 2000:
                seen.clear()
            seen[t] = grams(t)
        return seen[t]

    return pd.Series([jaccard(of(x), of(y)) for x, y in zip(a, b)], dtype="float64")


class Classes:
    """Texts of one or several tables: members (tbl, id, cid), a written table, and the different texts (cid, tbl, t)."""

    def __init__(self, tables: list[DataFrame], what: str = "neardup"):
        """tables: frames (tbl string, id string, version, text)."""
        spark = tables[0].sparkSession
        self.path = scratch(spark, what)
        rows = reduce(DataFrame.unionAll, [t.select("tbl", "id", "version", norm_text("text").alias("t")) for t in tables])
        rows = rows.where("id is not null").withColumn("cid", F.when(F.length("t") >= MIN_CHARS, F.xxhash64("tbl", "t")))
        # the latest version of a record says which text it has; only keys and hashes are shuffled for that
        members = rows.groupBy("tbl", "id").agg(F.max(F.struct("version", "cid")).alias("m")).select("tbl", "id", F.col("m.cid").alias("cid")).where("cid is not null")
        members.write.option("compression", "zstd").parquet(f"{self.path}/members")
        self.members = spark.read.parquet(f"{self.path}/members")
        # grouped by the key that candidates are joined by, so that one shuffle of the texts serves their signatures and both joins
        texts = rows.where("cid is not null").groupBy("cid").agg(F.collect_set(F.struct("tbl", "t")).alias("texts"))
        self.texts = texts.select("cid", F.explode("texts").alias("x")).select("cid", "x.tbl", "x.t")

    def pairs(self, threshold: float = THRESHOLD) -> DataFrame:
        """(tbl, cid_a, cid_b, similarity): pairs of different texts of the same table with at least the threshold, once each."""
        carry = [f"s{i}" for i in range(WORDS)]
        signed = self.texts.mapInArrow(sign, SIGNED).select(F.explode("halves").alias("h"), "cid", *carry)
        near = signed.repartition(F.shiftright("h", 2 * BITS)).sortWithinPartitions("h").mapInArrow(candidates, "cid_a long, cid_b long")
        near = near.repartition("cid_a").distinct()
        j = near.join(self.texts.select(F.col("cid").alias("cid_a"), F.col("tbl"), F.col("t").alias("ta")), "cid_a")
        j = j.join(self.texts.select(F.col("cid").alias("cid_b"), F.col("tbl").alias("tbl_b"), F.col("t").alias("tb")), "cid_b")
        # tables are compared here: as a condition of the join they would be keys of its shuffle, and the texts were shuffled again
        j = j.select("tbl", "cid_a", "cid_b", F.when(F.col("tbl") == F.col("tbl_b"), similarity("ta", "tb")).alias("similarity"))
        return j.where(F.col("similarity") >= threshold)

    def close(self) -> None:
        remove(self.members.sparkSession, self.path)


def tables_of(memories: DataFrame, drops: DataFrame) -> list[DataFrame]:
    return [
        memories.select(F.lit("memories").alias("tbl"), F.col("id").cast("string").alias("id"), F.col("updated_at").alias("version"), "text"),
        drops.select(F.lit("write_guard_drops").alias("tbl"), F.col("id").cast("string").alias("id"), F.col("ts").alias("version"), F.col("text_preview").alias("text")),
    ]


def links(tables: list[DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(tbl, id_a, id_b): every pair of different records of the same table whose texts have at least the threshold, id_a < id_b.

    tables: frames (tbl, id, version, text); the latest version of an id counts. Equal texts are one class, so a text that
    many records share is signed and compared once; only here, where the result lists pairs of records, classes are
    written out. Null texts and texts under 40 characters are never compared; texts of any length are read as a whole.
    """
    c = Classes(tables)
    pairs = cut(c.pairs(threshold).select("tbl", "cid_a", "cid_b"))
    m = c.members
    a, b = m.select("tbl", F.col("cid").alias("cid_a"), F.col("id").alias("x")), m.select("tbl", F.col("cid").alias("cid_b"), F.col("id").alias("y"))
    between = pairs.join(a, ["tbl", "cid_a"]).join(b, ["tbl", "cid_b"]).select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = m.groupBy("tbl", "cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tbl", "cid")
    copied = m.join(copies, ["tbl", "cid"], "left_semi")
    within = copied.select("tbl", "cid", F.col("id").alias("id_a")).join(copied.select("tbl", "cid", F.col("id").alias("id_b")), ["tbl", "cid"]).where("id_a < id_b").select("tbl", "id_a", "id_b")
    return between.unionAll(within)


def groups(tables: list[DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(tbl, id, group_id, n_links): every record that has a near copy; group_id is the smallest class key of its component.

    n_links counts linked other texts and other records with the same text, without writing out pairs of copies.
    """
    c = Classes(tables)
    pairs = cut(c.pairs(threshold).select("tbl", "cid_a", "cid_b"))
    of = components(pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))).select(F.col("node").alias("cid"), "root")
    sizes = c.members.groupBy("tbl", "cid").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select(F.col("cid_a").alias("cid"), F.col("cid_b").alias("other")).unionAll(pairs.select(F.col("cid_b").alias("cid"), F.col("cid_a").alias("other")))
    partners = both.join(sizes.select(F.col("cid").alias("other"), "copies"), "other").groupBy("cid").agg(F.sum("copies").alias("partners"))
    per = sizes.join(of, "cid", "left").join(partners, "cid", "left").where("copies > 1 or root is not null")
    per = per.select("tbl", "cid", F.coalesce("root", "cid").alias("group_id"), (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return c.members.join(per, ["tbl", "cid"]).select("tbl", "id", "group_id", "n_links")
