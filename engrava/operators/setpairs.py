"""Pairs of similar sets: an exact join by rare common elements that writes no pair twice and shuffles none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements are ordered by how often the bucket of their hash occurs; any order gives the same pairs, a good one few candidates.
BUCKETS = 1 << 16
#: Rows that a task holds at once (more only if they share an element), and pairs that it compares at once.
ROWS, PAIRS = 1 << 16, 1 << 18


def frequencies(sets: DataFrame) -> np.ndarray:
    """For each bucket of elements eight times the logarithm of its count."""
    of = sets.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).alias("k")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    rank = np.zeros(BUCKETS, dtype=np.uint8)
    rank[of["k"].to_numpy()] = np.minimum(255, np.log2(of["n"].to_numpy() + 1.0) * 8)
    return rank


def prefixes(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of the first elements of a set of n may be the first that it has in common with a similar one."""
    return n - np.ceil(np.round(threshold * n, 9)).astype(np.int64) + 1


def spread(rank: np.ndarray, threshold: float):
    """Rows (who, h) to one row per element of the prefix: (token, r, h, who), h in the common order, r the place in it from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                who, lists = part["who"], part["h"]
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                v, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                v = v[np.lexsort((v, rank[v & (BUCKETS - 1)], row))]
                begin = np.concatenate([[0], np.cumsum(n)])
                p = np.where(n > 0, prefixes(n, threshold), 0)
                rows = np.repeat(np.arange(len(n)), p)
                r = np.arange(len(rows)) - np.repeat(np.cumsum(p) - p, p)
                whole = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(v))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(v[begin[rows] + r]), pa.array(r.astype(np.int32)), whole.take(at), who.take(at)], names=["token", "r", "h", "who"])

    return run


def padded(begin: np.ndarray, n: np.ndarray, v: np.ndarray, rows: np.ndarray, fill: int) -> np.ndarray:
    """Elements of the rows as a matrix; fill stands beyond a row's end."""
    at = begin[rows][:, None] + np.arange(n[rows].max())
    return np.where(at < (begin + n)[rows][:, None], v[np.minimum(at, len(v) - 1)], fill)


def common(begin: np.ndarray, n: np.ndarray, m: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of the first n elements of rows i are among the first m of rows j."""
    out = np.zeros(len(i), dtype=np.int64)
    size = n[i] * m[j]
    order = np.argsort(size)
    at = 0
    while at < len(order):  # as many pairs at once as fit
        most = PAIRS * 16
        end = at + 1
        while end < len(order) and (end - at) * 2 * size[order[min(len(order) - 1, 2 * end - at)]] <= most:
            end = min(len(order), 2 * end - at)
        k = order[at:end]
        if size[k[-1]]:
            x, y = padded(begin, n, v, i[k], -1), padded(begin, m, v, j[k], -2)
            total = np.zeros(len(k), dtype=np.int64)
            for c in range(x.shape[1]):
                total += (y == x[:, c : c + 1]).any(axis=1)
            out[k] = total
        at = end
    return out


def similar(token: np.ndarray, r: np.ndarray, begin: np.ndarray, n: np.ndarray, v: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common): similar rows whose first common element is their token; all rows of each token in it, sorted by it."""
    share = threshold / (1 + threshold)  # of both sizes together that must be common
    order = np.lexsort((n, token))
    group = np.cumsum(np.concatenate([[0], token[order][1:] != token[order][:-1]]))
    size, rest, before = n[order], (n - r)[order], r
    most = int(size.max()) + 1
    key = group * (2 * most) + size
    end = np.searchsorted(key, group * (2 * most) + np.minimum(most, np.floor(size / threshold + 1e-6).astype(np.int64)), side="right")
    own = np.arange(len(order))
    # rows are sorted by size in a token, so those of fitting size are a stretch behind a row
    many = np.where(rest >= 2 * share * size - 1e-6, end - own - 1, 0)
    word = np.stack([np.bitwise_or.reduceat(np.where((v >> 22 & 1) == w, np.uint64(1) << (v >> 16 & 63).astype(np.uint64), np.uint64(0)), begin) for w in range(2)])[:, order]
    total = np.cumsum(many)
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        left = 0
        while True:  # a row with very many others is taken in parts
            length = np.minimum(many[a:b] - left, PAIRS) if b == a + 1 else many[a:b]
            i = np.repeat(own[a:b], length)
            j = i + 1 + left + np.arange(len(i)) - np.repeat(np.cumsum(length) - length, length)
            need = share * (size[i] + size[j]) - 1e-6
            k = np.flatnonzero((rest[i] >= need) & (rest[j] >= need))
            i, j, need = i[k], j[k], need[k]
            apart = sum(np.bitwise_count(word[w][i] & ~word[w][j]).astype(np.int64) for w in range(2))
            k = np.flatnonzero(size[i] - apart >= need)
            i, j = order[i[k]], order[j[k]]
            k = np.flatnonzero(common(begin, before, before, v, i, j) == 0)
            i, j = i[k], j[k]
            c = common(begin, n, n, v, i, j)
            k = np.flatnonzero(c >= threshold * (n[i] + n[j] - c) - 1e-9)
            if len(k):
                yield i[k], j[k], c[k]
            left += PAIRS
            if b > a + 1 or left >= many[a]:
                break
        a = b


def meet(threshold: float):
    """Rows (token, r, h, who) sorted by token to pairs (x, y, common, size_x, size_y)."""

    def found(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.combine_chunks()
        token, r, lists, who = (held[c].chunk(0) if held[c].num_chunks else None for c in ("token", "r", "h", "who"))
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(n) - n
        for i, j, c in similar(token.to_numpy(), r.to_numpy().astype(np.int64), begin, n, lists.flatten().to_numpy(), threshold):
            for s in range(0, len(i), 1 << 15):
                x, y = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                columns = [who.take(pa.array(x)), who.take(pa.array(y)), *[pa.array(k.astype(np.int32)) for k in (c[s : s + (1 << 15)], n[x], n[y])]]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "common", "size_x", "size_y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            parts.append(batch)
            n += len(batch)
            last = batch["token"][-1].as_py()
            if n < ROWS or parts[0]["token"][0].as_py() == last:
                continue
            held = pa.Table.from_batches(parts)
            whole = int(np.searchsorted(held["token"].to_numpy(), last))  # the last element may go on in the next batch
            yield from found(held.slice(0, whole))
            parts = held.slice(whole).to_batches()
            n = len(held) - whole
        if parts:
            yield from found(pa.Table.from_batches(parts))

    return run


def set_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, size_a, size_b) of sets (who, tokens) with a Jaccard similarity of at least threshold; a, b: who, a.id < b.id.

    who is a struct with an id and whatever else the pairs shall have. Elements are compared by 64-bit hashes. Two sets this similar have
    their first common element, in an order from rare to common, among their first n - ceil(threshold * n) + 1 each: there they meet, once,
    with all their elements, so that pairs are decided where they meet and neither candidates nor pairs are shuffled.
    """
    s = sets.select("who", F.array_distinct(F.transform("tokens", lambda x: F.xxhash64(x))).alias("h")).where(F.size("h") > 0)
    who = s.schema["who"].dataType.simpleString()
    rows = s.mapInArrow(spread(frequencies(s), threshold), f"token long, r int, h array<long>, who {who}")
    p = rows.repartition("token").sortWithinPartitions("token").mapInArrow(meet(threshold), f"x {who}, y {who}, common int, size_x int, size_y int")
    first = F.col("x.id") < F.col("y.id")
    pick = lambda l, r: F.when(first, F.col(l)).otherwise(F.col(r))
    return p.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), "common", pick("size_x", "size_y").alias("size_a"), pick("size_y", "size_x").alias("size_b"))
