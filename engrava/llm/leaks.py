"""Problem 8: evaluation texts inside training text. SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak is a run of so many consecutive words of a passage; windows have this size.
RUN = 13
#: Fingerprints within RADIUS differ in none of at least one of RADIUS + 1 blocks.
BITS, RADIUS = 64, 3
#: Verified windows have at least this weighted similarity of their word pairs before the exact run is looked for.
LEAST = 0.8
#: Passages are held in every task; more of them than this are looked up in several passes over blocks of passages.
PASSAGES = 20_000

WORD = regex.compile(r"[\p{L}\p{Nd}]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def word_class() -> np.ndarray:
    """Of every code point, whether it is a letter or digit."""
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        table[c] = kind[0] == "L" or kind == "Nd"
    return table


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, BASE, dtype=np.uint64), out=up[1:])
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    down = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, inverse, dtype=np.uint64), out=down[1:])
    return up, down


CHUNK = 1 << 20


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a lower-cased text, and where they begin and end. Words never depend on chunking."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flag = word_class()[cp]
    edge = np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = powers(CHUNK)
    # prefix sums of c * BASE^i; positions are taken modulo CHUNK with the sum restarted, a word across two chunks adds both
    pos = np.arange(len(cp), dtype=np.int64) % CHUNK
    terms = np.where(flag, (cp.astype(np.uint64) + np.uint64(1)) * up[pos], np.uint64(0))
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    h = (total[ends] - total[starts]) * down[starts % CHUNK]
    for i in np.nonzero(starts // CHUNK != np.maximum(ends - 1, 0) // CHUNK)[0]:  # at most one word a chunk
        v = cp[starts[i] : ends[i]].astype(np.uint64) + np.uint64(1)
        p = np.concatenate([up] * (len(v) // CHUNK + 1))[: len(v)] if len(v) > CHUNK else up[: len(v)]
        h[i] = np.sum(v * p, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return h, starts, ends


def simhashes(h: np.ndarray, size: int = RUN) -> np.ndarray:
    """64-bit SimHash of every window of size words; the bits of a window are the majorities of its words' bits.

    The 64 counts of a window are kept as planes of bits (plane j holds bit j of all 64 counts), to which words are added
    with carries, so a window costs a few operations on whole words instead of 64 sums.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    planes: list[np.ndarray] = []
    for k in range(size):
        carry = h[k : k + n].copy()
        for j, plane in enumerate(planes):
            planes[j], carry = plane ^ carry, plane & carry
        if (k + 1).bit_length() > len(planes):
            planes.append(carry)
    # counts of more than half: compare the planes with size // 2 + 1 from the highest bit on
    least = size // 2 + 1
    more, equal = np.zeros(n, dtype=np.uint64), np.full(n, ~np.uint64(0))
    for j in reversed(range(len(planes))):
        if least >> j & 1:
            equal &= planes[j]
        else:
            more |= equal & planes[j]
            equal &= ~planes[j]
    return more | equal


class Passages:
    """The index over all windows of the passages: for each block of bits the windows in the order of that block."""

    def __init__(self, items: list[tuple[str, str]], run: int = RUN, radius: int = RADIUS):
        self.run, self.radius = run, radius
        self.words = {}
        prints, owner, at = [], [], []
        for item, passage in items:
            text = (passage or "").lower()
            words = WORD.findall(text)
            h, _, _ = word_hashes(text) if text else (np.zeros(0, np.uint64),) * 3
            self.words[item] = words
            s = simhashes(h, run)
            prints.append(s)
            owner += [item] * len(s)
            at += range(len(s))
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.owner, self.at = np.array(owner, dtype=object), np.array(at, dtype=np.int64)
        self.width = BITS // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            key = self.block(self.prints, b)
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange((1 << self.width) + 1))
            self.blocks.append((order, first))
        # word pairs weigh less the more windows of passages hold them
        self.weight: dict[tuple[str, str], float] = {}
        for words in self.words.values():
            for pair in {*zip(words, words[1:])}:
                self.weight[pair] = self.weight.get(pair, 0.0) + 1.0
        self.weight = {k: 1.0 / v for k, v in self.weight.items()}

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window of the text, window of a passage) whose fingerprints differ in at most radius bits."""
        found = []
        for b, (order, first) in enumerate(self.blocks):
            key = self.block(prints, b)
            lo, n = first[key], first[key + 1] - first[key]
            hit = np.nonzero(n)[0]
            for i in range(0, len(hit), 1 << 16):
                part = hit[i : i + (1 << 16)]
                m = n[part]
                w = np.repeat(part, m)
                off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                p = order[np.repeat(lo[part], m) + off]
                near = np.bitwise_count(prints[w] ^ self.prints[p]) <= self.radius
                found.append(np.stack([w[near], p[near]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def similarity(self, a: list[str], b: list[str]) -> float:
        x, y = {*zip(a, a[1:])}, {*zip(b, b[1:])}
        w = lambda s: sum(self.weight.get(p, 1.0) for p in s)
        return w(x & y) / (w(x | y) or 1.0)

    def leaked(self, texts: list[str]) -> list[tuple[int, str]]:
        """(number of the text, item) for the items with a window that is a run of the text."""
        out: set[tuple[int, str]] = set()
        group, chars = [], 0
        for i, t in enumerate(texts):
            if t and len(t) >= 2 * self.run - 1:
                group.append((i, t.lower()))
                chars += len(t)
                if chars > 1_000_000:
                    out |= self._leaked(group)
                    group, chars = [], 0
        return sorted(out | self._leaked(group))

    def _leaked(self, group: list[tuple[int, str]]) -> set[tuple[int, str]]:
        if not group:
            return set()
        low = "\n".join(t for _, t in group)
        begin = np.cumsum([0] + [len(t) + 1 for _, t in group])
        h, starts, ends = word_hashes(low)
        if len(h) < self.run:
            return set()
        of = np.searchsorted(begin, starts, side="right") - 1
        inside = np.nonzero(of[: len(of) - self.run + 1] == of[self.run - 1 :])[0]
        w, p = self.candidates(simhashes(h, self.run)[inside])
        out = set()
        for i, j in zip(inside[w].tolist(), p.tolist()):
            hit = (group[of[i]][0], self.owner[j])
            if hit in out:
                continue
            mine = [low[s:e] for s, e in zip(starts[i : i + self.run].tolist(), ends[i : i + self.run].tolist())]
            theirs = self.words[hit[1]][self.at[j] : self.at[j] + self.run]
            if self.similarity(mine, theirs) >= LEAST and mine == theirs:
                out.add(hit)
        return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, radius: int = RADIUS) -> DataFrame:
    """(key, item_id): the documents that hold at least run consecutive words of an item's passage.

    The passages' windows are fingerprinted and kept in every task (a stated set of queries, in blocks of PASSAGES
    items); the documents are read once a block and never shuffled. Equal windows have equal fingerprints, so every
    run is a candidate; blocks of bits find all fingerprints within radius; candidates are verified on their words.
    Null and empty texts and passages, and passages shorter than the run, give no rows. Rows that repeat a (key, text)
    give the same rows once.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    sought = sorted((r["i"], r["p"]) for r in items.select(F.col("item_id").alias("i"), F.col("passage").alias("p")).where("i is not null and p is not null").collect())

    def block(part: list[tuple[str, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Passages(shared.value, run, radius)
            for b in batches:
                out = [(b["k"].iloc[i], item) for i, item in index.leaked(b["t"].tolist())]
                yield pd.DataFrame(out, columns=["k", "item_id"]) if out else pd.DataFrame({"k": b["k"][:0], "item_id": b["t"][:0]})

        return rows.mapInPandas(search, f"k {kind}, item_id string")

    found = None
    for i in range(0, max(1, len(sought)), PASSAGES):
        part = block(sought[i : i + PASSAGES])
        found = part if found is None else found.unionAll(part)
    return found.distinct().withColumnRenamed("k", key)
