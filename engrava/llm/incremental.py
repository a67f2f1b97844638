"""Problem 6: new batches against all history. Multi-key sorted runs, windows around new records, periodic compaction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.common import MIN_CHARS, free, minhash, norm_text, remove, rows_of, scratch
from engrava.llm.neardup import RADIUS, WORDS, carried, distance, similarity
from engrava.session import cut

#: Sort keys of a record. A key is the number of an order, then SYMBOLS leading and TRAILING further hash symbols of 8 bits.
KEYS, SYMBOLS, TRAILING = 12, 4, 3
#: Bits of a key behind its number, and behind its leading part.
BITS, TAIL = 8 * (SYMBOLS + TRAILING), 8 * TRAILING
#: A window holds so many neighbours to either side, and all that agree with the new record in the leading part of the key.
SIDE = 3
THRESHOLD = 0.70
#: Entries of a key range, and texts of a part: more history has more of them, and a batch reads those that its keys fall into.
ENTRIES_A_RANGE, TEXTS_A_PART = 50_000, 20_000
#: Later runs are merged into one when there are so many, and into the first when they have half of its texts.
COMPACT = 4
#: New entries that are held in every task at a time; a batch of more is looked up in several passes.
HELD = 400_000
#: Rows of candidates or of a batch's ids up to which they are broadcast (at most 64 bytes each); more are shuffled.
BROADCAST_ROWS = 100_000
#: Links within a batch up to which one task decides them (16 bytes each); of more, rounds decide some first.
ONE_TASK = 400_000


def sort_keys(symbols: np.ndarray) -> np.ndarray:
    """A sort key per order: its number, the order's own symbols, and the first symbols of the next order."""
    low = (symbols & np.uint32(0xFF)).astype(np.int64).reshape(len(symbols), KEYS, SYMBOLS)
    line = np.concatenate([low, np.roll(low, -1, axis=1)[:, :, :TRAILING]], axis=2)
    keys = np.broadcast_to(np.arange(KEYS, dtype=np.int64), (len(symbols), KEYS)).copy()
    for i in range(SYMBOLS + TRAILING):
        keys = (keys << 8) | line[:, :, i]
    return keys


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 4096):
            part = b.iloc[i : i + 4096]
            m = minhash(part["t"].tolist(), KEYS * SYMBOLS)
            yield part[["cid"]].assign(keys=list(sort_keys(m)), **carried(m))


SIGNED = "cid long, keys array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


class SortedRuns:
    """History: texts (part, cid, t, rec) and entries (range, k, cid, s0..) sorted by k within key ranges, as runs.

    A key is one of KEYS different orders of the texts, kept as it is, so that neighbours in the order are alike. Ranges are
    intervals of the keys of about ENTRIES_A_RANGE entries, of which a batch reads those that its keys fall into: for a
    given batch what is read is bounded however long the history is. The window around a new record is SIDE neighbours to
    either side and the whole stretch that agrees with the leading part of its key, which is never cut at a count. A
    run is written once and never changed; the list of runs in force is replaced at the end of an update, so an
    update that fails leaves the former state. The folders of the first run, the longest by far, are listed once for
    as long as it is in force: a listing of many is a job that fills the driver's memory.
    """

    def __init__(self, spark: SparkSession, a_range: int = ENTRIES_A_RANGE, a_part: int = TEXTS_A_PART):
        self.spark, self.path, self.a_range, self.a_part = spark, scratch(spark, "runs"), a_range, a_part
        self.runs: list[tuple[int, int, int, int]] = []  # number, texts, bits of a range within an order, parts
        self.n = 0
        self.listed: dict[str, tuple[int, DataFrame]] = {}  # of the first run, by kind: its number and its files

    def add(self, texts: DataFrame, signed: DataFrame, rows: int) -> None:
        """A new run of these texts (cid, t, rec), about so many rows, and their signatures (cid, keys, s0..)."""
        self._write(texts, signed.select("cid", F.explode("keys").alias("k"), *[f"s{i}" for i in range(WORDS)]), rows)
        later = self.runs[1:]
        if 2 * sum(r[1] for r in later) >= self.runs[0][1] and later:
            self._merge(list(self.runs))
        elif len(later) >= COMPACT:
            self._merge(later)

    def _write(self, texts: DataFrame, entries: DataFrame, rows: int) -> None:
        self.n += 1
        bits, parts = max(0, (rows // self.a_range).bit_length()), max(1, rows // self.a_part)
        entries = entries.withColumn("range", F.shiftright("k", BITS - bits).cast("int"))
        tasks = max(1, min(KEYS << bits, -(-rows * KEYS // self.a_range)))
        entries.repartition(tasks, "range").sortWithinPartitions("range", "k").write.partitionBy("range").option("compression", "zstd").parquet(f"{self.path}/entries/run={self.n}")
        if rows >= self.a_range:
            free(self.spark)  # the shuffle of a run's entries is as large as the run
        texts = texts.withColumn("part", F.pmod(F.col("cid"), F.lit(parts)).cast("int")).select("part", "cid", "t", "rec")
        texts.repartition(parts, "part").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/texts/run={self.n}")
        self.runs.append((self.n, rows, bits, parts))

    def _merge(self, old: list[tuple[int, int, int, int]]) -> None:
        """Write these runs, the last ones, as one, with ranges and parts for what it holds now."""
        texts, entries = self._table(old, "texts").select("cid", "t", "rec"), self._table(old, "entries").select("cid", "k", *[f"s{i}" for i in range(WORDS)])
        self._write(texts, entries, sum(r[1] for r in old))
        self.runs = self.runs[: len(self.runs) - 1 - len(old)] + self.runs[-1:]
        for r in old:
            for kind in ("texts", "entries"):
                remove(self.spark, f"{self.path}/{kind}/run={r[0]}")

    def _files(self, runs: list[tuple[int, int, int, int]], kind: str) -> DataFrame:
        s = "cid long, k long, " + ", ".join(f"s{i} long" for i in range(WORDS)) + ", run int, `range` int" if kind == "entries" else "cid long, t string, rec string, run int, part int"
        return self.spark.read.schema(s).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/run={r[0]}" for r in runs])

    def _table(self, runs: list[tuple[int, int, int, int]], kind: str, wanted: dict[int, list[int]] | None = None) -> DataFrame:
        """The rows of these runs in a scan of the first run and one of all others; of the ranges or parts that are wanted of each, if given."""
        scans, later = [], [r for r in runs if r[0] != self.runs[0][0]]
        if len(later) < len(runs):
            if self.listed.get(kind, (0,))[0] != self.runs[0][0]:
                self.listed[kind] = self.runs[0][0], self._files(self.runs[:1], kind)
            scans.append((runs[:1], self.listed[kind][1]))
        if later:
            scans.append((later, self._files(later, kind)))
        if wanted is not None:
            column = F.col("range" if kind == "entries" else "part")
            scans = [(of, df.where(reduce(lambda a, b: a | b, [(F.col("run") == r[0]) & column.isin(wanted[r[0]]) for r in of]))) for of, df in scans]
        return reduce(DataFrame.unionAll, [df for _, df in scans])

    def windows(self, signed: DataFrame, rows: int) -> DataFrame:
        """(cid, other): history texts in the windows around these texts whose signatures are near enough."""
        new = signed.select("cid", F.explode("keys").alias("k"), *[f"s{i}" for i in range(WORDS)])
        passes = -(-rows * KEYS // HELD)
        out = None
        for i in range(passes):
            held = new.where(F.pmod(F.xxhash64("cid"), F.lit(passes)) == i).toPandas().sort_values("k")
            k, cid, sig = held["k"].to_numpy(), held["cid"].to_numpy(), held[[f"s{w}" for w in range(WORDS)]].to_numpy()
            shared = self.spark.sparkContext.broadcast((k, cid, sig))
            entries = self._table(self.runs, "entries", {r[0]: np.unique(k >> (BITS - r[2])).tolist() for r in self.runs})
            part = cut(entries.select("k", "cid", *[f"s{w}" for w in range(WORDS)]).mapInPandas(around(shared), "cid long, other long").distinct())
            shared.destroy()
            out = part if out is None else out.unionAll(part)
        return out

    def matches(self, texts: DataFrame, signed: DataFrame, rows: int, threshold: float) -> DataFrame:
        """(cid, rec, similarity) of the most similar history record (the smallest of equal ones) with at least the threshold."""
        near = self.windows(signed, rows)
        # parts of each run that hold a candidate: at most as many as there are parts
        at = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("run"), F.pmod("other", F.lit(r[3])).cast("int").alias("part")) for r in self.runs])).alias("x")
        wanted: dict[int, list[int]] = {r[0]: [0] for r in self.runs}
        pairs = 0
        for row in near.select(at).groupBy("x.run", "x.part").agg(F.count(F.lit(1)).alias("n")).collect():
            wanted[row["run"]].append(row["part"])
            pairs += row["n"]  # of every run, so it counts each candidate once a run
        few = pairs <= BROADCAST_ROWS * len(self.runs)
        history = self._table(self.runs, "texts", wanted).select(F.col("cid").alias("other"), F.col("t").alias("ta"), "rec")
        j = history.join(F.broadcast(near) if few else near, "other").join(texts.select("cid", F.col("t").alias("tb")), "cid")
        j = j.select("cid", "rec", similarity("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold)
        return j.groupBy("cid").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "rec")).alias("m")).select("cid", F.col("m.rec").alias("rec"), (-F.col("m.less")).alias("similarity"))

    def close(self) -> None:
        remove(self.spark, self.path)


def around(shared):
    """For sorted stretches of history entries: those in the windows of the held new entries with a near signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = list(batches)  # at most what a task reads of the files, which is bounded by the session's size of a split
        if not have:
            return
        h = pd.concat(have).sort_values("k")
        hk, hc, hs = h["k"].to_numpy(), h["cid"].to_numpy(), h[[f"s{w}" for w in range(WORDS)]].to_numpy()
        k, cid, sig = shared.value
        begin, end = np.searchsorted(k, hk[0] >> TAIL << TAIL), np.searchsorted(k, hk[-1] | ((1 << TAIL) - 1), side="right")
        for i in range(begin, end, 1 << 14):
            part = slice(i, min(i + (1 << 14), end))
            at = np.searchsorted(hk, k[part])
            lo = np.minimum(np.searchsorted(hk, k[part] >> TAIL << TAIL), np.maximum(at - SIDE, 0))
            hi = np.maximum(np.searchsorted(hk, k[part] | ((1 << TAIL) - 1), side="right"), np.minimum(at + SIDE, len(hk)))
            size = hi - lo
            for s in range(0, len(size), 1024):
                m = size[s : s + 1024]
                for first in range(0, int(m.max(initial=0)), 4096):  # a crowded window is read piece by piece
                    n = np.clip(m - first, 0, 4096)
                    new = np.repeat(np.arange(i + s, i + s + len(m)), n)
                    old = np.repeat(lo[s : s + 1024] + first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    x = sig[new] ^ hs[old]
                    x |= (x >> 1) & 0x7777777777777777
                    x |= (x >> 2) & 0x3333333333333333
                    near = np.bitwise_count(x & 0x1111111111111111).sum(axis=1) <= RADIUS
                    if near.any():
                        yield pd.DataFrame({"cid": cid[new[near]], "other": hc[old[near]]}).drop_duplicates()

    return run


def different(records: DataFrame, key: str = "id", text: str = "text", version: str = "updated_at") -> DataFrame:
    """(cid, t, rec): the different texts of the records, each with the smallest id that has it in its latest version.

    Texts are grouped by their key, as the ids are, so that they are shuffled once; different texts of one key stay apart.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("rec"), F.col(version).alias("version"), norm_text(text).alias("t"))
    rows = rows.withColumn("cid", F.when(F.length("t") >= MIN_CHARS, F.xxhash64("t")))
    last = rows.groupBy("rec").agg(F.max(F.struct("version", "cid")).alias("m")).select("rec", F.col("m.cid").alias("cid")).where("cid is not null")
    least = last.groupBy("cid").agg(F.min("rec").alias("rec"))
    texts = rows.where("cid is not null").groupBy("cid").agg(F.collect_set("t").alias("texts"))
    return texts.join(least, "cid").select("cid", F.explode("texts").alias("t"), "rec")


def history_of(records: DataFrame, key: str = "id", text: str = "text", version: str = "updated_at", a_range: int = ENTRIES_A_RANGE, a_part: int = TEXTS_A_PART) -> SortedRuns:
    """The runs of all accepted records so far: one entry per different text, under the smallest id that has it."""
    spark = records.sparkSession
    texts = different(records, key, text, version)
    path = scratch(spark, "history")
    texts.write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    n = texts.count()
    if n >= a_range:
        free(spark)
    runs = SortedRuns(spark, a_range, a_part)
    runs.add(texts, texts.select("cid", "t").mapInPandas(sign, SIGNED), n)
    remove(spark, path)
    return runs


def within(signed: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(cid, other, a, b, open, similarity): pairs of different texts of one batch, once, with their first items; open: none of both is in history."""
    e = signed.select("cid", F.explode("keys").alias("k"), *[f"s{i}" for i in range(WORDS)]).withColumn("k", F.shiftright("k", TAIL))
    near = e.alias("a").join(e.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.cid") < F.col("b.cid")) & (distance("a", "b") <= RADIUS))
    near = near.select(F.col("a.cid").alias("cid"), F.col("b.cid").alias("other")).distinct()
    side = lambda cid, x: known.select(F.col("cid").alias(cid), F.col("first").alias(x), F.col("t").alias(f"t{x}"), F.col("rec").isNull().alias(f"open{x}"))
    j = near.join(side("cid", "a"), "cid").join(side("other", "b"), "other")
    return cut(j.select("cid", "other", "a", "b", (F.col("opena") & F.col("openb")).alias("open"), similarity("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold))


def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links (a, b), a before b, in one task: the items that are linked to an earlier accepted one."""
    have = list(batches)
    if not have:
        return
    links, dup = pd.concat(have).sort_values("b"), set()
    for a, b in zip(links["a"].tolist(), links["b"].tolist()):  # all links to a come before those from it
        if a not in dup:
            dup.add(b)
    yield pd.DataFrame({"first": sorted(dup)})


def duplicates(links: DataFrame) -> DataFrame | None:
    """(first): of the links (a, b), a before b, those items that an earlier accepted one is linked to; None if there are no links.

    While there are too many links for one task, a round decides those to items without a link to an earlier one, which are
    accepted; it leaves at least no link of the least item.
    """
    live, taken = links, []
    while (n := rows_of(live)) > ONE_TASK:
        dup = cut(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select(F.col("b").alias("first")).distinct())
        taken.append(dup)
        live = cut(live.join(dup.select(F.col("first").alias("b")), "b", "left_anti").join(dup.select(F.col("first").alias("a")), "a", "left_anti").select("a", "b"))
    if n:
        taken.append(live.repartition(1).mapInPandas(decided, "first long"))
    return reduce(DataFrame.unionAll, taken) if taken else None


def batch(runs: SortedRuns, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Compare a batch (item_id, text) in the order of item_id, accept what isn't a duplicate, and give (item_id, matched_id) of the rest.

    The state of runs afterwards holds the accepted items. The first item of each different text can be accepted; which
    first items are follows from the links between them: an item is a duplicate once an earlier accepted item is linked
    to it, and accepted once every earlier linked item is a duplicate.

    A small batch costs plans and their exchanges, each of which is a thread of the driver for a minute, rather than data: so
    texts carry what is known of them, and ids that are few by their count are broadcast, not left to be shuffled first.
    """
    rows = items.where(F.length("t") >= MIN_CHARS).select("item_id", "t", F.xxhash64("t").alias("cid"))
    texts = cut(rows.groupBy("cid").agg(F.min(F.struct("item_id", "t")).alias("m")).select("cid", F.col("m.item_id").alias("first"), F.col("m.t").alias("t")))
    n = rows_of(texts)
    if n == 0:
        return rows.select("item_id", F.lit("").alias("matched_id")).limit(0)
    ids = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    signed = cut(texts.select("cid", "t").mapInPandas(sign, SIGNED))
    known = cut(texts.join(runs.matches(texts, signed, n, threshold), "cid", "left"))
    links = within(signed, known, threshold)
    taken = duplicates(links.where("open and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    accepted = known.where("rec is null").select("cid", "first")
    accepted = cut(accepted if taken is None else accepted.join(ids(taken), "first", "left_anti").select("cid", "first"))
    # accepted records like a text: the best of history, first items of the batch (for items after them), and its own first item
    new = links.select("cid", "other", "similarity").unionAll(links.select(F.col("other").alias("cid"), F.col("cid").alias("other"), "similarity"))
    new = new.join(ids(accepted.withColumnRenamed("cid", "other")), "other").select("cid", "first", "similarity").unionAll(accepted.select("cid", "first", F.lit(1.0).alias("similarity")))
    old = known.where("rec is not null").select("cid", F.lit(None).cast("long").alias("first"), F.col("rec").alias("matched_id"), "similarity")
    like = old.unionAll(new.select("cid", "first", F.col("first").cast("string").alias("matched_id"), "similarity"))
    cases = rows.select("item_id", "cid").join(like, "cid").where("first is null or first < item_id")
    cases = cut(cases.groupBy("item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "matched_id")).alias("m")).select("item_id", "m.matched_id"))
    kept = ids(accepted.select("cid"))
    keep = known.join(kept, "cid", "left_semi").select("cid", "t", F.col("first").cast("string").alias("rec"))
    runs.add(keep, signed.join(kept, "cid", "left_semi"), n)
    return cases


def found(memories: DataFrame, incoming: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, matched_id): the items that repeat an accepted record, batch after batch.

    Items without an id or batch are left out; an item that is delivered again counts once, in its earliest batch. Null texts
    and texts under 40 characters are accepted and never compared. Empty batches give no rows.
    """
    runs = history_of(memories)
    items = incoming.where("item_id is not null and batch_no is not null").select("item_id", "batch_no", norm_text("text").alias("t"))
    items = cut(items.groupBy("item_id").agg(F.min(F.struct("batch_no", "t")).alias("m")).select("item_id", F.col("m.batch_no").alias("batch_no"), F.col("m.t").alias("t")))
    numbers = sorted(r["batch_no"] for r in items.select("batch_no").distinct().collect())
    out = [batch(runs, items.where(F.col("batch_no") == n), threshold) for n in numbers]
    runs.close()
    if not out:
        return items.select("item_id", F.lit("").alias("matched_id")).limit(0)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionAll(o)
    return whole
