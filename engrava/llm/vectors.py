"""Vectors: usable ones, their directions in 16-bit fixed point, and problem 5's search by a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.llm.common import remove, scratch
from engrava.session import cut

DIM, NEAR, NEIGHBOURS = 64, 0.80, 5
#: Trees of the forest: each is one array of all vectors, sorted by their hash strings.
TREES = 4
#: A hash string: the signed axis of a rotation with the greatest projection (FIRST_BITS), then LATER times that of two further axes (2 bits each).
FIRST_BITS, LATER = 7, 27
#: A prefix that more than LEAF vectors share is lengthened; a vector ascends until it shares its prefix with at least LEAF / 2.
LEAF = 2048
#: So often a vector takes the least label among those of its neighbours; vectors with the same label are compared.
SPREAD = 3
#: Cosines of 16-bit directions are off by less than this; what lies nearer to a bound is decided by the stored values.
DOUBT = 1e-4
#: Rows of a block of queries that is compared with its leaf at a time.
BLOCK = 512
#: Tables up to this size (rows counted) are broadcast; larger ones are joined as the optimiser sees fit.
BROADCAST_BYTES = 8 << 20


def usable_vectors(v: pd.Series) -> np.ndarray:
    """Of each list of floats, whether it is a usable vector: DIM values, none missing, all finite, not all zero."""
    out = np.zeros(len(v), dtype=bool)
    for i, a in enumerate(v):
        if a is not None and len(a) == DIM:
            x = np.asarray(a, dtype=np.float64)  # a missing value becomes nan
            out[i] = bool(np.isfinite(x).all() and x.any())
    return out


def quantised(memories: DataFrame, key: str = "id", vector: str = "embedding", version: str = "updated_at") -> DataFrame:
    """(id, n, q): the usable vectors of the latest versions; q is the direction, n a number in the order of the ids.

    One range shuffle by id serves the choice of the latest version, the order and the numbers.
    """

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = usable_vectors(b["v"])
            q = np.full(len(b), None, dtype=object)
            q[ok] = pack_directions(directions(b["v"][ok]))
            yield pd.DataFrame({"id": b["id"], "version": b["version"], "q": q})

    rows = memories.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(version).alias("version"), F.col(vector).alias("v"))
    rows = rows.mapInPandas(quantise, "id string, version timestamp, q binary")
    last = rows.repartitionByRange("id").groupBy("id").agg(F.max(F.struct("version", "q")).alias("m")).select("id", F.col("m.q").alias("q")).where("q is not null")
    return last.sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("n"), "q")


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The frame with a broadcast hint if its rows, counted now, take up at most BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def with_ids(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The frame with surrogates in columns turned into ids; ids: (id, n)."""
    ids = if_small(ids.select("id", "n"), 64)
    for c in columns:
        df = df.join(ids.select(F.col("n").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c).withColumnRenamed(f"{c}_id", c)
    return df


def exact_cosines(pairs: DataFrame, numbers: DataFrame, memories: DataFrame, key: str = "id", vector: str = "embedding", version: str = "updated_at") -> DataFrame:
    """(a, b, cosine) of pairs (a, b) of numbers: in double precision from the stored values, rounded to 6 decimals.

    Meant for the few pairs that 16-bit directions leave in doubt: only their vectors are read again and joined.
    """
    ends = with_ids(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("x", F.col("n")), numbers, "x")
    rows = memories.where(F.col(key).isNotNull()).select(F.col(key).alias("x"), F.col(version).alias("version"), F.col(vector).alias("v"))
    ends = cut(ends)
    v = rows.join(if_small(ends, 64), "x").groupBy("n").agg(F.max(F.struct("version", "v")).alias("m")).select("n", F.col("m.v").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = directions(b["va"]), directions(b["vb"])
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "cosine": np.round((x * y).sum(axis=1), 6)})

    j = pairs.select("a", "b").join(v.select(F.col("n").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("n").alias("b"), F.col("v").alias("vb")), "b")
    return j.mapInPandas(run, "a long, b long, cosine double")


def directions(v: pd.Series) -> np.ndarray:
    if not len(v):
        return np.zeros((0, DIM))
    x = np.stack([np.asarray(a, dtype=np.float64) for a in v])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack_directions(u: np.ndarray) -> list[bytes]:
    """Unit vectors as 16-bit numbers: a component is off by 1.6e-5 at most, a cosine by about 1e-5."""
    return [r.tobytes() for r in np.rint(u * 32767).astype("<i2")]


def unpack_directions(b: pd.Series | list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(b), dtype="<i2").reshape(len(b), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotations(trees: int, seed: int, dim: int = DIM) -> np.ndarray:
    """Two rotations per tree: that of the first symbol and that of the later ones."""
    rng = np.random.default_rng(seed)
    return np.stack([np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(2)]) for _ in range(trees)])


def strings(u: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Hash strings of unit vectors, one column per tree: its number, the first symbol, the later symbols, most significant first."""
    out = np.empty((len(u), len(rot)), dtype=np.int64)
    for t, (one, two) in enumerate(rot):
        p = u @ one
        s = (np.int64(t) << FIRST_BITS) | np.concatenate([p, -p], axis=1).argmax(axis=1)
        p = u @ two
        x, y = p[:, 0 : 2 * LATER : 2], p[:, 1 : 2 * LATER : 2]
        symbols = np.where(np.abs(x) >= np.abs(y), x < 0, 2 + (y < 0)).astype(np.int64)
        out[:, t] = (s << 2 * LATER) | symbols @ (np.int64(1) << 2 * np.arange(LATER - 1, -1, -1))
    return out


def prefix(s: F.Column, length: int) -> F.Column:
    """The first symbols of a hash string; of length 0, the tree's number."""
    return F.shiftright(s, 2 * (LATER + 1 - length) if length else 2 * LATER + FIRST_BITS)


def leaves(codes: DataFrame, leaf: int = LEAF) -> list[DataFrame]:
    """For every prefix length from 1 a table (p, leaf, tiles): the leaf that the places with a prefix p of that length, and of no other table, are in.

    codes: (s). Descent: a prefix that more than leaf places share is crowded, and its places are told apart by one more symbol.
    Ascent, in all trees at once, from the longest prefixes up: what hangs below a crowded prefix is filled into leaves of
    about leaf places in the order of the sorted array; a rest of less than half of that ascends, and is filled in with
    what its parent's siblings leave. So a leaf is a stretch of the sorted array that holds all longest matches of its
    members, and at least leaf / 2 places unless the tree has no more. Strings that are equal to their end and crowded make
    a leaf of several tiles. Prefix counts are combined map-side; tables have as many rows as there are prefixes below
    crowded ones, and the driver sees only whether there is a crowded one.
    """
    kids, live, d = [], codes, 0
    while True:
        d += 1
        counted = cut(live.groupBy(prefix(F.col("s"), d).alias("p")).agg(F.count(F.lit(1)).alias("c")).withColumn("up", F.shiftright("p", 2 if d > 1 else FIRST_BITS)))
        kids.append(counted)
        if d > LATER:
            break
        crowded = counted.where(F.col("c") > leaf).select(F.col("p").alias("full"))
        if crowded.isEmpty():
            break
        live = live.join(if_small(crowded, 8), prefix(F.col("s"), d) == F.col("full"), "left_semi")
    rest: DataFrame | None = None
    filled: list[DataFrame] = []
    for d in range(len(kids), 0, -1):
        entries = kids[d - 1].where((F.col("c") <= leaf) | F.lit(d > LATER)).select("up", "p", "c", F.lit(False).alias("crowded"))
        if rest is not None:
            entries = entries.unionAll(rest)
        order = Window.partitionBy("up").orderBy("p", "crowded")
        entries = entries.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("bin", F.floor(F.col("before") / leaf))
        whole = Window.partitionBy("up", "bin")
        entries = entries.withColumn("size", F.sum("c").over(whole)).withColumn("leaf", F.min(F.struct("p", "crowded")).over(whole)["p"])
        up = (F.col("size") * 2 < leaf) & F.lit(d > 1)
        shift = 2 * (LATER + 1 - d)
        entries = cut(entries.select("up", "p", "c", "crowded", "size", F.when(~up, F.shiftleft("leaf", shift) + d).alias("leaf")))
        filled.insert(0, entries)
        rest = entries.where("leaf is null").groupBy("up").agg(F.sum("c").alias("c")).select(F.shiftright("up", 2 if d > 2 else FIRST_BITS).alias("up"), F.col("up").alias("p"), "c", F.lit(True).alias("crowded"))
    out, above = [], None
    for d, entries in enumerate(filled, start=1):
        if above is not None:
            entries = entries.join(above, "up", "left").withColumn("leaf", F.coalesce("leaf", "above")).drop("above")
        above = entries.where("crowded").select(F.col("p").alias("up"), F.col("leaf").alias("above"))
        tiles = F.when(F.lit(d > LATER) & (F.col("c") > leaf), F.ceil(F.col("c") / leaf)).otherwise(F.lit(1)).cast("int")
        out.append(cut(entries.where("not crowded").select("p", "leaf", tiles.alias("tiles"))))
    return out


def top_neighbours(ids: np.ndarray, u: np.ndarray, k: int, near: float, asking: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple]:
    """For rows of a leaf, or the asking (ids, vectors): (row, neighbours' rows, cosines, links) of up to k others of the leaf with at least near, best first, ties by id.

    links holds, for every row listed, the first of all others with at least near. ids must be sorted, so that the row number stands for the order of ids.
    """
    who, x = (ids, u) if asking is None else asking
    own = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
    for s in range(0, len(who), BLOCK):
        c = x[s : s + BLOCK] @ u.T
        at = own[s : s + BLOCK]
        self = np.nonzero(ids[at] == who[s : s + BLOCK])[0]
        c[self, at[self]] = -2.0
        rows, cols = np.nonzero(c >= near)
        links = cols[np.nonzero(np.diff(rows, prepend=-1))[0]]
        # row, descending cosine and column in one number
        key = np.sort((rows << 45) | (np.int64(1_000_100) - np.rint(c[rows, cols] * 1e6).astype(np.int64)) << 24 | cols)
        rows, cols = key >> 45, key & 0xFFFFFF
        start = np.searchsorted(rows, np.arange(len(c)))
        keep = np.arange(len(rows)) - start[rows] < k
        rows, cols = rows[keep], cols[keep]
        yield rows + s, cols, c[rows, cols], links


LISTS = "n long, label long, others array<long>, cosines array<float>"


def merged(lists: DataFrame, most: int) -> DataFrame:
    """LISTS, one row a vector: of all its lists the most best others, ties by number, and the least of its labels."""

    def best(n: np.ndarray, label: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((-cosine, other, n))
        n, label, other, cosine = n[order], label[order], other[order], cosine[order]
        begin = np.nonzero(np.diff(n, prepend=n[0] - 1))[0]
        least = np.minimum.reduceat(label, begin)
        once = np.nonzero((np.diff(n, prepend=n[0] - 1) != 0) | (np.diff(other, prepend=other[0] - 1) != 0))[0]
        once = once[np.lexsort((other[once], -np.round(cosine[once].astype(np.float64), 6), n[once]))]
        n, other, cosine = n[once], other[once], cosine[once]
        ids, begin, count = np.unique(n, return_index=True, return_counts=True)
        keep = np.arange(len(n)) - np.repeat(begin, count) < most
        ends = np.concatenate([[0], np.cumsum(np.minimum(count, most))]).astype(np.int32)
        columns = [pa.array(ids), pa.array(least), pa.ListArray.from_arrays(ends, other[keep]), pa.ListArray.from_arrays(ends, cosine[keep])]
        return pa.RecordBatch.from_arrays(columns, names=["n", "label", "others", "cosines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not len(b):
                continue
            size = b["others"].value_lengths().to_numpy()
            part = [np.repeat(b["n"].to_numpy(), size), np.repeat(b["label"].to_numpy(), size), b["others"].flatten().to_numpy(), b["cosines"].flatten().to_numpy()]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            whole = np.searchsorted(held[0], held[0][-1])  # the last vector may go on in the next batch
            if whole:
                yield best(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None:
            yield best(*held)

    return lists.repartition("n").sortWithinPartitions("n").mapInArrow(run, LISTS)


def in_tiles(places: DataFrame) -> DataFrame:
    """(leaf, i, j, role, n, q): where the places (n, q, leaf, tiles) are compared: in their leaf, or in pairs of its tiles.

    A place asks in all tiles of its leaf and is met in its own; with a single tile that is one row.
    """
    own = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int")).otherwise(F.lit(0))
    both = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role"))
    asks = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("role")))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("role")))
    return places.withColumn("own", own).withColumn("x", F.explode(F.when(F.col("tiles") > 1, F.concat(asks, meets)).otherwise(F.array(both)))).select("leaf", "x.i", "x.j", "x.role", "n", "q")


def spread(lists: DataFrame, rounds: int) -> DataFrame:
    """(n, label): labels of LISTS after so many rounds, in each of which a vector takes the least label of its own and its listed neighbours."""
    labels = lists.select("n", "label")
    for _ in range(rounds):
        of = if_small(labels.select(F.col("n").alias("other"), F.col("label").alias("theirs")), 16)
        seen = lists.select("n", F.explode("others").alias("other")).join(of, "other").select("n", F.col("theirs").alias("label"))
        labels = cut(labels.unionAll(seen).groupBy("n").agg(F.min("label").alias("label")))
    return labels


def by_label(labels: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(n, leaf, tiles): leaves of about half of leaf vectors that hold whole labels; a label of more than twice leaf is a leaf of several tiles."""
    bins = max(1, 2 * labels.count() // leaf)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    crowded = if_small(cut(sizes.where(F.col("c") > 2 * leaf).select("label", F.ceil(F.col("c") / leaf).cast("int").alias("tiles"))), 16)
    at = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(-1 - F.col("label"))
    return labels.join(crowded, "label", "left").select("n", at.alias("leaf"), F.coalesce("tiles", F.lit(1)).alias("tiles"))


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, near: float = NEAR, trees: int = TREES, leaf: int = LEAF, seed: int = 5, spare: int = 0, rounds: int = SPREAD) -> DataFrame:
    """(n, other, cosine): for every vector of (n, q) its up to k + spare most similar others with at least near; ties by n.

    A forest of trees, each an array sorted by long hash strings and cut into leaves (see leaves): a vector's candidates are,
    in every tree, those that share its longest prefix which enough others share. All vectors are indexed and all are
    queries. As vectors grow, prefixes get longer and a pair is separated in more trees, but what is linked stays linked
    through others: a leaf gives a vector the least number it is linked with as its label, labels spread along the
    neighbours found, and vectors with the same label are compared too. The search is approximate, its recall is measured
    against brute force. A leaf has at most 2 * leaf vectors, so work and shuffle are in proportion to the number of
    vectors, but for strings that are equal to their end and labels of more vectors: these are compared in pairs of tiles. Vectors with equal directions are entered under their k + 1 smallest numbers only: no other
    copy can be among anyone's k, and the others' neighbours are the k smallest. No vectors, no rows.
    """
    spark = vectors.sparkSession
    rot, most = rotations(trees, seed), k + spare
    ranked = vectors.select("n", "q", F.xxhash64("q").alias("h"))
    hot = cut(ranked.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most + 1).select("h"))
    copied = None
    kept = ranked.select("n", "q")
    if not hot.isEmpty():
        some = ranked.join(hot, "h", "left_semi")
        # the smallest numbers of each direction, of salted parts first, so that no task ranks a whole hot group
        part = Window.partitionBy("h", "q", "salt").orderBy("n")
        few = some.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(64))).withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= most + 1)
        few = few.withColumn("rn", F.row_number().over(Window.partitionBy("h", "q").orderBy("n"))).where(F.col("rn") <= most + 1).select("h", "q", "n", "rn")
        few = cut(few)
        kept = ranked.join(hot, "h", "left_anti").select("n", "q").unionAll(few.select("n", "q"))
        first = few.where(F.col("rn") <= most).select("h", "q", F.col("n").alias("other"))
        copied = some.join(few.select("n"), "n", "left_anti").join(first, ["h", "q"]).select("n", "other", F.lit(1.0).alias("cosine"))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": strings(unpack_directions(b["q"]), rot).ravel()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["n", "q"]].assign(s=list(strings(unpack_directions(b["q"]), rot)))

    path = scratch(spark, "codes")
    kept.select("q").mapInPandas(code, "s long").write.option("compression", "zstd").parquet(path)
    places = kept.mapInPandas(place, "n long, q binary, s array<long>").select("n", "q", F.explode("s").alias("s"))
    places = places.withColumns({"leaf": F.lit(None).cast("long"), "tiles": F.lit(None).cast("int")})
    for d, table in enumerate(leaves(spark.read.parquet(path), leaf), start=1):
        t = if_small(table.select("p", F.col("leaf").alias("at"), F.col("tiles").alias("in")), 24)
        places = places.join(t, prefix(F.col("s"), d) == F.col("p"), "left").select("n", "q", "s", F.coalesce("leaf", "at").alias("leaf"), F.coalesce("tiles", "in").alias("tiles"))
    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        role, ids = t["role"].to_numpy(), t["n"].to_numpy()
        u = unpack_directions(t["q"].to_pylist())
        asking = None if (role == 2).all() else (ids[role != 1], u[role != 1])
        ids, u = ids[role != 0], u[role != 0]
        who = ids if asking is None else asking[0]
        found = [(who[r], ids[c], v.astype(np.float32), ids[links]) for r, c, v, links in top_neighbours(ids, u, most, near - DOUBT, asking)] if len(ids) else []
        mine, others, cosines, label = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=x) for x in ("i8", "i8", "f4", "i8")]
        begin = np.nonzero(np.diff(mine, prepend=-1))[0]
        ends = np.append(begin, len(mine)).astype(np.int32)
        columns = [pa.array(mine[begin]), pa.array(np.minimum(mine[begin], label)), pa.ListArray.from_arrays(ends, others), pa.ListArray.from_arrays(ends, cosines)]
        return pa.Table.from_arrays(columns, names=["n", "label", "others", "cosines"])

    def searched(places: DataFrame) -> DataFrame:
        return in_tiles(places).groupBy("leaf", "i", "j").applyInArrow(search, LISTS)

    lists = cut(merged(searched(places), most))
    if rounds:
        again = kept.join(if_small(cut(by_label(spread(lists, rounds), leaf)), 24), "n")
        lists = merged(searched(again).unionAll(lists), most)
    best = lists.select("n", F.explode(F.arrays_zip("others", "cosines")).alias("x")).select("n", F.col("x.others").alias("other"), F.round(F.col("x.cosines").cast("double"), 6).alias("cosine"))
    return best if copied is None else best.unionAll(copied)


def decided(near_by: DataFrame, numbers: DataFrame, memories: DataFrame, k: int = NEIGHBOURS, near: float = NEAR) -> DataFrame:
    """(n, other): of more than k neighbours each (n, other, cosine) the k best, where DOUBT leaves it open by the stored values.

    In doubt are cosines next to the bound and those next to that of the k-th neighbour.
    """
    by_n = Window.partitionBy("n")
    order = by_n.orderBy(F.col("cosine").desc(), "other")
    c = near_by.withColumn("r", F.row_number().over(order))
    c = c.withColumn("last", F.max(F.when(F.col("r") == k, F.col("cosine"))).over(by_n))
    close = F.abs(F.col("cosine") - F.coalesce("last", F.lit(-2.0))) <= 2 * DOUBT
    c = c.withColumn("rivals", F.sum(close.cast("int")).over(by_n))
    doubtful = (close & (F.col("rivals") > 1)) | (F.abs(F.col("cosine") - F.lit(near)) <= DOUBT)
    c = c.select("n", "other", "cosine", doubtful.alias("doubtful"), "last")
    c = cut(c.where(F.col("doubtful") | (F.col("r") <= k)))
    asked = cut(c.where("doubtful").select(F.least("n", "other").alias("a"), F.greatest("n", "other").alias("b")).distinct())
    if asked.isEmpty():
        return c.where(F.col("cosine") >= near).select("n", "other")
    exact = cut(exact_cosines(asked, numbers, memories))
    exact = if_small(exact.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("cosine").alias("exact")), 24)
    # only vectors with a pair in doubt are ranked again
    open_ = c.where("doubtful").select("n").distinct()
    sure = c.join(open_, "n", "left_anti").select("n", "other")
    c = c.join(open_, "n", "left_semi").join(exact, (F.least("n", "other") == F.col("x")) & (F.greatest("n", "other") == F.col("y")), "left")
    value = F.when(F.col("doubtful"), F.col("exact")).otherwise(F.col("cosine"))
    above = F.when(F.col("doubtful"), 1).otherwise(0)
    c = c.withColumn("value", value).where(F.col("value") >= near)
    c = c.withColumn("r", F.row_number().over(by_n.orderBy(above, F.col("value").desc(), "other"))).where(F.col("r") <= k)
    return sure.unionAll(c.select("n", "other"))


def stored(memories: DataFrame, what: str) -> tuple[DataFrame, str]:
    """quantised(memories) as a table in the shared folder, so that numbers stay the same however often it is read, and its path."""
    path = scratch(memories.sparkSession, what)
    quantised(memories).write.option("compression", "zstd").parquet(path)
    return memories.sparkSession.read.parquet(path), path


def neighbour_table(memories: DataFrame) -> DataFrame:
    """(id, neighbour_id, cosine): every usable vector's neighbours; rows of unusable vectors are left out.

    Which they are is decided as in found; the cosines shown are those of 16-bit directions, off by less than DOUBT.
    """
    v, path = stored(memories, "vectors")
    near_by = cut(neighbours(v.select("n", "q"), spare=1))
    kept = decided(near_by, v, memories).join(near_by, ["n", "other"])
    out = cut(with_ids(kept, v, "n", "other").select(F.col("n").alias("id"), F.col("other").alias("neighbour_id"), "cosine"))
    remove(memories.sparkSession, path)
    return out


def found(memories: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of which one is a neighbour of the other."""
    v, path = stored(memories, "vectors")
    n = decided(neighbours(v.select("n", "q"), spare=1), v, memories).select(F.least("n", "other").alias("id_a"), F.greatest("n", "other").alias("id_b")).distinct()
    out = cut(with_ids(n, v, "id_a", "id_b"))
    remove(memories.sparkSession, path)
    return out
