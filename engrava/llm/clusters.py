"""Problem 1: clusters of similar records. Gaussian mixture on standardised, reduced features; exact links within what it keeps together."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.llm.common import components, remove
from engrava.llm.vectors import DIM, DOUBT, NEAR, exact_cosines, if_small, stored, unpack_directions, with_ids
from engrava.session import cut

#: Vectors a mixture is fitted on at most, chosen by a hash over all of them: that of the whole table, and that of one cell (documented bounds).
SAMPLE, CELL_SAMPLE = 16_384, 2_048
#: Features kept after standardising, as the leading principal components.
REDUCED = 24
#: Numbers of components that the information criterion chooses from.
CHOICES = (1, 4, 16, 64)
#: Added to every variance.
RIDGE = 0.02
#: A vector is put with its best components: this many, and only those whose share is at least SHARE of the best's.
PLACES, SHARE = 3, 1e-3
#: The same in a divided cell.
CELL_PLACES, CELL_SHARE = 2, 0.4
#: A cell (what is put with a component) of more places than this is divided by a mixture of its own of at most CELL_PARTS components, up to DEPTH times.
CELL, CELL_PARTS, DEPTH = 2_048, 64, 8
#: Mixtures of cells up to this size are broadcast; more are sent to the rows of their cells, of which one task gets at most CHUNK.
MODEL_BYTES, CHUNK = 64 << 20, 50_000
#: Vectors of a cell's sample that are tried as leaders, and the part of the sample that one must be linked to.
LEADERS, LED = 32, 0.25
#: Smallest group.
LEAST = 5


class Mixture:
    """Gaussian mixture with diagonal covariances in the space of standardised, reduced features, regularised by RIDGE."""

    def __init__(self, mean, scale, basis, weights, centres, variances):
        self.mean, self.scale, self.basis = mean, scale, basis
        self.weights, self.centres, self.variances = weights, centres, variances

    def features(self, u: np.ndarray) -> np.ndarray:
        return ((u - self.mean) / self.scale) @ self.basis

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        """log(weight * density) of every component for rows of features, as two matrix products."""
        inv = 1.0 / self.variances
        const = np.log(self.weights) - 0.5 * (np.log(self.variances).sum(axis=1) + z.shape[1] * math.log(2 * math.pi) + (self.centres**2 * inv).sum(axis=1))
        return const[None, :] + z @ (self.centres * inv).T - 0.5 * (z * z) @ inv.T

    def best(self, u: np.ndarray, places: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, components): for every row its up to places best components whose share is at least that of the best's."""
        j = self.log_joint(self.features(u).astype(np.float64))
        k = min(places, j.shape[1])
        best = np.argpartition(-j, k - 1, axis=1)[:, :k]
        val = np.take_along_axis(j, best, axis=1)
        rows, cols = np.nonzero(val >= val.max(axis=1, keepdims=True) + math.log(share))
        return rows, best[rows, cols].astype(np.int64)

    def log_density(self, z: np.ndarray) -> np.ndarray:
        j = self.log_joint(z)
        top = j.max(axis=1)
        return top + np.log(np.exp(j - top[:, None]).sum(axis=1))


def seeds(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres, each far from those before it."""
    chosen = [int(rng.integers(len(z)))]
    far = ((z - z[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = far.sum()
        i = int(rng.choice(len(z), p=far / total)) if total > 0 else int(rng.integers(len(z)))
        chosen.append(i)
        far = np.minimum(far, ((z - z[i]) ** 2).sum(axis=1))
    return z[chosen]


def expectation_maximisation(z: np.ndarray, k: int, rng: np.random.Generator, most: int = 25, ridge: float = RIDGE) -> tuple[tuple, float]:
    """(weights, centres, variances) and the log likelihood."""
    n, d = z.shape
    m = Mixture(None, None, None, np.full(k, 1 / k), seeds(z, k, rng), np.tile(z.var(axis=0) / max(1.0, k ** (2 / d)) + ridge, (k, 1)))
    before = -np.inf
    for _ in range(most):
        j = m.log_joint(z)
        top = j.max(axis=1)
        p = np.exp(j - top[:, None])
        s = p.sum(axis=1)
        like = float((top + np.log(s)).sum())
        p /= s[:, None]
        mass = p.sum(axis=0) + 1e-9
        m.weights = mass / mass.sum()
        m.centres = (p.T @ z) / mass[:, None]
        m.variances = np.maximum((p.T @ (z * z)) / mass[:, None] - m.centres**2, 0) + ridge
        if like - before < 1e-4 * n:
            break
        before = like
    return (m.weights, m.centres, m.variances), like


def fit(u: np.ndarray, reduced: int = REDUCED, choices: tuple[int, ...] = CHOICES, seed: int = 3) -> Mixture:
    """The mixture of these unit vectors whose number of components has the least Bayesian information criterion."""
    rng = np.random.default_rng(seed)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    x = (u - mean) / scale
    d = min(reduced, x.shape[1], max(1, len(u) - 1))
    basis = np.linalg.svd(x.T @ x)[0][:, :d]
    z = x @ basis
    best, least = None, np.inf
    for k in choices:
        if k > max(1, len(u) // 8):
            break
        parts, like = expectation_maximisation(z, k, rng)
        bic = (k * (2 * d + 1) - 1) * math.log(len(u)) - 2 * like
        if bic < least:
            best, least = parts, bic
        elif best is not None:
            break  # the criterion rises again
    return Mixture(mean.astype(np.float32), scale.astype(np.float32), basis.astype(np.float32), best[0], best[1].astype(np.float64), best[2])


def sample(vectors: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """At most about most unit vectors, chosen by the hash of their direction, so that the choice is the same for any partitioning."""
    n = vectors.count()
    if n == 0:
        return np.zeros((0, DIM), dtype=np.float32)
    rows = vectors
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("q", "n"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    got = rows.select("q").limit(2 * most).toPandas()["q"].map(bytes)  # the limit only guards the driver
    return unpack_directions(got.sort_values())


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, near: float, doubt: float = 0.0, block: int = 1024) -> pd.DataFrame:
    """Edges (a, b, sure) that connect what links between rows of a and rows of b connect; at most one sure edge per node.

    ids: numbers of a's rows, then (unless same) of b's. Labels spread over the links block by block: linked rows take
    the smallest label, and merged labels are united, so links are never listed. Cosines within doubt of the bound make no
    link; of these the pairs that nothing else connects are given as edges that aren't sure.
    """
    n = len(ids)
    parent = np.arange(n)
    off = 0 if same else len(a)
    open_ = []
    for s in range(0, len(a), block):
        c = a[s : s + block] @ (b[s:] if same else b).T
        left = off + (s if same else 0)
        if doubt:
            rows, cols = np.nonzero(np.abs(c - near) < doubt)
            open_.append(np.stack([rows + s, cols + left]))
        rows, cols = np.nonzero(c >= near + doubt)
        rows, cols = rows + s, cols + left
        while len(rows):
            x, y = parent[rows], parent[cols]
            apart = x != y
            rows, cols, x, y = rows[apart], cols[apart], x[apart], y[apart]
            if not len(rows):
                break
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.concatenate([[True], hi[1:] != hi[:-1]])
            parent[hi[first]] = lo[first]
            while True:  # flatten
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
    node = np.nonzero(parent != np.arange(n))[0]
    x, y = np.concatenate(open_, axis=1) if open_ else np.zeros((2, 0), dtype=np.int64)
    apart = (parent[x] != parent[y]) & (ids[x] != ids[y])
    x, y = x[apart], y[apart]
    return pd.DataFrame({"a": np.concatenate([ids[node], ids[x]]), "b": np.concatenate([ids[parent[node]], ids[y]]), "sure": np.arange(len(node) + len(x)) < len(node)})


class Cell:
    """How a large cell is divided: a mixture, and leaders, which are vectors of the cell that are linked to one another and to much of it."""

    def __init__(self, n: np.ndarray, u: np.ndarray, parts: int, near: float):
        rng = np.random.default_rng(5)
        mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
        x = (u - mean) / scale
        basis = np.linalg.svd(x.T @ x)[0][:, : min(REDUCED, x.shape[1])]
        z = x @ basis
        centres, variance = seeds(z, parts, rng), 1.0
        for _ in range(10):
            far = (z * z).sum(axis=1)[:, None] - 2 * z @ centres.T + (centres**2).sum(axis=1)
            p = np.exp((far.min(axis=1, keepdims=True) - far) / (2 * variance))
            p /= p.sum(axis=1, keepdims=True)
            mass = p.sum(axis=0) + 1e-9
            centres = (p.T @ z) / mass[:, None]
            variance = float((p * far).sum() / z.size) + RIDGE * 1e-3
        single = np.float32
        self.mixture = Mixture(mean.astype(single), scale.astype(single), basis.astype(single), np.full(parts, 1 / parts, dtype=single), centres.astype(single), np.full((1, z.shape[1]), variance, dtype=single))
        tried = rng.choice(len(u), min(LEADERS, len(u)), replace=False)
        links = u @ u[tried].T >= near + DOUBT
        first = int(links.sum(axis=0).argmax())
        led = tried[links[tried, first] | (np.arange(len(tried)) == first)] if links[:, first].mean() >= LED else tried[:0]
        self.leaders, self.heads = n[led], u[led].astype(single)
        self.first = int(n[tried[first]])

    def lead(self, n: np.ndarray, u: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): links between vectors and a leader each, and between the leaders."""
        if not len(self.leaders):
            return n[:0], n[:0]
        c = u @ self.heads.T
        is_linked = c.max(axis=1) >= near + DOUBT
        return np.concatenate([n[is_linked], self.leaders]), np.concatenate([self.leaders[c[is_linked].argmax(axis=1)], np.full(len(self.leaders), self.first)])


def linked(vectors: DataFrame, mixture: Mixture, near: float = NEAR, places: int = PLACES, share: float = SHARE, cell: int = CELL, depth: int = DEPTH, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(a, b, sure): edges that connect the vectors of (n, q) whose cosine is at least near, found within the mixture's components.

    Vectors of equal direction are placed once. A vector is placed with the components that have a part in it; these are
    the cells of the first level. A cell with more than cell places (counted) is divided by a mixture of its own, with tied
    variances and as many components as its size asks for, fitted on a bounded sample of it; and so on. So the number of components
    follows the number of vectors, and a vector is compared with about as many others however many there are. What a
    division cuts apart in a dense cell is held together by the cell's leaders, to which all vectors linked to them get an edge. Mixtures
    are broadcast up to model_bytes; beyond that each level's rows are shuffled to their cell's mixture. A cell that is still
    large after depth levels is compared in pairs of tiles. Edges that aren't sure have a cosine within DOUBT of near.
    """
    spark = vectors.sparkSession
    keyed = vectors.select("n", "q", F.xxhash64("q").alias("h"))
    hot = cut(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    edges: list[DataFrame] = []
    if not hot.isEmpty():
        hot = if_small(hot, 8)
        some = keyed.join(hot, "h", "left_semi")
        first = cut(some.groupBy("h", "q").agg(F.min("n").alias("first")))
        edges.append(some.join(if_small(first, 160), ["h", "q"]).where("n <> first").select(F.col("n").alias("a"), F.col("first").alias("b"), F.lit(True).alias("sure")))
        keyed = keyed.join(hot, "h", "left_anti").select("n", "q").unionAll(first.select(F.col("first").alias("n"), "q"))
    held: dict[int, Cell] = {}
    models = spark.sparkContext.broadcast((mixture, held))

    def child(at: int, part: np.ndarray) -> np.ndarray:
        """Numbers of the cells of a divided cell; those of the first level are 1, 2 and so on."""
        return at * (CELL_PARTS + len(mixture.weights)) + len(mixture.weights) + 1 + part

    def route(n: np.ndarray, u: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(cell, rows, None) where rows end, and (cell, rows, u) for the divided cells that they pass."""
        top, cells = models.value
        rows, cols = top.best(u, places, share)
        todo = [(int(c) + 1, rows[cols == c]) for c in np.unique(cols)]
        while todo:
            at, rows = todo.pop()
            if at not in cells:
                yield at, rows, None
                continue
            yield at, rows, u[rows]
            who, part = cells[at].mixture.best(u[rows], CELL_PLACES, CELL_SHARE)
            todo += [(int(child(at, p)), rows[who[part == p]]) for p in np.unique(part)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, q = b["n"].to_numpy(), b["q"].to_numpy()
            ends = [(at, rows) for at, rows, passed in route(n, unpack_directions(b["q"])) if passed is None]
            rows = np.concatenate([r for _, r in ends])
            yield pd.DataFrame({"cell": np.repeat([at for at, _ in ends], [len(r) for _, r in ends]), "n": n[rows], "q": q[rows]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(at, len(rows)) for at, rows, passed in route(b["n"].to_numpy(), unpack_directions(b["q"])) if passed is None], columns=["cell", "c"])

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy()
            for at, rows, passed in route(n, unpack_directions(b["q"])):
                if passed is not None:
                    x, y = models.value[1][at].lead(n[rows], passed, near)
                    yield pd.DataFrame({"a": x, "b": y, "sure": True})

    def fit_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        parts = min(CELL_PARTS, len(pdf), max(4, math.ceil(2 * pdf["c"].iloc[0] / cell)))
        own = Cell(pdf["n"].to_numpy(), unpack_directions(pdf["q"]), parts, near)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "model": [pickle.dumps(own)], "leads": [len(own.leaders) > 0]})

    def divide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"cell": left["cell"].iloc[:0], "n": left["n"].iloc[:0], "q": left["q"].iloc[:0], "lead": left["n"].iloc[:0]})
        own, u, n = pickle.loads(right["model"].iloc[0]), unpack_directions(left["q"]), left["n"].to_numpy()
        who, part = own.mixture.best(u, CELL_PLACES, CELL_SHARE)
        x, y = own.lead(n, u, near)
        down = pd.DataFrame({"cell": child(int(left["cell"].iloc[0]), part), "n": n[who], "q": left["q"].to_numpy()[who], "lead": None})
        return pd.concat([down, pd.DataFrame({"cell": -1, "n": x, "q": None, "lead": y})])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "n"])
        ids, u, side = pdf["n"].to_numpy(), unpack_directions(pdf["q"]), pdf["side"].to_numpy()
        if (side == 0).all():
            return forest(ids, u, u, True, near, DOUBT)
        return forest(ids, u[side == 0], u[side == 1], False, near, DOUBT)

    columns = ["cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "n", "q"]
    whole: list[DataFrame] = []  # (cell, i, j, side, n, q): what is compared
    placed, moved, leads, size = keyed.mapInPandas(place, "cell long, n long, q binary"), False, False, 0
    for level in range(depth + 1):
        counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")) if moved else keyed.mapInPandas(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
        large = cut(counted.where(F.col("c") > cell))
        if large.isEmpty():
            break
        large = if_small(large, 16)
        rows = placed.join(large, "cell")
        if level == depth:
            whole.append(placed.join(large, "cell", "left_anti").select(*columns))
            tiles = F.ceil(F.col("c") / cell).cast("int")
            cross = rows.withColumn("own", F.pmod(F.xxhash64("n"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
            whole.append(cross.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "n", "q"))
            placed = None
            break
        some = rows.where(F.pmod(F.xxhash64("n"), F.lit(1 << 30)) < F.lit(float(CELL_SAMPLE << 30)) / F.col("c"))
        fitted = cut(some.groupBy("cell").applyInPandas(fit_cell, "cell long, model binary, leads boolean"))
        new = fitted.agg(F.sum(F.length("model")).alias("bytes"), F.max("leads").alias("leads")).first()
        size += new["bytes"]
        if not moved and size <= model_bytes:
            held = held | {r["cell"]: pickle.loads(r["model"]) for r in fitted.select("cell", "model").collect()}
            models = spark.sparkContext.broadcast((mixture, held))
            leads = leads or new["leads"]
            placed = keyed.mapInPandas(place, "cell long, n long, q binary")
            continue
        moved = True
        whole.append(placed.join(large, "cell", "left_anti").select(*columns))
        parts = F.ceil(F.col("c") / CHUNK).cast("int")
        spread = fitted.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "model")
        rows = rows.select("cell", F.pmod(F.xxhash64("n", F.lit(17)), parts).cast("int").alias("part"), "n", "q")
        cells = cut(rows.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(divide, "cell long, n long, q binary, lead long"))
        edges.append(cells.where("lead is not null").select(F.col("n").alias("a"), F.col("lead").alias("b"), F.lit(True).alias("sure")))
        placed = cells.where("lead is null").select("cell", "n", "q")
    if placed is not None:
        whole.append(placed.select(*columns))
    if leads:
        edges.append(keyed.mapInPandas(lead, "a long, b long, sure boolean"))
    found = reduce(DataFrame.unionAll, whole).groupBy("cell", "i", "j").applyInPandas(compare, "a long, b long, sure boolean")
    return reduce(DataFrame.unionAll, edges, found)


def clusters(vectors: DataFrame, memories: DataFrame, least: int = LEAST, near: float = NEAR, mixture: Mixture | None = None) -> DataFrame:
    """(n, root): the vectors of (id, n, q) in groups of at least least members, root being the smallest number of the group.

    A group is everything that links connect. Vectors that stand alone, or in smaller groups, are left out. Edges whose
    cosine is next to near are decided by the stored values of memories.
    """
    if mixture is None:
        u = sample(vectors)
        if len(u) == 0:
            return vectors.select("n", F.col("n").alias("root")).limit(0)
        mixture = fit(u)
    edges = cut(linked(vectors.select("n", "q"), mixture, near))
    sure, open_ = edges.where("sure").select("a", "b"), edges.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not open_.isEmpty():
        sure = sure.unionAll(exact_cosines(cut(open_), vectors, memories).where(F.col("cosine") >= near).select("a", "b"))
    of = components(sure).select(F.col("node").alias("n"), "root")
    large = of.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return of.join(large.select("root"), "root", "left_semi").select("n", "root")


def found(memories: DataFrame) -> DataFrame:
    """(cluster_id, memory_id): members of groups of at least LEAST memories; cluster_id is the smallest id of the group."""
    v, path = stored(memories, "clusters")
    out = cut(with_ids(clusters(v, memories), v, "n", "root").select(F.col("root").alias("cluster_id"), F.col("n").alias("memory_id")))
    remove(memories.sparkSession, path)
    return out


def described(memories: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, rank, memory_id): each cluster's size and its most typical members, of highest density under the mixture."""
    v, path = stored(memories, "clusters")
    u = sample(v.select("n", "q"))
    if len(u) == 0:
        return v.select(F.col("id").alias("cluster_id"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("rank"), F.col("id").alias("memory_id")).limit(0)
    mixture = fit(u)
    model = memories.sparkSession.sparkContext.broadcast(mixture)

    def density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            d = m.log_density(m.features(unpack_directions(b["q"])).astype(np.float64))
            yield pd.DataFrame({"n": b["n"], "root": b["root"], "density": np.round(d, 6)})

    c = clusters(v, memories, mixture=mixture)
    d = v.select("n", "q").join(c, "n").select("n", "root", "q").mapInPandas(density, "n long, root long, density double")
    size = c.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    # best members are chosen map-side first, so that a hot cluster isn't sorted in one task
    part = d.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(64)))
    order = [F.col("density").desc(), F.col("n")]
    top = part.withColumn("r", F.row_number().over(Window.partitionBy("root", "salt").orderBy(*order))).where(F.col("r") <= typical)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("rank") <= typical)
    out = cut(top.select("n", "root", "rank").join(size, "root"))
    out = cut(with_ids(out, v, "n", "root").select(F.col("root").alias("cluster_id"), "size", "rank", F.col("n").alias("memory_id")))
    remove(memories.sparkSession, path)
    return out
