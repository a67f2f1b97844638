"""Problem 4: items that appear together. A pair table kept up to date by signed deltas of changed baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.common import remove, scratch
from engrava.session import cut

#: Hash buckets of the persistent counts at least; a table of more rows gets more, so that a bucket has about so many rows.
BUCKETS, ROWS_A_BUCKET = 16, 2_000_000


def baskets(mentions: DataFrame, basket: str = "memory_id", item: str = "entity_id") -> DataFrame:
    """Distinct (basket, item) under the names basket and item; rows with a null in either are no mentions."""
    rows = mentions.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    return rows.distinct()


def pair_deltas(signed: DataFrame) -> DataFrame:
    """(a, b, n): sums of signed pair counts of signed basket rows (basket, item, sign), a < b.

    The pairs of a basket come from a join of its rows with themselves, so that no basket is ever collected; the join's own shuffle
    by basket lets the adaptive plan split a hot basket. Sums combine map-side before pairs are shuffled.
    """
    left, right = signed.select("basket", F.col("item").alias("a"), "sign"), signed.select("basket", F.col("item").alias("b"), F.col("sign").alias("sign_b"))
    return left.join(right, ["basket"]).where("a < b and sign = sign_b").groupBy("a", "b").agg(F.sum("sign").alias("n")).where("n <> 0")


KEYS = {"pairs": ("a", "b"), "items": ("item",), "baskets": ("basket",)}


class PairTable:
    """The persistent state below a path: pairs (a, b, n), items (item, n) and baskets (basket, item), each in hash buckets.

    A bucket is a folder of one version. An update reads and writes only the buckets that its deltas fall into, as folders of a
    new version, and these come into force together when all are written; a lost executor or a failed update leaves the
    versions before it in force. After an update, touched holds the items whose pairs must be scored again
    (scores(items=touched)), or None if all must because the number of baskets is another; gone the pairs that are no more.
    """

    touched: DataFrame | None = None
    gone: DataFrame | None = None

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.version = spark, path or scratch(spark, "pairs"), buckets, 0
        self.at: dict[str, dict[int, int]] = {name: {} for name in KEYS}  # the version in force of each bucket that has rows
        self.n = 0

    def _bucket(self, name: str) -> F.Column:
        return F.pmod(F.hash(*KEYS[name]), F.lit(self.buckets)).cast("int")

    def _folder(self, name: str, version: int, bucket: int | None = None) -> str:
        return f"{self.path}/{name}-{version}" + (f"/bucket={bucket}" if bucket is not None else "")

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows in force, of all buckets or of these."""
        by: dict[int, list[int]] = {}
        for b, v in self.at[name].items():
            if buckets is None or b in buckets:
                by.setdefault(v, []).append(b)
        out = None
        for v, bs in sorted(by.items()):
            df = self.spark.read.parquet(*[self._folder(name, v, b) for b in sorted(bs)])
            out = df if out is None else out.unionByName(df)
        return out

    def _merge(self, name: str, rows: DataFrame, buckets: set[int]) -> dict[int, int]:
        """Write these rows, all of the given buckets, as the next version of them: one task a bucket. The versions then in force."""
        to = self._folder(name, self.version)
        rows = rows.repartition(self.buckets, *KEYS[name])
        if "n" in rows.columns:
            rows = rows.groupBy(*KEYS[name]).agg(F.sum("n").alias("n")).where("n > 0")
        rows.withColumn("bucket", self._bucket(name)).write.partitionBy("bucket").option("compression", "zstd").parquet(to)
        have = set()
        if rows.columns:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(to)
            have = {int(f.getPath().getName().split("=")[1]) for f in jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(jpath) if f.getPath().getName().startswith("bucket=")}
        return {b: v for b, v in self.at[name].items() if b not in buckets} | dict.fromkeys(have, self.version)

    def update(self, changed: DataFrame) -> None:
        """Put (basket, item) rows in the place of the same baskets' former rows; an item that is null empties its basket.

        A changed basket emits its former pairs with sign -1 and its present ones with +1; likewise for its items. Only
        changed baskets emit, the sums are merged into the persistent counts of the buckets they fall into, and other buckets
        are neither read nor written. An empty state is updated by the same steps.
        """
        self.version += 1
        changed = cut(changed.where("basket is not null").select("basket", "item").distinct())
        where = {name: set() for name in KEYS}
        where["baskets"] = {r["b"] for r in changed.select(self._bucket("baskets").alias("b")).distinct().collect()}  # at most as many as there are buckets
        kept = self.table("baskets", where["baskets"])
        signed = changed.where("item is not null").withColumn("sign", F.lit(1).cast("long"))
        rest = signed.select("basket", "item")
        keys = changed.select("basket").distinct()
        if kept is not None:
            kept = kept.select("basket", "item")
            signed = signed.unionAll(kept.join(keys, "basket", "left_semi").withColumn("sign", F.lit(-1).cast("long")))
            rest = rest.unionAll(kept.join(keys, "basket", "left_anti"))
        signed = cut(signed)
        # rows that stay cancel out in the marginals; pairs need old and new baskets apart
        deltas = {"items": cut(signed.groupBy("item").agg(F.sum("sign").alias("n")).where("n <> 0")), "pairs": cut(pair_deltas(signed))}
        # a pair's own count may change where its items' don't, and a changed number of baskets changes every score
        many = {r["sign"]: r["c"] for r in signed.groupBy("sign").agg(F.countDistinct("basket").alias("c")).collect()}
        touched = None
        if many.get(-1, 0) == many.get(1, 0):
            touched = cut(deltas["items"].select("item").unionAll(deltas["pairs"].select(F.explode(F.array("a", "b")).alias("item"))).distinct())
        to = {"baskets": self._merge("baskets", rest, where["baskets"])}
        for name, d in deltas.items():
            where[name] = {r["b"] for r in d.select(self._bucket(name).alias("b")).distinct().collect()}
            old = self.table(name, where[name])
            to[name] = self._merge(name, d if old is None else d.unionByName(old.select(*d.columns)), where[name])
        before, self.at, self.touched = self.at, to, touched
        self.n += many.get(1, 0) - many.get(-1, 0)
        now = self.table("pairs", where["pairs"])
        lost = deltas["pairs"].where("n < 0").select("a", "b")
        self.gone = cut(lost if now is None else lost.join(now.select("a", "b"), ["a", "b"], "left_anti"))
        for name, was in before.items():
            for b, v in was.items():
                if to[name].get(b) != v:
                    remove(self.spark, self._folder(name, v, b))

    def close(self) -> None:
        remove(self.spark, self.path)

    def scores(self, least: int = 1, items: DataFrame | None = None) -> DataFrame:
        """(entity_a, entity_b, n_ab, n_a, n_b, n, lift, npmi) of pairs with n_ab >= least; of pairs with one of items only, if given.

        Pairs below least are left out before the marginals are joined; so are items that are rarer than least, since no
        pair of theirs can reach it.
        """
        n, pairs, m = self.n, self.table("pairs"), self.table("items")
        if pairs is None or m is None:
            return self.spark.createDataFrame([], "entity_a string, entity_b string, n_ab long, n_a long, n_b long, n long, lift double, npmi double")
        pairs = pairs.where(F.col("n") >= least).select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("n").alias("n_ab"))
        if items is not None:
            touched = items.select(F.col("item").alias("x"))
            one = pairs.join(touched, pairs["entity_a"] == touched["x"], "left_semi")
            pairs = one.unionAll(pairs.join(touched, pairs["entity_b"] == touched["x"], "left_semi")).distinct()
        m = m.where(F.col("n") >= least)
        pairs = pairs.join(m.select(F.col("item").alias("entity_a"), F.col("n").alias("n_a")), "entity_a").join(m.select(F.col("item").alias("entity_b"), F.col("n").alias("n_b")), "entity_b")
        lift = F.col("n_ab").cast("double") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
        pmi = F.log(F.col("lift")) / F.when(F.col("n_ab") < n, -F.log(F.col("n_ab") / F.lit(float(n or 1))))
        return pairs.select("entity_a", "entity_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), lift.alias("lift")).withColumn("npmi", F.round(pmi, 6)).withColumn("lift", F.round("lift", 6))


def table_of(mentions: DataFrame, basket: str = "memory_id", item: str = "entity_id", batches: int = 2) -> PairTable:
    """The table of all baskets, which arrive in so many batches (parts by a hash of the basket) and are put in by updates."""
    rows = cut(baskets(mentions, basket, item))
    t = PairTable(mentions.sparkSession, buckets=max(BUCKETS, rows.count() // ROWS_A_BUCKET))
    for i in range(batches):
        t.update(rows.where(F.pmod(F.xxhash64("basket"), F.lit(batches)) == i))
    return t


def all_scores(mentions: DataFrame, least: int = 1) -> DataFrame:
    t = table_of(mentions)
    out = cut(t.scores(least))
    t.close()
    return out


def updated(mentions: DataFrame, basket: str = "memory_id", item: str = "entity_id") -> DataFrame:
    """The rescored pairs of a table that was made of three quarters of the baskets and updated by the others: the scores of all."""
    rows = cut(baskets(mentions, basket, item)).withColumn("late", F.pmod(F.xxhash64("basket"), F.lit(4)) == 0)
    t = PairTable(mentions.sparkSession, buckets=max(BUCKETS, rows.count() // ROWS_A_BUCKET))
    t.update(rows.where("not late").drop("late"))
    t.update(rows.where("late").drop("late"))
    out = cut(t.scores(items=t.touched))
    t.close()
    return out


def found(mentions: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(entity_a, entity_b): pairs that share at least least memories and at least times as many as chance would have.

    The counts are those of a table that was filled by updates with signed deltas.
    """
    s = all_scores(mentions, least)
    return s.where(F.col("n_ab") * F.col("n") >= times * F.col("n_a") * F.col("n_b")).select("entity_a", "entity_b")
