"""Problem 7: filling fixed-capacity containers. Mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.session import cut

#: Where the files of the public tokenizers lie, and which of them sizes the documents; both are parameters.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The words of the pattern that goes with the byte-level vocabulary (fixed value, from the tokenizer's publication).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a packing task, so that each task holds the sizes of a bounded number of documents.
SHARD_TOKENS = 4_000_000


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str):
    import base64

    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens): tokens of each whole text. A null text has 0 tokens; a null source is the source ''."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "s": b["s"], "n_tokens": n})

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.col(text).alias("t"))
    kind = dict(docs.dtypes)[key]
    return rows.mapInPandas(count, f"k {kind}, s string, n_tokens long").select(F.col("k").alias(key), F.col("s").alias(source), "n_tokens")


class Containers:
    """Open containers of one task. An item goes where it leaves the least room (best fit); what is left small is closed."""

    def __init__(self, capacity: int, prefix: str, most_open: int = 256):
        self.capacity, self.prefix, self.most_open = capacity, prefix, most_open
        self.room: list[tuple[int, int]] = []  # (room, number), sorted by room
        self.n = 0

    def put(self, size: int) -> str:
        import bisect

        i = bisect.bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, number = self.room.pop(i)
        else:
            left, number = self.capacity, self.n
            self.n += 1
        if left - size > 0:
            bisect.insort(self.room, (left - size, number))
            if len(self.room) > self.most_open:
                self.room.pop(0)
        return f"{self.prefix}-{number}"


def pack_shard(pdf: pd.DataFrame, capacity: int, quantum: int, prefix: str, target: dict[str, float], carried: dict[str, float]) -> list[tuple]:
    """Rows (key, piece_no, piece_tokens, container_id) of one shard.

    Every source has a queue, longest items first. In each round a source's deficit grows by quantum * its share and
    it may place items while the deficit covers them; what is left of the deficit is carried to the next round, and the
    deficits that earlier shards left (carried) are where a shard begins. When only sources without credit have items,
    rounds go on, so nothing is left out.
    """
    queues: dict[str, deque] = {}
    for s, k, n in pdf.sort_values(["n_tokens", "k"], ascending=[False, True])[["s", "k", "n_tokens"]].itertuples(index=False):
        queues.setdefault(s, deque()).append((k, n))
    order = sorted(queues)
    deficit = {s: carried.get(s, 0.0) for s in order}
    box, out = Containers(capacity, prefix), []
    while order:
        for s in list(order):
            deficit[s] += max(quantum * target.get(s, 0.0), 1.0)
            q = queues[s]
            while q and q[0][1] <= deficit[s]:
                k, n = q.popleft()
                deficit[s] -= n
                left, piece = n, 0
                while left > capacity:
                    out.append((k, piece, capacity, f"{prefix}-full-{len(out)}", n))
                    left, piece = left - capacity, piece + 1
                out.append((k, piece, left, box.put(left), n))
            if not q:
                order.remove(s)
        if order:  # skip the rounds in which no queue could be served
            need = min(math.ceil((queues[s][0][1] - deficit[s]) / max(quantum * target.get(s, 0.0), 1.0)) for s in order)
            if need > 1:
                for s in order:
                    deficit[s] += (need - 1) * max(quantum * target.get(s, 0.0), 1.0)
    return out


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(budget, container_id, key, piece_no, piece_tokens, n_tokens): every document once per budget, whole unless it exceeds the capacity.

    sizes: (key, source, n_tokens); budgets: (budget, capacity_tokens), few rows. weights: target share of each source,
    by default its share of all tokens. A source of weights that has no items takes no part.
    Documents are spread over shards by a hash, so a hot source is spread as well; each shard is packed by one task,
    and starts from the deficits that the shards before it leave by their own totals, so the mixture holds across tasks.
    Empty documents (0 tokens) take part and use no room. A key that occurs again in the input is another item; null
    keys are packed like others. An empty input gives an empty result.
    """
    sizes = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n_tokens"))
    total = sizes.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, math.ceil((total["t"] or 0) / shard_tokens), math.ceil((total["n"] or 0) / 200_000))
    cells = sizes.withColumn("shard", F.pmod(F.xxhash64("k", "n_tokens"), F.lit(shards)).cast("int"))
    # totals by shard and source, and the deficit with which a shard starts; as many rows as shards x sources, joined by shard
    per = cells.groupBy("shard", "s").agg(F.sum("n_tokens").alias("t"))
    if weights is None:
        share = per.groupBy("s").agg((F.sum("t") / F.lit(float(total["t"] or 1))).alias("w"))
    else:
        whole = sum(weights.values()) or 1.0
        share = per.select("s").distinct().withColumn("w", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("s")), F.lit(0.0)) / F.lit(whole))
    # what a shard's predecessors leave of each source: its share of all their tokens less its own tokens among them
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    whole_before = per.groupBy("shard").agg(F.sum("t").alias("all_t")).select("shard", F.coalesce(F.sum("all_t").over(before.orderBy("shard")), F.lit(0)).alias("all_before"))
    mix = per.withColumn("own_before", F.coalesce(F.sum("t").over(before.partitionBy("s").orderBy("shard")), F.lit(0)))
    mix = mix.join(whole_before, "shard").join(share, "s").withColumn("carried", F.col("w") * F.col("all_before") - F.col("own_before"))
    mix = mix.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("w", "carried")))).alias("mix"))
    sought = [(r["budget"], int(r["capacity_tokens"])) for r in budgets.where("capacity_tokens > 0").select("budget", "capacity_tokens").distinct().collect()]  # a handful of rows
    kind = dict(sizes.dtypes)["k"]

    columns = ["budget", "container_id", "k", "piece_no", "piece_tokens", "n_tokens"]

    def run(keys, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left.iloc[:0].assign(budget="", container_id="", piece_no=0, piece_tokens=0)[columns]
        shard = int(left["shard"].iloc[0])
        m = right["mix"].iloc[0]
        m = dict(m) if not isinstance(m, dict) else m
        share = {s: v["w"] for s, v in m.items()}
        carried = {s: v["carried"] for s, v in m.items()}
        parts = [left.iloc[:0].assign(budget="", container_id="", piece_no=0, piece_tokens=0)[columns]]
        for budget, capacity in sought:
            out = pack_shard(left, capacity, capacity, f"{budget}-{shard}", share, carried)
            part = pd.DataFrame(out, columns=["k", "piece_no", "piece_tokens", "container_id", "n_tokens"])
            part["budget"] = budget
            parts.append(part)
        return pd.concat(parts)[columns]

    mix = mix.select(F.col("shard").alias("sh"), "mix")
    packed = cells.groupBy("shard").cogroup(mix.groupBy("sh")).applyInPandas(run, f"budget string, container_id string, k {kind}, piece_no int, piece_tokens long, n_tokens long")
    return packed.withColumnRenamed("k", key)


def found(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(doc_id): documents that the packing for the budget 'large' splits."""
    sizes = cut(token_counts(docs))
    packed = pack(sizes, budgets.where("budget = 'large'"))
    return packed.where("piece_no = 1").select("doc_id").distinct()


def containers(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    return pack(cut(token_counts(docs)), budgets)


