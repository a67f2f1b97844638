"""The operators for training data against brute force, exact round trips and held-out texts; and awkward input."""

import itertools
import math
import random

import numpy as np
import pytest

pytest.importorskip("engrava.llm")

from datetime import datetime, timedelta  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from engrava.llm import clusters, common, incremental, leaks, neardup, packing, pairs, pii, queries, residue, vectors  # noqa: E402

T0 = datetime(2025, 1, 1)
WORDS = "cache ledger cursor window parser bundle router filter ticket signal branch worker harbor meadow copper lantern silver anchor river falcon".split()


def sentence(r, n=14):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def edited(r, t):
    w = t.split()
    for _ in range(r.randint(1, 2)):
        i = r.randrange(len(w))
        w[i] = r.choice(WORDS)
    return " ".join(w)


def sets(t):
    t = " ".join(t.lower().split())
    return common.grams(t) if len(t) >= 40 else None


# ---- problem 1 and 5


def cloud(seed=1, groups=12, size=9, alone=60):
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(groups):
        c = rng.standard_normal(64)
        for i in range(size):
            out[f"g{g:02d}-{i:02d}"] = c + rng.standard_normal(64) * 0.25
    for i in range(alone):
        out[f"z{i:03d}"] = rng.standard_normal(64)
    return out


def memories(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(hours=h), None if v is None else [None if x is None else float(x) for x in v], "clash") for i, h, v in rows], "id string, updated_at timestamp, embedding array<float>, n string")


AWKWARD = [("n1", 0, None), ("n2", 0, [1.0] * 3), ("n3", 0, [0.0] * 64), ("n4", 0, [float("nan")] + [1.0] * 63), ("n5", 0, [float("inf")] + [1.0] * 63), ("n6", 0, [None] + [1.0] * 63), (None, 0, [1.0] * 64)]


def brute(vecs, near=0.8):
    ids = sorted(vecs)
    u = np.array([np.asarray(vecs[i], dtype=np.float32) for i in ids]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return ids, np.round(u @ u.T, 6)


def test_clusters_match_brute_force(spark):
    vecs = cloud()
    rows = [(i, 0, v) for i, v in vecs.items()] + [("g00-00", 5, vecs["g00-00"]), ("g00-01", -5, [1.0] * 64)] + AWKWARD
    rows += [(f"copy{i}", 0, vecs["g01-00"]) for i in range(20)]
    got = {(r["cluster_id"], r["memory_id"]) for r in clusters.found(memories(spark, rows)).collect()}
    vecs |= {f"copy{i}": vecs["g01-00"] for i in range(20)}
    ids, c = brute(vecs)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(c >= 0.8)):
        a, b = sorted((find(ids[i]), find(ids[j])))
        root[b] = a
    members = {}
    for i in ids:
        members.setdefault(find(i), []).append(i)
    assert got == {(k, m) for k, ms in members.items() if len(ms) >= 5 for m in ms}
    d = clusters.described(memories(spark, rows)).collect()
    assert {r["cluster_id"] for r in d} == {k for k, _ in got} and all((r["cluster_id"], r["memory_id"]) in got for r in d)
    assert clusters.found(memories(spark, AWKWARD)).isEmpty()
    assert clusters.found(memories(spark, AWKWARD[:0])).isEmpty()


def test_divided_cells_give_the_same_links(spark):
    vecs = cloud(seed=3, size=30)
    m = memories(spark, [(i, 0, x) for i, x in vecs.items()])
    v = vectors.quantised(m).cache()
    mix = clusters.fit(clusters.sample(v), choices=(4,))
    # one level; divided cells with broadcast mixtures and with shuffled ones; tiles of what is still large
    ways = ({"cell": 1 << 20}, {"cell": 120}, {"cell": 120, "model_bytes": 0}, {"cell": 120, "depth": 0}, {"cell": 120, "depth": 1, "model_bytes": 0})
    whole, *others = (sorted(map(tuple, common.components(clusters.linked(v.select("n", "q"), mix, **how).where("sure")).collect())) for how in ways)
    assert others[2] == whole
    for o in others:
        assert len(set(o) & set(whole)) >= 0.97 * len(whole)


def test_leaders_hold_a_dense_cell_together(spark):
    rng = np.random.default_rng(6)
    c = rng.standard_normal(64)
    vecs = {f"d{i:04d}": c + rng.standard_normal(64) * 0.2 for i in range(1500)}  # nearly every pair is linked
    m = memories(spark, [(i, 0, x) for i, x in vecs.items()])
    v = vectors.quantised(m).cache()
    mix = clusters.fit(clusters.sample(v), choices=(1,))
    for how in ({"cell": 100}, {"cell": 100, "model_bytes": 0}):
        roots = [r["root"] for r in common.components(clusters.linked(v.select("n", "q"), mix, **how).where("sure")).collect()]
        assert len(set(roots)) == 1 and len(roots) >= 1490


def test_links_next_to_the_bound_are_exact(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g in range(40):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        o = rng.standard_normal(64)
        o -= (o @ a) * a
        o /= np.linalg.norm(o)
        c = 0.8 + (g - 20) * 1e-6
        rows += [(f"g{g:02d}-{i}", 0, a * (i + 1)) for i in range(4)] + [(f"g{g:02d}-9", 0, c * a + math.sqrt(1 - c * c) * o)]
    vecs = {i: v for i, _, v in rows}
    ids, c = brute(vecs)
    for g in range(40):
        at = [k for k, i in enumerate(ids) if i.startswith(f"g{g:02d}")]
        if max(c[at[-1], k] for k in at[:-1]) >= 0.8:
            want[f"g{g:02d}-0"] = 5
    got = {}
    for r in clusters.found(memories(spark, rows)).collect():
        got[r["cluster_id"]] = got.get(r["cluster_id"], 0) + 1
    assert got == want and 0 < len(want) < 40


def test_neighbours_recall_and_ties(spark):
    vecs = cloud(seed=2, groups=20, size=12, alone=100)
    rows = [(i, 0, v) for i, v in vecs.items()] + AWKWARD + [(f"copy{i:02d}", 0, vecs["g01-00"]) for i in range(15)]
    vecs |= {f"copy{i:02d}": vecs["g01-00"] for i in range(15)}
    ids, c = brute(vecs)
    want = set()
    for i in range(len(ids)):
        c[i, i] = -2
        best = sorted(np.nonzero(c[i] >= 0.8)[0], key=lambda j: (-c[i, j], j))[:5]
        want |= {tuple(sorted((ids[i], ids[j]))) for j in best}
    found = [(r["id_a"], r["id_b"]) for r in vectors.found(memories(spark, rows)).collect()]
    got = set(found)
    assert len(found) == len(got) and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)
    hot = {p for p in want if p[0].startswith("copy") and p[1].startswith("copy")}
    assert len(hot & got) >= 0.9 * len(hot)
    assert vectors.found(memories(spark, AWKWARD)).isEmpty()


def test_leaves_are_stretches_of_the_sorted_arrays(spark):
    vecs = cloud(seed=4, groups=4, size=200, alone=100)
    v = vectors.quantised(memories(spark, [(i, 0, x) for i, x in vecs.items()])).select("n", "q").cache()
    rot = vectors.rotations(2, 5)
    s = vectors.strings(vectors.unpack_directions(v.toPandas()["q"]), rot)
    codes = spark.createDataFrame([(int(x),) for x in s.ravel()], "s long")
    tables = [{r["p"]: (r["leaf"], r["tiles"]) for r in t.collect()} for t in vectors.leaves(codes, 40)]
    assert len(tables) > 2  # prefixes of several lengths
    of = {}
    for x in s.ravel().tolist():
        hit = [(d, t[p]) for d, t in enumerate(tables, start=1) if (p := x >> 2 * (vectors.LATER + 1 - d)) in t]
        assert len(hit) == 1  # every place is in one leaf
        of.setdefault(hit[0][1][0], []).append(x)
    assert all(len(m) <= 80 for m in of.values())
    for tree in (0, 1):
        sizes = [len(m) for m in of.values() if m[0] >> (2 * vectors.LATER + vectors.FIRST_BITS) == tree]
        assert sum(n < 20 for n in sizes) <= 1  # only the rest of a whole tree may be small


def test_recall_with_small_leaves(spark):
    rng = np.random.default_rng(8)
    vecs = {}
    for g in range(3):
        c = rng.standard_normal(64)
        for i in range(200):  # pairs have cosines of about .95 to .8, on both sides of most axes
            vecs[f"g{g}-{i:03d}"] = c + rng.standard_normal(64) * 0.4
    ids, c = brute(vecs)
    np.fill_diagonal(c, -2)
    want = {(a, b) for a in range(len(ids)) for b in sorted(np.nonzero(c[a] >= 0.8)[0], key=lambda j: (-c[a, j], j))[:5]}
    v = vectors.quantised(memories(spark, [(i, 0, x) for i, x in vecs.items()])).cache()
    at = {r["n"]: ids.index(r["id"]) for r in v.collect()}
    recall = lambda **how: len({(at[r["n"]], at[r["other"]]) for r in vectors.neighbours(v.select("n", "q"), **how).collect()} & want) / len(want)
    assert recall() >= 0.999 and recall(leaf=150, trees=8) >= 0.9


def test_recall_does_not_fall_with_the_length_of_prefixes(spark):
    vecs = cloud(seed=9, groups=60, size=20, alone=600)  # leaves of 12 to 24 of 1,800: as far divided as a much larger table
    ids, c = brute(vecs)
    np.fill_diagonal(c, -2)
    want = {(a, b) for a in range(len(ids)) for b in sorted(np.nonzero(c[a] >= 0.8)[0], key=lambda j: (-c[a, j], j))[:5]}
    v = vectors.quantised(memories(spark, [(i, 0, x) for i, x in vecs.items()])).cache()
    at = {r["n"]: ids.index(r["id"]) for r in v.collect()}
    rows = [(at[r["n"]], at[r["other"]]) for r in vectors.neighbours(v.select("n", "q"), leaf=12).collect()]
    assert len(rows) == len(set(rows)) and len(set(rows) & want) >= 0.95 * len(want)


def test_strings_equal_to_their_end_make_tiles(spark):
    rng = np.random.default_rng(3)
    c = rng.standard_normal(64)
    vecs = {f"t{i:03d}": c + rng.standard_normal(64) * 1e-3 for i in range(90)}
    ids, cos = brute(vecs)
    v = vectors.quantised(memories(spark, [(i, 0, x) for i, x in vecs.items()])).select("n", "q").cache()
    rows = vectors.neighbours(v, leaf=20, trees=1).collect()
    assert len(rows) == 5 * 90 and all(r["cosine"] > 0.999 and r["n"] != r["other"] for r in rows)


# ---- problem 2


@pytest.fixture(scope="module")
def field():
    return pii.fit(1200)


def test_held_out_sentences(field):
    hit = total = extra = 0
    for text, spans in pii.made(250, seed=99):
        got = pii.spans_of(text, field)
        for a, b, k in spans:
            total += 1
            # a span made here holds the words that announce a number ('passport no. '), what is found only the number
            hit += any(k == y and min(b, q) - max(a, p) > 0.5 * min(b - a, q - p) for p, q, y in got)
        extra += max(0, len(got) - len(spans))
    assert hit >= 0.97 * total and extra <= 0.03 * total


def test_names_outside_the_lexicon(field):
    """Given names, surnames and sentences that occur neither in the tables nor in the training sentences."""
    for t in ("Reached Okafor, Chinedu by phone (+1 415 555 0113), agreed.", "Applicant CHINEDU OKAFOR, SSN 900-12-3456, call back."):
        assert "Chinedu" not in pii.redacted(t, field) and "CHINEDU" not in pii.redacted(t, field), t
    assert {n.same for n in pii.candidates("OKAFOR, see: Okafor, Chinedu; CHINEDU OKAFOR") if "name" in n.options} == {"okafor"}
    for t in ("We compared Tulsen, Morgat and kel.", "The log says CACHE MISSED for kel."):
        assert pii.redacted(t, field) == t


def test_redaction_changes_nothing_else(spark, field):
    t = "Reached Katya Moldsen by phone (+1 415 555 0113), agreed.\nBuild 3955504606 finished. Clone git@git.tulgim.example:team/x.git, mail lev [at] corp [dot] example."
    assert pii.redacted(t, field) == "Reached [NAME] by phone ([PHONE]), agreed.\nBuild 3955504606 finished. Clone git@git.tulgim.example:team/x.git, mail [EMAIL]."
    long = "filler words here. " * 20_000 + "contact=ulla+shard@corp.fundix.example phone=01.99.00.25.32 job=x"
    rows = spark.createDataFrame([("memories", "1", T0, t), ("memories", "1", T0 + timedelta(1), "no one here"), ("memories", "2", T0, None), ("memories", "3", T0, ""), ("memories", None, T0, t), ("turns", "4", None, long), ("turns", "4", None, long)], "tbl string, rec_id string, version timestamp, text string")
    got = sorted((r["tbl"], r["rec_id"], r["pii_kind"], r["nth"]) for r in pii.occurrences([rows], field).collect())
    assert got == [("turns", "4", "email", 1), ("turns", "4", "phone", 1)]
    back = pii.redact([rows], field).collect()
    assert len(back) == 7 and sum(r["text"] is None for r in back) == 1 and all(r["text"] is None or "555 0113" not in r["text"] for r in back)
    assert pii.occurrences([rows.limit(0)], field).isEmpty()


def test_skip_edges_carry_labels():
    f = pii.Field({("x", "name"): 3.0, ("skip:name", "name"): 2.0, ("skip:O", "O"): 2.0, ("y", "O"): 0.5})
    a, m, b = pii.Node(0, 1, ("name",), ["x"], "s"), pii.Node(2, 3, ("phone", "id_number"), [], "7"), pii.Node(4, 5, ("name",), ["y"], "s")
    assert f.labels([a, m, b])[0] == f.labels([a, m, b])[2] == "name" and f.labels([b]) == ["O"]


# ---- problem 3 and 6


def copies(seed=5, n=60):
    r = random.Random(seed)
    base = [sentence(r) for _ in range(n)]
    rows = [(f"m{i:04d}", t) for i, t in enumerate(base)]
    rows += [(f"e{i:04d}", edited(r, r.choice(base))) for i in range(n)]
    rows += [(f"s{i:02d}", base[0]) for i in range(12)] + [("short", "too short"), ("empty", ""), ("null", None), ("long", "x y z " * 30_000), ("long2", "x  Y z " * 30_000)]
    return rows


def test_near_copies_match_brute_force(spark):
    rows = copies()
    d = spark.createDataFrame([("t", i, T0, t) for i, t in rows] + [("t", "m0001", T0 + timedelta(1), rows[1][1]), ("t", None, T0, rows[0][1])], "tbl string, id string, version timestamp, text string")
    s = {i: g for i, t in rows if t and (g := sets(t))}
    want = {("t", a, b) for a, b in itertools.combinations(sorted(s), 2) if common.jaccard(s[a], s[b]) >= 0.7}
    found = [(r["tbl"], r["id_a"], r["id_b"]) for r in neardup.links([d]).collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.99 * len(want)
    per = {r["id"]: r["n_links"] for r in neardup.groups([d]).collect()}
    assert per == {i: sum(i in p[1:] for p in found) for p in found for i in p[1:]}
    assert neardup.links([d.limit(0)]).isEmpty()


def test_signatures_within_the_guaranteed_distance_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 256, size=(1, neardup.CHUNKS * neardup.WIDTH), dtype=np.uint32)
        b = a.copy()
        b[0, rng.choice(a.shape[1], size=neardup.CHUNKS - 1, replace=False)] ^= np.uint32(1)
        assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any()
        assert not set(neardup.chunk_keys(a)[0][:1]) & set(neardup.chunk_keys(a)[0][1:])


def test_chunks_with_one_error_meet():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a = rng.integers(0, 1 << 16, size=(1, neardup.CHUNKS * neardup.WIDTH), dtype=np.uint32)
        b = a.copy()  # an error in every chunk, two in all but one
        for chunk in range(neardup.CHUNKS):
            b[0, chunk * neardup.WIDTH + rng.choice(neardup.WIDTH, size=2 if chunk else 1, replace=False)] ^= np.uint32(1)
        assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).sum() == 1


def test_pairs_next_to_the_threshold_are_found(spark):
    r = random.Random(12)
    rows = []
    while len(rows) < 1600:  # pairs with similarities of 0.70 to 0.72
        t = sentence(r, 24).split()
        u = [r.choice(WORDS) + str(r.randint(0, 99)) if i % 6 == 0 else w for i, w in enumerate(t)]
        t, u = " ".join(t), " ".join(u)
        if 0.7 <= common.jaccard(common.grams(t), common.grams(u)) <= 0.72:
            rows += [(f"a{len(rows):04d}", t), (f"b{len(rows):04d}", u)]
    d = spark.createDataFrame([("t", i, T0, t) for i, t in rows], "tbl string, id string, version timestamp, text string")
    found = {(x["id_a"][1:], x["id_b"][1:]) for x in neardup.links([d]).collect()}
    assert len({p for p in found if p[0] == p[1]}) >= 799  # 788 of 800 when chunks must agree as a whole


def test_halves_that_meet_are_the_chunks_with_one_error():
    """Against all pairs: each is given once for each chunk with one error at most, if it is within RADIUS and of one table."""
    r = random.Random(14)
    texts = [t for i, t in copies(seed=14) if t and len(t) > 40 and not i.startswith(("s", "l"))]
    texts = list(dict.fromkeys(texts + [edited(r, edited(r, t)) for t in texts]))
    m = common.minhash(texts, neardup.CARRIED)
    carry = list(neardup.carried(m).values())
    tables = np.arange(len(texts)) % 5 // 4
    h = neardup.halves(m[:, : neardup.CHUNKS * neardup.WIDTH], tables)
    assert h.shape == (len(texts), 2 * neardup.CHUNKS) and (h >= 0).all()
    keys = neardup.chunk_keys(m[:, : neardup.CHUNKS * neardup.WIDTH] & np.uint32((1 << neardup.BITS) - 1)).reshape(len(texts), neardup.CHUNKS, neardup.WIDTH)
    nibbles = (m[:, : neardup.CARRIED] >> np.uint32(8)) & np.uint32(0xF)
    want = {}
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = int((keys[a] == keys[b]).any(axis=1).sum())
        if n and tables[a] == tables[b] and (nibbles[a] != nibbles[b]).sum() <= neardup.RADIUS:
            want[a, b] = n
    rows, order = np.repeat(np.arange(len(texts)), h.shape[1]), np.argsort(h.ravel())
    batch = neardup.pa.RecordBatch.from_arrays([neardup.pa.array(x[order]) for x in (h.ravel(), rows, *(c[rows] for c in carry))], names=["h", "cid", "s0", "s1", "s2"])
    for size, held in ((len(batch), neardup.ROWS), (37, 50)):  # at once, and in batches that divide halves
        before, neardup.ROWS = neardup.ROWS, held
        try:
            out = list(neardup.candidates(iter([batch.slice(i, size) for i in range(0, len(batch), size)] + [batch.slice(0, 0)])))
        finally:
            neardup.ROWS = before
        found = [p for x in out for p in zip(x["cid_a"].to_pylist(), x["cid_b"].to_pylist())]
        assert {p: found.count(p) for p in set(found)} == want and len(want) > 100


def test_near_copies_in_different_tables_are_no_pairs(spark):
    r = random.Random(16)
    rows = []
    for i in range(40):
        t = sentence(r)
        rows += [("d", f"a{i:02d}", t), ("d", f"b{i:02d}", edited(r, t)), ("f", f"c{i:02d}", t), ("f", f"e{i:02d}", edited(r, t))]
    s = {(tbl, i): sets(t) for tbl, i, t in rows}
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(s), 2) if a[0] == b[0] and common.jaccard(s[a], s[b]) >= 0.7}
    frames = [spark.createDataFrame([(tbl, i, T0, t) for tbl, i, t in rows if tbl == name], "tbl string, id string, version timestamp, text string") for name in "df"]
    assert neardup.zlib.crc32(b"d") & 3 == neardup.zlib.crc32(b"f") & 3  # their halves meet
    found = [(x["tbl"], x["id_a"], x["id_b"]) for x in neardup.links(frames).collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.97 * len(want) > 10


def test_near_copies_shuffle_few_bytes_a_text(spark):
    r = random.Random(15)
    rows = [(f"a{i:04d}", sentence(r)) for i in range(2000)]
    d = spark.createDataFrame([("t", i, T0, t) for i, t in rows], "tbl string, id string, version timestamp, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    set_ = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # so many that rows of a text are not next to each other
    before = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        bus.waitUntilEmpty()
        written = store.executorSummary("driver").totalShuffleWrite()
        neardup.links([d]).count()
        bus.waitUntilEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (store.executorSummary("driver").totalShuffleWrite() - written) / len(rows) < 1100  # 1,625 when each text had 40 rows of keys, 992 now


def test_batches_follow_the_order_of_arrival(spark):
    rows = [(i, t) for i, t in copies(seed=7) if t]
    r = random.Random(8)
    items, n = [], 100
    for b in range(1, 4):
        for _ in range(25):
            kind = r.random()
            t = edited(r, r.choice(rows)[1]) if kind < 0.4 else edited(r, r.choice(items)[2]) if kind < 0.7 and items else r.choice(items)[2] if kind < 0.8 and items else sentence(r)
            items.append((n, b, t[:4000]))
            n += 1
    items += [(n, 3, None), (n + 1, 3, ""), (n + 2, 3, "short")]
    accepted = {i: g for i, t in rows if (g := sets(t))}
    want = {}
    for i, _, t in items:
        g = sets(t or "")
        if not g:
            continue
        like = [(-common.jaccard(g, h), k) for k, h in accepted.items()]
        best = min((x for x in like if -x[0] >= 0.7), default=None)
        if best:
            want[i] = best[1]
        else:
            accepted[str(i)] = g
    m = spark.createDataFrame([(i, T0, t, "x") for i, t in rows], "id string, updated_at timestamp, text string, cid string")
    inc = spark.createDataFrame([*items, items[0], (None, 1, "x"), (999, None, "y")], "item_id long, batch_no int, text string")
    found = incremental.found(m, inc).collect()
    got = {r["item_id"]: r["matched_id"] for r in found}
    assert len(found) == len(got) and len(set(got.items()) & set(want.items())) >= 0.97 * len(want) and len(set(got) - set(want)) <= 0.03 * len(want)
    assert incremental.found(m, inc.limit(0)).isEmpty()
    assert not incremental.found(m.limit(0), inc).isEmpty()


def test_a_batch_reads_a_bounded_part_of_any_history(spark):
    r = random.Random(3)
    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(90)).strip() + "xyz"
    new = [(i, f"{letters()} {letters()}") for i in range(3)]
    assert common.jaccard(sets(new[0][1]), sets(new[0][1][:-6] + "qjqvqz")) >= 0.9
    read = {}
    for n in (400, 4000):
        m = spark.createDataFrame([(f"m{i:05d}", T0, letters()) for i in range(n)] + [("z", T0, new[0][1][:-6] + "qjqvqz")], "id string, updated_at timestamp, text string")
        runs = incremental.history_of(m, a_range=256, a_part=64)
        b = common.cut(spark.createDataFrame(new, "item_id long, t string"))
        signed = b.select(F.col("item_id").alias("cid"), "t").mapInPandas(incremental.sign, incremental.SIGNED)
        keys = {int(k) for row in signed.select("keys").collect() for k in row["keys"]}
        number, _, bits, _ = runs.runs[0]
        wanted = {k >> (incremental.BITS - bits) for k in keys}
        read[n] = spark.read.parquet(f"{runs.path}/entries/run={number}").where(F.col("range").isin(sorted(wanted))).count()
        assert [x["matched_id"] for x in incremental.batch(runs, b).collect()] == ["z"]
        runs.close()
    assert max(read.values()) <= 3 * incremental.KEYS * 256 * 1.5 and read[4000] < 12 * 4000 / 3


def test_texts_of_history_are_shuffled_once(spark):
    rows = [("a", T0, "one " * 20), ("b", T0, "one " * 20), ("c", T0, "two " * 20), ("c", T0 + timedelta(1), "six " * 20), ("d", T0, None), (None, T0, "ten " * 20)]
    m = spark.createDataFrame(rows, "id string, updated_at timestamp, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = incremental.different(m)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["t"][:3], r["rec"]) for r in d.collect()) == [("one", "a"), ("six", "c")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3  # records by id, their keys, and texts by their keys


def test_runs_are_merged(spark):
    r = random.Random(4)
    texts = [sentence(r) for _ in range(120)]
    m = spark.createDataFrame([(f"m{i:05d}", T0, t) for i, t in enumerate(texts[:60])], "id string, updated_at timestamp, text string")
    runs = incremental.history_of(m, a_range=64, a_part=16)
    for b in range(6):
        incremental.batch(runs, common.cut(spark.createDataFrame([(100 * b + i, t) for i, t in enumerate(texts[60 + 10 * b : 70 + 10 * b])], "item_id long, t string")))
        assert len(runs.runs) <= incremental.COMPACT + 1
    assert sum(x[1] for x in runs.runs) >= 115 and runs.runs[0][1] > 60  # the first run has grown
    last = common.cut(spark.createDataFrame([(999, texts[65]), (1000, texts[5])], "item_id long, t string"))
    assert {x["item_id"]: x["matched_id"] for x in incremental.batch(runs, last).collect()} == {999: "5", 1000: "m00005"}
    runs.close()


def test_a_batch_takes_few_jobs_of_the_driver(spark):
    r = random.Random(6)
    texts = [sentence(r) for _ in range(260)]
    m = spark.createDataFrame([(f"m{i:05d}", T0, t) for i, t in enumerate(texts[:200])], "id string, updated_at timestamp, text string")
    runs = incremental.history_of(m, a_range=64, a_part=16)  # in 48 folders, which are listed by a job
    items = [texts[200], texts[3], texts[200], texts[201], texts[200] + " end", texts[202], texts[202] + " end", texts[202]]
    jobs = []
    for b in range(2):
        spark.sparkContext.setJobGroup(f"batch {b}", "")
        rows = common.cut(spark.createDataFrame([(100 * b + i, t) for i, t in enumerate(items)], "item_id long, t string"))
        got = {x["item_id"] % 100: x["matched_id"] for x in incremental.batch(runs, rows).collect()}
        want = {1: "m00003", 2: "0", 4: "0", 6: "5", 7: "5"}
        assert got == (want | {0: "0", 3: "3", 5: "5"} if b else want)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {b}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    runs.close()
    assert max(jobs) <= 50, jobs


def test_rounds_decide_as_one_task(spark, monkeypatch):
    r = random.Random(5)
    links = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(120)}, key=lambda x: x[1])
    dup = set()
    for a, b in links:
        if a not in dup:
            dup.add(b)
    df = spark.createDataFrame(links, "a long, b long")
    for most in (incremental.ONE_TASK, 30, 0):
        monkeypatch.setattr(incremental, "ONE_TASK", most)
        assert sorted(x["first"] for x in incremental.duplicates(df).collect()) == sorted(dup)
    assert incremental.duplicates(df.limit(0)) is None


# ---- problem 4


def test_updates_equal_a_new_count(spark):
    r = random.Random(1)
    m = [(f"b{r.randint(0, 40)}", f"i{int(r.random() ** 2 * 12)}") for _ in range(300)]
    d = lambda rows: spark.createDataFrame(rows, "memory_id string, entity_id string")
    t = pairs.table_of(d(m + m[:50] + [(None, "i1"), ("b1", None)]), batches=3)
    changed = [("b1", "i0"), ("b1", "i99"), ("b2", "i0"), ("new", "i0"), ("new", "i1"), ("b3", None)]
    t.update(d(changed).select(F.col("memory_id").alias("basket"), F.col("entity_id").alias("item")))
    gone = {b for b, _ in changed}
    after = [x for x in m if x[0] not in gone] + [x for x in changed if x[1]]
    again = pairs.table_of(d(after))
    assert sorted(map(str, t.scores().collect())) == sorted(map(str, again.scores().collect()))
    some = t.scores(items=t.touched)
    assert 0 < some.count() <= t.scores().count()
    assert pairs.found(d(m[:0])).isEmpty()


def test_rescored_pairs_equal_a_new_count(spark, sf):
    d = lambda rows: spark.createDataFrame(rows, "memory_id string, entity_id string")
    rows = [("b1", "x"), ("b1", "y"), ("b2", "z"), ("b2", "y"), ("b3", "x"), ("b3", "y"), ("b3", "z"), ("b4", "v"), ("b4", "w")]
    scored = lambda f: {(r["entity_a"], r["entity_b"]): r for r in f.collect()}
    for changed, gone in (
        ([("b1", "x"), ("b1", "w"), ("b4", "v"), ("b4", "y")], {("v", "w")}),  # y and w change baskets: no marginal changes
        ([("b1", "z"), ("b1", "y"), ("b2", "x"), ("b2", "y"), ("b2", "v")], set()),
        ([("b1", "y"), ("b1", "x"), ("b5", "x")], set()),  # one basket more
        ([("b4", None)], {("v", "w")}),  # one basket fewer
    ):
        t = pairs.table_of(d(rows))
        before = scored(t.scores())
        t.update(d(changed).select(F.col("memory_id").alias("basket"), F.col("entity_id").alias("item")))
        after = [x for x in rows if x[0] not in {b for b, _ in changed}] + [x for x in changed if x[1]]
        want = scored(pairs.table_of(d(after)).scores())
        got = scored(t.scores(items=t.touched))
        assert {(r["a"], r["b"]) for r in t.gone.collect()} == gone == before.keys() - want.keys()
        assert {k: r for k, r in before.items() if k not in gone} | got == want
    t = pairs.table_of(d(rows))
    t.update(d([("b1", "z"), ("b1", "y"), ("b2", "x"), ("b2", "y")]).select(F.col("memory_id").alias("basket"), F.col("entity_id").alias("item")))
    assert {r["item"] for r in t.touched.collect()} == set()  # the same pairs in other baskets: nothing to score again
    q = queries.queries()
    assert sorted(map(str, q["p4_updated"](spark, sf).collect())) == sorted(map(str, q["p4_pairs"](spark, sf).collect()))


def test_an_update_rewrites_its_buckets_only(spark):
    d = lambda rows: spark.createDataFrame(rows, "basket string, item string")
    t = pairs.PairTable(spark, buckets=64)
    t.update(d([(f"b{i}", f"i{j}") for i in range(40) for j in range(i % 7 + 2)]))
    before = {k: dict(v) for k, v in t.at.items()}
    t.update(d([("b1", "i0"), ("b1", "i1")]))
    changed = {k: {b for b in t.at[k].keys() | before[k].keys() if t.at[k].get(b) != before[k].get(b)} for k in t.at}
    assert len(changed["baskets"]) == 1 and len(changed["items"]) == 1 and len(changed["pairs"]) <= 2
    t.close()


def test_a_hot_basket_is_split(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 900)).alias("basket"), F.concat(F.lit("i"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("item"), F.lit(1).cast("long").alias("sign")).distinct()
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = pairs.pair_deltas(common.cut(rows.repartition(8)))
        assert df.count() > 1_000_000
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


# ---- problem 7


@pytest.mark.skipif(not __import__("os").path.exists(packing.TOKENIZERS), reason="no tokenizers")
def test_every_document_once(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([3, 50, 400]))), r.choice(["hot", "hot", "hot", "a", None])) for i in range(200)]
    docs += [(900, None, "a"), (901, "", "a"), (902, "word " * 9000, "hot"), (902, "word " * 9000, "hot")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    budgets = spark.createDataFrame([("small", 512), ("large", 8192)], "budget string, capacity_tokens long")
    sizes = packing.token_counts(d).cache()
    p = packing.pack(sizes, budgets, shard_tokens=20_000).cache()
    size = {x["doc_id"]: x["n_tokens"] for x in sizes.collect()}
    for budget, cap in (("small", 512), ("large", 8192)):
        rows = p.where(F.col("budget") == budget).collect()
        used, pieces = {}, {}
        for x in rows:
            used[x["container_id"]] = used.get(x["container_id"], 0) + x["piece_tokens"]
            pieces.setdefault(x["doc_id"], []).append(x)
        assert max(used.values()) <= cap and set(pieces) == set(size)
        for k, xs in pieces.items():
            times = 2 if k == 902 else 1
            assert sum(x["piece_tokens"] for x in xs) == times * size[k] and (len(xs) == times or size[k] > cap)
        filled = sorted(used.values())
        assert sum(filled) >= 0.8 * cap * (len(filled) - 12)
    assert packing.found(d, budgets).collect() == [] if size[902] <= 8192 else [x[0] for x in packing.found(d, budgets).collect()] == [902]
    assert packing.pack(sizes.limit(0), budgets).isEmpty()


def test_round_robin_keeps_the_mixture():
    import pandas as pd

    pdf = pd.DataFrame({"s": ["a"] * 300 + ["b"] * 300, "k": range(600), "n_tokens": [100] * 600})
    out = packing.pack_shard(pdf, 1000, 1000, "x", {"a": 0.5, "b": 0.5}, {})
    first = [k < 300 for k, *_ in out[:100]]
    assert 40 <= sum(first) <= 60 and len(out) == 600


# ---- problem 8


def test_leaks_match_brute_force(spark):
    r = random.Random(4)
    items = [(f"ev{i}", sentence(r, 40)) for i in range(12)] + [("tiny", "one two three"), ("null", None), ("same", None)]
    items[-1] = ("same", items[0][1])
    docs = []
    for i in range(80):
        w = sentence(r, 60).split()
        if i % 3:
            p = r.choice(items[:12])[1].split()
            k, n = r.randint(0, 20), r.choice([11, 12, 13, 14, 20])
            w[10:10] = [x.upper() + r.choice([",", "", " -- "]) for x in p[k : k + n]]
        docs.append((i, r.choice([" ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "é " * 50_000 + items[3][1]), (102, "é " * 50_000 + items[3][1]), (103, "x" * 300_000)]
    words = lambda t: leaks.WORD.findall(t.lower())
    grams = lambda t: {tuple(w[i : i + 13]) for w in [words(t)] for i in range(len(w) - 12)}
    ig = {i: grams(p) for i, p in items if p}
    want = {(d, i) for d, t in docs if t for g in [grams(t)] for i in ig if g & ig[i]}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id string, passage string")
    found = [(x["doc_id"], x["item_id"]) for x in leaks.leaks(d, it).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want
    assert leaks.leaks(d.limit(0), it).isEmpty() and leaks.leaks(d, it.limit(0)).isEmpty()


def test_word_hashes_do_not_depend_on_place():
    a, _, _ = leaks.word_hashes("alpha beta gamma")
    b, _, _ = leaks.word_hashes("x" * (leaks.CHUNK - 3) + " beta " + "y" * leaks.CHUNK + " gamma alpha")
    assert b[1] == a[1] and b[3] == a[2] and b[4] == a[0]


def test_fingerprints_within_the_radius_meet():
    ix = leaks.Passages([("a", sentence(random.Random(6), 60))])
    rng = np.random.default_rng(1)
    for p in ix.prints[:30]:
        q = p
        for b in rng.choice(64, size=leaks.RADIUS, replace=False):
            q ^= np.uint64(1 << int(b))
        assert len(ix.candidates(np.array([q]))[0])


# ---- problem 9

GOOD = [
    'In the template we write `{{ title }}` and src/a/b.py fills it before the page is stored.',
    "A lint rule of kox-mur rejects notes that still hold [INSERT NAME HERE] or similar marks",
    "Users who open a deleted note get the 404 page from fix-dang, which links to the search.",
    "The viewer shows a notice asking people to enable JavaScript; pal-pon now renders without it.",
    "We removed the lorem ipsum filler from the sample pages of vux-vur before the demo",
    '```\nbody = "Hello ${USER}"\n```\nThe snippet above shows how values are filled.',
    "", "   \n ", "An ordinary note about the cache that nobody reads.", "x" * 100_000,
]
BAD = [
    "Please enable JavaScript to view this dashboard.", "404\nThe wiki page you asked for does not exist or was moved.", "# Page\n\n## Next steps\nDapibus sapien magna dolor velit mattis libero urna lorem.",
    "Hello [Your summary goes here],\n\nyour report for {{ owner }} is ready.", "Decision: <enter root cause>", "foo bar baz foo bar Content coming soon.", "An ordinary note.\n\n- Owner\n(fill in owner)", "Error 500: 访问被拒绝", "veuillez  activer  javascript  pour continuer.",
    "An ordinary note about the cache. " * 3000 + "\nSlow down and retry in 214 seconds.",
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(GOOD)] + [(100 + i, t) for i, t in enumerate(BAD)] + [(200, None), (100, BAD[0])]
    rows += [(300 + i, sentence(random.Random(i))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    assert {r["doc_id"] for r in residue.found(d).collect()} == {100 + i for i in range(len(BAD))}
    assert residue.scores(d).count() == len(BAD) + 1
    assert residue.found(d.limit(0)).isEmpty()


UNSEEN = [
    "Dear [customer_name], thank you.", "Dear <recipient>,", "Hi {{ user-name }}!", "Total: {{ x|default }}", "{{#each items}}", "Path ${a:b}", "Owner: %NAME%", "Sent to {{ " + "very_long_" * 8 + "name }}.",
    "An ordinary note.\n\nPlease enable JavaScript to\nview this dashboard.", "```\nx = 1\n\nReport of {{ owner }} is ready.",
]
INTACT = ["It was long [cut] and odd [sic].", "See [docs](http://a.example) and arr[index] for more.", "- [x] done", "It grew by 5% and then 7% more.", "<b>bold</b> and List<String> stay.", "We enable\nthe cache in the dashboard.", "```\na\n\nHello {{ owner }}\n```\nfine"]


def test_residue_of_other_names_and_layouts(spark):
    rows = [(i, t) for i, t in enumerate(INTACT)] + [(100 + i, t) for i, t in enumerate(UNSEEN)] + [(300 + i, sentence(random.Random(i))) for i in range(200)]
    got = {r["doc_id"] for r in residue.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100 + i for i in range(len(UNSEEN))}


# ---- shared


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(100)] + [(7, 7), (None, 3)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {tuple(x) for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, find(n)) for n in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()
