"""The client's verbs, near-copy vectors and pluggable functions."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from engrava.operators import nearvec
from engrava.plans import wiki
from engrava.store import Store

NOW = 1_700_000_000.0


def test_verbs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.memories(NOW).isEmpty()
    rows = spark.createDataFrame([("fact", "The staging cache lives in Frankfurt since May", 0.8, "a"), ("fact", "ok", 0.9, "a"), ("plan", "Move the cache to Dublin before the winter freeze", 0.4, None)], "kind string, text string, importance double, agent_id string")
    assert [r["verdict"] for r in s.remember(rows, NOW).collect()] == ["too_short"]
    s.remember(rows, NOW + 10)  # the same again: nothing new
    m = s.memories(NOW + 20)
    assert m.count() == 2 and {r["created"] for r in m.collect()} == {NOW} and s.memories(NOW, agent="b").count() == 1
    hits = s.recall("where does the cache live now", NOW + 20)
    assert hits.count() == 2 and hits.columns == ["id", "text", "hit"]
    before = m.where("kind = 'plan'").first()
    s.feedback(m.where("kind = 'plan'").select("id"), 1, NOW + 30)
    s.used(m.where("kind = 'plan'").select("id"), NOW + 30)
    after = s.memories(NOW + 20).where("kind = 'plan'").first()
    assert after["score"] > before["score"] and (after["recall_count"], after["positive"]) == (1, 1)
    s.forget(m.where("kind = 'plan'").select("id"))
    assert [r["kind"] for r in s.list(NOW + 40).collect()] == ["fact"]


def test_losers(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for g in range(30):
        c = rng.standard_normal(64)
        for i in range(4):
            rows.append((f"g{g:02d}-{i}", "fact", float(i) / 10, [float(x) for x in c + rng.standard_normal(64) * 0.1]))
            want |= {f"g{g:02d}-{i}"} if i < 3 else set()
    rows += [("copy1", "fact", 0.1, rows[3][3]), ("copy2", "plan", 0.1, rows[3][3]), ("alone", "fact", None, [1.0] * 64)]
    got = {r["id"]: r["kept_id"] for r in nearvec.losers(spark.createDataFrame(rows, "id string, kind string, importance double, embedding array<float>")).collect()}
    assert set(got) == want | {"copy1"} and got["copy1"] == "g00-3"


def test_losers_misses_none(spark):
    """Pairs just above and below the threshold, ties of importance, in tiles: as all pairs compared."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(300):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for i, cos in enumerate((1.0, 0.922, 0.918)):
            v = cos * a + np.sqrt(1 - cos * cos) * b * (1 if i == 1 else -1)
            rows.append((f"{(g * 7919 + i * 31) % 1000:03d}-{g}-{i}", None if g % 5 == 0 else "fact", float(g % 3) / 10 if i else 0.1, [float(x) for x in v]))
    x = np.array([r[3] for r in rows], dtype=np.float32).astype(np.float64)
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = {}
    for i, r in enumerate(rows):
        before = [(-o[2], o[0]) for j, o in enumerate(rows) if cos[i, j] >= 0.92 and o[1] == r[1] and (-o[2], o[0]) < (-r[2], r[0])]
        if before:
            want[r[0]] = min(before)[1]
    d = spark.createDataFrame(rows, "id string, kind string, importance double, embedding array<float>")
    assert len(want) >= 300
    assert {r["id"]: r["kept_id"] for r in nearvec.losers(d, tile=100).collect()} == want


def lone(rng, n):
    return [[float(x) for x in v] for v in rng.standard_normal((n, 64))]


def test_dedupe_crosses_sessions_and_batches(spark, tmp_path):
    """More than 300 rows of one session and kind; near copies far apart in importance, in other sessions and without one; a chain."""
    rng = np.random.default_rng(3)
    base = lone(rng, 400)
    copy = lambda v: [float(x) for x in np.asarray(v) + rng.standard_normal(64) * 0.1]
    rows = [(f"a{i:03d}", "s", "fact", 0.9 - i / 1000, v) for i, v in enumerate(base)]
    rows += [("far", "s", "fact", 0.01, copy(base[0])), ("other", "t", "fact", 0.01, copy(base[1])), ("none", None, "fact", 0.01, copy(base[2]))]
    rows += [("only", None, "fact", 0.5, [1.0] * 64), ("kind", "s", "plan", 0.01, copy(base[0])), ("null", "s", "fact", None, copy(base[3])), ("tie", "t", "fact", 0.9, base[0])]
    a, b = np.eye(64)[0], np.eye(64)[1]
    turn = lambda d: [float(x) for x in np.cos(np.radians(d)) * a + np.sin(np.radians(d)) * b]
    rows += [(f"chain{d}", "s", "step", 1 - d / 100, turn(d)) for d in (0, 25, 50, 75)]  # each near the one before only
    m = spark.createDataFrame([(*r, datetime(2026, 1, 1)) for r in rows], "id string, session_id string, kind string, importance double, embedding array<float>, updated_at timestamp").withColumn("created_at", F.col("updated_at"))
    m.write.parquet(f"{tmp_path}/memories.parquet")
    u = np.array([r[4] for r in rows], dtype=np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rank = [(-(r[3] or 0.0), r[0]) for r in rows]
    near = u @ u.T >= 0.85
    want = {r[0] for i, r in enumerate(rows) if not any(near[i, j] and rows[j][2] == r[2] and rank[j] < rank[i] for j in range(len(rows)))}
    got = [r["id"] for r in wiki.stage0_dedupe(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {"only", "kind", "chain0"} <= want and not want & {"far", "other", "none", "null", "tie", "chain25", "chain50", "chain75"}
    v = m.select("id", "kind", "importance", "embedding")
    assert {r["id"] for r in nearvec.survivors(v, tile=50).collect()} == want
    g = {r["id"]: (r["session_id"], r["group_no"]) for r in wiki.clusters(spark, str(tmp_path)).collect()}
    assert set(g) == {r[0] for r in rows} and g["chain0"] == g["chain25"] and g["none"][0] is None
    plain, means = {}, []
    for r in sorted((r for r in rows if r[1] == "s"), key=lambda r: (-(r[3] or 0.0), r[0])):  # the loop as it stands in the survey
        x = np.asarray(r[4], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x)
        k = next((k for k, (c, n) in enumerate(means) if n < 15 and float(c @ x) >= 0.35), len(means))
        means[k:k + 1] = [((means[k][0] * means[k][1] + x) / (means[k][1] + 1), means[k][1] + 1) if k < len(means) else (x, 1)]
        plain[r[0]] = k
    assert {i: n for i, (s, n) in g.items() if s == "s"} == plain


def test_pluggable(spark):
    d = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [list(r["embedding"]) for r in nearvec.embed(d, "t", lambda ts: [[float(len(t))] for t in ts]).collect()] == [[2.0], [0.0]]
    assert [r["answer"] for r in nearvec.apply_model(d, "t", lambda ts: [t.upper() for t in ts]).collect()] == ["AB", ""]
    assert [r["answer"] for r in nearvec.apply_model(d.select(F.lit("x").alias("t")), "t", lambda ts: 1 / 0).collect()] == ["", ""]
