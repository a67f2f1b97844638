"""Operators on hand-made rows: scores, retrieval, state, sources, streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from engrava.functions import score, text
from engrava.operators import lexical, pages, scan, state
from engrava.sources import bundle, transcripts
from engrava.streaming import events

NOW = 1_000_000_000.0
DAY = 86400.0


def one(spark, column, **values):
    names = ", ".join(f"{'NULL' if v is None else repr(v)} AS {k}" for k, v in values.items()) or "1 AS x"
    return spark.sql(f"SELECT {names}").select(column.alias("v")).first()["v"]


def test_scores(spark):
    created = F.lit(NOW - 30 * DAY)
    assert one(spark, score.legacy(F.lit(1.0), created, NOW)) == pytest.approx(0.675)
    null = F.lit(None).cast("double")
    assert one(spark, score.blended(F.lit(1.0), created, F.lit(0), null, F.lit(0), F.lit(0), NOW)) == pytest.approx(0.525)
    assert one(spark, score.feedback(F.lit(0), F.lit(50))) == pytest.approx(-0.5)
    assert one(spark, score.usage(F.lit(100), null, NOW)) == pytest.approx(1.0)
    assert one(spark, score.legacy(F.lit(1.0), F.lit(NOW + DAY), NOW)) == pytest.approx(1.0)
    assert one(spark, score.temporal("current", 1.0, F.lit(NOW), NOW)) == pytest.approx(1.5)
    assert one(spark, score.temporal("any", 0.0, F.lit(NOW), NOW)) == pytest.approx(1.0)


def test_rank_fusion(spark):
    a = spark.createDataFrame([("A", 1), ("C", 2)], "id string, rank int")
    b = spark.createDataFrame([("A", 1), ("B", 2)], "id string, rank int")
    got = {r["id"]: r["rrf"] for r in lexical.fuse([a, b]).collect()}
    assert got["A"] == pytest.approx(2 / 61) and got["A"] > got["B"] == pytest.approx(1 / 62)


def test_bm25(spark):
    d = spark.createDataFrame([("1", "red fox fox"), ("2", "red dog"), ("3", None), ("4", "")], "id string, t string")
    s = {r["id"]: r["score"] for r in lexical.bm25(d, "id", ["t"], ["fox"]).collect()}
    dl, avg = 9.0, (9 + 5 + 0 + 0) / 4
    assert s == {"1": pytest.approx(math.log((4 - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * dl / avg)))}
    assert lexical.bm25(d, "id", ["t"], ["ox"]).isEmpty()
    assert {r["id"] for r in lexical.bm25(d, "id", ["t"], ["ox", "red"]).collect()} == {"1", "2"}


def test_temporal_intent():
    assert lexical.intent_of("what is the current latest plan now") == ("current", 1.0)
    assert lexical.intent_of("现在的方案")[0] == "current"
    assert lexical.intent_of("hello") == ("any", 0.0) == lexical.intent_of("now or next")


def test_vector_top(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id int, v array<float>")
    assert [r["id"] for r in lexical.vector_top(d, "id", "v", [1.0, 0.1], 5).collect()] == [1, 2]


def test_keyset_loses_nothing(spark):
    d = spark.createDataFrame([(float(i // 3), f"k{i}") for i in range(10)], "at double, id string")
    seen, cursor = [], None
    while page := scan.keyset(d, "at", "id", cursor, 4).collect():
        seen += [r["id"] for r in page]
        cursor = (page[-1]["at"], page[-1]["id"])
    assert sorted(seen) == sorted(f"k{i}" for i in range(10)) and len(seen) == 10


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", None, "x1", "fact", 0.1), ("b", "u", "x2", "plan", 0.2)], "agent string, user string, external string, kind string, importance double")
    new = spark.createDataFrame([("a", None, "x1", "episode", 0.9), ("c", None, "x3", "fact", None)], old.schema)
    f = lambda o: state.upsert(o, new, ["agent", "user", "external"], ["kind"], ["importance"])
    once = sorted(map(str, f(old).collect()))
    assert sorted(map(str, f(f(old)).collect())) == once and len(once) == 3
    assert {(r["agent"], r["kind"], r["importance"]) for r in f(old).collect()} == {("a", "fact", 0.9), ("b", "plan", 0.2), ("c", "fact", None)}


def test_guard_order(spark):
    g = lambda t, k, i: one(spark, state.guard(F.lit(t), F.lit(k), F.lit(i)))
    assert [g("short text", "episode", 0.1), g("x" * 40, "episode", 0.1), g("x" * 1300, "fact", 0.9), g("x" * 40, "fact", 0.1), g(None, "fact", 0.5)] == ["too_short", "low_signal", "too_long", "pass", "too_short"]


def test_redact(spark):
    t = "key sk-" + "a" * 30 + " and AKIA" + "B" * 16 + " token = \"" + "0f" * 20 + "\""
    d = spark.createDataFrame([(t,), (None,)], "t string").select(text.redact("t").alias("t"))
    got = d.first()["t"]
    assert "sk-a" not in got and "AKIAB" not in got and "0f0f" not in got
    assert d.select(text.redact("t").alias("t")).first()["t"] == got
    assert one(spark, text.strip_private(F.lit("a <Private>x\ny</PRIVATE> b"))) == "a [private] b"
    assert one(spark, text.clip(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.slugify(F.lit("  Hello, World! 记忆 "))) == "hello-world-记忆"


def test_token_pairs_are_exact(spark):
    import itertools
    import random

    r = random.Random(1)
    sets = {i: frozenset(r.sample(range(14), r.randint(3, 9))) for i in range(40)}
    d = spark.createDataFrame([(i, str(x)) for i, s in sets.items() for x in s], "id int, token string")
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r["a"], r["b"]) for r in pages.token_pairs(d, 0.6).collect()} == want


def test_set_pairs_meet_once(spark, monkeypatch):
    import itertools
    import random

    import numpy as np
    import pyarrow as pa

    from engrava.operators import setpairs

    r = random.Random(3)
    sets = {i: frozenset(r.sample(range(12), r.randint(1, 8))) | ({99} if i % 3 else frozenset()) for i in range(60)}
    want = sorted((a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.45)
    d = spark.createDataFrame([(i, f"t{i}", sorted(map(str, s))) for i, s in sets.items()], "id int, title string, tokens array<string>").select(F.struct("id", "title").alias("who"), "tokens")
    got = setpairs.set_pairs(d, 0.45).collect()
    assert sorted((x["a"]["id"], x["b"]["id"]) for x in got) == want
    assert all(x["b"]["title"] == f"t{x['b']['id']}" and x["size_a"] == len(sets[x["a"]["id"]]) for x in got)
    # in parts: rows that share an element are held together, many others of a row are taken one part after the other
    batch = pa.RecordBatch.from_pydict({"who": pa.array([{"id": i} for i in sets]), "h": pa.array([[hash(x) for x in s] for s in sets.values()], pa.list_(pa.int64()))})
    rows = pa.Table.from_batches(setpairs.spread(np.zeros(setpairs.BUCKETS, dtype=np.uint8), 0.45)(iter([batch]))).sort_by("token")
    monkeypatch.setattr(setpairs, "PAIRS", 3)
    monkeypatch.setattr(setpairs, "ROWS", 10)
    out = [tuple(sorted((x["x"]["id"], x["y"]["id"]))) for b in setpairs.meet(0.45)(iter(rows.to_batches(max_chunksize=7))) for x in b.to_pylist()]
    assert sorted(out) == want


def wiki(spark, tmp_path, texts):
    rows = [(100 + i, t, "wiki", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, doc_kind string, lang string").withColumn("created_at", F.lit("2026-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_contradictions_list_their_partners(spark, tmp_path):
    from engrava.plans import wiki as plans

    sf = wiki(spark, tmp_path, ["# One\n\n> the cache keeps ten rows", "# Two\n\n> the cache keeps nine rows", "# Other\n\n> nothing alike"])
    got = sorted((r["doc_id"], r["title"], r["partner_id"], r["partner_title"], r["partner_summary"], r["score"]) for r in plans.contradiction_list(spark, sf).collect())
    assert got == [(100, "One", 101, "Two", "the cache keeps nine rows", 0.666667), (101, "Two", 100, "One", "the cache keeps ten rows", 0.666667)]


def test_evidence_is_cited_or_recovered(spark):
    p = spark.createDataFrame([("k", 1, "none", ["a", "b", "c", "d", "e"]), ("k", 2, "m4", ["a"]), ("k", 3, "none", ["z"]), ("one", 4, "none", ["z"]), ("no", 5, "none", ["z"])], "k string, doc_id long, cites string, tokens array<string>")
    m = spark.createDataFrame([("k", "m1", "m1", ["a", "b", "c", "d", "e"]), ("k", "m2", "m2", ["a", "b", "c", "y"]), ("k", "m3", "m3", ["a", "b"]), ("k", "m4", "m4", []), ("one", "m5", "m5", ["q"])], "k string, memory_id string, cites string, tokens array<string>")
    got = sorted(tuple(r) for r in pages.recovered(p, m).collect())
    assert got == [(1, "m1", 5, "recovered"), (1, "m2", 3, "recovered"), (2, "m4", 0, "cited"), (4, "m5", 0, "recovered")]
    t = spark.createDataFrame([("The Project uses v1.2 and ab 元数据治理 是",)], "t string").select(text.topic_tokens("t")).first()[0]
    assert sorted(t) == sorted(["uses", "v1.2", "元数据治理", "元数", "数据", "据治", "治理"])


def test_transcripts(spark, tmp_path):
    (tmp_path / "claude").mkdir()
    (tmp_path / "claude/a.jsonl").write_text("\n".join([json.dumps({"type": "user", "sessionId": "s1", "message": {"role": "user", "content": "hello"}, "timestamp": "2024-01-01T00:00:00Z"}), "{broken", json.dumps({"sessionId": "s1", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "x" * 900}]}})]))
    got = sorted(transcripts.read(spark, "claude", str(tmp_path / "claude")).collect(), key=lambda r: r["turn_no"])
    assert [(r["role"], r["text"][:5], len(r["text"])) for r in got] == [("user", "hello", 5), ("assistant", "hi\nxx", 403)] and got[0]["at"] == 1704067200.0
    (tmp_path / "codex").mkdir()
    (tmp_path / "codex/b.jsonl").write_text("\n".join(json.dumps(x) for x in [{"type": "session_meta", "payload": {"id": "c9"}, "timestamp": 1704067200000}, {"type": "response_item", "payload": {"role": "user", "content": "q"}, "timestamp": "1704067201"}, {"type": "agent_message", "payload": {"message": "a"}}]))
    got = transcripts.read(spark, "codex", str(tmp_path / "codex")).orderBy("turn_no").collect()
    assert [(r["session_id"], r["role"], r["text"], r["at"]) for r in got] == [("c9", "user", "q", 1704067201.0), ("c9", "assistant", "a", None)]
    (tmp_path / "md").mkdir()
    (tmp_path / "md/2024-01-05.md").write_text("# Day\ntext")
    assert transcripts.read(spark, "openclaw_daily", str(tmp_path / "md")).first()["at"] == 1704412800.0
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat/c.json").write_text(json.dumps([{"role": "user", "content": "one", "ts": 1.5}, {"role": "assistant", "content": ""}]))
    assert [(r["text"], r["at"]) for r in transcripts.read(spark, "codex_flat", str(tmp_path / "flat")).collect()] == [("one", 1.5)]
    (tmp_path / "claw").mkdir()
    (tmp_path / "claw/d.jsonl").write_text("\n".join(json.dumps(x) for x in [{"type": "session", "id": "w1"}, {"type": "model_change"}, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "hey"}], "timestamp": 1704067200000}}]))
    assert [(r["session_id"], r["text"], r["at"]) for r in transcripts.read(spark, "openclaw", str(tmp_path / "claw")).collect()] == [("w1", "hey", 1704067200.0)]
    (tmp_path / "hist").mkdir()
    (tmp_path / "hist/e.jsonl").write_text("\n".join(json.dumps({"sessionId": s, "display": t}) for s, t in [("x", "1"), ("y", "2"), ("y", "3")]))
    assert {r["session_id"] for r in transcripts.read(spark, "claude_history", str(tmp_path / "hist")).collect()} == {"y"}


def test_bundle_round_trip(spark, tmp_path):
    schema = "id string, agent_id string, external_id string, kind string, text string, importance double"
    m = spark.createDataFrame([("1", "a", None, "fact", "one", 0.5), ("2", None, "e", "plan", "two", 0.6)], schema)
    p = spark.createDataFrame([(1, "T\nx", 0.9), (2, "U", 0.1)], "doc_id int, title string, importance double")
    bundle.export(m.withColumn("embedding", F.lit(None).cast("array<float>")), p, str(tmp_path), least=0.5)
    back = bundle.read(spark, str(tmp_path), schema)
    first = bundle.merge(back.limit(0), back)
    assert sorted(map(str, bundle.merge(first, back).select(*sorted(first.columns)).collect())) == sorted(map(str, first.select(*sorted(first.columns)).collect()))
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/index").collect()] == ["- T x"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 00:04:00"), ("s", "2024-01-01 00:10:00"), ("t", "2024-01-02 00:00:00")]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"session_id": s, "at": a}) for s, a in rows))
    src = events.source(spark, str(tmp_path / "in"), "session_id string, at timestamp")
    events.drain(events.idle_sessions(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["session_id"], r["n"]) for r in got) == [("s", 1), ("s", 2)]  # the last session is still open
    batch = spark.createDataFrame(rows, "session_id string, at string").withColumn("at", F.to_timestamp("at"))
    assert events.idle_sessions(batch, gap="15 minutes").count() == 2
    seen = []
    log = events.source(spark, str(tmp_path / "in"), "session_id string, at timestamp").select(F.col("session_id").alias("memory_id"), F.lit(0.9).alias("vote"), "at")
    events.merge_into(events.counters(log), lambda b, n: seen.extend((r["memory_id"], r["recall_count"]) for r in b.collect()), str(tmp_path / "ck2")).awaitTermination()
    assert sorted(seen) == [("s", 3), ("t", 1)]
    assert events.due(None, None, 10.0, every=5) and not events.due(8.0, None, 10.0, every=5) and events.due(1.0, 5.0, 10.0, quiet=5)


def test_llm_is_optional(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "engrava.llm", None)
    for k in [k for k in sys.modules if k.startswith("engrava.llm.")]:
        monkeypatch.delitem(sys.modules, k)
    assert "score_v2" in e.queries() and not any(n.startswith("p1_") for n in e.queries())
