"""Queries by name with the SQL that gives the same rows, and the common table expressions that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

CTE = {
    "m": "m AS (SELECT * REPLACE (coalesce(importance, CAST(0.5 AS DOUBLE)) AS importance), epoch_us(created_at) / 1e6 AS created, epoch_us(updated_at) / 1e6 AS updated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM memories WHERE id IS NOT NULL) WHERE rn = 1)",
    "s": "s AS (SELECT memory_id, count(*) AS recall_count, count(*) FILTER (weight >= 0.75) AS positive, count(*) FILTER (weight < 0.25) AS negative, max(epoch_us(created_at) / 1e6) AS last_recalled FROM entity_mentions WHERE memory_id IS NOT NULL GROUP BY 1)",
    "ms": "ms AS (SELECT m.*, coalesce(recall_count, 0) AS recall_count, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, last_recalled FROM m LEFT JOIN s ON m.id = s.memory_id)",
    "t": "t AS (SELECT *, epoch_us(created_at) / 1e6 AS created FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC) AS rn FROM turns WHERE turn_id IS NOT NULL) WHERE rn = 1)",
    "d": "d AS (SELECT *, epoch_us(ts) / 1e6 AS at_s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn FROM write_guard_drops WHERE id IS NOT NULL) WHERE rn = 1)",
    "p": "p AS (SELECT doc_id, trim(regexp_extract(text, '^# ([^\\n]*)', 1)) AS title, trim(regexp_extract(text, '\\n> ([^\\n]*)', 1)) AS summary, text AS body, CASE doc_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'codex' WHEN 2 THEN 'codex,claude' ELSE 'hermes' END AS scope, ((doc_id * 53) % 101) / CAST(100 AS DOUBLE) AS importance, epoch_us(created_at) / 1e6 AS created, lang FROM documents WHERE doc_kind = 'wiki' AND text IS NOT NULL)",
    "ev": "ev AS (SELECT p.doc_id, m.id AS memory_id FROM p JOIN m ON substr(md5(CAST(p.doc_id AS VARCHAR)), 1, 3) = substr(m.id, 1, 3))",
}
NEEDS = {"ms": ("m", "s"), "ev": ("m", "p")}


def with_ctes(names: str, body: str) -> str:
    order: list[str] = []
    for n in names.split():
        for x in (*NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    return ("WITH " + ", ".join(CTE[x] for x in order) + " " if order else "") + body


def query(sql: str | None = None, ctes: str = "", name: str | None = None):
    """Register fn(spark, sf_dir) under its name (or name); sql may use the named common table expressions."""

    def add(fn: Callable) -> Callable:
        n = name or fn.__name__
        assert n not in QUERIES, n
        QUERIES[n] = fn
        if sql:
            SQL[n] = with_ctes(ctes, sql)
        return fn

    return add
