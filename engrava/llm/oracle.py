"""SQL that gives the same rows, for the queries that SQL can express on whole tables."""

from __future__ import annotations

P8 = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{Nd}]+') AS w FROM eval_items),
     ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw WHERE len(w) >= 13)),
     dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


P4 = """
WITH m AS (SELECT DISTINCT memory_id, entity_id FROM entity_mentions WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL),
     t AS (SELECT count(DISTINCT memory_id) AS n FROM m),
     e AS (SELECT entity_id, count(*) AS n FROM m GROUP BY entity_id),
     p AS (SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS n_ab FROM m a JOIN m b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY 1, 2)
SELECT {columns} FROM p JOIN e ea ON ea.entity_id = entity_a JOIN e eb ON eb.entity_id = entity_b CROSS JOIN t {where}
"""
P4_PAIRS = "entity_a, entity_b, n_ab, ea.n AS n_a, eb.n AS n_b, t.n AS n, round(CAST(n_ab AS DOUBLE) * CAST(t.n AS DOUBLE) / (CAST(ea.n AS DOUBLE) * CAST(eb.n AS DOUBLE)), 6) AS lift"


P1 = """
WITH RECURSIVE r AS (SELECT id, arg_max(embedding, updated_at) AS v FROM memories WHERE id IS NOT NULL AND embedding IS NOT NULL GROUP BY id),
     u AS (SELECT id, CAST(v AS DOUBLE[]) AS v FROM r WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
     l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.8),
     reach(id, r) AS (SELECT id, id FROM u UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r)
SELECT min(r) AS cluster_id, id AS memory_id FROM reach GROUP BY id HAVING count(*) >= 5
"""
P3 = r"""
WITH r AS (SELECT 'memories' AS tbl, id, arg_max(text, updated_at) AS t FROM memories WHERE id IS NOT NULL GROUP BY id
           UNION ALL SELECT 'write_guard_drops', CAST(id AS VARCHAR), arg_max(text_preview, ts) FROM write_guard_drops WHERE id IS NOT NULL GROUP BY id),
     n AS (SELECT tbl, id, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM r WHERE t IS NOT NULL),
     g AS (SELECT tbl, id, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS s FROM n WHERE length(t) >= 40),
     p AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, len(a.s) AS x, len(b.s) AS y, len(list_intersect(a.s, b.s)) AS c FROM g a JOIN g b ON a.tbl = b.tbl AND a.id < b.id AND len(a.s) >= 0.7 * len(b.s) AND len(b.s) >= 0.7 * len(a.s))
SELECT tbl, id_a, id_b FROM p WHERE CAST(c AS DOUBLE) / CAST(x + y - c AS DOUBLE) >= CAST(0.7 AS DOUBLE)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1,
        "p3_found": P3,
        "p4_found": P4.format(columns="entity_a, entity_b", where="WHERE n_ab >= 6 AND n_ab * t.n >= 4 * ea.n * eb.n"),
        "p4_pairs": P4.format(columns=P4_PAIRS, where=""),
        "p4_updated": P4.format(columns=P4_PAIRS, where=""),
        "p8_found": P8,
    }
