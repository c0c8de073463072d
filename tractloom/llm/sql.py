"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

OP3 = r"""
WITH dw AS (
  SELECT doc_id, words, len(words) AS n_words FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)),
bw AS (
  SELECT item_id, words, len(words) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0),
win AS (
  SELECT item_id, least(n, 13) AS size, array_to_string(words[p:p + least(n, 13) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(n - 12, 1) + 1)) AS p FROM bw)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT doc_id, p, size, array_to_string(words[p:p + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, n_words - size + 2)) AS p FROM dw, sizes WHERE n_words >= size)),
hit AS (SELECT DISTINCT doc_id, p, d.size, item_id FROM dwin d JOIN win USING (size, w)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6 = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM said),
r AS (
  SELECT conv_id, perspective, turn, speaker, said, speaker = perspective AS loss,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(speaker, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM conv),
p AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS rendered,
    CAST(coalesce(sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
  FROM r)
SELECT conv_id, perspective, turn, speaker, CASE WHEN loss THEN 'assistant' ELSE 'user' END AS role, CASE WHEN NOT loss THEN speaker END AS name,
  rendered, loss, start_char, start_char + length(head) AS mask_start,
  CASE WHEN loss THEN start_char + length(rendered) - 1 ELSE start_char + length(head) END AS mask_end
FROM p
"""

#: floor(a / b) of integers, which the division operator does not give for negative a.
FLOOR = "CAST(({a} - (({a} % {b}) + {b}) % {b}) // {b} AS BIGINT)"
USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _floor(a: str, b: str) -> str:
    return FLOOR.format(a=a, b=b)


def op12(k: int = 16, rounds: int = 3) -> str:
    """Lloyd rounds, one after the other, over (vector, position) rows."""
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {USABLE}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INT) AS cluster, x FROM v WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {k})"""
    near = """SELECT vec_id, any_value(x) AS x, arg_min(cluster, d) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM (
  SELECT vec_id, v.x, cluster, 32 * CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) + cluster AS k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM v CROSS JOIN {c} c) GROUP BY vec_id"""
    near = near.replace("arg_min(cluster, d)", "arg_min(cluster, k)")
    for r in range(rounds + 1):
        sql += f",\na{r} AS MATERIALIZED ({near.format(c=f'c{r}')})"
        if r < rounds:
            sql += f""",
m{r} AS (SELECT cluster, list(f ORDER BY p) AS x FROM (SELECT cluster, p, {_floor("sum(y)", "count(*)")} AS f FROM (SELECT cluster, unnest(x) AS y, unnest(range(1, 65)) AS p FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (cluster))"""
    return (
        sql
        + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
    )


def op11(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebook rounds over (vector, position) rows; a part has 64 / parts components."""
    w = 64 // parts
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {USABLE}),
q AS MATERIALIZED (SELECT vec_id, p, x[p * {w} + 1:p * {w} + {w}] AS x FROM (SELECT vec_id, x, unnest(range(0, {parts})) AS p FROM v)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, e, x FROM q JOIN first USING (vec_id))"""
    d = " + ".join(f"(q.x[{j}] - c.x[{j}]) * (q.x[{j}] - c.x[{j}])" for j in range(1, w + 1))
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(k) % 256 AS e, min(k) // 256 AS d FROM (SELECT vec_id, p, q.x, 256 * ({d}) + e AS k FROM q JOIN c{r} c USING (p)) GROUP BY vec_id, p)"""
        if r < rounds:
            mean = ", ".join(_floor(f"sum(x[{j}])", "count(*)") for j in range(1, w + 1))
            sql += f""",
m{r} AS (SELECT p, e, [{mean}] AS x FROM a{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (p, e))"""
    return (
        sql
        + f""",
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)"""
    )


ORACLE = {"op6_perspective_rotation": OP6, "op3_benchmark_decontamination": OP3, "op11_vector_codes": op11(), "op12_centroid_clusters": op12()}
