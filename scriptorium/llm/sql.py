"""DuckDB SQL of the queries on word runs and vector codes."""

from __future__ import annotations

# crc32 of an ASCII string, bit by bit (polynomial 0xEDB88320: fixed value)
_BIT = "CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"


def _crc32(text: str) -> str:
    step = "xor(c, b)"
    steps = [f"list_transform([{step}], lambda v0: {_BIT.format(c='v0')})[1]"]
    for k in range(1, 8):
        steps.append(f"list_transform([{steps[-1]}], lambda v{k}: {_BIT.format(c=f'v{k}')})[1]")
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {steps[-1]}), 4294967295)"


RUNS = rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, h // 10 AS g, h % 10 = 0 AND doc_id IS NOT NULL AS chosen, w FROM (
    SELECT doc_id, {_crc32("coalesce(doc_id, 0)::VARCHAR")} AS h,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), e AS (
  SELECT *, g % greatest(len(w), 1) AS a, 1 + (len(w) - g % greatest(len(w), 1)) // (3 + g % 8) AS p FROM t
), d AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN chosen AND len(w) > 0
    THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM e
), grams AS MATERIALIZED (
  SELECT rid, i, hash(w[i+1], w[i+2], w[i+3], w[i+4], w[i+5], w[i+6]) AS gram, len(w) AS n
  FROM (SELECT rid, w, unnest(range(len(w) - 5)) AS i FROM d WHERE len(w) >= 12)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y
  ON x.rid = y.rid AND x.gram = y.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT rid, q, min(i) AS s, count(*) + 5 + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island
), stretches AS MATERIALIZED (
  SELECT * FROM islands WHERE l >= 12 AND l >= 2 * q
), runs AS MATERIALIZED (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)
), dropped AS MATERIALIZED (
  SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT d.rid, string_agg(x.word, ' ' ORDER BY x.i) AS text
  FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM d WHERE rid IN (SELECT rid FROM runs)) x
  JOIN d USING (rid) ANTI JOIN dropped ON dropped.rid = x.rid AND dropped.i = x.i GROUP BY d.rid
), best AS (
  SELECT rid, count(*) AS n_runs, min({{'l': -l, 's': s, 'q': q}}) AS b,
         string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(-b.l AS BIGINT) AS length,
       CAST(b.q AS BIGINT) AS period, CAST(-1000 * b.l // b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, array_to_string(d.w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""


def _codes(rounds: int = 6) -> str:
    ctes = ["""k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT rid, p, v[p * w + 1 : p * w + w] AS x FROM (SELECT rid, v, len(v) // 8 AS w, unnest(range(8)) AS p FROM k)
), b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 16) USING (rid)
)"""]
    distance = "list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, p, min({{'d': {distance}, 'e': e}}) AS m FROM x JOIN b{r} b USING (p) GROUP BY rid, p
)""")
        if r < rounds:
            ctes.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (
        SELECT a.p, a.m.e AS e, unnest(x.x) AS v, unnest(range(len(x.x))) AS i FROM a{r} a JOIN x USING (rid, p))
      GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")
    return f"""WITH {", ".join(ctes)}, f AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', CAST(a.m.e AS BIGINT)), '' ORDER BY a.p) AS code, CAST(sum(a.m.d) AS BIGINT) AS error
  FROM a{rounds} a JOIN k USING (rid) GROUP BY k.rid, k.vec_id, k.label
), h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h
"""


CODES = _codes()
