"""SQL for DuckDB of those queries that SQL can say."""

from __future__ import annotations

from .urlfilter import DAMPING, DISTRUST_RATIO, LEAST_DISTRUST, ROUNDS, RULES

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS bytes, sha256(COALESCE(html, '')) AS digest FROM pages),
f AS (SELECT digest, MIN(page_id) AS first FROM p WHERE bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND bytes >= 100"""


def _rule(column: str) -> str:
    whens = []
    for host, path, verdict in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host + path if column == 'rule' else verdict}'")
    return f"CASE {' '.join(whens)} END"


def _ranks(name: str, seeds: str, links: str) -> str:
    """CTEs of ROUNDS steps of personalised PageRank from ``seeds``(host, weight) over ``links``(src, dst, n).

    A step moves on what the one before it brought; the rank is the sum of all that came.
    """
    return f"""{name}_share AS (SELECT src, dst, {DAMPING} * n / SUM(n) OVER (PARTITION BY src) AS share FROM {links}),
{name}_moved AS (
  SELECT 0 AS step, host, {1 - DAMPING} * weight / (SELECT SUM(weight) FROM {seeds}) AS rank FROM {seeds}
  UNION ALL SELECT step + 1, dst, SUM(rank * share) FROM {name}_moved JOIN {name}_share ON host = src WHERE step < {ROUNDS} GROUP BY step, dst),
{name}_ranks AS (SELECT host, SUM(rank) AS rank FROM {name}_moved GROUP BY host)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URLS = rf"""
WITH RECURSIVE u AS (SELECT page_id, html, {_LOWER.format("COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT page_id, html, host, path, {_rule('rule')} AS rule, {_rule('verdict')} AS ruled FROM u),
found AS (SELECT page_id, host AS src, UNNEST(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1), lambda x: {_LOWER.format("regexp_extract(x, '^(?:[a-zA-Z]+:)?//([^/?#]*)', 1)")}))) AS dst FROM r),
edges AS (SELECT src, dst, COUNT(*) AS n FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
votes AS (SELECT host, COUNT(*) FILTER (ruled = 'allow') AS a, COUNT(*) FILTER (ruled = 'block') AS b, COUNT(*) AS n FROM r WHERE host <> '' GROUP BY 1),
good AS (SELECT host, a AS weight FROM votes WHERE a > n / 2),
bad AS (SELECT host, b AS weight FROM votes WHERE b > n / 2),
ahead AS (SELECT src, dst, n FROM edges WHERE dst NOT IN (SELECT host FROM bad)),
back AS (SELECT dst AS src, src AS dst, n FROM edges WHERE src NOT IN (SELECT host FROM good)),
{_ranks('t', 'good', 'ahead')},
{_ranks('d', 'bad', 'back')}
SELECT page_id, r.host, path, rule,
  COALESCE(ruled, CASE WHEN d.rank > {LEAST_DISTRUST} AND d.rank > {DISTRUST_RATIO} * COALESCE(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t_ranks t ON r.host = t.host LEFT JOIN d_ranks d ON r.host = d.host"""

def _clusters(clusters: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds, each centroid a list; all sums are of integers."""
    usable = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {usable})",
        f"c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY key) - 1 AS k, x AS c FROM (SELECT sha256('1:' || vec_id) AS key, x FROM v ORDER BY key LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        distance = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (SELECT vec_id, x, k, {distance} AS d FROM v, c{i}) QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, floor(SUM(e) / COUNT(*)) AS m FROM (SELECT k, UNNEST(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, COALESCE(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(SUM(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


#: Crc32 of ASCII text in SQL: the table's 256 values, and a fold over the bytes.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"

REPAIR = rf"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
raw AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS MATERIALIZED (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind
  FROM raw, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, UNNEST(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS MATERIALIZED (
  SELECT conv_id, turn, role, text, ROW_NUMBER() OVER w AS pos, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS initial,
    LAG(left(role, 1)) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
puts AS (SELECT * FROM (VALUES ('0', '0', 0, ''), ('0', 'u', 1, 'user:'), ('0', 'a', 2, 'user:' || chr(10) || 'assistant:'), ('s', 's', 0, ''), ('s', 'u', 1, 'user:'), ('s', 'a', 2, 'user:' || chr(10) || 'assistant:'), ('u', 'u', 0, ''), ('u', 'a', 1, 'assistant:'), ('a', 'a', 0, ''), ('a', 'u', 1, 'user:')) x(p, q, n, lines)),
steps AS (SELECT * FROM (VALUES ('0', 's', 's', 'K'), ('0', 'u', 'u', 'K'), ('s', 'u', 'u', 'K'), ('a', 'u', 'u', 'K'), ('u', 'a', 'a', 'K'), ('0', 'u', '', 'R'), ('s', 'u', '', 'R'), ('a', 'u', '', 'R'), ('u', 'a', '', 'R'), ('0', '0', '', 'D'), ('s', 's', '', 'D'), ('u', 'u', '', 'D'), ('a', 'a', '', 'D')) x(p, q, needs, edit)),
chart AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '0' AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM (SELECT DISTINCT conv_id FROM marked)
  UNION ALL
  SELECT c.conv_id, c.pos + 1, s.q, MIN({{
    'cost': c.best.cost + 5 * puts.n + CASE s.edit WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END + CASE WHEN s.edit <> 'D' AND m.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': c.best.audit || repeat('I', puts.n) || s.edit,
    'lines': c.best.lines || CASE WHEN puts.n > 0 THEN string_split(puts.lines, chr(10)) ELSE [] END || CASE s.edit WHEN 'D' THEN [] WHEN 'K' THEN [m.role || ':' || m.text] ELSE [CASE s.q WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text] END}})
  FROM chart c JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.pos = c.pos + 1 JOIN puts ON puts.p = c.q JOIN steps s ON s.p = puts.q
    AND (s.edit <> 'K' OR m.initial = s.needs) AND (s.edit = 'D' OR m.fault IS NULL OR m.fault = 'truncated')
  GROUP BY c.conv_id, c.pos, s.q),
sums AS (
  SELECT conv_id, MAX(pos) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
    COUNT(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
ended AS (
  SELECT s.conv_id, MIN({{'cost': c.best.cost + 5 * p.n, 'audit': c.best.audit || repeat('I', p.n), 'lines': c.best.lines || CASE WHEN p.n > 0 THEN string_split(p.lines, chr(10)) ELSE [] END}}) AS best
  FROM sums s JOIN chart c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.pos = s.n JOIN puts p ON p.p = c.q AND p.q IN ('0', 'a') GROUP BY s.conv_id)
SELECT i.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  COALESCE(e.best.cost, 0) AS cost, COALESCE(e.best.audit, '') AS audit, sha256(COALESCE(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""

#: All pairs of a label, and the smallest row that each reaches.
PASSES = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
roots AS (SELECT a, MIN(b) AS root FROM reached GROUP BY a), degrees AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(d.n, 0) AS n_links, COALESCE(r.root, e.vec_id) AS component_id, e.vec_id = COALESCE(r.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degrees d ON e.vec_id = d.a LEFT JOIN roots r ON e.vec_id = r.a"""

SQL = {"op1_topk": TOPK, "op7_warc": WARC, "op9_urlfilter": URLS, "op11_clustering": _clusters(), "op12_repair": REPAIR, "op13_passes": PASSES}
