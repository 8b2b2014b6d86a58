"""SQL twins of the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

_SNAPSHOTS = """
a AS (SELECT o_custkey % 4 AS domain, o_orderkey AS key, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 1),
b AS (SELECT o_custkey % 4 AS domain, o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN '0-CHANGED' ELSE o_orderpriority END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 2),
d AS (SELECT COALESCE(a.domain, b.domain) AS domain, COALESCE(a.key, b.key) AS key,
        CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' WHEN a.p IS DISTINCT FROM b.p OR a.s IS DISTINCT FROM b.s THEN 'changed' END AS finding
      FROM a FULL JOIN b ON a.domain = b.domain AND a.key = b.key)
"""

_SCANS = """
s AS (SELECT user_id, event_id, ts, event_type = 'click' AS go, event_id % 11 = 0 AS halt, event_id % 3 <> 0 AS held, event_id % 40 + 10 AS dt FROM events)
"""
_W = "PARTITION BY user_id ORDER BY ts, event_id"

_CONTAINED = """
c AS (SELECT p_partkey + 1 AS node, CAST(CASE WHEN (p_partkey + 1) % 97 = 0 THEN p_partkey + 1 WHEN (p_partkey + 1) % 89 = 0 THEN p_partkey + 1 + 10000000
        WHEN (p_partkey + 1) % 83 = 0 THEN p_partkey + 1 + CASE WHEN (p_partkey + 1) % 2 = 0 THEN 1 ELSE -1 END ELSE (p_partkey + 1) // 2 END AS BIGINT) AS held_in FROM part),
h AS (SELECT node, NULLIF(held_in, 0) AS held_in FROM c),
up AS (SELECT h.node, p.node AS up FROM h LEFT JOIN h p ON h.held_in = p.node),
walk AS (SELECT node, up, node AS top, 0 AS depth FROM up UNION ALL SELECT w.node, u.up, u.node, w.depth + 1 FROM walk w JOIN up u ON w.up = u.node WHERE w.depth < 64)
"""

_REVIEWED = """
r AS (SELECT d.doc_id, d.lang, COALESCE(CAST(NULLIF(l.quality, 0) AS INTEGER), CAST(d.n_chars % 2 AS INTEGER)) AS quality, l.doc_id IS NOT NULL AS reviewed
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

_CHANNELS = """
ch AS (SELECT s_suppkey, UNNEST(range(0, s_suppkey % 8 + 1)) AS channel FROM supplier),
us AS (SELECT l_suppkey AS s_suppkey, l_partkey % 16 AS channel, MIN(l_partkey) AS assigned FROM lineitem GROUP BY 1, 2),
x AS (SELECT ch.s_suppkey, CAST(ch.channel AS INTEGER) AS channel, assigned, CASE WHEN assigned IS NULL THEN 'spare' ELSE 'assigned' END AS state
      FROM ch LEFT JOIN us ON ch.s_suppkey = us.s_suppkey AND ch.channel = us.channel)
"""

_TOKENS = r"list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
_NAME_TOKENS = _TOKENS.format("p_name || ' ' || p_type")
_IDENTIFIERS = r"list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_:]*(?:\.[A-Za-z_0-9]+|\[[^\]]*\])*)', 1), lambda w: lower(w) NOT IN ('true', 'false'))"

_PRICE = "CASE WHEN lines IS NULL THEN 'u' WHEN (o_totalprice > 100000) = (lines > 4) THEN 'm' ELSE 'c' END"
_PRIORITY = "CASE WHEN NULLIF(o_orderpriority, '3-MEDIUM') IS NULL THEN 'u' WHEN o_orderpriority = '1-URGENT' THEN 'm' ELSE 'c' END"
_STATUS = "CASE WHEN o_orderstatus IS NULL OR ls IS NULL THEN 'u' WHEN o_orderstatus = ls THEN 'm' ELSE 'c' END"


def _fields(code: str) -> str:
    return f"concat_ws(',', CASE WHEN price = '{code}' THEN 'price' END, CASE WHEN priority = '{code}' THEN 'priority' END, CASE WHEN status = '{code}' THEN 'status' END)"


SQL = {
    "unique_resolution": """
        WITH m AS (SELECT s_nationkey, COUNT(*) AS n, MIN(s_suppkey) AS s FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY 1)
        SELECT c_custkey, COALESCE(n, 0) AS match_count, CASE WHEN n = 1 THEN s END AS s_suppkey,
          CASE WHEN c_nationkey IS NULL THEN 'no_key' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
        FROM customer LEFT JOIN m ON c_nationkey = s_nationkey""",
    "scoped_lookup": """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS scope, l_partkey % 50 AS name FROM lineitem),
        i AS (SELECT s_suppkey AS scope, s_nationkey AS name, MIN(s_name) AS v FROM supplier GROUP BY 1, 2),
        o AS (SELECT p_partkey AS name, MIN(p_name) AS v FROM part WHERE p_size > 25 GROUP BY 1)
        SELECT l_orderkey, l_linenumber, COALESCE(i.v, o.v) AS definition, CASE WHEN i.v IS NOT NULL THEN 'inner' WHEN o.v IS NOT NULL THEN 'outer' END AS resolved_scope
        FROM r LEFT JOIN i ON r.scope = i.scope AND r.name = i.name LEFT JOIN o ON r.name = o.name""",
    "bound_unbound_edges": """
        SELECT 'bound' AS kind, c_nationkey, o_orderpriority, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 2, 3
        UNION ALL
        SELECT 'unbound', NULL, o_orderpriority, COUNT(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY 3""",
    "colocation_cause_effect": """
        WITH l AS (SELECT DISTINCT l_orderkey, NULLIF(l_linenumber % 3, 0) AS line, l_partkey, l_returnflag FROM lineitem)
        SELECT e.l_partkey AS effect, c.l_partkey AS cause, COUNT(*) AS locations
        FROM (SELECT * FROM l WHERE l_returnflag = 'R') e JOIN (SELECT * FROM l WHERE l_returnflag = 'A') c
          ON e.l_orderkey = c.l_orderkey AND e.line IS NOT DISTINCT FROM c.line AND e.l_partkey <> c.l_partkey GROUP BY 1, 2""",
    "relationship_key": """
        SELECT l_orderkey AS "order", l_linenumber AS line, l_returnflag AS flag,
          'ce:' || substr(sha256('{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"order":' || l_orderkey || '}'), 1, 24) AS relationship_key FROM lineitem""",
    "drift_full_outer": f"WITH {_SNAPSHOTS} SELECT domain, key, finding FROM d WHERE finding IS NOT NULL",
    "drift_domain_gated": f"WITH {_SNAPSHOTS} SELECT domain, key, finding FROM d WHERE finding IS NOT NULL AND domain IN (1, 2)",
    "drift_sanitized": f"""
        WITH {_SNAPSHOTS}, n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY domain, key) AS n FROM d WHERE finding IS NOT NULL)
        SELECT 'DRIFT-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS reference, domain, finding FROM n""",
    "inventory_reconcile": """
        WITH o AS (SELECT o_custkey + 100 AS key, COUNT(*) AS orders FROM orders GROUP BY 1)
        SELECT COALESCE(c_custkey, key) AS key, c_mktsegment, orders, CASE WHEN c_custkey IS NULL THEN 'discovered_only' WHEN key IS NULL THEN 'configured_only' ELSE 'both' END AS side
        FROM customer FULL JOIN o ON c_custkey = key""",
    "field_comparison_status": f"""
        WITH l AS (SELECT l_orderkey, COUNT(*) AS lines, MAX(l_linestatus) AS ls FROM lineitem GROUP BY 1),
        f AS (SELECT o_orderkey, {_PRICE} AS price, {_PRIORITY} AS priority, {_STATUS} AS status FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
        SELECT o_orderkey, {_fields('m')} AS matched, {_fields('c')} AS conflicting, {_fields('u')} AS unavailable,
          CASE WHEN 'c' IN (price, priority, status) THEN 'CONFLICT' WHEN 'm' NOT IN (price, priority, status) THEN 'INSUFFICIENT' WHEN 'u' IN (price, priority, status) THEN 'PARTIAL' ELSE 'EXACT' END AS status
        FROM f""",
    "key_verdict": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NOT_CONFIGURED' WHEN 1 THEN 'DISABLED'
          WHEN 2 THEN CASE WHEN p_size IS NULL OR NOT COALESCE(p_retailprice > 1500, FALSE) THEN 'DEFERRED' WHEN p_size % 2 <> 0 OR p_retailprice <= 1700 THEN 'REJECTED' ELSE 'SATISFIED' END
          ELSE CASE WHEN p_size % 2 <> 0 THEN 'REJECTED' ELSE 'DEFERRED' END END AS verdict FROM part""",
    "theta_identity_match": """
        WITH m AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND (c_custkey % 100 = s_suppkey % 100 OR floor(c_acctbal / 100) = floor(s_acctbal / 100)))
        SELECT * FROM m
        UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM m)
        UNION ALL SELECT NULL, s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m)""",
    "multi_basis_correlation": """
        WITH u AS (SELECT c_custkey, s_suppkey AS identity, 'key' AS basis FROM customer JOIN supplier ON c_custkey = s_suppkey
          UNION SELECT c_custkey, s_suppkey, 'balance' FROM customer JOIN supplier ON floor(c_acctbal) = floor(s_acctbal)
          UNION SELECT c_custkey, s_suppkey, 'nation' FROM customer JOIN supplier ON c_nationkey = s_nationkey)
        SELECT c_custkey, MIN(identity) AS identity, string_agg(DISTINCT basis, ',' ORDER BY basis) AS bases FROM u GROUP BY 1 HAVING COUNT(DISTINCT identity) = 1""",
    "topology_corroboration": """
        WITH e AS (SELECT user_id AS target, NULLIF(event_id % 4, 0) AS interface, lower(event_type) AS peer, event_id FROM events),
        n AS (SELECT DISTINCT target, interface, peer FROM e WHERE event_id % 2 = 0), s AS (SELECT DISTINCT target, interface, peer FROM e WHERE event_id % 3 = 0)
        SELECT n.target, n.interface, n.peer, 'reported_neighbour' AS kind, s.peer IS NOT NULL AS corroborated
        FROM n LEFT JOIN s ON n.target = s.target AND n.peer = s.peer AND n.interface IS NOT DISTINCT FROM s.interface
        UNION ALL SELECT target, interface, peer, 'mac_reachability', FALSE FROM s
        WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.target = s.target AND n.peer = s.peer AND n.interface IS NOT DISTINCT FROM s.interface)""",
    "channel_expansion": f"WITH {_CHANNELS} SELECT * FROM x",
    "module_schedule": f"WITH {_CHANNELS} SELECT s_suppkey, COUNT(*) AS channels, COUNT(*) FILTER (state = 'assigned') AS assigned, COUNT(*) FILTER (state = 'spare') AS spare FROM x GROUP BY 1",
    "longest_prefix_match": r"""
        WITH r AS (SELECT DISTINCT p AS prefix FROM (SELECT regexp_extract(url, '^(https?://[a-z]*\.)', 1) AS p FROM pages UNION ALL SELECT regexp_extract(url, '^(https?://)', 1) FROM pages) WHERE p <> ''),
        t AS (SELECT prefix FROM r UNION ALL SELECT prefix FROM r WHERE prefix = 'https://www.'),
        m AS (SELECT page_id, prefix, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS rn FROM pages JOIN t ON starts_with(url, prefix) GROUP BY 1, 2)
        SELECT p.page_id, CASE WHEN n = 1 THEN prefix END AS prefix, COALESCE(n, 0) AS prefix_count FROM pages p LEFT JOIN m ON p.page_id = m.page_id AND rn = 1""",
    "prefix_family_counts": """
        WITH o AS (SELECT '1.' || (p_size % 6) || '.' || (p_partkey % 20) AS oid FROM part)
        SELECT CASE WHEN oid = '1.3.1' OR oid LIKE '1.3.1.%' THEN 'standard' WHEN oid LIKE '1.3.%' THEN 'general' WHEN oid LIKE '1.4.%' THEN 'other-known' ELSE 'branch.' || split_part(oid, '.', 2) END AS family, COUNT(*) AS n
        FROM o GROUP BY 1""",
    "family_merge": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1",
    "lexical_classification": f"""
        SELECT p_partkey, concat_ws(',', CASE WHEN list_has_any(t, ['1', 'part', 'promo']) THEN 'first' END, CASE WHEN list_has_any(t, ['large', 'jumbo', 'big']) THEN 'large' END,
          CASE WHEN list_has_any(t, ['steel', 'brushed']) THEN 'steel' END) AS kinds FROM (SELECT p_partkey, {_NAME_TOKENS} AS t FROM part)""",
    "identifier_extraction": f"""
        SELECT identifier, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS docs FROM (SELECT doc_id, UNNEST({_IDENTIFIERS}) AS identifier FROM documents) GROUP BY 1""",
    "unit_suffix": r"""
        SELECT p_partkey, NULLIF(regexp_extract(p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_brand || ')  ' ELSE ' (x) tail' END, '\(([^()]+)\)\s*$', 1), '') AS unit FROM part""",
    "pointer_select": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "record_index": "SELECT event_id, '/k' AS pointer, json_extract_string(props, '$.k') AS scalar FROM events",
    "structural_diff": """
        WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CASE k % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'add' ELSE 'remove' END AS operation, CASE k % 3 WHEN 1 THEN '/new' ELSE '/k' END AS pointer FROM e""",
    "evidence_inventory": """
        SELECT event_type, COUNT(*) AS n, COUNT(value) AS with_value, COUNT(*) FILTER (value > 50) AS large, COUNT(props) AS with_props FROM events GROUP BY 1""",
    "coverage_percent": """
        SELECT l_suppkey, COUNT(*) AS occurrences, COUNT(*) FILTER (l_returnflag <> 'N') AS supported, round(100.0 * COUNT(*) FILTER (l_returnflag <> 'N') / COUNT(*), 6) AS percent FROM lineitem GROUP BY 1""",
    "multiset_consumption": """
        WITH r AS (SELECT event_id, user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
        t AS (SELECT event_id AS token, user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 3 = 0)
        SELECT r.event_id, r.user_id, r.event_type, token FROM r LEFT JOIN t ON r.user_id = t.user_id AND r.event_type = t.event_type AND r.n = t.n""",
    "unique_value_per_group": "SELECT l_orderkey, MIN(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_returnflag) = 1",
    "confidence_argmax": """
        SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_orderkey) = 1""",
    "value_assessment": """
        WITH v AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS v, CAST(floor(p_retailprice) AS DECIMAL(18,2)) AS f FROM part)
        SELECT p_partkey, CASE WHEN v IS NULL THEN 'no value' WHEN v = f THEN 'labelled option' WHEN v < 950 THEN 'below range' WHEN v > 1850 THEN 'above range' ELSE 'in range' END AS assessment FROM v""",
    "opaque_topk": """
        SELECT p_brand, COUNT(*) AS n, array_to_string(list_sort(list_distinct(list(p_type)))[1:5], '|') AS samples FROM part GROUP BY 1""",
    "containment_validation": f"""
        WITH RECURSIVE {_CONTAINED}
        SELECT node, 'self_parent' AS code FROM h WHERE node = held_in
        UNION ALL SELECT node, 'missing_parent' FROM h WHERE held_in IS NOT NULL AND held_in NOT IN (SELECT node FROM h)
        UNION ALL SELECT node, 'containment_cycle' FROM walk WHERE depth = 64""",
    "root_chain": f"WITH RECURSIVE {_CONTAINED} SELECT node, top AS root, CAST(depth AS BIGINT) AS depth FROM walk WHERE up IS NULL",
    "lifecycle_generations": f"""
        SELECT user_id, event_id, ROW_NUMBER() OVER ({_W}) AS generation, CASE WHEN ROW_NUMBER() OVER ({_W}) = 1 THEN 'CREATED' ELSE 'OBSERVED' END AS transition FROM events""",
    "active_identities": """
        SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'click'""",
    "review_overlay": f"WITH {_REVIEWED} SELECT doc_id, quality, reviewed FROM r",
    "review_coverage": f"""
        WITH {_REVIEWED} SELECT lang, COUNT(*) AS candidates, COUNT(*) FILTER (reviewed) AS reviewed, COUNT(NULLIF(quality, 0)) AS complete, COUNT(*) - COUNT(NULLIF(quality, 0)) AS missing_quality FROM r GROUP BY 1""",
    "seal_in_latch": f"""
        WITH {_SCANS} SELECT event_id, COALESCE(last_value(CASE WHEN halt THEN FALSE WHEN go THEN TRUE END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), FALSE) AS run FROM s""",
    "one_shot": f"""
        WITH {_SCANS}, w AS (SELECT event_id, halt, go, (go OR halt) AND NOT COALESCE(lag(go OR halt) OVER ({_W}), FALSE) AS write FROM s)
        SELECT event_id, write, CASE WHEN write THEN CASE WHEN go THEN (event_id & 65535) | 4 ELSE (event_id & 65535) & 65531 END END AS mode_out FROM w""",
    "edge_counter": f"""
        WITH {_SCANS},
        e AS (SELECT *, held AND NOT halt AND ROW_NUMBER() OVER ({_W}) > 1 AND NOT COALESCE(lag(held AND NOT halt) OVER ({_W}), FALSE) AS edge,
                SUM(CAST(halt AS INTEGER)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM s),
        v AS (SELECT *, CAST(SUM(CAST(edge AS BIGINT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cv FROM e)
        SELECT event_id, edge, cv, COALESCE(last_value(CASE WHEN edge THEN cv >= 2 END IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), FALSE) AS q FROM v""",
    "on_delay": f"""
        WITH {_SCANS}, i AS (SELECT *, SUM(CAST(NOT held AS INTEGER)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM s),
        a AS (SELECT event_id, held, CAST(least(100, SUM(CASE WHEN held THEN dt ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS acc FROM i)
        SELECT event_id, acc, held AND acc >= 100 AS done FROM a""",
    "retentive_timer": f"""
        WITH {_SCANS}, i AS (SELECT *, CASE WHEN held AND NOT halt AND COALESCE(lag(held AND NOT halt) OVER ({_W}), FALSE) THEN dt ELSE 0 END AS d,
          SUM(CAST(halt AS INTEGER)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM s),
        a AS (SELECT event_id, CAST(least(120, SUM(d) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS et FROM i)
        SELECT event_id, et, et >= 120 AS q FROM a""",
    "rtc_pulse": f"""
        WITH RECURSIVE {_SCANS},
        o AS (SELECT *, CASE WHEN event_id % 29 <> 0 THEN epoch_ms(ts) END AS clock, ROW_NUMBER() OVER ({_W}) AS n FROM s),
        f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS start, FALSE AS pulse FROM (SELECT DISTINCT user_id FROM o)
          UNION ALL SELECT o.user_id, o.n, o.event_id,
            CASE WHEN NOT o.held OR o.clock IS NULL THEN NULL WHEN f.start IS NULL OR o.clock - f.start >= 86400000 THEN o.clock ELSE f.start END,
            COALESCE(o.held AND o.clock - f.start >= 86400000, FALSE)
          FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
        SELECT event_id, pulse FROM f WHERE n > 0""",
    "adjacent_pattern": f"SELECT user_id, event_id FROM events QUALIFY event_type = 'view' AND lead(event_type) OVER ({_W}) = 'click'",
    "status_nibble": "SELECT o_orderkey, ((o_orderkey * 37) & 61440) >> 12 AS nibble FROM orders",
    "command_word": """
        SELECT l_orderkey, l_linenumber, CAST((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END) + (CASE WHEN l_quantity > 25 THEN 4 ELSE 0 END)
          + (CASE WHEN l_discount > 0.05 THEN 8 ELSE 0 END) + (CASE WHEN l_tax > 0.04 THEN 16 ELSE 0 END) AS BIGINT) AS word FROM lineitem""",
    "packed_decode": """
        WITH i AS (SELECT o_orderkey, o_orderkey * 2654435 AS v FROM orders),
        b AS (SELECT o_orderkey, (v >> 24) & 255 AS b4, (v >> 16) & 255 AS b5, (v >> 8) & 255 AS b6, v & 255 AS b7 FROM i)
        SELECT o_orderkey, b4 + 256 * b5 AS low, b6 + 256 * b7 - CASE WHEN b7 >= 128 THEN 65536 ELSE 0 END AS high, (b7 >> 3) & 1 = 1 AS flag FROM b""",
    "netmask_prefix": """
        WITH m AS (SELECT p_partkey, ([0, 128, 192, 224, 240, 248, 252, 254, 255, 37])[p_partkey % 10 + 1] AS o, p_partkey % 3 AS k FROM part),
        t AS (SELECT p_partkey, o, k, CASE k WHEN 0 THEN '255.255.' || o || '.0' WHEN 1 THEN '255.' || o || '.0.0' ELSE '255.255.255.' || o END AS mask FROM m)
        SELECT p_partkey, mask, CASE WHEN o <> 37 THEN CAST(CASE k WHEN 0 THEN 16 WHEN 1 THEN 8 ELSE 24 END + bit_count(CAST(o AS INTEGER)) AS INTEGER) END AS prefix_length FROM t""",
    "radix_literal": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey
          WHEN 2 THEN CAST('1' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) > 6 THEN left(CAST(p_partkey AS VARCHAR), 6) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS BIGINT) END AS value FROM part""",
    "fault_pivot": """
        SELECT CAST(user_id % 9 AS VARCHAR) AS position, MAX(CASE WHEN event_type = 'click' THEN event_id END) AS click, MAX(CASE WHEN event_type = 'view' THEN event_id END) AS view,
          MAX(CASE WHEN event_type = 'purchase' THEN event_id END) AS purchase FROM events GROUP BY 1""",
    "manifest_digest": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "tumbling_window": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
    "session_gaps": f"""
        WITH g AS (SELECT user_id, event_id, ts, CASE WHEN COALESCE(epoch_us(ts) - lag(epoch_us(ts)) OVER ({_W}) > 86400000000, TRUE) THEN 1 ELSE 0 END AS starts FROM events),
        x AS (SELECT user_id, CAST(SUM(starts) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
        SELECT user_id, session, COUNT(*) AS n FROM x GROUP BY 1, 2""",
    "rollup_counts": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "natural_order": "SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_partkey) AS position FROM part",
}
