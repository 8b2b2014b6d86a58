"""Queries of typed values, parameters, images, identities and requests, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladder
from ..operators import parameters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = ("BOOL", "DINT", "REAL", "int", "STRING")


def scalar_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (n % 5 + 1).cast("int"))
    text = F.when(n % 3 == 0, (n % 2).cast("string")).when(n % 3 == 1, F.concat(F.lit("16#"), F.hex(n))).otherwise(F.concat(n.cast("string"), F.lit(".5")))
    return _table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in parameters.scalar_value(kind, text).items()])


def type_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*[F.lit(t) for t in (*parameters.PROMOTION, "TIMER")]), (i + 1).cast("int"))
    a, b = pick(F.col("p_partkey") % 11), pick(F.col("p_size") % 11)
    return _table(spark, sf_dir, "part").select("p_partkey", parameters.promoted(a, b).alias("wide"), parameters.compatibility(a, b).alias("compatibility"))


def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+02:00").otherwise("")
    return _table(spark, sf_dir, "orders").select("o_orderkey", parameters.iso_text(parameters.iso_instant(F.concat(day, F.lit("T12:30:00"), zone))).alias("at"))


def parameter_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("name"))
    catalogue = _table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return parameters.enriched(orders, catalogue, "key", ["name"])


def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_custkey", F.when(F.substring("o_orderpriority", 1, 1) == "1", "High").when(F.substring("o_orderpriority", 1, 1) == "2", "Medium").when(F.substring("o_orderpriority", 1, 1) == "3", "Low").otherwise("None").alias("severity"))
    return parameters.highest(rows, ["o_custkey"], "severity")


def literal_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("P"), (F.col("l_linenumber") % 3).cast("string")).alias("target"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("value"))
    return parameters.literal_writes(rows, ["l_orderkey"], "target", "value")


def literal_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("A"), n, F.lit("[1, 2] := 16#1F; B := C + 1; "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("IF go THEN D := "), n, F.lit("; END_IF; // a note "), n)).otherwise(F.lit("E := 1_000;")))
    found = _table(spark, sf_dir, "part").select("p_partkey", F.explode(ladder.literal_assignments(line)).alias("a"), ladder.line_comment(line).alias("comment"))
    return found.select("p_partkey", "a.target", F.concat_ws(",", F.col("a.indices").cast("array<string>")).alias("indices"), "a.value", "comment")


def statement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    text = F.when(n % 4 == 0, "A := 1;").when(n % 4 == 1, "IF x THEN y := 2; END_IF;").when(n % 4 == 2, "Go(1);").otherwise("@@ what;")
    kinds = _table(spark, sf_dir, "part").select(F.explode(ladder.statements(text)).alias("s")).select(ladder.statement_kind(F.col("s")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def capability_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    have = _table(spark, sf_dir, "events").where("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    return parameters.set_difference(need, have, "user_id", "names").select("user_id", F.concat_ws(",", "missing").alias("missing"), "compatible")


def byte_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), (F.col("l_partkey") % 4 + 1).cast("int")).alias("size"))
    lines = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("size").alias("size"))
    return parameters.byte_layout(lines, ["l_orderkey"], "l_linenumber", "size")


def packed_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = parameters.packed_image(6, [(0, 2, F.col("p_partkey")), (2, 2, -F.col("p_size").cast("long"))], [(5, 3, F.col("p_size") > 25), (0, 0, F.lit(True))])
    return _table(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(image)).alias("image"))


def property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    of = lambda rows, segment: rows.select("c_custkey", F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), segment).alias("properties"))
    before, after = of(c.where("c_custkey % 5 <> 0"), F.col("c_mktsegment")), of(c.where("c_custkey % 7 <> 0"), F.when(F.col("c_custkey") % 3 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    return parameters.property_diff(before, after, ["c_custkey"], "properties")


def accepted_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "events").select("event_id", "event_type")
    reviews = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "accepted").when(F.col("event_id") % 3 == 1, "rejected").otherwise("deferred").alias("disposition"), F.col("user_id").alias("identity"))
    return parameters.accepted_identities(found, reviews, "event_id", "identity", "event_type").select("identity", "candidates", F.concat_ws(",", "evidence").alias("evidence"))


def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 4 == 0, "SUCCEEDED").when(F.col("event_id") % 4 == 1, "FAILED").otherwise("PENDING")
    events = _table(spark, sf_dir, "events").select((F.col("event_id") / 3).cast("long").alias("request"), "event_id", "ts", status.alias("status"))
    return parameters.request_states(events, "request", "ts", "event_id", "status")


def cross_layer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"))
    bindings = _table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("device"), (F.col("o_orderkey") % 200).alias("module"))
    accepted = _table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("module"), F.col("s_nationkey").alias("target"))
    return parameters.linked_once(devices, bindings, accepted, "device", "module", "target")


def caseless_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("brand"), F.nullif(F.col("p_size") % 4, F.lit(0)).alias("size"))
    return parameters.in_order(rows, ["size", "brand", "p_partkey"]).select("p_partkey", "position")


QUERIES = (
    scalar_literals, type_promotion, iso_instants, parameter_enrichment, highest_severity, literal_writes, literal_assignments, statement_coverage, capability_difference,
    byte_layout, packed_encode, property_changes, accepted_identities, request_states, cross_layer_links, caseless_order,
)

_RANKS = "['SINT', 'USINT', 'INT', 'UINT', 'DINT', 'UDINT', 'LINT', 'ULINT', 'REAL', 'LREAL', 'TIMER']"

SQL = {
    "scalar_literals": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN p_partkey % 2 = 1 END AS boolean,
          CASE WHEN p_partkey % 5 IN (1, 3) THEN CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 WHEN p_partkey % 3 = 1 THEN p_partkey END END AS whole,
          CASE WHEN p_partkey % 5 = 2 THEN CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 WHEN p_partkey % 3 = 2 THEN p_partkey + 0.5 END END AS real FROM part""",
    "type_promotion": f"""
        WITH p AS (SELECT p_partkey, p_partkey % 11 AS a, p_size % 11 AS b FROM part)
        SELECT p_partkey, CASE WHEN a < 10 AND b < 10 THEN {_RANKS}[GREATEST(a, b) + 1] END AS wide, CASE WHEN a = b THEN 'EXACT' WHEN a = 10 OR b = 10 THEN 'UNKNOWN' WHEN b > a THEN 'IMPLICIT' ELSE 'INCOMPATIBLE' END AS compatibility FROM p""",
    "iso_instants": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T12:30:00Z' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00Z' END AS at FROM orders""",
    "parameter_enrichment": """
        SELECT o_orderkey, o_custkey AS key, COALESCE(NULLIF(o_orderpriority, '5-LOW'), c_name) AS name, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0""",
    "highest_severity": """
        SELECT o_custkey, CASE MIN(CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN o_orderpriority[1] END) WHEN '1' THEN 'High' WHEN '2' THEN 'Medium' WHEN '3' THEN 'Low' END AS severity FROM orders GROUP BY 1""",
    "literal_writes": """
        SELECT l_orderkey, 'P' || CAST(l_linenumber % 3 AS VARCHAR) AS target, MIN(l_returnflag) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 HAVING COUNT(DISTINCT l_returnflag) = 1""",
    "literal_assignments": """
        WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS even, CAST(p_partkey AS VARCHAR) AS n FROM part), q AS (SELECT *, CASE WHEN even THEN 'a note ' || n END AS comment FROM p)
        SELECT p_partkey, 'A' || n || '[1, 2]' AS target, '1,2' AS indices, 31 AS value, comment FROM q
        UNION ALL SELECT p_partkey, CASE WHEN even THEN 'D' ELSE 'E' END, '', CASE WHEN even THEN p_partkey ELSE 1000 END, comment FROM q""",
    "statement_coverage": """
        WITH k AS (SELECT UNNEST(CASE p_partkey % 4 WHEN 0 THEN ['assignment'] WHEN 1 THEN ['control', 'control'] WHEN 2 THEN ['call'] ELSE ['unknown'] END) AS kind FROM part) SELECT kind, COUNT(*) AS n FROM k GROUP BY 1""",
    "capability_difference": """
        WITH e AS (SELECT user_id, event_type, COUNT(*) FILTER (value > 90) > 0 AS has FROM events GROUP BY 1, 2)
        SELECT user_id, COALESCE(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT has), '') AS missing, COUNT(*) FILTER (NOT has) = 0 AS compatible FROM e GROUP BY 1""",
    "byte_layout": """
        WITH l AS (SELECT l_orderkey, l_linenumber, MAX([1, 2, 4, 8][l_partkey % 4 + 1]) AS size FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, l_linenumber, size, CAST(COALESCE(SUM(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""",
    "packed_encode": """
        WITH p AS (SELECT p_partkey, (p_partkey % 65536) | 1 AS a, (65536 - p_size) % 65536 AS b, CASE WHEN p_size > 25 THEN '08' ELSE '00' END AS c FROM part)
        SELECT p_partkey, lpad(lower(hex(a % 256)), 2, '0') || lpad(lower(hex(a // 256)), 2, '0') || lpad(lower(hex(b % 256)), 2, '0') || lpad(lower(hex(b // 256)), 2, '0') || '00' || c AS image FROM p""",
    "property_changes": """
        WITH b AS (SELECT c_custkey, UNNEST(['nation', 'segment']) AS property, UNNEST([CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS before FROM customer WHERE c_custkey % 5 <> 0),
        a AS (SELECT c_custkey, UNNEST(['nation', 'segment']) AS property, UNNEST([CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END]) AS after FROM customer WHERE c_custkey % 7 <> 0)
        SELECT c_custkey, property, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change, before, after FROM b FULL JOIN a USING (c_custkey, property) WHERE before IS DISTINCT FROM after""",
    "accepted_identities": """
        SELECT user_id AS identity, COUNT(DISTINCT event_id) AS candidates, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS evidence FROM events WHERE event_id % 3 = 0 GROUP BY 1""",
    "request_states": """
        WITH e AS (SELECT event_id // 3 AS request, ts, event_id, CASE event_id % 4 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' END AS ended FROM events)
        SELECT request, COALESCE(arg_min(ended, struct_pack(ts := ts, id := event_id)) FILTER (ended IS NOT NULL), 'PENDING') AS state FROM e GROUP BY 1""",
    "cross_layer_links": """
        WITH b AS (SELECT DISTINCT o_custkey AS device, o_orderkey % 200 AS module FROM orders WHERE o_orderkey % 5 = 0), a AS (SELECT s_suppkey AS module, s_nationkey AS target FROM supplier WHERE s_suppkey % 2 = 0),
        j AS (SELECT c_custkey AS device, COUNT(b.module) AS bound, COUNT(DISTINCT target) AS targets, MIN(target) AS target FROM customer LEFT JOIN b ON b.device = c_custkey LEFT JOIN a ON a.module = b.module GROUP BY 1)
        SELECT device, CASE WHEN targets = 1 THEN target END AS target, CASE WHEN bound = 0 THEN 'unbound' WHEN targets = 0 THEN 'unmapped' WHEN targets = 1 THEN 'linked' ELSE 'ambiguous' END AS status FROM j""",
    "caseless_order": """
        SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY COALESCE(NULLIF(p_size % 4, 0), -1), lower(p_brand), p_partkey) AS position FROM part""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
