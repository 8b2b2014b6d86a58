"""Queries of operators that the other lists don't reach: ledgers, units, reviews, streams, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, ladder
from ..operators import aggregate, lifecycle, ordering, review, scan_cycle, topology, units
from ..streaming import windows
from . import software


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, scan_cycle.Scans]:
    e = _table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("go"), (F.col("event_id") % 11 == 0).alias("halt"), (F.col("event_id") % 3 != 0).alias("held"), (F.col("event_id") % 5 != 0).alias("read"), (F.col("event_id") % 7 == 0).alias("local"))
    return rows, scan_cycle.Scans("user_id", "ts", "event_id")


def up_down_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _scans(spark, sf_dir)
    return scan_cycle.up_down_counter(rows, "user_id", ["ts", "event_id"], "held", "go", "halt", 2).select("event_id", "cv", "done", "overflow", "underflow")


def unread_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    return scan_cycle.unread_one_shot(rows, scans, "held", "read").select("event_id", "write")


def drive_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    rows = rows.withColumn("sealed", scans.latch(F.col("go"), F.col("halt")))
    return scan_cycle.drive_source(rows, scans, "local", "read", "sealed", "held").select("event_id", "source", "run")


def command_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    return scan_cycle.command_run(rows, scans, "go", "held", "local", "halt", "read").select("event_id", "run")


def clamped_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", bits.clamped_command(F.col("o_totalprice") / 1000, 10.5, 90.25).alias("command"))


def ledger_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    at = lambda n: F.timestamp_seconds(F.lit(86_400 * n))
    key = F.col("c_custkey").cast("string").alias("key")
    ledger = c.where("c_custkey % 3 <> 0").select(key, F.lit(1).cast("long").alias("generation"), at(1).alias("observed_at")).union(c.where("c_custkey % 6 = 1").select(key, F.lit(2).cast("long"), at(2)))
    accepted = c.where("c_custkey % 2 = 0").select(key, at(3).alias("observed_at"))
    none = spark.createDataFrame([], "directive int, transition string, sources array<string>, targets array<string>, directed_at timestamp")
    return lifecycle.advance(ledger, accepted, none).select("key", "generation", "transition")


def ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    name = lambda x: x.cast("string")
    n = F.col("c_custkey")
    ledger = c.select(name(n).alias("key"), F.lit(1).alias("generation"), F.timestamp_seconds(F.lit(86_400)).alias("observed_at"))
    retired = c.where("c_custkey % 10 = 0").select(name(n).alias("key"))
    targets = F.when(n % 5 == 0, F.array(name(n))).when(n % 7 == 0, F.array(F.concat(F.lit("x"), name(n)))).otherwise(F.array(name(n + 0)))
    asked = c.select(n.alias("directive"), F.when(n % 11 == 0, "merge").otherwise("supersede").alias("transition"), F.array(name(n)).alias("sources"), F.when(targets == F.array(name(n)), F.when(n % 5 == 0, targets).otherwise(F.array(F.concat(F.lit("x"), name(n))))).otherwise(targets).alias("targets"), F.timestamp_seconds(F.when(n % 13 == 0, F.lit(0)).otherwise(F.lit(100_000))).alias("directed_at"))
    return lifecycle.directive_faults(asked, ledger, retired)


def ledger_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordering.generations(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select(F.col("user_id").cast("string").alias("key"), "generation")
    asked = e.select("key").distinct().withColumn("core_id", F.concat(F.lit("core-"), "key"))
    held = lifecycle.promotions(e, asked)
    return held.select("key", "core_id", F.size("generations").cast("long").alias("generations"), F.element_at("generations", -1).alias("last"))


def broken_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.min("event_id").alias("first"))
    before = e.select("key", F.array(F.lit(1), F.lit(2)).alias("generations"))
    after = e.select("key", F.when(F.col("first") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(3))).alias("generations"))
    return lifecycle.broken_histories(before, after)


def unit_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in a chain of comparisons: the first one's unit goes all the way."""
    p = _table(spark, sf_dir, "part")
    block = F.floor(F.col("p_partkey") / 100).cast("string").alias("workspace")
    first = F.col("p_partkey") % 100 == 0
    tags = p.select(block, F.col("p_partkey").cast("string").alias("tag"), F.when(first, F.col("p_brand")).alias("unit"), F.when(first, F.lit("CONFIRMED")).alias("confidence"))
    pairs = p.where(~first).select(block, F.col("p_partkey").alias("place"), (F.col("p_partkey") - 1).cast("string").alias("left"), F.col("p_partkey").cast("string").alias("right"))
    return units.inherited_units(tags, pairs).select("workspace", "tag", "unit", "confidence", "inherited_from")


def review_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    given = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(F.max("quality") == 1, "accepted").otherwise("rejected").alias("disposition"))
    return review.by_disposition(docs, given, "doc_id")


def invalid_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    known = _table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key"))
    return review.invalid_reviews(known, orders, "key")


def conflicting_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.conflicting_parents(_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topology.merged_nodes(_table(spark, sf_dir, "supplier").select("s_nationkey", "s_name"), "s_nationkey", ["s_name"])
    return found.select("s_nationkey", F.concat_ws(",", "s_name").alias("names"))


def link_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return topology.link_index(events, "user_id", "event_type", "event_id")


def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return aggregate.ranked(groups, "n", F.col("l_suppkey")).select("l_suppkey", "n", "position")


def ladder_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, positions and access of rungs made of a part's numbers."""
    n = F.col("p_partkey").cast("string")
    rung = F.concat(F.lit("XIC(A"), n, F.lit(")CPT(Out,SIN(B"), n, F.lit("))MOV(C[1,2],'x)(' );"))
    called = _table(spark, sf_dir, "part").select("p_partkey", F.explode(ladder.calls(rung)).alias("call")).select("p_partkey", F.col("call.callee").alias("callee"), F.posexplode("call.operands").alias("position", "operand"))
    return called.withColumn("access", ladder.access(F.col("callee"), F.col("position"), F.lit(None).cast("string")))


def routine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    rung = F.when(n % 3 == 0, F.concat(F.lit("JSR(R"), n.cast("string"), F.lit(", 1);"))).when(n % 3 == 1, F.concat(F.lit("XIC(a)JSR(R"), n.cast("string"), F.lit(");"))).otherwise("NOP();")
    return _table(spark, sf_dir, "part").select("p_partkey", ladder.jsr_target(rung).alias("target"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = windows.windowed(events, "at", "1 hour", "2 days", ["user_id"], [F.count(F.lit(1)).alias("n")], slide="1 day")
    return found.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = windows.sessions(events, "at", "1 hour", "1 day", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def review_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return review.receipts(docs, "doc_id", "text", "n_chars")


def broken_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    given = review.receipts(docs.where("doc_id % 7 <> 0"), "doc_id", "text", "n_chars").withColumn("receipt", F.when(F.col("doc_id") % 5 == 0, F.lit("{}")).otherwise(F.col("receipt")))
    return review.broken_receipts(given, docs.where("doc_id % 11 <> 0"), "doc_id", "text", "n_chars")


def behaviour_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    one = lambda when, name, flow: F.when(when, F.struct(F.lit(name).alias("name"), F.lit(flow).alias("flow")))
    made = [one(n % 2 == 0, "xExecute", "Input"), one(n % 5 == 0, "En_able", "Input"), one(n % 3 != 0, "Done", "Output"), one(F.lit(True), "xBusy", "Output"), one(n % 7 != 0, "Error", "Output"), one(F.lit(True), "udiErrorID", "Output"), one(n % 4 == 0, "Abort", "Input")]
    given = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_compact(F.array(*made))).alias("g")).select("p_partkey", "g.*")
    found = software.behaviour(given, ["p_partkey"])
    return found.select("p_partkey", "model", "match", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "extensions").alias("extensions"))


QUERIES = (
    up_down_counter, unread_one_shot, drive_source, command_run, clamped_command, ledger_advance, ledger_faults, ledger_promotions, broken_histories, unit_inheritance,
    review_dispositions, invalid_reviews, conflicting_parents, merged_nodes, link_index, ranked_groups, ladder_calls, routine_calls, windowed_counts, session_windows,
    review_receipts, broken_receipts, behaviour_signatures,
)

_SCANS = "s AS (SELECT user_id, event_id, ts, event_type = 'click' AS go, event_id % 11 = 0 AS halt, event_id % 3 <> 0 AS held, event_id % 5 <> 0 AS readable, event_id % 7 = 0 AS local FROM events)"
_W = "PARTITION BY user_id ORDER BY ts, event_id"

SQL = {
    "up_down_counter": f"""WITH {_SCANS},
        e AS (SELECT *, CAST(held AND NOT halt AND ROW_NUMBER() OVER ({_W}) > 1 AND NOT COALESCE(LAG(held) OVER ({_W}), false) AS INTEGER) - CAST(go AND NOT halt AND ROW_NUMBER() OVER ({_W}) > 1 AND NOT COALESCE(LAG(go) OVER ({_W}), false) AS INTEGER) AS step,
          SUM(CAST(halt AS INTEGER)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM s),
        c AS (SELECT event_id, CAST(SUM(step) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cv FROM e)
        SELECT event_id, cv, cv >= 2 AS done, false AS overflow, false AS underflow FROM c""",
    "unread_one_shot": f"""WITH {_SCANS}
        SELECT event_id, readable AND held AND NOT COALESCE(LAST_VALUE(CASE WHEN readable THEN held END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS write FROM s""",
    "drive_source": f"""WITH {_SCANS},
        l AS (SELECT *, COALESCE(LAST_VALUE(CASE WHEN halt THEN false WHEN go THEN true END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), false) AS sealed FROM s)
        SELECT event_id, CASE WHEN local THEN 'LOCAL' WHEN readable THEN 'PROGRAM' ELSE 'OPERATOR' END AS source, CASE WHEN local THEN false WHEN readable THEN held ELSE sealed END AS run FROM l""",
    "command_run": f"""WITH {_SCANS}
        SELECT event_id, COALESCE(LAST_VALUE(CASE WHEN NOT (readable AND NOT halt) THEN false WHEN go AND held AND NOT local THEN true END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), false) AS run FROM s""",
    "clamped_command": "SELECT o_orderkey, CAST(trunc(LEAST(GREATEST(o_totalprice / 1000, 10.5), 90.25) * 100) AS INTEGER) AS command FROM orders",
    "ledger_advance": """
        WITH l AS (SELECT c_custkey, 1 AS generation FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 6 = 1),
        m AS (SELECT c.c_custkey, COALESCE(MAX(generation), 0) + 1 AS generation FROM customer c LEFT JOIN l ON c.c_custkey = l.c_custkey WHERE c.c_custkey % 2 = 0 GROUP BY 1)
        SELECT CAST(c_custkey AS VARCHAR) AS key, generation, CASE WHEN generation = 1 THEN 'CREATED' ELSE 'OBSERVED' END AS transition FROM (SELECT * FROM l UNION ALL SELECT * FROM m)""",
    "ledger_faults": """
        WITH d AS (SELECT c_custkey AS n, c_custkey % 5 = 0 AS same FROM customer)
        SELECT n AS directive, CASE WHEN n % 11 = 0 THEN 'arity' ELSE 'overlap' END AS fault FROM d WHERE n % 11 = 0 OR same
        UNION ALL SELECT n, 'unknown_target' FROM d WHERE NOT same
        UNION ALL SELECT n, 'inactive_source' FROM d WHERE n % 10 = 0
        UNION ALL SELECT n, 'predates' FROM d WHERE n % 13 = 0 AND (n % 10 <> 0 OR same)""",
    "ledger_promotions": "SELECT CAST(user_id AS VARCHAR) AS key, 'core-' || CAST(user_id AS VARCHAR) AS core_id, COUNT(*) AS generations, COUNT(*) AS last FROM events GROUP BY user_id",
    "broken_histories": "SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY user_id HAVING MIN(event_id) % 2 <> 0",
    "unit_inheritance": """
        SELECT CAST(p.p_partkey // 100 AS VARCHAR) AS workspace, CAST(p.p_partkey AS VARCHAR) AS tag, f.p_brand AS unit, CASE WHEN p.p_partkey % 100 = 0 THEN 'CONFIRMED' ELSE 'DERIVED' END AS confidence,
          CASE WHEN p.p_partkey % 100 <> 0 THEN CAST(p.p_partkey - 1 AS VARCHAR) END AS inherited_from FROM part p JOIN part f ON f.p_partkey = p.p_partkey // 100 * 100""",
    "review_dispositions": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN q = 1 THEN 'accepted' ELSE 'rejected' END AS disposition FROM documents d LEFT JOIN (SELECT doc_id, MAX(quality) AS q FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""",
    "invalid_reviews": """
        SELECT DISTINCT o_custkey AS key, 'unknown' AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)
        UNION ALL SELECT o_custkey, 'duplicate' FROM orders GROUP BY 1 HAVING COUNT(*) > 1""",
    "conflicting_parents": "SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS parents FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey) > 1",
    "merged_nodes": "SELECT s_nationkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1",
    "link_index": "SELECT user_id, event_type, MAX(event_id) AS event_id FROM events GROUP BY 1, 2",
    "ranked_groups": "SELECT l_suppkey, n, ROW_NUMBER() OVER (ORDER BY n DESC, l_suppkey) AS position FROM (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1)",
    "ladder_calls": """
        WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS n FROM part)
        SELECT p_partkey, 'XIC' AS callee, 0 AS position, 'A' || n AS operand, 'READ' AS access FROM p UNION ALL SELECT p_partkey, 'CPT', 0, 'Out', 'UNKNOWN' FROM p UNION ALL SELECT p_partkey, 'CPT', 1, 'SIN(B' || n || ')', 'UNKNOWN' FROM p
        UNION ALL SELECT p_partkey, 'MOV', 0, 'C[1,2]', 'READ' FROM p UNION ALL SELECT p_partkey, 'MOV', 1, chr(39) || 'x)(' || chr(39), 'WRITE' FROM p""",
    "routine_calls": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'R' || CAST(p_partkey AS VARCHAR) END AS target FROM part",
    "windowed_counts": """
        WITH d AS (SELECT user_id, UNNEST([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) AS day FROM events)
        SELECT user_id, strftime(day, '%Y-%m-%d') AS day, COUNT(*) AS n FROM d GROUP BY user_id, day""",
    "review_receipts": """
        SELECT doc_id, '{"item_count":' || CAST(n_chars AS VARCHAR) || ',"review_sha256":"' || sha256(text) || '","status":"valid"}' AS receipt FROM documents""",
    "broken_receipts": """
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'unexpected' ELSE 'changed' END AS fault FROM documents
        WHERE CASE WHEN doc_id % 7 = 0 THEN doc_id % 11 <> 0 ELSE doc_id % 11 = 0 OR doc_id % 5 = 0 END""",
    "behaviour_signatures": """
        WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS e, p_partkey % 5 = 0 AS l, p_partkey % 3 <> 0 AS d, p_partkey % 7 <> 0 AS r, p_partkey % 4 = 0 AS a FROM part),
        m AS (SELECT *, CASE WHEN e AND l THEN 'AMBIGUOUS' WHEN e THEN 'EDGE_TRIGGERED' WHEN l THEN 'LEVEL_CONTROLLED' ELSE 'NONE' END AS model FROM p)
        SELECT p_partkey, model, CASE WHEN model IN ('AMBIGUOUS', 'NONE') THEN model WHEN model = 'EDGE_TRIGGERED' AND d AND r THEN 'COMPLETE' ELSE 'PARTIAL' END AS match,
          CASE model WHEN 'EDGE_TRIGGERED' THEN concat_ws(',', CASE WHEN NOT d THEN 'Done' END, CASE WHEN NOT r THEN 'Error' END) WHEN 'LEVEL_CONTROLLED' THEN concat_ws(',', 'Valid', CASE WHEN NOT r THEN 'Error' END) ELSE '' END AS missing,
          CASE WHEN a AND model IN ('EDGE_TRIGGERED', 'LEVEL_CONTROLLED') THEN 'Abort' ELSE '' END AS extensions FROM m""",
    "session_windows": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS starts FROM events),
        s AS (SELECT user_id, SUM(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g),
        c AS (SELECT user_id, session, COUNT(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, COUNT(*) AS sessions, MAX(n) AS longest FROM c GROUP BY 1""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
