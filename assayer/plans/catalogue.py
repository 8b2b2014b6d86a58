"""The operators applied to the driver's tables. Their SQL twins are in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, hashing, text
from ..operators import aggregate, evidence_json, ordering, reconcile, resolve, review, scan_cycle, topology, tree
from ..streaming import windows
from . import oracles, report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    return resolve.resolve_unique(customers, suppliers, {"c_nationkey": "s_nationkey"}, "s_suppkey").select("c_custkey", "match_count", "s_suppkey", "status")


def scoped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("scope"), (F.col("l_partkey") % 50).alias("name"))
    inner = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scope"), F.col("s_nationkey").cast("long").alias("name"), F.col("s_name").alias("definition"))
    outer = _table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("definition"))
    return resolve.scoped_lookup(refs, inner, outer, "scope", "name", "definition").select("l_orderkey", "l_linenumber", "definition", "resolved_scope")


def bound_unbound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    bindings = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    bound, unbound = resolve.split_bound(orders, bindings, "c_custkey")
    edges = bound.groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bound").alias("kind"), "c_nationkey", "o_orderpriority", "n")
    rest = unbound.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unbound").alias("kind"), F.lit(None).cast("int").alias("c_nationkey"), "o_orderpriority", "n")
    return edges.union(rest)


def colocation_cause_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("line"), "l_partkey", "l_returnflag")
    effects, causes = lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")
    return aggregate.co_located(effects, causes, ["l_orderkey", "line"], "l_partkey")


def relationship_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return aggregate.with_relationship_key(lines, ["order", "line", "flag"])


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("domain"), F.col("o_orderkey").alias("key"), "o_orderpriority", "o_orderstatus")
    changed = F.when(F.col("key") % 7 == 0, F.lit("0-CHANGED")).otherwise(F.col("o_orderpriority"))
    return orders.where("key % 10 <> 1"), orders.where("key % 10 <> 2").withColumn("o_orderpriority", changed)


def drift_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.drift(*_snapshots(spark, sf_dir), "domain", "key", ["o_orderpriority", "o_orderstatus"])


def drift_domain_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [reconcile.complete_in_both(t, "domain", [0, 1, 2], [1, 2, 3]) for t in _snapshots(spark, sf_dir)]
    return reconcile.drift(*sides, "domain", "key", ["o_orderpriority", "o_orderstatus"])


def drift_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.sanitized(drift_full_outer(spark, sf_dir), ["domain", "key"]).select("reference", "domain", "finding")


def inventory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    ordering_ = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 100).alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    return reconcile.reconcile(customers, ordering_, ["key"])


def _field_pairs() -> dict:
    return {"price": (F.col("o_totalprice") > 100_000, F.col("lines") > 4), "priority": (F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")), F.lit("1-URGENT")), "status": (F.col("o_orderstatus"), F.col("l_linestatus"))}


def field_comparison_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.max("l_linestatus").alias("l_linestatus"))
    joined = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus").join(lines, "o_orderkey", "left")
    out = reconcile.compare_fields(_field_pairs())
    return joined.select("o_orderkey", *[F.concat_ws(",", out[c]).alias(c) for c in ("matched", "conflicting", "unavailable")], out["status"].alias("status"))


def key_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit(None).cast("string"), F.lit("Disabled"), F.lit("Exact"), F.lit("Compatible")), (F.col("p_partkey") % 4 + 1).cast("int"))
    fields = {"size": (F.col("p_size") % 2, F.lit(0)), "price": (F.when(F.col("p_retailprice") > 1500, F.col("p_retailprice") > 1700), F.lit(True))}
    verdict = reconcile.key_verdict(mode, fields, {"size": fields["size"]})
    return _table(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"))


def theta_identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    nation = (F.col("c_nationkey"), F.col("s_nationkey"))
    by_number = [nation, (F.col("c_custkey") % 100, F.col("s_suppkey") % 100)]
    by_balance = [nation, (F.floor(F.col("c_acctbal") / 100), F.floor(F.col("s_acctbal") / 100))]
    both, left, right = reconcile.any_basis_match(customers, suppliers, "c_custkey", "s_suppkey", [by_number, by_balance])
    none = F.lit(None).cast("long")
    return both.union(left.select("c_custkey", none)).union(right.select(none, "s_suppkey"))


def multi_basis_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("by_key"), F.floor("c_acctbal").alias("by_balance"), F.col("c_nationkey").alias("by_nation"))
    s = _table(spark, sf_dir, "supplier")
    bases = {
        "key": (s.select(F.col("s_suppkey").alias("by_key"), "s_suppkey"), "by_key", "s_suppkey"),
        "balance": (s.select(F.floor("s_acctbal").alias("by_balance"), "s_suppkey"), "by_balance", "s_suppkey"),
        "nation": (s.select(F.col("s_nationkey").alias("by_nation"), "s_suppkey"), "by_nation", "s_suppkey"),
    }
    return reconcile.multi_basis(nodes, "c_custkey", bases).select("c_custkey", "identity", F.concat_ws(",", "bases").alias("bases"))


def topology_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.nullif(F.col("event_id") % 4, F.lit(0)).alias("interface"), F.upper(F.col("event_type")).alias("peer"), "event_id")
    near = events.where("event_id % 2 = 0").withColumnRenamed("peer", "chassis")
    seen = events.where("event_id % 3 = 0").select("target", "interface", F.lower("peer").alias("mac"))
    return topology.correlate(near, seen)


def channel_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 8 + 1).alias("channels"))
    used = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 16).cast("int").alias("channel")).agg(F.min("l_partkey").alias("assigned"))
    return report.channel_states(modules, used, ["s_suppkey"], "channels", "assigned").select("s_suppkey", "channel", "assigned", F.col("status").alias("state"))


def module_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.channel_counts(channel_expansion(spark, sf_dir).withColumnRenamed("state", "status"), ["s_suppkey"])


def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = pages.select(F.regexp_extract("url", r"^(https?://[a-z]*\.)", 1).alias("prefix")).union(pages.select(F.regexp_extract("url", r"^(https?://)", 1))).where("prefix <> ''").distinct()
    twice = rules.union(rules.where("prefix = 'https://www.'"))
    return resolve.longest_prefix(pages, "url", "page_id", twice, "prefix").select("page_id", "prefix", "prefix_count")


FAMILIES = (("1.3.1", "standard"), ("1.3", "general"), ("1.4", "other-known"))


def _dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.lit("1"), (F.col("p_size") % 6).cast("string"), (F.col("p_partkey") % 20).cast("string")).alias("oid"))


def prefix_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = aggregate.family_of(F.col("oid"), FAMILIES, F.concat(F.lit("branch."), F.element_at(F.split("oid", r"\."), 2)))
    return _dotted(spark, sf_dir).groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


def family_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    return aggregate.merge_counts(maps, "counts", "event_type")


KINDS = {"steel": ("steel", "brushed"), "large": ("large", "jumbo", "big"), "first": ("1", "part", "promo")}


def lexical_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = text.classified(F.concat_ws(" ", "p_name", "p_type"), KINDS)
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", kinds).alias("kinds"))


def identifier_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifier_extraction_whole(spark, sf_dir)


def identifier_extraction_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("identifier"))
    by_doc = words.groupBy("identifier", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("identifier").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


def unit_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), "p_brand", F.lit(")  "))).otherwise(F.lit(" (x) tail")))
    return _table(spark, sf_dir, "part").select("p_partkey", text.unit_suffix(described).alias("unit"))


def pointer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", evidence_json.select_pointer(F.col("props"), "#/k").cast("long").alias("k"))


def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = evidence_json.flatten(_table(spark, sf_dir, "events"), "event_id", "props")
    return nodes.where("kind = 'scalar'").select(F.col("doc").cast("long").alias("event_id"), "pointer", "scalar")


def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    after = F.when(k % 3 == 0, F.concat(F.lit('{"k": '), (k + 1).cast("string"), F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "new": {"deep": [1, 2]}}'))).otherwise(F.lit("{}"))
    changed = events.select("event_id", after.alias("props"))
    found = evidence_json.compare_documents(events, changed, "event_id", "props")
    return found.select(F.col("doc").cast("long").alias("event_id"), "operation", "pointer")


def evidence_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return aggregate.inventory(events, "event_type", {"with_value": F.col("value").isNotNull(), "large": F.col("value") > 50, "with_props": F.col("props").isNotNull()})


def coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    return aggregate.coverage(lines, "l_suppkey", F.col("l_returnflag") != "N").withColumn("percent", F.round("percent", 6))


def multiset_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    tokens = events.where("event_id % 3 = 0").select("user_id", "event_type", F.col("event_id").alias("token"))
    return aggregate.consume(events, tokens, ["user_id", "event_type"], ["event_id"], ["token"], "token")


def unique_value_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.unique_value(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


def confidence_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    rank = F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")
    return ordering.best_evidence(orders, ["o_custkey"], rank, "o_orderkey")


def value_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("p_retailprice").cast("decimal(18,2)")
    verdict = report.value_assessment(value, F.array(F.floor("p_retailprice").cast("decimal(18,2)")), F.lit(950), F.lit(1850))
    return _table(spark, sf_dir, "part").select("p_partkey", verdict.alias("assessment"))


def opaque_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.samples(_table(spark, sf_dir, "part"), "p_brand", "p_type").select("p_brand", "n", F.concat_ws("|", "samples").alias("samples"))


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under the part of half their number; some contain themselves, miss their parent or form a ring."""
    p = F.col("p_partkey") + 1
    above = F.when(p % 97 == 0, p).when(p % 89 == 0, p + 10_000_000).when(p % 83 == 0, p + F.when(p % 2 == 0, 1).otherwise(-1)).otherwise(F.floor(p / 2))
    return _table(spark, sf_dir, "part").select(p.alias("node"), above.cast("long").alias("held_in"))


def containment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.containment_issues(_contained(spark, sf_dir), "node", "held_in").select("node", "code")


def root_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _contained(spark, sf_dir).select("node", F.nullif("held_in", F.lit(0)).alias("held_in"))
    return tree.ancestors(nodes, "node", "held_in").where("not in_cycle").select("node", "root", "depth")


def lifecycle_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordering.generations(events, "user_id", "ts", "event_id").select("user_id", "event_id", "generation", "transition")


def active_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return ordering.latest_active(events, "user_id", "ts", "event_id", F.col("event_type") == "click").select("user_id", "event_id", "event_type")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 2).cast("int").alias("quality"))
    given = _table(spark, sf_dir, "labels").select("doc_id", F.nullif("quality", F.lit(0)).cast("int").alias("quality"))
    return review.overlay(docs, given, "doc_id", ["quality"])


def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("doc_id", "quality", "reviewed")


def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir).withColumn("quality", F.nullif("quality", F.lit(0)))
    return review.review_coverage(rows, ["quality"], ["lang"])


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, scan_cycle.Scans]:
    e = _table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("go"), (F.col("event_id") % 11 == 0).alias("halt"), (F.col("event_id") % 3 != 0).alias("held"), (F.col("event_id") % 40 + 10).cast("long").alias("dt"))
    return rows, scan_cycle.Scans("user_id", "ts", "event_id")


def seal_in_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    return rows.select("event_id", scans.latch(F.col("go"), F.col("halt")).alias("run"))


def one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    rows = rows.withColumn("mode", F.col("event_id").bitwiseAND(F.lit(0xFFFF)))
    return scan_cycle.mode_write(rows, scans, "go", "halt", "mode").select("event_id", "write", "mode_out")


def edge_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    return scan_cycle.edge_counter(rows, scans, "held", "halt", 2).select("event_id", "edge", "cv", "q")


def on_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    return scan_cycle.on_delay(rows, scans, "held", "dt", 100).select("event_id", "acc", "done")


def retentive_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scans = _scans(spark, sf_dir)
    return scan_cycle.retentive_timer(rows, scans, "held", "halt", "dt", 120).select("event_id", "et", "q")


def rtc_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scans(spark, sf_dir)[0].withColumn("clock", F.when(F.col("event_id") % 29 != 0, F.unix_millis(F.col("ts").cast("timestamp"))))
    return scan_cycle.rtc_pulse(rows, "user_id", ["ts", "event_id"], "held", "clock", 86_400_000).select("event_id", "pulse")


def adjacent_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return ordering.followed_by(events, "user_id", ["ts", "event_id"], "event_type", ["view", "click"]).select("user_id", "event_id")


def status_nibble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", bits.status_nibble(F.col("o_orderkey") * 37).alias("nibble"))


def command_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04]
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.packed_bits(flags).alias("word"))


def packed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.unhex(F.lpad(F.hex(F.col("o_orderkey") * 2_654_435), 16, "0"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", image.alias("image"))
    return orders.select("o_orderkey", bits.unsigned_le(F.col("image"), 4, 2).alias("low"), bits.signed_le(F.col("image"), 6, 2).alias("high"), bits.bit_of(bits.unsigned_le(F.col("image"), 7, 1), 3).alias("flag"))


def netmask_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    octet = F.element_at(F.array(*[F.lit(x) for x in (0, 128, 192, 224, 240, 248, 252, 254, 255, 37)]), (n % 10 + 1).cast("int")).cast("string")
    mask = F.when(n % 3 == 0, F.concat(F.lit("255.255."), octet, F.lit(".0"))).when(n % 3 == 1, F.concat(F.lit("255."), octet, F.lit(".0.0"))).otherwise(F.concat(F.lit("255.255.255."), octet))
    return _table(spark, sf_dir, "part").select("p_partkey", mask.alias("mask"), bits.netmask_prefix(mask).alias("prefix_length"))


def radix_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    literal = F.when(n % 4 == 0, F.concat(F.lit("16#"), F.hex(n))).when(n % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex(n)))).when(n % 4 == 2, F.concat(F.lit("1_"), F.lpad(n.cast("string"), 6, "0"))).otherwise(F.concat(F.lit("8#9"), n.cast("string")))
    return _table(spark, sf_dir, "part").select("p_partkey", bits.radix_literal(literal).alias("value"))


def fault_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "events").select(F.concat(F.lit("Fault_"), (F.col("user_id") % 9).cast("string"), F.lit("_"), "event_type").alias("name"), F.col("event_id").alias("value"))
    return aggregate.pivot_fields(named, "name", r"^Fault_(\d+)_(\w+)$", "value", ["click", "view", "purchase"])


def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", hashing.manifest_entry(F.col("text")).alias("m"))
    return docs.select("doc_id", "m.sha256", "m.bytes")


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    e = windows.windowed(events, "at", "1 hour", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")])
    return e.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.coalesce(at - F.lag(at).over(w) > 3_600_000_000 * 24, F.lit(True))
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", gap.cast("int").alias("starts"))
    sessions = e.withColumn("session", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return sessions.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def _natural_order(parts: DataFrame) -> DataFrame:
    named = parts.select("p_partkey", F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("name"))
    return ordering.numbered(named.withColumn("key", ordering.natural_key(F.col("name"))), ["key"], "position").select("p_partkey", "position")


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _natural_order(_table(spark, sf_dir, "part"))


def natural_order_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _natural_order(_table(spark, sf_dir, "part"))


QUERIES = (
    unique_resolution, scoped_lookup, bound_unbound_edges, colocation_cause_effect, relationship_key, drift_full_outer, drift_domain_gated, drift_sanitized,
    inventory_reconcile, field_comparison_status, key_verdict, theta_identity_match, multi_basis_correlation, topology_corroboration, channel_expansion,
    module_schedule, longest_prefix_match, prefix_family_counts, family_merge, lexical_classification, identifier_extraction, unit_suffix, pointer_select,
    record_index, structural_diff, evidence_inventory, coverage_percent, multiset_consumption, unique_value_per_group, confidence_argmax, value_assessment,
    opaque_topk, containment_validation, root_chain, lifecycle_generations, active_identities, review_overlay, review_coverage, seal_in_latch, one_shot,
    edge_counter, on_delay, retentive_timer, rtc_pulse, adjacent_pattern, status_nibble, command_word, packed_decode, netmask_prefix, radix_literal,
    fault_pivot, manifest_digest, tumbling_window, session_gaps, rollup_counts, natural_order,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: Names that two queries had while they left rows out.
WHOLE = (identifier_extraction_whole, natural_order_whole)


WHOLE_SQL = {f.__name__: oracles.SQL[f.__name__.removesuffix("_whole")] for f in WHOLE}


def whole_queries() -> dict:
    return {f.__name__: f for f in WHOLE}
