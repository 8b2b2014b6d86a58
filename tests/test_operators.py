"""Operators on small tables whose results are worked out by hand."""

import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer.functions import bits, hashing, ladder, text
from assayer.operators import aggregate, evidence_json, ordering, reconcile, resolve, review, scan_cycle, topology, tree
from assayer.plans import catalogue, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def test_every_query_has_a_twin():
    assert set(catalogue.queries()) == set(oracles.SQL)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", catalogue.queries())
def test_query_equals_its_twin(spark, duck, name):
    def normal(table):
        table = table[sorted(table.columns)]
        cell = lambda x: None if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
        return list(table.columns), sorted([tuple(cell(x) for x in row) for row in table.astype(object).where(table.notna(), None).to_numpy()], key=repr)

    ours, theirs = normal(catalogue.queries()[name](spark, SMALL).toPandas()), normal(duck.sql(oracles.SQL[name]).df())
    assert ours == theirs


def test_resolution(spark):
    refs = spark.createDataFrame([(1, "A"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    table = spark.createDataFrame([("a", 10), ("B", 20), ("b", 21), (None, 9)], "name string, v int")
    assert values(resolve.resolve_unique(refs, table, {"k": "name"}, "v", fold_case=True), "id", "match_count", "v", "status") == [(1, 1, 10, "resolved"), (2, 2, None, "ambiguous"), (3, 0, None, "missing"), (4, 0, None, "no_key")]
    assert values(resolve.resolve_unique(refs, table, {"k": "name"}, "v"), "id", "status") == [(1, "missing"), (2, "resolved"), (3, "missing"), (4, "no_key")]


def test_drift_respects_completeness(spark):
    before = spark.createDataFrame([("hw", 1, "a"), ("hw", 2, None), ("sw", 1, "x")], "d string, k int, v string")
    after = spark.createDataFrame([("hw", 1, "b"), ("hw", 2, None), ("hw", 3, "c")], "d string, k int, v string")
    assert values(reconcile.drift(before, after, "d", "k", ["v"]), "d", "k", "finding") == [("hw", 1, "changed"), ("hw", 3, "added"), ("sw", 1, "removed")]
    gated = [reconcile.complete_in_both(t, "d", ["hw", "sw"], ["hw"]) for t in (before, after)]
    assert values(reconcile.drift(*gated, "d", "k", ["v"]), "k") == [(1,), (3,)]


def test_pairs_of_several_bases_leave_their_joins(spark):
    left = [(1, 1, "x"), (1, 2, "y"), (1, 2, "x"), (2, 2, None), (3, None, "y"), (4, 9, "z"), (5, 1, "x"), (5, 1, "x"), (6, None, None)]
    right = [(10, 1, "x"), (10, 2, "y"), (11, 2, "y"), (12, 1, "q"), (13, None, None), (14, 7, "q"), (12, 2, "x")]
    frames = spark.createDataFrame(left, "a long, n int, t string"), spark.createDataFrame([(k, n, t) for k, n, t in right], "b long, m long, u string")
    bases = [[(F.col("n"), F.col("m"))], [(F.col("t"), F.col("u"))], [(F.col("n"), F.col("m")), (F.col("t"), F.col("u"))]]
    pairs, a, b = reconcile.any_basis_match(*frames, "a", "b", bases)
    expected = {(x[0], y[0]) for x in left for y in right if (x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2] == y[2])}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(expected)
    assert sorted(r[0] for r in a.collect()) == [4, 6] and sorted(r[0] for r in b.collect()) == [13, 14]
    # All pairs are neither stored nor grouped: above the joins there are only unions and projections.
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_exact_key_defers_before_it_rejects(spark):
    df = spark.createDataFrame([("Exact", 1, 2, None), ("Exact", 1, 2, 5), ("Exact", 1, 1, 5), ("Disabled", 1, 2, 5), (None, 1, 1, 5), ("Compatible", 1, 1, 4), ("Compatible", 1, 2, 5)], "mode string, a int, b int, c int")
    fields = {"x": (F.col("a"), F.col("b")), "y": (F.col("c"), F.lit(5))}
    verdict = reconcile.key_verdict(F.col("mode"), fields, {"x": fields["x"]})
    assert [r[0] for r in df.select(verdict).collect()] == ["DEFERRED", "REJECTED", "SATISFIED", "DISABLED", "NOT_CONFIGURED", "DEFERRED", "REJECTED"]


def test_co_location_is_null_safe(spark):
    effects = spark.createDataFrame([("r", 1, None, "E"), ("r", 2, None, "E")], "routine string, rung int, line int, node string")
    causes = spark.createDataFrame([("r", 1, None, "C"), ("r", 2, None, "C"), ("r", 1, 5, "D"), ("r", 1, None, "E")], "routine string, rung int, line int, node string")
    assert values(aggregate.co_located(effects, causes, ["routine", "rung", "line"], "node"), "effect", "cause", "locations") == [("E", "C", 2)]


def test_containment(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 99), (3, 4), (4, 3), (5, 4), (6, 0), (7, 6)], "k long, p long")
    assert values(tree.containment_issues(nodes, "k", "p"), "k", "code") == [(1, "containment_cycle"), (1, "self_parent"), (2, "missing_parent"), (3, "containment_cycle"), (4, "containment_cycle"), (5, "containment_cycle")]
    assert values(tree.valid_edges(nodes, "k", "p"), "p", "k") == [(6, 7)]


def test_json_evidence(spark):
    before = spark.createDataFrame([("d", '{"a": [1, 2], "b": {"x/y": 1}, "c": {"0": 1}, "t": true}')], "doc string, body string")
    after = spark.createDataFrame([("d", '{"a": [1, 3, 4], "c": [1], "n": {"deep": [1]}, "t": 1}')], "doc string, body string")
    a, b = (evidence_json.flatten(t, "doc", "body") for t in (before, after))
    assert values(evidence_json.compare(a, b), "operation", "pointer") == [("add", "/a/2"), ("add", "/n"), ("remove", "/b"), ("replace", "/a/1"), ("replace", "/c"), ("replace", "/t")]
    assert before.select(evidence_json.select_pointer(F.col("body"), "#/b/x~1y"), evidence_json.select_pointer(F.col("body"), "/a/1"), evidence_json.select_pointer(F.col("body"), "/c/0"), evidence_json.select_pointer(F.col("body"), "/none")).first()[:] == ("1", "2", "1", None)
    typed = spark.createDataFrame([("d", '{"p": {"$type": "m.Routine", "name": "R"}, "q": {"$ref": "#/p"}, "r": {"$ref": "#/none"}, "s": {"$ref": "#/z"}, "z": {"$type": "m.Tag"}}')], "doc string, body string")
    nodes = evidence_json.flatten(typed, "doc", "body")
    assert values(evidence_json.records(nodes, "Routine"), "pointer", "name") == [("/p", "R")]
    assert values(evidence_json.inventory(nodes), "record_type", "n") == [("m.Routine", 1), ("m.Tag", 1)]
    assert values(evidence_json.dangling_references(nodes), "target", "reason") == [("/none", "dangling"), ("/z", "forward")]


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(7)
    assert values(ordering.numbered(rows, ["v"]), "v", "n") == sorted(((i, i + 1) for i in range(500)), key=str)
    assert [r[0] for r in spark.createDataFrame([("a10",), ("a2",), ("A1b",)], "s string").orderBy(ordering.natural_key(F.col("s"))).collect()] == ["A1b", "a2", "a10"]
    assert spark.sql("select array(1,2) a, array(1,2,3) b").select(ordering.is_prefix(F.col("a"), F.col("b")), ordering.is_prefix(F.col("b"), F.col("a"))).first()[:] == (True, False)


def scans(spark, rows, names):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], f"device int, n int, {names}")
    return df, scan_cycle.Scans("device", "n")


def test_scan_cycles(spark):
    t, f = True, False
    df, s = scans(spark, [(t, f), (t, f), (t, t), (t, f), (f, f), (t, f)], "up boolean, reset boolean")
    out = scan_cycle.edge_counter(df, s, "up", "reset", 1).orderBy("n").collect()
    assert [(r["edge"], r["cv"], r["q"]) for r in out] == [(f, 0, f), (f, 0, f), (f, 0, f), (t, 1, t), (f, 1, t), (t, 2, t)]
    df, s = scans(spark, [(t, 40), (t, 60), (f, 10), (t, 50)], "req boolean, dt int")
    assert [(r["acc"], r["done"]) for r in scan_cycle.on_delay(df, s, "req", "dt", 100).orderBy("n").collect()] == [(40, f), (100, t), (0, f), (50, f)]
    df, s = scans(spark, [(t, f, 10), (t, f, 30), (f, f, 30), (t, f, 30), (t, f, 80), (t, t, 5)], "on boolean, reset boolean, dt int")
    assert [(r["et"], r["q"]) for r in scan_cycle.retentive_timer(df, s, "on", "reset", "dt", 100).orderBy("n").collect()] == [(0, f), (30, f), (30, f), (30, f), (100, t), (0, f)]
    df, s = scans(spark, [(t, f), (f, t), (f, f), (t, t)], "inh boolean, uninh boolean")
    out = scan_cycle.mode_write(df.withColumn("mode", F.lit(7)), s, "inh", "uninh", "mode").orderBy("n").collect()
    assert [(r["write"], r["mode_out"]) for r in out] == [(t, 7), (f, None), (f, None), (t, 7)]
    df, s = scans(spark, [(t, t, f, f, t), (f, t, f, f, t), (f, t, f, t, t), (t, f, f, f, t)], "cmd boolean, perm boolean, opp boolean, stop boolean, ilk boolean")
    assert [r["run"] for r in scan_cycle.command_run(df, s, "cmd", "perm", "opp", "stop", "ilk").orderBy("n").collect()] == [t, t, f, f]
    df, s = scans(spark, [(t, 0), (t, 900), (t, 1000), (t, 1500), (t, None), (t, 3000), (t, 2000), (t, 4000)], "on boolean, ms long")
    assert [r["pulse"] for r in scan_cycle.rtc_pulse(df, "device", ["n"], "on", "ms", 1000).orderBy("n").collect()] == [f, f, t, f, f, f, f, t]


def test_topology_and_reviews(spark):
    near = spark.createDataFrame([("T", 3, "02:AA"), ("T", None, "02:BB")], "target string, interface int, chassis string")
    seen = spark.createDataFrame([("T", 3, "02:aa"), ("T", None, "02:bb"), ("T", 2, "02:cc")], "target string, interface int, mac string")
    assert values(topology.correlate(near, seen), "peer", "kind", "corroborated") == [("02:aa", "reported_neighbour", True), ("02:bb", "reported_neighbour", True), ("02:cc", "mac_reachability", False)]
    candidates = spark.createDataFrame([(1, "a", None), (2, "b", "u")], "k int, p string, unit string")
    given = spark.createDataFrame([(1, None, "bar"), (9, "x", None), (9, "y", None)], "k int, p string, unit string")
    assert values(review.overlay(candidates, given.where("k = 1"), "k", ["p", "unit"]), "k", "p", "unit", "reviewed") == [(1, "a", "bar", True), (2, "b", "u", False)]
    assert values(review.invalid_reviews(candidates, given, "k"), "k", "reason") == [(9, "duplicate"), (9, "unknown")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.tokens(F.lit("PT102_HHAlarm highTrip"))) == ["pt102", "hhalarm", "high", "trip"]
    assert one(text.identifiers(F.lit("a.b[i] := TRUE AND Local:2:I.x"))) == ["a.b[i]", "AND", "Local:2:I.x"]
    assert one(text.unit_suffix(F.lit("Pressure (psi) "))) == "psi"
    assert [one(text.is_ipv4(F.lit(x))) for x in ("10.0.0.1", "256.0.0.1", "1.2.3", "01.2.3.4")] == [True, False, False, False]
    assert one(text.mac_from_octets(F.lit("2.0.171.255"))) == "02:00:ab:ff"
    assert text.pointer_path("#/a~1b/~0c/%20d") == ["a/b", "~c", " d"]
    assert [c["callee"] for c in ladder.calls_of("XIC(Enable)CPT(Output,SIN(Value))OTE(Done);")] == ["XIC", "CPT", "OTE"]
    assert ladder.calls_of("A(b[1,2],'x,)',(c,d))[B(e) , C()]D(open E(f)") == [{"callee": "A", "operands": ["b[1,2]", "'x,)'", "(c,d)"]}, {"callee": "B", "operands": ["e"]}, {"callee": "C", "operands": []}, {"callee": "E", "operands": ["f"]}]
    assert one(ladder.jsr_target(F.lit("JSR(Sub,0);"))) == "Sub" and one(ladder.jsr_target(F.lit("XIC(a)JSR(Sub,0);"))) is None


def test_bit_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    image = F.unhex(F.lit("0102FFFFFFFFFFFFFFFF0A"))
    assert one(bits.unsigned_le(image, 0, 2)) == 0x0201 and one(bits.signed_le(image, 2, 2)) == -1 and int(one(bits.unsigned_le(image, 2, 8))) == 2**64 - 1 and one(bits.unsigned_le(image, 10, 2)) is None
    assert [(r["offset"], bytes(r["bytes"])) for r in one(bits.unclaimed(image, [(2, 8)]))] == [(0, b"\x01\x02"), (10, b"\x0a")]
    with pytest.raises(ValueError):
        bits.unclaimed(image, [(0, 4), (2, 2)])
    assert [one(bits.netmask_prefix(F.lit(x))) for x in ("255.255.255.0", "0.0.0.0", "255.0.255.0", "x", "255.255.255.255", "255.256.0.0")] == [24, 0, None, None, 32, None]
    assert [one(bits.radix_literal(F.lit(x))) for x in ("16#FF", "0x1f", "1_000", "2#102", "-12", "8#17", "x")] == [255, 31, 1000, None, -12, 15, None]
    assert [one(bits.clamped_command(F.lit(x), 0.0, 60.0)) for x in (99.0, 12.34, -1.0)] == [6000, 1234, 0]
    assert one(bits.status_nibble(F.lit(0xA123))) == 10
    name = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    assert one(hashing.name_uuid(F.lit(str(name)), F.lit("größe"))) == str(uuid.uuid5(name, "größe"))


def test_whole_queries(spark, tmp_path):
    """Neither keys from 2000 on nor identifiers of few mentions are left out."""
    import __spark_entry__

    whole = __spark_entry__.queries()
    keys = [3000, 2, 10, 1999, 2000, 100_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = whole["natural_order_whole"](spark, str(tmp_path)).collect()
    assert sorted((r["position"], r["p_partkey"]) for r in found) == list(enumerate(sorted(keys), 1))
    spark.createDataFrame([(1, "pump_1 valve pump_1"), (2, "pump_1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["identifier"]: (r["n"], r["docs"]) for r in whole["identifier_extraction_whole"](spark, str(tmp_path)).collect()}
    assert found == {"pump_1": (3, 2), "valve": (1, 1)}
