"""Ledgers, binary replies and units."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assayer.operators import lifecycle, units
from assayer.sources import captures

DIRECTIVE = "directive int, transition string, sources array<string>, targets array<string>, directed_at timestamp"


def day(n):
    return datetime(2024, 1, n)


def test_ledger(spark, tmp_path):
    ledger = spark.createDataFrame([("a", 1, day(1)), ("a", 2, day(2)), ("b", 1, day(1))], "key string, generation long, observed_at timestamp")
    accepted = spark.createDataFrame([("a", day(3)), ("c", day(3))], "key string, observed_at timestamp")
    none = spark.createDataFrame([], DIRECTIVE)
    new = lifecycle.advance(ledger, accepted, none)
    assert sorted((r["key"], r["generation"], r["transition"]) for r in new.collect()) == [("a", 1, "CREATED"), ("a", 2, "OBSERVED"), ("a", 3, "OBSERVED"), ("b", 1, "CREATED"), ("c", 1, "CREATED")]
    retired = spark.createDataFrame([(1, "supersede", ["a"], ["b"], day(2))], DIRECTIVE)
    with pytest.raises(Exception, match="retired identity"):
        lifecycle.advance(ledger, accepted, retired).collect()
    with pytest.raises(Exception, match="accepted twice"):
        lifecycle.advance(ledger, accepted.union(accepted), none).collect()
    asked = spark.createDataFrame(
        [(1, "supersede", ["a"], ["c"], day(5)), (2, "merge", ["a"], ["c"], day(5)), (3, "split", ["a"], ["a", "c"], day(5)), (4, "supersede", ["b"], ["c"], day(2)), (5, "supersede", ["x"], ["y"], day(5)), (6, "odd", ["a"], ["c"], day(5))], DIRECTIVE
    )
    faults = lifecycle.directive_faults(asked, new.select("key", "generation", "observed_at"), spark.createDataFrame([], "key string"))
    assert sorted((r["directive"], r["fault"]) for r in faults.collect()) == [(2, "arity"), (3, "overlap"), (4, "predates"), (5, "inactive_source"), (5, "unknown_target"), (6, "arity")]
    before = lifecycle.promotions(ledger, ledger.select("key").distinct())
    after = lifecycle.promotions(new, new.select("key").distinct())
    assert lifecycle.broken_histories(before, after).count() == 0
    assert sorted(r["key"] for r in lifecycle.broken_histories(after, before).collect()) == ["a", "c"]
    folder = str(tmp_path / "state")
    assert lifecycle.save_revision(before, folder, 0) == 1
    with pytest.raises(Exception, match="(?i)exists"):
        lifecycle.save_revision(after, folder, 0)
    assert lifecycle.load_revision(spark, folder, 1).count() == 2


def test_identity_replies(spark):
    name = "Größe".encode()
    whole = struct.pack("<HHHBBHI", 1, 12, 166, 35, 2, 0x60, 0xDEADBEEF) + bytes([len(name)]) + name + b"\x03\x34\x12\x07"
    rows = spark.createDataFrame([(0, whole), (1, whole[:14]), (2, whole[:18]), (3, whole[: 15 + len(name)]), (4, None), (5, whole[:14] + b"\x01\xff")], "i int, payload binary")
    found = {r["i"]: r for r in rows.select("i", *[c.alias(n) for n, c in captures.identity(F.col("payload")).items()]).collect()}
    assert found[0].asDict() == {"i": 0, "vendor_id": 1, "device_type": 12, "product_code": 166, "major": 35, "minor": 2, "status": 0x60, "serial_number": 0xDEADBEEF, "product_name": "Größe", "state": 3, "consistency_value": 0x1234, "heartbeat_interval": 7, "fault": None}
    assert [found[i]["fault"] for i in range(1, 6)] == ["too_short", "name_exceeds_payload", None, "too_short", "name_not_utf8"]
    assert (found[3]["product_name"], found[3]["state"]) == ("Größe", None)


def test_symbol_pages(spark):
    record = lambda i, n: struct.pack("<IH", i, len(n)) + n + struct.pack("<HIIIIII", 0xC4, 1, 2, 3, 4, 0, 0)
    page = record(7, b"Program:Main") + record(9, b"Tag_1")
    rows = spark.createDataFrame([("p", page), ("q", page[:-3]), ("r", b"")], "page_id string, payload binary")
    symbols = captures.symbol_pages(rows).persist()
    assert sorted((r["page_id"], r["instance_id"] or -1, r["name"], r["fault"] is None) for r in symbols.collect()) == [("p", 7, "Program:Main", True), ("p", 9, "Tag_1", True), ("q", -1, None, False), ("q", 7, "Program:Main", True)]
    assert sorted((r["page_id"], r["capability"], r["name"]) for r in captures.inventory_items(symbols).collect()) == [("p", "programs", "Main"), ("p", "tags", "Tag_1"), ("q", "programs", "Main")]
    fields = captures.declared_fields(F.lit(b"\x01\x02\x03\x04"), [("a", 0, 2), ("b", 3, 1)])
    got = spark.range(1).select(*[c.alias(n) for n, c in fields.items()]).first()
    assert (got["a"], got["b"], [(u["offset"], bytes(u["bytes"])) for u in got["unclaimed"]]) == (0x0201, 4, [(2, b"\x03")])


def test_units_follow_the_order_of_the_rungs(spark):
    tags = spark.createDataFrame([("w", t, u, c) for t, u, c in (("a", "bar", "CONFIRMED"), ("b", None, None), ("c", None, None), ("d", "psi", "INFERRED"), ("e", None, None))], "workspace string, tag string, unit string, confidence string")
    pairs = spark.createDataFrame([("w", 1, "b", "c"), ("w", 2, "a", "b"), ("w", 3, "d", "e"), ("w", 4, "a", "d"), ("w", 5, "a", "none")], "workspace string, place int, left string, right string")
    found = {r["tag"]: (r["unit"], r["confidence"], r["inherited_from"], r["conflicts"]) for r in units.inherited_units(tags, pairs).collect()}
    assert found == {"a": ("bar", "CONFIRMED", None, []), "b": ("bar", "DERIVED", "a", []), "c": (None, None, None, []), "d": ("psi", "INFERRED", None, ["psi <> bar"]), "e": ("psi", "INFERRED", "d", [])}
