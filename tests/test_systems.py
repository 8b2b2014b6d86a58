"""Documents, archives, stores, gateways, graphs and devices on small cases."""

import hashlib
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import assembly, gateway, topology
from assayer.sources import archives, documents, manifest, revisions

# ---- documents

HARD = """<?xml version="1.0" encoding="UTF-8"?>
<!-- before --><?tool a="1"?><r xmlns="urn:d" xmlns:p="urn:p" b="2" a='1 &quot;"'>head <p:x p:k="&#10;tab&#9;"/><![CDATA[a < b & c]]> tail
  <mixed>one<b>two</b>three<b/>four</mixed><empty></empty>&#13;<deep><deep><deep>é \U0001f600</deep></deep></deep><!-- in --></r><!-- after -->"""


def test_documents_are_written_as_they_were(spark, tmp_path):
    (tmp_path / "a.XML").write_text(HARD, encoding="utf-8")
    (tmp_path / "b.xml").write_text("<only/>")
    (tmp_path / "c.xml").write_bytes("﻿<r>bom</r>".encode())
    rows = documents.read_documents(spark, str(tmp_path), "xml")
    before = {r["document"]: r["digest"] for r in documents.document_digests(spark, str(tmp_path), "xml").collect()}
    after = {r["document"]: r["digest"] for r in documents.digests_of(documents.written(rows)).collect()}
    assert len(before) == 3 and before == after
    kinds = {r["kind"]: r["n"] for r in rows.where("document like '%a.XML'").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["comment"] == 3 and kinds["instruction"] == 1 and kinds["element"] == 9
    strange = documents.unknown_content(rows, {"r": ("a", "xmlns"), "mixed": (), "b": (), "empty": (), "deep": ()})
    assert sorted((r["element"], r["attribute"] or "") for r in strange.where("document like '%a.XML'").collect()) == [("p:x", ""), ("r", "b"), ("r", "xmlns:p")]


# ---- archives


def entry(i, size=0):
    return f'<Single Type="{{t{i}}}" Method="m">\n  <Single Name="MetaObject"><Single Name="Name">V{i}</Single></Single><Single Name="Object"><Single Name="Text">{"x" * size}<Single/></Single></Single></Single>'


@pytest.mark.parametrize("split", [64, 333, 1 << 20])
def test_every_record_is_read_once_wherever_ranges_end(tmp_path, monkeypatch, split):
    monkeypatch.setattr(archives, "BLOCK", 100)
    whole = "<ExportFile><Single Name='P'/><List2>" + "\n".join(entry(i, i * 7 % 200) for i in range(60)) + "</List2></ExportFile>"
    path = tmp_path / "a.export"
    path.write_text(whole)
    found = [r for at in range(0, len(whole), split) for r in archives.records(str(path), at, min(at + split, len(whole)))]
    assert [raw.decode() for _, raw in found] == [entry(i, i * 7 % 200) for i in range(60)]
    assert [at for at, _ in found] == [whole.index(entry(i, i * 7 % 200)) for i in range(60)]


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "long.export", "w") as f:
        f.write("<ExportFile><List2>")
        for i in range(3000):
            f.write(entry(i, 5000))
        f.write("</List2></ExportFile>")
    rows = archives.read_archives(spark, str(tmp_path), split_bytes=1 << 20)
    assert rows.rdd.getNumPartitions() >= 15
    named = rows.select("name", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["name"] for r in named) == sorted(f"V{i}" for i in range(3000))
    assert len({r["task"] for r in named}) >= 15
    one = rows.where("name = 'V77'")
    assert [r["name"] for r in one.collect()] == ["V77"]
    (tmp_path / "open.export").write_text("<List2>" + entry(1)[:-9])
    with pytest.raises(Exception, match="isn't closed"):
        rows = archives.read_archives(spark, str(tmp_path)).count()


def test_many_small_archives_are_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.export").write_text("<List2>" + entry(2 * i, 900) + entry(2 * i + 1, 400) + "</List2>")
    rows = archives.read_archives(spark, str(tmp_path), split_bytes=500)
    assert rows.rdd.getNumPartitions() == 1
    assert sorted(r["name"] for r in rows.collect()) == sorted(f"V{i}" for i in range(600))
    parts = archives.shares([("a", 10), ("b", 0), ("c", 40 << 20)], 1 << 19)
    assert [r for p in parts for r in p if r[0] != "c"] == [("a", 0, 10)] and max(sum(e - s for _, s, e in p) for p in parts) <= archives.BLOCK
    cut = [r[1:] for p in parts for r in p if r[0] == "c"]
    assert cut[0][0] == 0 and cut[-1][1] == 40 << 20 and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))


def test_archives_of_no_records(spark, tmp_path):
    (tmp_path / "none.export").write_text("<ExportFile/>")
    (tmp_path / "empty.export").write_text("")
    assert archives.visual_elements(archives.read_archives(spark, str(tmp_path))).count() == 0


# ---- corpora


def test_only_new_and_changed_files_are_opened(spark, tmp_path):
    folder, store = tmp_path / "files", str(tmp_path / "runs")
    folder.mkdir()
    opened = tmp_path / "opened"
    opened.mkdir()
    log = str(opened)

    def rows_of(path, content):
        with open(f"{log}/{os.path.basename(path)}-{time.time_ns()}", "w"):
            pass
        yield from ({"word": w} for w in content.decode().split())

    def run():
        for f in opened.iterdir():
            f.unlink()
        counts = manifest.update(spark, f"file://{folder}", "*.txt", store, rows_of, "word string")
        words = sorted((os.path.basename(r["path"]), r["word"]) for r in manifest.corpus(spark, store).collect())
        return counts, sorted(re.sub(r"-\d+$", "", f.name) for f in opened.iterdir()), words

    for name, text in (("a.txt", "one two"), ("b.txt", "three"), ("c.txt", "six"), ("d.bin", "no"), ("f.txt", "")):
        (folder / name).write_text(text)
    counts, parsed, words = run()
    assert counts == {"new": 3, "read": 3, "parsed": 3} and parsed == ["a.txt", "b.txt", "c.txt"]
    assert words == [("a.txt", "one"), ("a.txt", "two"), ("b.txt", "three"), ("c.txt", "six")]
    counts, parsed, same = run()
    assert counts == {"same": 3, "read": 0, "parsed": 0} and parsed == [] and same == words
    (folder / "a.txt").write_text("four")  # changed
    (folder / "b.txt").unlink()  # gone
    (folder / "e.txt").write_text("five")  # new
    os.utime(folder / "c.txt", (1, 1))  # touched, with the same bytes
    counts, parsed, words = run()
    assert counts == {"touched": 2, "gone": 1, "new": 1, "read": 3, "parsed": 2} and parsed == ["a.txt", "e.txt"]
    assert words == [("a.txt", "four"), ("c.txt", "six"), ("e.txt", "five")]
    known = {os.path.basename(r["path"]): r["sha256"] for r in manifest.manifest(spark, store).collect()}
    assert known == {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in ("a.txt", "c.txt", "e.txt")}


# ---- revisions


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    state = lambda n, tail=0: spark.createDataFrame([(k, list(range(n)) + [tail] * (tail > 0)) for k in "abc"], "key string, history array<long>").repartition(3)
    assert revisions.load(spark, path) is None
    assert revisions.save(state(2), path, 0, "key", "history") == 1
    # Both have started from revision 1: the second one's tasks have written when the first publishes.
    late = revisions.RevisionWriter({"path": path, "expectedrevision": "1"}, None)
    import pyarrow as pa

    part = late.write(iter([pa.RecordBatch.from_pydict({"key": ["lost"]})]))
    assert revisions.save(state(3), path, 1, "key", "history") == 2
    with pytest.raises(revisions.StaleRevision):
        late.commit([part])
    with pytest.raises(revisions.StaleRevision):
        revisions.save(state(4), path, 1)
    with pytest.raises(revisions.BrokenHistory):
        revisions.save(state(1, 9), path, 2, "key", "history")
    assert sorted((r["key"], len(r["history"])) for r in revisions.load(spark, path).collect()) == [("a", 3), ("b", 3), ("c", 3)]
    assert revisions.load(spark, path, 1).agg(F.max(F.size("history"))).first()[0] == 2
    assert len([n for n in os.listdir(path) if n.startswith("parts-")]) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        revisions.save(bad, path, 0)
    assert revisions.last_revision(path) == 0 and not [n for n in os.listdir(path) if n.startswith("parts-")]


# ---- gateways


def plain_identifiers(raw):
    out, at = [], 0
    while at < len(raw):
        o = raw[at]
        if o & 0x30:
            n = ((o & 15) + 1) * (2 if o & 64 else 1)
            out.append((at, 1, n if o & 16 else 0, n if o & 32 else 0))
            at += 1
            continue
        size = lambda i: ((raw[i] & 63) + 1) * (2 if raw[i] & 64 else 1) if i < len(raw) else 0
        has_out, has_in = o >> 7 & 1, o >> 6 & 1
        taken = 1 + has_out + has_in + (0 if o & 15 == 15 else o & 15)
        out.append((at, taken, size(at + 1 + has_out) if has_in else 0, size(at + 1) if has_out else 0))
        at += taken
    return out


def test_identifiers_of_every_first_byte(spark):
    rows = [(f"{o:02x}{(o * 7) % 256:02X}{(o * 13) % 256:02x}1131" * (1 + o % 3),) for o in range(256)] + [("",), ("c0",), ("C041",)]
    df = spark.createDataFrame(rows, "stream string")
    for r in df.select("stream", gateway.identifiers(F.col("stream")).alias("ids")).collect():
        raw = bytes.fromhex(r["stream"])
        assert [(x["at"], x["taken"], x["inputs"], x["outputs"]) for x in r["ids"]] == plain_identifiers(raw)
        assert all(x["whole"] == (x["at"] + x["taken"] <= len(raw)) for x in r["ids"])


def test_slots_of_odd_devices(spark):
    devices = spark.createDataFrame([("none", "K", None), ("short", "K", "11"), ("left", "K", "1121"), ("noslots", "K", "11")], "device string, kind string, stream string")
    slots = spark.createDataFrame([("none", 1, "A"), ("short", 1, "A"), ("short", 2, "B"), ("short", 3, "X"), ("left", 5, "X")], "device string, slot int, module string")
    modules = spark.createDataFrame([("K", "A", "11"), ("K", "B", "2122")], "kind string, module string, configuration string")
    each, left = gateway.aligned_slots(devices, slots, modules, "device", "kind")
    found = {(r["device"], r["slot"]): (r["at"], r["taken"], r["input_at"], r["fault"]) for r in each.collect()}
    assert found == {("none", 1): (0, "", 0, "beyond_end"), ("short", 1): (0, "11", 0, None), ("short", 2): (1, "", 2, "beyond_end"), ("short", 3): (1, "", 2, "beyond_end"), ("left", 5): (0, "11", 0, "unknown_module")}
    assert {r["device"]: (r["at"], r["left"]) for r in left.collect()} == {"left": (1, "21"), "noslots": (0, "11")}


def test_points_of_a_hot_station(spark):
    n = 3000
    points = spark.createDataFrame([(i, "s", 1 if i % 3 else i, "Input", "P", i % 100) for i in range(n)] + [(n, None, 1, "Input", "P", 0), (n + 1, "s", None, "Input", "P", 0), (n + 2, "s", 1, "Both", "P", 0), (n + 3, "s", 1, "Output", "P", 0), (n + 4, "s", 1, "Input", None, 0), (n + 5, "s", 2, "Input", "P", 0)], "point long, scope string, station int, direction string, name string, offset int")
    stations = spark.createDataFrame([("s", 1, "D"), ("s", 1, "D"), ("s", 2, "E"), ("s", 2, "F")], "scope string, station int, base string")
    tags = spark.createDataFrame([("s", b, "T") for b in "DEF"], "scope string, base string, data_type string")
    members = spark.createDataFrame([("s", "T", "Input", "P")], "scope string, data_type string, direction string, name string")
    blocks = [("s", "D.Input", 500, 0, 40), ("s", "D.Input", 500, 0, 40), ("s", "D.Input", 700, 30, 30)] + [("s", f"{b}.Input", 0, 0, 10) for b in "EF"]
    transfers = spark.createDataFrame(blocks, "scope string, holder string, assembly_at int, first int, length int")
    found = {r["point"]: (r["status"], r["tag_path"], r["assembly_at"], r["lost_at"]) for r in gateway.points_to_tags(points, stations, tags, members, transfers).collect()}
    assert len(found) == n + 6
    for i in range(n):
        o = i % 100
        if i % 3 or i == 1:
            if o < 30:
                expected = ("corroborated", "D.Input.P", 500 + o, None)
            elif o < 40:
                expected = ("ambiguous", None, None, None)
            elif o < 60:
                expected = ("corroborated", "D.Input.P", 700 + o - 30, None)
            else:
                expected = ("unresolved", None, None, "transfer")
            assert found[i] == expected
        else:
            assert found[i] == ("unresolved", None, None, "station")
    assert [found[n + i] for i in range(3)] + [found[n + 4]] == [("unresolved", None, None, "station")] * 4
    assert found[n + 3] == ("unresolved", None, None, "member") and found[n + 5] == ("ambiguous", None, None, None)


# ---- graphs


def test_a_graph_is_accepted_or_refused_as_a_whole(spark):
    links = [("g", "l1", "A", "n1", 1, "B", "n2"), ("g", "l2", "B", "n2", None, "A", "n1"), ("h", "l1", "A", "n1", 9, "Z", "n3"), ("i", "l1", "A", "n1", 1, "B", "n1")]
    relationships = spark.createDataFrame(links, "g string, link string, source_asset string, source_node string, source_index int, target_asset string, target_node string")
    assets = spark.createDataFrame([(g, a) for g in "ghi" for a in "AB"], "g string, asset string")
    nodes = spark.createDataFrame([(g, f"n{k}", f"t{k}") for g in "ghi" for k in (1, 2)] + [("g", "n2", "t9")], "g string, node string, target string")
    interfaces = spark.createDataFrame([(g, f"t{k}", k) for g in "ghi" for k in (1, 2)], "g string, target string, index int")
    got = [sorted(tuple(r) for r in t.collect()) for t in topology.accepted_graphs(relationships, assets, nodes, interfaces, "g")]
    assert got[0] == [("g", "A", ["n1"]), ("g", "B", ["n2"])]
    assert got[1] == [("g", "A", "t1", 1), ("g", "B", "t2", 2)]
    assert sorted(got[2], key=str) == [("g", "l1", "A", "B", "A|t1|1"), ("g", "l2", "B", "A", None)]
    assert got[3] == [("h", "unknown_asset", "Z"), ("h", "unknown_node", "n3"), ("h", "unobserved_interface", "l1"), ("i", "claimed_twice", "n1:1")]


def test_repeated_rows_of_a_graph_are_one_without_grouping_its_interfaces(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(topology, "stored", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().optimizedPlan().toString()}), df)[1])
    links = [("g", f"l{i}", "A", "n1", 1, "B", "n2") for i in range(3)]
    relationships = spark.createDataFrame(links, "g string, link string, source_asset string, source_node string, source_index int, target_asset string, target_node string")
    assets = spark.createDataFrame([("g", a) for a in "ABA"], "g string, asset string")
    nodes = spark.createDataFrame([("g", f"n{k}", f"t{k}") for k in (1, 2, 1, 2)], "g string, node string, target string")
    interfaces = spark.createDataFrame([("g", f"t{k}", k) for k in (1, 2, 1)], "g string, target string, index int")
    got = [sorted(tuple(r) for r in t.collect()) for t in topology.accepted_graphs(relationships, assets, nodes, interfaces, "g")]
    assert got[1] == [("g", "A", "t1", 1), ("g", "B", "t2", 2)] and len(got[2]) == 3 and got[3] == []
    plan = plans["graph-interfaces"]
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]


# ---- devices


def test_the_first_provider_that_knows_a_device_wins(spark):
    drive = assembly.definition_provider("drive", "Dvc", "Drive", "M1", "Maker")
    rows = [(1, "definition", "DVC", "drive "), (1, "module", "m", None), (1, "parameter", "p", "1"), (1, "parameter", "q", "1"), (2, "definition", "Dvc", "drive"), (2, "module", "m", None), (2, "module", "k", None), (3, "definition", "Dvc", "Drive"), (4, "module", None, None), (None, "module", "z", None)]
    df = spark.createDataFrame(rows, "device long, kind string, name string, value string").withColumn("more", F.lit(1))
    found = {r["device"]: tuple(r)[1:] for r in assembly.assembled(df, [drive, assembly.AnyModule]).collect()}
    assert found == {1: ("drive", "M1", "Maker", "m", 2), 2: ("any_module", None, None, "k", 0), None: ("any_module", None, None, "z", 0)}
    assembly.register(spark, "any_device", [assembly.AnyModule])
    df.createOrReplaceTempView("evidence")
    assert {r["device"] for r in spark.sql("SELECT * FROM any_device(TABLE(evidence))").collect()} == {1, 2, None}
    # What providers only count reaches them as one row a device.
    many = df.union(df.sparkSession.range(5000).selectExpr("1", "'parameter'", "concat('x', id)", "'1'", "1"))
    assert {r["device"]: r["parameters"] for r in assembly.assembled(many, [drive, assembly.AnyModule]).collect()} == {1: 5002, 2: 0, None: 0}
    seen = type("Seen", (assembly.AnyModule,), {"see": lambda self, row: (setattr(self, "n", getattr(self, "n", 0) + 1), assembly.AnyModule.see(self, row))[0], "answer": lambda self: {"model": str(self.n), "maker": None, "module": None, "parameters": self.parameters}})
    assert [(r["model"], r["parameters"]) for r in assembly.assembled(many.where("device = 1"), [seen]).collect()] == [("3", 5002)]
    with pytest.raises(Exception, match="no column value"):
        assembly.assembled(df.drop("value"), [drive]).collect()
