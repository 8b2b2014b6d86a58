"""Nested datatypes against plain walks over the same definitions."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import ladder
from assayer.operators import datatypes, ordering, reconcile, resolve, rules, tree, units
from assayer.storage import stored

MEMBERS = "scope string, data_type string, ordinal int, name string, member_type string, dimension int, target string, bit_number int"


def definitions(seed, n=14, deep=6):
    """Types that hold types of higher number, some over several levels, with arrays, flags and overlays."""
    rng = random.Random(seed)
    rows = []
    for scope in "ab":
        for t in range(n):
            for i in range(rng.randint(1, 5)):
                kind = rng.choice(["BOOL", "SINT", "INT", "dint", "LREAL", "Missing"] + [f"T{x}" for x in range(t + 1, min(n, t + 3))] * 2)
                rows.append((scope, f"T{t}", i, f"m{i}", kind, rng.choice([None, None, 0, 2, 3, 33 if kind == "BOOL" else 1]), None, None))
            rows.append((scope, f"T{t}", 7, "over", "BIT", None, rng.choice(["m0", "nowhere"]), 3))
    return rows


def plain_layout(rows, scope, name, aligned):
    """size, align and {member: offset} of one type."""
    at, most, found = 0, 1, {}
    for _, _, _, member, kind, dimension, target, _ in sorted(r for r in rows if r[:2] == (scope, name)):
        if target is not None:
            found[member] = found.get(target)
            continue
        if kind.upper() == "BOOL" and dimension:
            align, room = 4, -(-dimension // 32) * 4
        elif kind.upper() in datatypes.ATOMIC:
            align = datatypes.ATOMIC[kind.upper()]
            room = align * max(dimension or 1, 1)
        else:
            inner, align, _ = plain_layout(rows, scope, kind, aligned) if any(r[:2] == (scope, kind) for r in rows) else (0, 1, {})
            room = inner * max(dimension or 1, 1)
        align = align if aligned else 1
        most, at = max(most, align), -(-at // align) * align
        found[member] = at
        at += room
    return -(-at // most) * most, most, found


def plain_leaves(rows, scope, name, path="", base=0):
    out = []
    offsets = plain_layout(rows, scope, name, True)[2]
    for _, _, _, member, kind, dimension, target, bit in sorted(r for r in rows if r[:2] == (scope, name)):
        if offsets[member] is None:
            continue
        here = f"{path}.{member}" if path else member
        if target is not None:
            out.append((here, base + offsets[member], bit))
            continue
        for i in range(max(dimension or 1, 1)):
            one = f"{here}[{i}]" if dimension else here
            if kind.upper() == "BOOL" and dimension:
                out.append((one, base + offsets[member] + i // 8, i % 8))
            elif kind.upper() in datatypes.ATOMIC:
                out.append((one, base + offsets[member] + i * datatypes.ATOMIC[kind.upper()], None))
            elif any(r[:2] == (scope, kind) for r in rows):
                out += plain_leaves(rows, scope, kind, one, base + offsets[member] + i * plain_layout(rows, scope, kind, True)[0])
    return out


@pytest.mark.parametrize("aligned", [True, False])
def test_layout_of_nested_types(spark, aligned):
    rows = definitions(3)
    placed, sizes = datatypes.layout(spark.createDataFrame(rows, MEMBERS), ["scope"], aligned)
    expected = {(s, f"T{t}"): plain_layout(rows, s, f"T{t}", aligned) for s in "ab" for t in range(14)}
    assert {(r["scope"], r["data_type"]): (r["size"], r["align"]) for r in sizes.collect()} == {k: v[:2] for k, v in expected.items()}
    found = {(r["scope"], r["data_type"], r["name"]): r for r in placed.collect()}
    assert len(found) == len(rows)
    for (scope, name, member), r in found.items():
        assert r["byte_offset"] == expected[scope, name][2][member]
        assert r["fault"] == ("unknown_type" if r["member_type"] == "Missing" else "unknown_target" if r["target"] == "nowhere" else None)


def test_leaves_of_nested_types(spark):
    rows = definitions(5, 9)
    placed, _ = datatypes.layout(spark.createDataFrame(rows, MEMBERS), ["scope"])
    roots = spark.createDataFrame([("a", "T0"), ("b", "T1"), ("a", "T0"), ("a", "None")], "scope string, root string")
    found = sorted((r["scope"], r["path"], r["byte_offset"], r["bit"] if r["bit"] is not None else -1) for r in datatypes.leaves(placed, roots, ["scope"]).collect())
    expected = sorted((s, p, o, -1 if b is None else b) for s, t in (("a", "T0"), ("b", "T1")) for p, o, b in plain_leaves(rows, s, t))
    assert found == expected


def test_rounds_over_nested_types_write_each_row_once(spark, monkeypatch):
    written = []

    def counted(df, tag, *args, **options):
        out = stored(df, tag, *args, **options)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(datatypes, "stored", counted)
    monkeypatch.setattr(datatypes, "FEW", 3)
    n = 12
    types = spark.createDataFrame([("s", f"T{i}") for i in range(n)] + [("s", "A"), ("s", "B")], "scope string, name string")
    needs = [(f"T{i}", f"T{i - 1}") for i in range(1, n)] + [("T9", "T2"), ("A", "B"), ("B", "A"), ("B", "T1"), ("T3", "Gone")]
    levels, missing = datatypes.dependency_levels(types, spark.createDataFrame([("s", *e) for e in needs], "scope string, name string, needs string"), ["scope"])
    assert {r["name"]: r["level"] for r in levels.collect()} == {f"T{i}": i for i in range(n)} | {"A": None, "B": None}
    assert [r["needs"] for r in missing.collect()] == ["Gone"]
    assert sum(rows for _, rows in written) <= 6 * n
    rows = definitions(2, 5)
    placed, sizes = datatypes.layout(spark.createDataFrame(rows, MEMBERS), ["scope"])
    assert {(r["scope"], r["data_type"]): r["size"] for r in sizes.collect()} == {(s, f"T{t}"): plain_layout(rows, s, f"T{t}", True)[0] for s in "ab" for t in range(5)}
    del written[:]
    found = datatypes.leaves(placed, sizes.select("scope", F.col("data_type").alias("root")), ["scope"]).collect()
    assert sorted((r["scope"], r["root"], r["path"], r["byte_offset"]) for r in found) == sorted((s, f"T{t}", p, o) for s in "ab" for t in range(5) for p, o, _ in plain_leaves(rows, s, f"T{t}"))
    assert not [tag for tag, _ in written if tag == "leaves"]


def test_cyclic_types_are_reported(spark):
    rows = [("a", "X", 0, "y", "Y", None, None, None), ("a", "Y", 0, "x", "X", None, None, None), ("a", "Z", 0, "x", "X", 2, None, None), ("a", "Own", 0, "own", "Own", None, None, None), ("a", "Fine", 0, "n", "INT", None, None, None), ("b", "X", 0, "y", "Y", None, None, None)]
    placed, sizes = datatypes.layout(spark.createDataFrame(rows, MEMBERS), ["scope"])
    state = {(r["scope"], r["data_type"]): (r["state"], r["size"]) for r in sizes.collect()}
    assert state == {("a", "X"): ("cyclic", None), ("a", "Y"): ("cyclic", None), ("a", "Z"): ("cyclic", None), ("a", "Own"): ("cyclic", None), ("a", "Fine"): ("ordered", 2), ("b", "X"): ("ordered", 0)}
    assert {r["data_type"]: r["fault"] for r in placed.where("scope = 'a'").collect()} == {"X": "cyclic", "Y": "cyclic", "Z": "cyclic", "Own": "cyclic", "Fine": None}
    empty, none = datatypes.layout(spark.createDataFrame([], MEMBERS), ["scope"])
    assert empty.count() == none.count() == 0
    assert datatypes.leaves(empty, spark.createDataFrame([], "scope string, root string"), ["scope"]).count() == 0


def test_levels_of_a_graph_with_many_parents(spark):
    rng = random.Random(1)
    edges = [(f"n{i}", f"n{rng.randint(i + 1, 40)}") for i in range(40) for _ in range(2)] + [("n7", "gone"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("above", "c1"), ("n3", "n4"), ("n3", "n4"), ("n5", None)]
    names = [f"n{i}" for i in range(41)] + ["c1", "c2", "c3", "above", "n3"]
    types = spark.createDataFrame([("s", n) for n in names], "scope string, name string")
    levels, missing = datatypes.dependency_levels(types, spark.createDataFrame([("s", *e) for e in edges], "scope string, name string, needs string"), ["scope"])

    def level(n):
        return max([level(b) + 1 for a, b in edges if a == n and b in names], default=0)

    found = {r["name"]: (r["level"], r["state"]) for r in levels.collect()}
    assert found == {n: (level(n), "ordered") if n[0] == "n" else (None, "cyclic") for n in names}
    assert [tuple(r) for r in missing.collect()] == [("s", "n7", "gone")]


def test_paths_through_nested_types(spark):
    members = [("s", f"T{i}", "next", f"T{i + 1}", "3,2" if i == 2 else "4") for i in range(6)] + [("s", "T6", "end", "DINT", None), ("s", "T6", "odd", "DINT", "x"), ("s", "T3", "flag", "BOOL", None), ("t", "T0", "only", "INT", None)]
    table = spark.createDataFrame(members, "scope string, data_type string, name string, member_type string, dimension string")
    deep = ".".join(["next"] * 6)
    cases = {
        1: ("T0", f"{deep}.end", "resolved", "DINT", [], 7, None, []),
        2: ("T0", "next[1].next[2].next[2,1].flag", "resolved", "BOOL", [1, 2, 2, 1], 4, None, []),
        3: ("T0", "next[4].next.next[1].flag", "resolved", "BOOL", [4, 1], 4, None, ["next[4]", "next[1]"]),
        4: ("T3", "flag.more.yet", "through_scalar", None, [], 1, "more", []),
        5: ("T3", "none", "unknown_member", None, [], 0, "none", []),
        6: ("T3", "next[", "not_parsed", None, [], 0, "next[", []),
        7: ("T9", "next", "unknown_type", None, [], 0, None, []),
        8: ("T3", "3.x", "bit", None, [], 0, None, []),
        9: ("T3", "", "empty", None, [], 0, None, []),
        10: ("T3", None, "empty", None, [], 0, None, []),
        11: ("T6", "odd[9]", "resolved", "DINT", [9], 1, None, []),
        12: ("T0", "Next", "unknown_member", None, [], 0, "Next", []),
        13: ("T0", "next[7].none[3]", "unknown_member", None, [7, 3], 1, "none[3]", ["next[7]"]),
    }
    paths = spark.createDataFrame([("s", k, v[0], v[1]) for k, v in cases.items()] + [("t", 99, "T0", "next")], "scope string, id int, data_type string, path string")
    found = {r["id"]: (r["status"], r["resolved_type"], list(r["indices"]), len(r["members"]), r["stopped_at"], list(r["beyond"])) for r in datatypes.walk_paths(paths, table, ["scope"], "id").collect()}
    assert found == {k: v[2:] for k, v in cases.items()} | {99: ("unknown_member", None, [], 0, "next", [])}


def test_values_take_the_type_above_them(spark):
    nodes = [("s", 0, None, "Root", None, "T", None), ("s", 1, 0, "a", None, "DINT", None), ("s", 2, 1, None, "[0]", None, "16#1F"), ("s", 3, 1, None, "[1]", None, "x"), ("s", 4, 0, "b", None, None, "1"), ("s", 5, 0, "c", None, "STRING", "hello")]
    nodes += [("s", 6 + i, 5 + i if i else 0, f"d{i}", None, "REAL" if i == 1 else None, "2.5" if i == 30 else None) for i in range(31)] + [("s", 90, 91, "p", None, None, "1"), ("s", 91, 90, "q", None, None, "1"), ("t", 1, 0, "orphan", None, None, "1")]
    df = spark.createDataFrame(nodes, "scope string, place long, parent_place long, name string, index string, data_type string, value string")
    found = {(r["scope"], r["place"]): (r["path"], r["data_type"], r["whole"], r["real"], r["text"], r["fault"]) for r in datatypes.composite_values(df, ["scope"]).collect()}
    deep = ".".join(["Root", *[f"d{i}" for i in range(31)]])
    assert found == {("s", 2): ("Root.a[0]", "DINT", 31, None, None, None), ("s", 3): ("Root.a[1]", "DINT", None, None, None, "invalid_value"), ("s", 4): ("Root.b", "T", None, None, None, None), ("s", 5): ("Root.c", "STRING", None, None, "hello", None), ("s", 36): (deep, "REAL", None, 2.5, None, None), ("t", 1): ("orphan", None, None, None, None, None)}


def test_operands_by_the_rules_of_tags(spark):
    text = "Line[2].Step[1,Next].Mask.7 Rack:3:I.Data[0].1 A[B[1]].C True _x9 Mod:I.Ch0 9lives [z]"
    found = spark.range(1).select(ladder.operand_paths(F.lit(text)).alias("f")).first()["f"]
    assert found == ["Line[2].Step[1,Next].Mask.7", "Rack:3:I.Data[0].1", "A[B[1]].C", "_x9", "Mod:I.Ch0", "lives", "z"]


def test_cycles_end_the_rounds(spark):
    rows = [(i, i // 2) for i in range(1, 200)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(2000, 1003), (3000, 3000)]
    nodes = spark.createDataFrame(rows, "k long, p long")
    found = {r["k"]: r["in_cycle"] for r in tree.ancestors(nodes, "k", "p").collect()}
    assert found == {k: k >= 1000 for k, _ in rows}


def test_bases_that_many_identities_share(spark):
    nodes = spark.createDataFrame([(i, i % 3, i) for i in range(30)], "n long, shared long, own long")
    shared = spark.createDataFrame([(s, 100 + i) for s in (0, 1) for i in range(50)] + [(2, 7), (2, 7), (2, None)], "shared long, id long")
    own = spark.createDataFrame([(2, 7), (5, 8), (1, 9)], "own long, id long")
    found = {r["n"]: (r["identity"], r["bases"]) for r in reconcile.multi_basis(nodes, "n", {"s": (shared, "shared", "id"), "o": (own, "own", "id")}).collect()}
    assert found == {i: (7, ["o", "s"] if i == 2 else ["s"]) for i in range(2, 30, 3) if i != 5}


def test_prefixes_of_any_number_of_lengths(spark):
    prefixes = spark.createDataFrame([("x" * n + ":",) for n in range(1, 600)] + [("a:b:",), ("a:",), ("twice:",), ("twice:",)], "prefix string")
    rows = spark.createDataFrame([(1, "x" * 550 + ":rest"), (2, "a:b:c:"), (3, "a:c"), (4, "none"), (5, "twice:x"), (6, None), (7, ":")], "id int, text string")
    found = {r["id"]: (r["prefix"], r["prefix_count"]) for r in resolve.longest_prefix(rows, "text", "id", prefixes, "prefix", separator=":").collect()}
    assert found == {1: ("x" * 550 + ":", 1), 2: ("a:b:", 1), 3: ("a:", 1), 4: (None, 0), 5: (None, 2), 6: (None, 0), 7: (None, 0)}
    with pytest.raises(ValueError, match="256 lengths"):
        resolve.longest_prefix(rows, "text", "id", prefixes, "prefix")


def test_statements_by_their_tokens():
    scan = lambda text: [(s["kind"], s["text"], s["line"]) for s in ladder.scan_statements(text)]
    assert scan("") == scan(" ;; \n // only\n") == []
    assert scan("IF a AND (b OR c) THEN x := 1; ELSIF d THEN\n Go(p := 1); END_IF;") == [("control", "IF a AND (b OR c)", 1), ("assignment", "x := 1", 1), ("control", "ELSIF d", 1), ("call", "Go(p := 1)", 2), ("control", "END_IF", 2)]
    assert scan("s := 'it''s; (* no *)'; t := \"a;$\"b\"; (* c;\nd *) u := 2") == [("assignment", "s := 'it''s; (* no *)'", 1), ("assignment", 't := "a;$"b"', 1), ("assignment", "u := 2", 2)]
    assert scan("WHILE i < 3 DO\n REPEAT\n  i := i + 1;\n UNTIL i = 2 END_REPEAT; EXIT; END_WHILE") == [("control", "WHILE i < 3", 1), ("control", "REPEAT", 2), ("assignment", "i := i + 1", 3), ("control", "UNTIL i = 2 END_REPEAT", 4), ("control", "EXIT", 4), ("control", "END_WHILE", 4)]
    assert scan("Timer.Go(a[1;2]); x; A(1)+2; (") == [("call", "Timer.Go(a[1;2])", 1), ("unknown", "x", 1), ("unknown", "A(1)+2", 1), ("unknown", "(", 1)]


def test_units_pass_by_in_a_stream(spark):
    tags = spark.createDataFrame([(w, t, u, c) for w in ("a", "b", None) for t, u, c in (("p", "bar", "CONFIRMED"), ("q", None, None), ("r", None, None), ("s", "psi", "INFERRED"))], "workspace string, tag string, unit string, confidence string")
    pairs = spark.createDataFrame([("a", 2, "q", "r"), ("a", 1, "p", "q"), ("a", 3, "r", "s"), ("a", 4, "r", "gone"), ("b", 1, "q", "r"), ("b", 2, "p", "q"), ("c", 1, "p", "q")], "workspace string, place long, left string, right string")
    found = {(r["workspace"], r["tag"]): (r["unit"], r["confidence"], r["inherited_from"], list(r["conflicts"])) for r in units.inherited_units(tags.repartition(3), pairs.repartition(2)).collect()}
    assert found["a", "q"] == ("bar", "DERIVED", "p", []) and found["a", "r"] == ("bar", "DERIVED", "q", []) and found["a", "s"] == ("psi", "INFERRED", None, ["psi <> bar"])
    assert found["b", "r"] == (None, None, None, []) and found["b", "q"] == ("bar", "DERIVED", "p", []) and found[None, "q"][0] is None and len(found) == 12


def test_rules_for_calls(spark):
    calls = spark.createDataFrame([(1, "cop", 3), (1, "COP", 2), (1, "mine", 9), (2, "mine", 9), (1, None, 0), (1, "abs", None)], "scope int, callee string, arguments int")
    own = spark.createDataFrame([(1, "Mine"), (1, "MINE"), (1, "Cop")], "scope int, name string")
    found = sorted((tuple(r) for r in rules.classified_calls(calls, own, ["scope"]).collect()), key=repr)
    assert found == sorted([(1, "cop", 3, "memory_copy", "Rockwell Automation", True), (1, "COP", 2, "memory_copy", "Rockwell Automation", False), (1, "mine", 9, "user_defined_instruction", None, None), (2, "mine", 9, "unknown", None, None), (1, None, 0, "unknown", None, None), (1, "abs", None, "absolute_value", None, True)], key=repr)


def test_breadth_first_order(spark):
    rows = [(1, None, 5), (2, None, 3), (3, 1, 1), (4, 2, 9), (5, 2, 2), (6, 3, 1), (7, 99, 4), (8, 9, 1), (9, 8, 1), (10, 4, 1)]
    nodes = spark.createDataFrame(rows, "k long, p long, o long")
    found = [(r["k"], r["depth"]) for r in tree.breadth_first(nodes, "k", "p", "o").orderBy("position").collect()]
    assert found == [(2, 0), (7, 0), (1, 0), (5, 1), (4, 1), (3, 1), (10, 2), (6, 2)]
    assert tree.breadth_first(nodes.limit(0), "k", "p", "o").count() == 0


def test_counters_described_in_full(spark):
    texts = ["XIC(U)CTU(C,5,0);", "XIC(U2)CTU(C,5,0);", "XIC(C.DN)OTE(L);", "XIC(R)RES(C);", "XIC(D)CTD(E,1,0);", "XIC(U)CTU(E,1,0);", "XIC(E.DN)OTE(L);", "XIC(R)RES(F);", None]
    rungs = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)] + [("q", i, t) for i, t in enumerate(texts[2:4])], "program string, number int, text string")
    found = [tuple(r) for r in ordering.counter_groups(rungs, ["program"], "number", "text").collect()]
    assert found == [("p", 1, "C", "U2", None, "R", "L", "up", 3, 1)]


def test_odd_values_and_messages(spark):
    rows = spark.createDataFrame([("12",), (" -3 ",), ("1_0",), ("_1",), ("9" * 30,), ("",), (None,), ("true",)], "t string")
    found = [(r["n"]["value"], r["n"]["fault"], r["f"]["value"], r["f"]["fault"]) for r in rows.select(rules.whole_number(F.col("t")).alias("n"), rules.flag(F.col("t")).alias("f")).collect()]
    bad, worse = "invalid_integer", "invalid_boolean"
    assert found == [(12, None, None, worse), (-3, None, None, worse), (10, None, None, worse), (None, bad, None, worse), (None, bad, None, worse), (None, bad, None, worse), (None, None, None, None), (None, bad, True, None)]
    calls = spark.createDataFrame([("p", "Msg", ["A"]), ("p", "MSG", [None]), (None, "msg", ["B"]), ("p", "msg", None), ("p", "other", ["A"])], "program string, callee string, arguments array<string>")
    own = spark.createDataFrame([("p", "A")], "program string, name string")
    shared = spark.createDataFrame([("A",), ("B",)], "name string")
    got = sorted(((r["callee"], r["tag"], r["tag_scope"], r["reason"]) for r in rules.message_evidence(calls, own, shared).collect()), key=repr)
    assert got == sorted([("Msg", "A", "program", None), ("MSG", None, None, "arity"), ("msg", "B", "controller", None), ("msg", None, None, "arity")], key=repr)
    first = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, "a"), ("k", 4, None), ("m", 1, None)], "k string, at int, v string")
    assert [tuple(r) for r in ordering.ordered_distinct(first, ["k"], "v", "at").collect()] == [("k", ["a", "b"])]
