"""Queries over files made from the tables, and of the other operators, against their twins."""

from pathlib import Path

import duckdb
import pytest

from assayer.operators import evidence_json, scan_cycle, tree
from assayer.plans import controllers, datatypes, engineering, extras, modules, parameters, recordings, systems

SMALL = "/root/testdata/sf0.001"
LISTS = (recordings, controllers, extras, parameters, datatypes, systems, engineering, modules)
QUERIES = {name: (f, m.SQL) for m in LISTS for name, f in m.queries().items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("module", LISTS)
def test_every_query_has_a_twin(module):
    assert set(module.queries()) == set(module.SQL)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, duck, name):
    def normal(table):
        table = table[sorted(table.columns)]
        cell = lambda x: None if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
        return list(table.columns), sorted([tuple(cell(x) for x in row) for row in table.astype(object).where(table.notna(), None).to_numpy()], key=repr)

    query, sql = QUERIES[name]
    assert normal(query(spark, SMALL).toPandas()) == normal(duck.sql(sql[name]).df())


def test_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(1000)]
    ring = [(5000 + i, 5000 + (i + 1) % 150) for i in range(150)] + [(6000, 5007), (6001, 6000), (7000, 7000), (8000, 9999)]
    nodes = spark.createDataFrame(chain + ring, "n long, p long")
    found = {r["n"]: (r["root"], r["depth"], r["in_cycle"]) for r in tree.ancestors(nodes, "n", "p").collect()}
    assert all(found[i] == (0, i, False) for i in range(1000)) and found[8000] == (8000, 0, False)
    assert all(found[i] == (None, None, True) for i in [*range(5000, 5150), 6000, 6001, 7000])
    faults = sorted((r["n"], r["code"]) for r in tree.containment_issues(nodes, "n", "p", -1).collect())
    assert faults == sorted([(i, "containment_cycle") for i in [*range(5000, 5150), 6000, 6001, 7000]] + [(7000, "self_parent"), (8000, "missing_parent")])
    assert tree.ancestors(nodes.limit(0), "n", "p").count() == 0


def test_counter_goes_round_at_both_ends(spark):
    rows = [("a", i, i % 2 == 1, False, i == 5) for i in range(9)] + [("b", i, False, i % 2 == 1, False) for i in range(4)]
    scans = spark.createDataFrame(rows, "d string, n int, up boolean, down boolean, reset boolean")
    found = {(r["d"], r["n"]): (r["cv"], r["done"], r["overflow"], r["underflow"]) for r in scan_cycle.up_down_counter(scans, "d", ["n"], "up", "down", "reset", 2).collect()}
    assert [found["a", n] for n in (0, 1, 3, 5, 7)] == [(0, False, False, False), (1, False, False, False), (2, True, False, False), (0, False, False, False), (1, False, False, False)]
    assert found["b", 3] == (-2, False, False, False)


def test_document_differences_are_those_of_the_nodes(spark):
    pairs = [("d1", '{"a": [1, 2], "b": 1}', '{"a": [1, 3, 4], "c/~": null, "b": 1.0}'), ("d2", "[]", "{}"), ("d3", '{"x": {"y": 1}}', '{"x": {"y": 1}}'), ("d4", None, "1"), ("d5", "true", None), ("d6", '"é"', '"e"')]
    before, after = (spark.createDataFrame([(p[0], p[i]) for p in pairs], "doc string, body string") for i in (1, 2))
    nodes = [evidence_json.flatten(t, "doc", "body") for t in (before, after)]
    plain = lambda df: sorted(tuple(r) for r in df.select("doc", "operation", "pointer").collect())
    assert plain(evidence_json.compare_documents(before, after, "doc", "body")) == plain(evidence_json.compare(*nodes))
