"""Engineering units handed on from tag to tag by comparisons, in the order of the rungs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "workspace string, tag string, unit string, confidence string, inherited_from string, conflicts array<string>"
#: Confidence of a unit, from what is only inferred to what is stated.
RANK = {"INFERRED": 1, "DERIVED": 2, "CONFIRMED": 3}


def _hand_on(units: dict[str, list], left: str, right: str) -> None:
    """units: tag to [unit, confidence, inherited_from, conflicts]; changed in place by one comparison."""
    for source, target in ((left, right), (right, left)):
        if units[source][0] is None:
            continue
        have, give = units[target], units[source]
        confidence = "INFERRED" if give[1] == "INFERRED" else "DERIVED"
        if have[0] is None:
            have[:3] = [give[0], confidence, source]
            break
        if have[0] != give[0]:
            have[3].append(f"{have[0]} <> {give[0]}")
            break
        if RANK[confidence] > RANK[have[1]]:
            have[1:3] = [confidence, source]


def inherited_units(tags: DataFrame, comparisons: DataFrame) -> DataFrame:
    """RESULT rows of every tag after one pass over the comparisons in order.

    tags: workspace, tag, unit, confidence (null without a unit); comparisons:
    workspace, place (order), left, right. A comparison hands the unit of one side to the
    other if that has none, and notes a conflict if both have different ones. A unit is
    handed on only from then on, so the order matters and a closure over all pairs would
    say something else. A workspace's tags and then its comparisons pass by in a sorted stream:
    a task keeps the tags of one workspace, and no comparison but the one at hand.
    """
    none = F.lit(None).cast("string")
    own = tags.select("workspace", F.lit(0).alias("which"), F.lit(None).cast("long").alias("place"), "tag", "unit", "confidence", none.alias("left"), none.alias("right"))
    pairs = comparisons.select("workspace", F.lit(1), F.col("place").cast("long"), none, none, none, "left", "right")
    rows = own.union(pairs).repartition("workspace").sortWithinPartitions("workspace", "which", "place", "tag", "left", "right")
    schema = pa.schema([*[(n, pa.string()) for n in ("workspace", "tag", "unit", "confidence", "inherited_from")], ("conflicts", pa.list_(pa.string()))])
    names = ("workspace", "which", "tag", "unit", "confidence", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict[str, list] = {}
        listed: list[str] = []
        now: tuple = ()

        def done() -> pa.RecordBatch:
            made = [{"workspace": now[0], "tag": t, "unit": units[t][0], "confidence": units[t][1], "inherited_from": units[t][2], "conflicts": units[t][3]} for t in listed]
            return pa.RecordBatch.from_pylist(made, schema)

        for b in batches:
            for workspace, which, tag, unit, confidence, left, right in zip(*[b.column(c).to_pylist() for c in names]):
                if now != (workspace,):
                    if listed:
                        yield done()
                    units, listed, now = {}, [], (workspace,)
                if which == 0:
                    units[tag] = [unit, confidence, None, []]
                    listed.append(tag)
                elif left in units and right in units:
                    _hand_on(units, left, right)
        if listed:
            yield done()

    return rows.mapInArrow(run, RESULT)
