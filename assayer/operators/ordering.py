"""Order-dependent operators: numbering, first and last of a key, ranked evidence, patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

Order = Sequence[str | Column]


def numbered(rows: DataFrame, order: Order, name: str = "n") -> DataFrame:
    """``rows`` with their position (from 1) in the given total order.

    Rows are range-partitioned, written to the shared folder with their partition and
    numbered within each; the positions at which partitions start come from their row
    counts. No task sees all rows, and a lost executor can't draw other ranges. The order
    should have no ties, else reruns may number equal rows differently.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "numbered")
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__rows")).select("__pid", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return ranged.withColumn("__own", own).join(starts, "__pid").select(*rows.columns, (F.col("__before") + F.col("__own")).cast("long").alias(name))


def first_of(rows: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of every key; last-wins is a descending order."""
    ranked = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__nth = 1").drop("__nth")


def best_evidence(rows: DataFrame, keys: Sequence[str], rank: Column, sequence: str) -> DataFrame:
    """The row of the highest rank of every key; the one seen first wins a tie."""
    return first_of(rows, keys, [rank.desc(), F.col(sequence)])


def generations(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """``rows`` plus generation (from 1) by key and transition (CREATED, then OBSERVED)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(at, tie))
    return rows.withColumn("generation", nth.cast("long")).withColumn("transition", F.when(F.col("generation") == 1, "CREATED").otherwise("OBSERVED"))


def latest_active(rows: DataFrame, key: str, at: str, tie: str, retired: Column) -> DataFrame:
    """The last row of every key whose last row isn't ``retired``."""
    return first_of(rows, [key], [F.col(at).desc(), F.col(tie).desc()]).where(~F.coalesce(retired, F.lit(False)))


def followed_by(rows: DataFrame, key: str, order: Order, kind: str, pattern: Sequence[str]) -> DataFrame:
    """Rows at which the kinds of this and the next rows of the key are ``pattern``."""
    window = Window.partitionBy(key).orderBy(*order)
    for i, wanted in enumerate(pattern):
        rows = rows.withColumn(f"__p{i}", (F.lead(kind, i).over(window) if i else F.col(kind)) == wanted)
    hit = F.lit(True)
    for i in range(len(pattern)):
        hit = hit & F.col(f"__p{i}")
    return rows.where(hit).drop(*[f"__p{i}" for i in range(len(pattern))])


def is_prefix(previous: Column, current: Column) -> Column:
    """True if the array ``current`` starts with all of ``previous``."""
    return F.slice(current, 1, F.greatest(F.size(previous), F.lit(0))) == previous


def natural_key(text: Column) -> Column:
    """Array of (number, text) structs that sorts digits by value: a2 before a10."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.coalesce(p.try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("number"), F.lower(p).alias("text")))


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str, name: str = "values") -> DataFrame:
    """Each key's distinct values in the order in which they are first seen, nulls left out.

    Values are made distinct before they meet, so a key's row holds what differs and no more.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__at"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col(value).alias("value")))).alias("__all"))
    return listed.select(*keys, F.transform("__all", lambda x: x["value"]).alias(name))


# The rungs of a counter that shares its state: counting, its done bit, its reset.
COUNT_RUNG, DONE_RUNG, RESET_RUNG = r"^\s*XIC\((\w+)\)\s*(CTU|CTD)\((\w+)[,)].*$", r"^\s*XIC\((\w+)\.DN\)\s*OTE\((\w+)\)\s*;?\s*$", r"^\s*XIC\((\w+)\)\s*RES\((\w+)\)\s*;?\s*$"


def counter_groups(rungs: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Counters that a run of rungs describes in full: keys, ``order`` of the first rung, counter, up, down, reset, output, sequence, rungs and groups.

    A run is one counting rung, or two of the same counter in both directions, then the rung of its done bit and
    the rung that resets it. sequence is up, down, up_down or down_up; groups is how many runs the counter has in
    its keys: more than one is a fault. A run that another one includes doesn't count.
    """
    part = lambda pattern, n: F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))
    window = Window.partitionBy(*keys).orderBy(order)
    seen = rungs.select(*keys, order, part(COUNT_RUNG, 1).alias("by"), part(COUNT_RUNG, 2).alias("way"), part(COUNT_RUNG, 3).alias("counter"), part(DONE_RUNG, 1).alias("done"), part(DONE_RUNG, 2).alias("lamp"), part(RESET_RUNG, 1).alias("reset_by"), part(RESET_RUNG, 2).alias("reset"))
    ahead = lambda c, n: F.lead(c, n).over(window)
    pair = F.col("way").isNotNull() & (ahead("way", 1) != F.col("way"))
    seen = seen.withColumns({"pair": F.coalesce(pair, F.lit(False)), "by2": ahead("by", 1), "counter2": ahead("counter", 1)})
    after = lambda c: F.when(F.col("pair"), ahead(c, 2)).otherwise(ahead(c, 1))
    last = lambda c: F.when(F.col("pair"), ahead(c, 3)).otherwise(ahead(c, 2))
    seen = seen.withColumns({"n_done": after("done"), "n_lamp": after("lamp"), "n_by": last("reset_by"), "n_reset": last("reset")})
    whole = F.col("way").isNotNull() & (F.col("n_done") == F.col("counter")) & (F.col("n_reset") == F.col("counter")) & (~F.col("pair") | (F.col("counter2") == F.col("counter")))
    seen = seen.withColumn("whole", F.coalesce(whole, F.lit(False)))
    inside = F.coalesce(F.lag(F.col("whole") & F.col("pair")).over(window), F.lit(False))
    found = seen.withColumn("inside", inside).where("whole and not inside")
    is_up = F.col("way") == "CTU"
    up = F.when(is_up, F.col("by")).when(F.col("pair"), F.col("by2"))
    down = F.when(~is_up, F.col("by")).when(F.col("pair"), F.col("by2"))
    sequence = F.when(F.col("pair"), F.when(is_up, "up_down").otherwise("down_up")).otherwise(F.when(is_up, "up").otherwise("down"))
    out = found.select(*keys, order, "counter", up.alias("up"), down.alias("down"), F.col("n_by").alias("reset"), F.col("n_lamp").alias("output"), sequence.alias("sequence"), F.when(F.col("pair"), 4).otherwise(3).alias("rungs"))
    return out.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy(*keys, "counter")))
