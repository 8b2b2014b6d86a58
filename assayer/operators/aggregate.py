"""Counting operators: inventories, coverage, multisets, unique values, co-location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import relationship_key
from ..storage import join_hot, stored
from .ordering import numbered

#: Effects of a location up to which no task has too many.
HOT_LOCATION = 1000


def inventory(rows: DataFrame, kind: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows of every kind, and how many of them meet each named condition."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def family_of(name: Column, families: Sequence[tuple[str, str]], other: Column) -> Column:
    """Family of a dotted name: the first entry whose prefix ends at a dot or the end of it."""
    out = other
    for prefix, family in reversed(families):
        out = F.when((name == prefix) | name.startswith(f"{prefix}."), family).otherwise(out)
    return out


def merge_counts(rows: DataFrame, counts: str, name: str = "name") -> DataFrame:
    """Sum of all rows' maps of counts, by entry."""
    return rows.select(F.explode(counts).alias(name, "__n")).groupBy(name).agg(F.sum("__n").alias("n"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 100 where there is nothing to cover."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.lit(100.0) * part / whole)


def coverage(rows: DataFrame, kind: str, supported: Column) -> DataFrame:
    """occurrences, supported and percent of every kind."""
    out = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(supported).alias("supported"))
    return out.withColumn("percent", percent(F.col("supported"), F.col("occurrences")))


def consume(rows: DataFrame, tokens: DataFrame, keys: Sequence[str], row_order: Sequence[str], token_order: Sequence[str], value: str) -> DataFrame:
    """``rows`` plus ``value`` of the token each one uses up.

    The n-th row of a key takes the n-th token of it; tokens are spent once, and rows
    beyond the tokens get null.
    """
    nth = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    own = rows.withColumn("__nth", nth(row_order))
    spent = tokens.select(*keys, value, nth(token_order).alias("__nth"))
    return own.join(spent, [*keys, "__nth"], "left").drop("__nth")


def unique_value(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that have one distinct value, with it. Least and greatest tell as much as a set."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    return out.where(F.col(value) == F.col("__most")).drop("__most")


def samples(rows: DataFrame, key: str, value: str, most: int = 5) -> DataFrame:
    """n and the first ``most`` distinct values in order of every key.

    Values are made distinct by a shuffle and ranked, so no task gathers a key's values.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.select(key, value).where(F.col(value).isNotNull()).distinct().withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("__nth") <= most)
    firsts = ranked.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("samples"))
    return counts.join(firsts, key, "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def ranked(groups: DataFrame, count: str, key: Column, name: str = "position") -> DataFrame:
    """``groups`` with their position: the largest count first, then by key."""
    return numbered(groups.withColumn("__key", key), [F.desc(count), "__key"], name).drop("__key")


def co_located(effects: DataFrame, causes: DataFrame, location: Sequence[str], node: str) -> DataFrame:
    """effect, cause and locations: pairs of different nodes at the same location.

    Locations compare null-safe: a place without a line number is a place too. A
    location's pairs are counted there, so its size, not the table's, bounds them; the
    effects of a location that has more than a task's share are dealt to several tasks.
    """
    at = F.struct(*location).alias("at")
    left = stored(effects.select(at, F.col(node).alias("effect")).distinct(), "effects")
    right = causes.select(at, F.col(node).alias("cause")).distinct()
    sizes = left.groupBy("at").agg(F.count(F.lit(1)).alias("copies"))
    total, largest = sizes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    if largest > max(HOT_LOCATION, total // (4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))):
        pairs = join_hot(left, right.join(sizes, "at"), "at", F.col("copies"), total)
    else:
        pairs = left.join(right, "at")
    return pairs.where("effect <> cause").groupBy("effect", "cause").agg(F.count(F.lit(1)).alias("locations"))


def with_relationship_key(rows: DataFrame, columns: Sequence[str], name: str = "relationship_key") -> DataFrame:
    return rows.withColumn(name, relationship_key({c: F.col(c) for c in columns}))


def pivot_fields(rows: DataFrame, name: str, pattern: str, value: str, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row a position, one column a field, from names like ``fault_3_code``.

    pattern has two groups: position and field. The greatest value of a cell is kept.
    """
    parts = rows.select(*keys, F.regexp_extract(name, pattern, 1).alias("position"), F.regexp_extract(name, pattern, 2).alias("__field"), value).where("position <> ''")
    cells = [F.max(F.when(F.col("__field") == f, F.col(value))).alias(f) for f in fields]
    return parts.groupBy(*keys, "position").agg(*cells)
