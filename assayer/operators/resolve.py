"""Resolution joins: a reference is resolved by exactly one match or stays unresolved.

The looked-up side is aggregated by key before it is joined, so a key with any number of
rows joins as one row: no fan-out, no skew on that side, and every reference is kept.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(name: str, fold_case: bool) -> Column:
    return F.lower(F.col(name)) if fold_case else F.col(name)


def unique_matches(table: DataFrame, keys: Sequence[str], value: str, fold_case: bool = False) -> DataFrame:
    """One row a key: its columns, match_count and ``value`` (null unless there is one match)."""
    found = table.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*[_key(k, fold_case).alias(k) for k in keys])
    out = found.agg(F.count(F.lit(1)).alias("match_count"), F.min(value).alias("__value"))
    return out.select(*keys, "match_count", F.when(F.col("match_count") == 1, F.col("__value")).alias(value))


def resolve_unique(references: DataFrame, table: DataFrame, on: dict[str, str], value: str, fold_case: bool = False) -> DataFrame:
    """All rows of ``references`` plus match_count, ``value`` and status.

    on: reference column to table column. status is ``resolved`` for one match,
    ``missing`` for none, ``ambiguous`` for more and ``no_key`` where a key is null.
    """
    keys = list(on)
    matches = unique_matches(table.select(*[F.col(t).alias(r) for r, t in on.items()], value), keys, value, fold_case)
    right = matches.select(*[F.col(k).alias(f"__{k}") for k in keys], "match_count", value)
    joined = references.join(right, [_key(k, fold_case) == F.col(f"__{k}") for k in keys], "left")
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    count = F.coalesce("match_count", F.lit(0)).cast("long")
    status = F.when(no_key, "no_key").when(count == 0, "missing").when(count == 1, "resolved").otherwise("ambiguous")
    return joined.select(*references.columns, count.alias("match_count"), value, status.alias("status"))


def scoped_lookup(references: DataFrame, inner: DataFrame, outer: DataFrame, scope: str, name: str, value: str, fold_case: bool = False) -> DataFrame:
    """``references`` plus ``value`` and resolved_scope: the inner scope shadows the outer one.

    inner has (scope, name, value), outer (name, value); several definitions of a name in
    one scope count as one, the first by value. resolved_scope is ``inner``, ``outer`` or null.
    """
    low = inner.groupBy(F.col(scope).alias("__scope"), _key(name, fold_case).alias("__inner")).agg(F.min(value).alias("__inner_value"))
    high = outer.groupBy(_key(name, fold_case).alias("__outer")).agg(F.min(value).alias("__outer_value"))
    joined = references.join(low, (F.col(scope) == F.col("__scope")) & (_key(name, fold_case) == F.col("__inner")), "left")
    joined = joined.join(high, _key(name, fold_case) == F.col("__outer"), "left")
    where = F.when(F.col("__inner_value").isNotNull(), "inner").when(F.col("__outer_value").isNotNull(), "outer")
    return joined.select(*references.columns, F.coalesce("__inner_value", "__outer_value").alias(value), where.alias("resolved_scope"))


def split_bound(evidence: DataFrame, bindings: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Evidence joined with its binding, and the evidence that has none. Bindings have unique keys."""
    return evidence.join(bindings, key), evidence.join(bindings.select(key), key, "left_anti")


def longest_prefix(rows: DataFrame, text: str, row_key: str, prefixes: DataFrame, prefix: str, most_lengths: int = 256, separator: str | None = None) -> DataFrame:
    """``rows`` plus ``prefix`` (the longest that ``text`` starts with) and prefix_count.

    Each row is cut to every length that occurs among the prefixes and joined by equality,
    so no row is compared with every prefix. prefix_count is the number of entries with
    that longest prefix; the prefix is null where it isn't 1. Prefixes that all end in one
    ``separator`` may be of any number of lengths: a row is cut after each one that it has. Others
    may have ``most_lengths`` lengths, and more are an error.
    """
    entries = prefixes.groupBy(F.col(prefix).alias("__prefix")).agg(F.count(F.lit(1)).alias("__n"))
    if separator is not None:
        parts = F.split(F.col(text), re.escape(separator))
        cuts = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), separator), F.lit(separator))))
        cuts = F.coalesce(cuts, F.array().cast("array<string>"))
    else:
        lengths = [r[0] for r in prefixes.select(F.length(prefix).alias("n")).where("n > 0").distinct().limit(most_lengths + 1).collect()]
        if len(lengths) > most_lengths:
            raise ValueError(f"prefixes have more than {most_lengths} lengths")
        cuts = F.array(*[F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in sorted(lengths)] or [F.lit(None).cast("string")])
    cut = rows.select(row_key, F.explode(F.array_compact(cuts)).alias("__prefix"))
    best = cut.join(entries, "__prefix").groupBy(row_key).agg(F.max(F.struct(F.length("__prefix").alias("length"), "__prefix", "__n")).alias("best"))
    joined = rows.join(best, row_key, "left")
    count = F.coalesce(F.col("best.__n"), F.lit(0)).cast("long")
    return joined.select(*rows.columns, F.when(count == 1, F.col("best.__prefix")).alias(prefix), count.alias("prefix_count"))
