"""Reconciliation of two states: three-way splits, drift, field comparison, verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .ordering import numbered


def reconcile(configured: DataFrame, discovered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on ``keys``: the keys, both sides' other columns, and side.

    side is ``both``, ``configured_only`` or ``discovered_only``. Columns that both sides
    have get the prefix configured_ or discovered_. Null keys match nothing.
    """
    own = [c for c in configured.columns if c not in keys]
    other = [c for c in discovered.columns if c not in keys]
    left = configured.select(*keys, *[F.col(c).alias(f"configured_{c}" if c in other else c) for c in own], F.lit(True).alias("__left"))
    right = discovered.select(*keys, *[F.col(c).alias(f"discovered_{c}" if c in own else c) for c in other], F.lit(True).alias("__right"))
    side = F.when(F.col("__left").isNull(), "discovered_only").when(F.col("__right").isNull(), "configured_only").otherwise("both")
    return left.join(right, list(keys), "full").withColumn("side", side).drop("__left", "__right")


def attribute_bag(names: Sequence[str]) -> Column:
    """Columns as a sorted array of (name, value) structs, which unlike a map compares."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in sorted(names)])


def complete_in_both(rows: DataFrame, domain: str, baseline: Sequence[str | int], current: Sequence[str | int]) -> DataFrame:
    """Rows of the domains that both captures hold completely.

    It has to come before the comparison: what an incomplete capture lacks was not removed.
    """
    return rows.where(F.col(domain).isin([d for d in baseline if d in set(current)]))


def drift(baseline: DataFrame, current: DataFrame, domain: str, key: str, attributes: Sequence[str]) -> DataFrame:
    """domain, key and finding (added, removed or changed) of all keys that differ.

    Attributes are compared null-safe; keys without a difference give no row.
    """
    sides = [t.select(domain, key, attribute_bag(attributes).alias("bag")) for t in (baseline, current)]
    both = reconcile(*sides, [domain, key])
    finding = F.when(F.col("side") == "configured_only", "removed").when(F.col("side") == "discovered_only", "added")
    finding = finding.when(~F.col("configured_bag").eqNullSafe(F.col("discovered_bag")), "changed")
    return both.select(domain, key, finding.alias("finding")).where("finding is not null")


def sanitized(findings: DataFrame, order: Sequence[str], prefix: str = "DRIFT-") -> DataFrame:
    """Findings with a reference (DRIFT-0001 and on) in the given order instead of their keys."""
    return numbered(findings, order, "__n").select(F.concat(F.lit(prefix), F.when(F.col("__n") < 10_000, F.lpad(F.col("__n").cast("string"), 4, "0")).otherwise(F.col("__n").cast("string"))).alias("reference"), *findings.columns)


def compare_fields(fields: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """matched, conflicting and unavailable field names (sorted arrays) and status.

    A field is unavailable if either value is null. status is CONFLICT if any field
    conflicts, INSUFFICIENT if none matches, PARTIAL if some are unavailable, else EXACT.
    """
    parts = {"matched": [], "conflicting": [], "unavailable": []}
    for name in sorted(fields):
        a, b = fields[name]
        missing = a.isNull() | b.isNull()
        parts["matched"].append(F.when(~missing & (a == b), F.lit(name)))
        parts["conflicting"].append(F.when(~missing & (a != b), F.lit(name)))
        parts["unavailable"].append(F.when(missing, F.lit(name)))
    out = {k: F.array_compact(F.array(*v)) for k, v in parts.items()}
    status = F.when(F.size(out["conflicting"]) > 0, "CONFLICT").when(F.size(out["matched"]) == 0, "INSUFFICIENT")
    return out | {"status": status.when(F.size(out["unavailable"]) > 0, "PARTIAL").otherwise("EXACT")}


def key_verdict(mode: Column, exact: dict[str, tuple[Column, Column]], compatible: dict[str, tuple[Column, Column]]) -> Column:
    """Verdict of an electronic key: NOT_CONFIGURED, DISABLED, SATISFIED, REJECTED or DEFERRED.

    Exact keying defers as soon as a field is unavailable, even if another conflicts.
    Compatible keying rejects a conflict in the identifying fields and defers otherwise,
    as only the device itself can tell.
    """
    strict = compare_fields(exact)
    loose = compare_fields(compatible)
    by_exact = F.when(F.size(strict["unavailable"]) > 0, "DEFERRED").when(F.size(strict["conflicting"]) > 0, "REJECTED").otherwise("SATISFIED")
    by_compatible = F.when(F.size(loose["conflicting"]) > 0, "REJECTED").otherwise("DEFERRED")
    return F.when(mode.isNull(), "NOT_CONFIGURED").when(mode == "Disabled", "DISABLED").when(mode == "Exact", by_exact).otherwise(by_compatible)


def any_basis_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, bases: Sequence[Sequence[tuple[Column, Column]]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of keys that one basis or more ties together, and the keys of either side without a pair.

    A basis is a list of (left, right) columns that have to be equal, nulls to nothing.
    Each is one join on equal keys, so no row meets another that it isn't tied to. A pair is told once, by its
    first basis and the least value that ties it there: pairs, which may be as many as the product
    of both sides, leave their join as they come and are neither compared with each other nor stored.
    """
    values = [f"__{i}" for i in range(len(bases))]

    def sides(table: DataFrame, key: str, at: int) -> DataFrame:
        """One row a key, with the set of its values in each basis."""
        sets = []
        for name, basis in zip(values, bases):
            parts = [pair[at].alias(f"c{i}") for i, pair in enumerate(basis)]
            whole = reduce(lambda a, b: a & b, [pair[at].isNotNull() for pair in basis])
            sets.append(F.collect_set(F.when(whole, F.struct(*parts))).alias(name))
        return stored(table.groupBy(F.col(key).alias("key")).agg(*sets), "basis-side")

    a, b = sides(left, left_key, 0), sides(right, right_key, 1)
    pairs, tied = None, [None, None]
    for i, name in enumerate(values):
        each = [t.select(F.col("key").alias(f"{n}_key"), *[F.col(v).alias(n + v) for v in values[: i + 1]], F.explode(name).alias("v")).select("*", "v.*").drop("v") for n, t in (("a", a), ("b", b))]
        on = [f"c{x}" for x in range(len(bases[i]))]
        first = reduce(lambda x, y: x & y, [~F.arrays_overlap(f"a{v}", f"b{v}") for v in values[:i]], F.lit(True))
        least = (F.size(f"a{name}") == 1) | (F.size(f"b{name}") == 1) | (F.struct(*on) == F.array_min(F.array_intersect(f"a{name}", f"b{name}")))
        one = each[0].join(each[1], on).where(first & least).select(F.col("a_key").alias(left_key), F.col("b_key").alias(right_key))
        pairs = one if pairs is None else pairs.union(one)
        for at, (n, own, other) in enumerate((("a", each[0], each[1]), ("b", each[1], each[0]))):
            some = own.join(other.select(*on).distinct(), on, "left_semi").select(f"{n}_key")
            tied[at] = some if tied[at] is None else tied[at].union(some)
    alone = lambda t, k, found: t.select(k).join(found.toDF(k).distinct(), k, "left_anti")
    return pairs, alone(left, left_key, tied[0]), alone(right, right_key, tied[1])


def multi_basis(nodes: DataFrame, node: str, bases: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Nodes that all bases together tie to exactly one identity, with the bases that do.

    bases: name to (table, node column to join on, identity column); the table has a
    column of the same name as the node column. Returns node, identity, bases. Only
    whether there is one identity counts, so each key of a basis is one row with its
    least and greatest before it is joined: a key that many identities share costs no more.
    """
    found = None
    for name, (table, column, identity) in bases.items():
        by_key = table.where(F.col(identity).isNotNull()).groupBy(column).agg(F.min(identity).alias("identity"), F.max(identity).alias("__other"))
        one = nodes.select(node, column).join(by_key, column).select(node, "identity", "__other", F.lit(name).alias("basis"))
        found = one if found is None else found.union(one)
    tied = found.groupBy(node).agg(F.min("identity").alias("identity"), F.max("__other").alias("__other"), F.array_sort(F.collect_set("basis")).alias("bases"))
    return tied.where("identity = __other").drop("__other")
