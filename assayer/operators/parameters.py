"""Typed values, parameters, packed images, property diffs, evidence by identity, requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import radix_literal
from .aggregate import unique_value
from .ordering import first_of, numbered

# Numeric types from the narrowest to the widest, severities from the least up.
PROMOTION = ("SINT", "USINT", "INT", "UINT", "DINT", "UDINT", "LINT", "ULINT", "REAL", "LREAL")
SEVERITIES = ("Low", "Medium", "High")


def scalar_value(data_type: Column, text: Column) -> dict[str, Column]:
    """boolean, whole and real value of a literal by its type; null where it isn't one.

    A BOOL is 0, 1, true or false; whole numbers may have a radix; REAL and LREAL are real.
    """
    kind, plain = F.upper(data_type), F.lower(F.trim(text))
    return {
        "boolean": F.when((kind == "BOOL") & plain.isin("1", "true"), True).when((kind == "BOOL") & plain.isin("0", "false"), False),
        "whole": F.when(kind.isin(*PROMOTION[:-2]), radix_literal(F.trim(text))),
        "real": F.when(kind.isin(*PROMOTION[-2:]), F.trim(text).try_cast("double")),
    }


def rank_of(name: Column, order: Sequence[str]) -> Column:
    """Place of a name in ``order``, from 1, or null."""
    out = F.lit(None).cast("int")
    for i, one in enumerate(order, 1):
        out = F.when(name == one, i).otherwise(out)
    return out


def promoted(a: Column, b: Column) -> Column:
    """The wider of two numeric types, or null if either isn't one."""
    ranks = [rank_of(F.upper(c), PROMOTION) for c in (a, b)]
    return F.when(ranks[0].isNotNull() & ranks[1].isNotNull(), F.element_at(F.array(*[F.lit(t) for t in PROMOTION]), F.greatest(*ranks)))


def compatibility(source: Column, target: Column) -> Column:
    """EXACT, IMPLICIT (the target is wider), INCOMPATIBLE, or UNKNOWN where a type isn't known."""
    wide = promoted(source, target)
    return F.when(F.upper(source) == F.upper(target), "EXACT").when(wide.isNull(), "UNKNOWN").when(wide == F.upper(target), "IMPLICIT").otherwise("INCOMPATIBLE")


def iso_instant(text: Column) -> Column:
    """Timestamp of an ISO-8601 text with a zone, null without one."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.trim(text)))


def iso_text(at: Column) -> Column:
    """A timestamp as ISO-8601 in UTC (the session's zone is taken to be UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def enriched(observed: DataFrame, catalogue: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``observed`` with what it lacks taken from the catalogue: an observed value wins.

    catalogue: one row a key. known tells whether the catalogue has the key.
    """
    given = catalogue.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__known"))
    joined = observed.join(given, key, "left")
    out = [F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in observed.columns]
    return joined.select(*out, F.coalesce("__known", F.lit(False)).alias("known"))


def highest(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[str] = SEVERITIES) -> DataFrame:
    """The name of every key that is last in ``order``; null if none of them is in it."""
    return rows.groupBy(*keys).agg(F.max_by(name, rank_of(F.col(name), order)).alias(name))


def literal_writes(assignments: DataFrame, keys: Sequence[str], target: str, value: str) -> DataFrame:
    """Targets that are only ever assigned one literal, with it."""
    return unique_value(assignments, [*keys, target], value)


def set_difference(required: DataFrame, provided: DataFrame, key: str, names: str) -> DataFrame:
    """key, missing (sorted array) and compatible of every row of ``required``, by what is provided for it."""
    joined = required.select(key, F.col(names).alias("__need")).join(provided.select(key, F.col(names).alias("__have")), key, "left")
    missing = F.array_sort(F.array_except("__need", F.coalesce("__have", F.array().cast("array<string>"))))
    return joined.select(key, missing.alias("missing"), (F.size(missing) == 0).alias("compatible"))


def byte_layout(members: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """``members`` with their byte offset: the sizes of those before them."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def packed_image(size: int, fields: Sequence[tuple[int, int, Column]], bits: Sequence[tuple[int, int, Column]] = ()) -> Column:
    """Binary image of ``size`` bytes from little-endian fields (offset, width, value) and bits (byte, bit, flag).

    Bits are laid over the fields. Negative values are written as two's complement; fields
    that overlap or leave the image are an error.
    """
    octets: list[Column | None] = [None] * size
    for offset, width, value in fields:
        if offset + width > size or any(octets[offset : offset + width]):
            raise ValueError(f"field at byte {offset} overlaps another one or the end")
        for i in range(width):
            octets[offset + i] = F.shiftright(value.cast("long"), min(63, 8 * i)).bitwiseAND(F.lit(255))
    whole = [F.lit(0).cast("long") if o is None else o for o in octets]
    for at, bit, flag in bits:
        mask = 1 << bit
        whole[at] = F.when(flag, whole[at].bitwiseOR(F.lit(mask))).otherwise(whole[at].bitwiseAND(F.lit(255 - mask)))
    return F.unhex(F.concat(*[F.lpad(F.hex(o), 2, "0") for o in whole]))


def property_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], properties: str) -> DataFrame:
    """keys, property, change (added, removed, changed), before and after of all properties that differ.

    properties: a map of text to text. Of an object that one side lacks all are added or removed.
    """
    flat = [t.select(*keys, F.explode(properties).alias("property", side)) for t, side in ((before, "before"), (after, "after"))]
    both = flat[0].join(flat[1], [*keys, "property"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(*keys, "property", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("change"), "before", "after")


def accepted_identities(candidates: DataFrame, reviews: DataFrame, candidate: str, key: str, evidence: str) -> DataFrame:
    """key, candidates and evidence (sorted, each once) of every identity that a review accepts.

    candidates: candidate and evidence; reviews: candidate, disposition and the identity's
    key. Several candidates of one identity become one row.
    """
    kept = reviews.where("disposition = 'accepted'").select(candidate, key)
    return candidates.join(kept, candidate).groupBy(key).agg(F.countDistinct(candidate).alias("candidates"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def request_states(events: DataFrame, request: str, at: str, tie: str, status: str) -> DataFrame:
    """request and state: the first SUCCEEDED or FAILED one, else PENDING. What comes after it is late."""
    ended = first_of(events.where(F.col(status).isin("SUCCEEDED", "FAILED")), [request], [at, tie]).select(request, F.col(status).alias("state"))
    return events.select(request).distinct().join(ended, request, "left").withColumn("state", F.coalesce("state", F.lit("PENDING")))


def linked_once(devices: DataFrame, bindings: DataFrame, accepted: DataFrame, device: str, module: str, target: str) -> DataFrame:
    """device, target and status of every device over its binding and the accepted mapping of that.

    bindings: device, module; accepted: module, target. status is ``linked`` for one
    target in all, ``unbound`` without a binding, ``unmapped`` where no binding is mapped
    and ``ambiguous`` for several targets, which has no target.
    """
    bound = devices.select(device).join(bindings.select(device, module).distinct(), device, "left").join(accepted.select(module, target).distinct(), module, "left")
    found = bound.groupBy(device).agg(F.count(module).alias("__bound"), F.countDistinct(target).alias("__targets"), F.min(target).alias("__target"))
    status = F.when(F.col("__bound") == 0, "unbound").when(F.col("__targets") == 0, "unmapped").when(F.col("__targets") == 1, "linked").otherwise("ambiguous")
    return found.select(device, F.when(F.col("__targets") == 1, F.col("__target")).alias(target), status.alias("status"))


def in_order(rows: DataFrame, columns: Sequence[str], name: str = "position") -> DataFrame:
    """``rows`` with their position by ``columns``: text without case, nulls as -1 or "" before all else."""
    kinds = dict(rows.dtypes)
    key = [F.coalesce(F.lower(c), F.lit("")) if kinds[c] == "string" else F.coalesce(c, F.lit(-1)) for c in columns]
    named = rows.withColumns({f"__k{i}": k for i, k in enumerate(key)})
    return numbered(named, [f"__k{i}" for i in range(len(key))], name).drop(*[f"__k{i}" for i in range(len(key))])
