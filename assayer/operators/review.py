"""Review documents laid over candidates, and how much of them is reviewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json


def invalid_reviews(candidates: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """key and reason of reviews that can't be applied: ``unknown`` or ``duplicate`` keys."""
    unknown = reviews.join(candidates.select(key), key, "left_anti").select(key, F.lit("unknown").alias("reason"))
    duplicate = reviews.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("reason"))
    return unknown.distinct().union(duplicate)


def overlay(candidates: DataFrame, reviews: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Candidates with the fields that a review asserts replaced, plus reviewed.

    Null fields of a review assert nothing. Reviews have unique keys.
    """
    given = reviews.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__reviewed"))
    joined = candidates.join(given, key, "left")
    out = [F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in candidates.columns]
    return joined.select(*out, F.coalesce("__reviewed", F.lit(False)).alias("reviewed"))


def by_disposition(candidates: DataFrame, reviews: DataFrame, key: str, disposition: str = "disposition") -> DataFrame:
    """Candidates plus the review's disposition, ``unreviewed`` without one."""
    return candidates.join(reviews.select(key, disposition), key, "left").withColumn(disposition, F.coalesce(disposition, F.lit("unreviewed")))


def review_coverage(reviewed: DataFrame, fields: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """candidates, reviewed, complete (no field is null) and missing_<field> counts."""
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    return reviewed.groupBy(*groups).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("reviewed").alias("reviewed"), F.count_if(complete).alias("complete"), *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields])


def conflicting_parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """Children that are linked to more than one parent, with their number."""
    return links.groupBy(child).agg(F.countDistinct(parent).alias("parents")).where("parents > 1")


def receipts(reviews: DataFrame, key: str, text: str, items: str) -> DataFrame:
    """key and receipt of every valid review document: a canonical JSON text with the document's digest.

    The same document gives the same receipt, whenever it is made.
    """
    fields = {"item_count": F.col(items), "review_sha256": F.sha2(text, 256), "status": F.lit("valid")}
    return reviews.select(key, canonical_json(fields).alias("receipt"))


def broken_receipts(given: DataFrame, reviews: DataFrame, key: str, text: str, items: str) -> DataFrame:
    """key and fault of receipts that don't belong to the documents: ``missing``, ``unexpected`` or ``changed``."""
    actual = receipts(reviews, key, text, items).withColumnRenamed("receipt", "__actual")
    both = given.select(key, "receipt").join(actual, key, "full")
    fault = F.when(F.col("receipt").isNull(), "missing").when(F.col("__actual").isNull(), "unexpected").when(F.col("receipt") != F.col("__actual"), "changed")
    return both.select(key, fault.alias("fault")).where("fault is not null")
