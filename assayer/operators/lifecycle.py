"""Append-only identity ledgers: generations, transitions, promotions, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Least and most sources and targets of each transition.
TRANSITIONS = {"supersede": (1, 1, 1, 1), "merge": (2, None, 1, 1), "split": (1, 1, 2, None)}


def inactive_keys(directives: DataFrame) -> DataFrame:
    """Keys that a directive has retired. directives: directive, transition, sources, targets, directed_at."""
    return directives.select(F.explode("sources").alias("key")).distinct()


def advance(ledger: DataFrame, accepted: DataFrame, directives: DataFrame) -> DataFrame:
    """The ledger with one more generation for every accepted key, and transition.

    ledger: key, generation, observed_at; accepted: key, observed_at; directives are the
    earlier ones. A retired key that is accepted again, or a key accepted twice, is an
    error when the result is run.
    """
    last = ledger.groupBy("key").agg(F.max("generation").alias("last"))
    gone = inactive_keys(directives).withColumn("gone", F.lit(True))
    per_key = accepted.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key")))
    joined = per_key.join(last, "key", "left").join(gone, "key", "left")
    bad = F.when(F.col("gone"), F.raise_error(F.concat(F.lit("retired identity is observed again: "), "key"))).when(F.col("times") > 1, F.raise_error(F.concat(F.lit("identity is accepted twice: "), "key")))
    new = joined.where(bad.isNull()).select("key", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("generation"), "observed_at")
    return ledger.select("key", "generation", "observed_at").union(new).withColumn("transition", F.when(F.col("generation") == 1, "CREATED").otherwise("OBSERVED"))


def directive_faults(directives: DataFrame, ledger: DataFrame, retired: DataFrame) -> DataFrame:
    """directive and fault of directives that can't be applied.

    Faults: ``arity`` (too few or many sources or targets), ``overlap`` (a key on both
    sides), ``inactive_source``, ``unknown_target`` and ``predates`` (before the last
    observation of one of its keys). ledger includes the present capture; retired: key.
    """
    def within(side: str, low: int, high: int | None):
        enough = F.size(side) >= low
        return enough & (F.size(side) <= high) if high else enough

    arity = F.lit(False)
    for name, (s0, s1, t0, t1) in TRANSITIONS.items():
        arity = arity | ((F.col("transition") == name) & within("sources", s0, s1) & within("targets", t0, t1))
    shape = directives.select("directive", F.when(~arity, "arity").when(F.arrays_overlap("sources", "targets"), "overlap").alias("fault")).where("fault is not null")
    last = ledger.groupBy("key").agg(F.max("observed_at").alias("seen"))
    gone = retired.select("key").distinct().withColumn("gone", F.lit(True))
    side = lambda c: directives.select("directive", "directed_at", F.lit(c).alias("side"), F.explode(c).alias("key"))
    keys = side("sources").union(side("targets")).join(last, "key", "left").join(gone, "key", "left")
    fault = F.when((F.col("side") == "sources") & (F.col("seen").isNull() | F.coalesce("gone", F.lit(False))), "inactive_source").when(F.col("seen").isNull(), "unknown_target").when(F.col("directed_at") < F.col("seen"), "predates")
    return shape.union(keys.select("directive", fault.alias("fault")).where("fault is not null")).distinct()


def promotions(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested keys with their generations in order, as one row a key. requests: key, core_id."""
    held = ledger.groupBy("key").agg(F.array_sort(F.collect_set("generation")).alias("generations"))
    return requests.join(held, "key")


def broken_histories(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Keys whose earlier generations are no longer the beginning of the present ones."""
    both = previous.select("key", F.col("generations").alias("before")).join(current.select("key", F.col("generations").alias("after")), "key", "left")
    kept = F.slice("after", 1, F.size("before")) == F.col("before")
    return both.where(~F.coalesce(kept, F.lit(False))).select("key")


def save_revision(state: DataFrame, folder: str, expected_revision: int) -> int:
    """Write a state as the revision after the expected one; an error if it is there already.

    A revision is a folder of its own, so writers that start from the same one can't
    both win and no reader sees half of one.
    """
    state.write.mode("errorifexists").parquet(f"{folder}/revision={expected_revision + 1}")
    return expected_revision + 1


def load_revision(spark: SparkSession, folder: str, revision: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/revision={revision}")
