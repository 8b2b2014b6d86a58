"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

The documents of a source wait in a shuffled queue, the whole queue up to ``repeats``
times. A document's virtual finish time is the words of its source up to and with it,
divided by the source's target. All documents are range-sorted by finish time, and what
comes before the point where the budget is spent is taken.

Queues are split into buckets by the first bits of the draw that orders them, so a source
that holds a third of all rows is summed up by many tasks, and a queue is in the order of its
draws whatever the number of buckets; only sums a bucket, a range partition and a source meet. Where
documents may be cut, the one in which a source reaches its target waits as two pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """skey, source_size and target of every source.

    sources: skey (in the order in which weights repeat) and source_size. The budget,
    ``share`` of all sizes, is dealt by weight; a target stops at ``repeats`` times its
    source's size and the excess is dealt again. A source is capped exactly if the level
    (words a unit of weight) that the sources not below it would share reaches its cap,
    so one pass over the sources in the order of cap per weight finds the last level.
    One row a source is all that these windows see.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy("skey")) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)).withColumn("budget", F.sum("source_size").over(everything) * float(share))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("budget") - before) / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return leveled.withColumn("target", F.when(F.col("open"), final * F.col("weight")).otherwise(F.col("cap"))).select("skey", "source_size", "target")


def copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; all columns stay.

    mixed: what ``mix`` returned for ``docs``. Rows are told apart by doc_id and text, so
    rows that share a doc_id or have none are taken each as the mix says; exact
    repetitions alike, as often as the most taken of them.
    """
    key, often, turn = (fresh(docs, c) for c in ("draw", "often", "turn"))
    taken = mixed.where("taken > 0").groupBy(F.col("draw").alias(key)).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(often)).where(F.col(often) > 0)
    drawn = docs.withColumn(key, _draw(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return drawn.join(taken, key).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(often)))).select(docs.columns)


def _draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    return F.xxhash64(doc_id, text, F.lit(seed))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, cut: bool = False) -> DataFrame:
    """doc_id, draw, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source).

    size is the number of words (null: 0), taken the words that the mix takes of the
    row, 0 to ``repeats`` times its size. Sources are ordered by code point, null being
    a source of its own and the last. draw, a hash of doc_id and text, is the order in a
    queue, so reruns agree; identical rows at the cut are left out together. Rows without
    words are never taken. Other columns are ignored, an empty table gives an empty result.

    Documents are taken whole, or with ``cut`` the first words of the one in which a
    source reaches its target: it waits as two pieces, the first of which has the finish
    time 1. Then each source has its target but for a word.
    """
    spark = docs.sparkSession
    # The first bits of a draw, in its order: how many there are changes no position.
    first_bits = max(1, min(30, (partitions(spark) - 1).bit_length()))
    text = F.col("text").cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("skey"),
        word_count(text).alias("size"),
        _draw(F.col("doc_id").cast("long"), text, seed).alias("draw"),
    ).withColumn("bucket", F.shiftright("draw", 64 - first_bits).cast("int"))
    slim = stored(slim, "mix-sizes")
    sums = slim.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, share, repeats)
    offset = F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("skey", "bucket", F.coalesce(offset, F.lit(0)).alias("offset")).join(targets, "skey")
    queue = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = slim.withColumn("running", F.sum("size").over(queue)).join(offsets, ["skey", "bucket"]).withColumn("position", F.col("offset") + F.col("running"))
    queued = stored(queued.select("doc_id", "size", "draw", "source_size", "target", "position"), "mix-queue")

    def pieces(turn: int) -> list[tuple[Column, Column]]:
        """Finish time and words of the pieces of a row's turn; no words where there is no such piece."""
        end = F.col("source_size") * turn + F.col("position")
        finish = lambda at: F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(float("inf")))
        if not cut:
            return [(finish(end), F.col("size"))]
        first = F.least(F.col("size"), F.greatest(F.lit(0), F.floor("target").cast("long") - (end - F.col("size"))))
        inside = (first > 0) & (first < F.col("size"))
        return [(F.when(inside, F.lit(1.0)).otherwise(finish(end)), F.when(inside, first).otherwise(F.col("size"))), (finish(end), F.when(inside, F.col("size") - first).otherwise(F.lit(0)))]

    turns = queued.where("size > 0").select("doc_id", "draw", F.explode(F.array(*[F.struct(f.alias("finish"), w.cast("long").alias("size")) for t in range(repeats) for f, w in pieces(t)])).alias("piece"))
    turns = turns.select(F.col("piece.size").alias("size"), "doc_id", "draw", F.col("piece.finish").alias("finish")).where("size > 0")
    key = ["finish", "draw", "doc_id", "size"]
    ranged = stored(turns.repartitionByRange(*key).withColumn("pid", F.spark_partition_id()), "mix-order")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    budget = int(budget * share)
    by_pid = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = ranged.groupBy("pid").agg(F.sum("size").alias("part")).withColumn("upto", F.sum("part").over(by_pid))
    at = spent.where(F.col("upto") > budget).orderBy("pid").first()
    if at is None:
        taken = F.col("size") * repeats
    else:
        running = F.sum("size").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        last = ranged.where(F.col("pid") == at["pid"]).withColumn("upto", running + F.lit(at["upto"] - at["part"])).where(F.col("upto") > budget).orderBy(*key).first()
        stop = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["draw"]).cast("long").alias("draw"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"))
        taken = sum((F.when(F.struct(f.alias("finish"), "draw", "doc_id", w.cast("long").alias("size")) < stop, w).otherwise(F.lit(0)) for t in range(repeats) for f, w in pieces(t)), F.lit(0))
    return queued.select("doc_id", "draw", "size", "source_size", "target", taken.cast("long").alias("taken"))
