"""Sharding by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards of exact sizes, sends a
multivariate hypergeometric number of rows from each partition to each shard. The matrix
of those counts is drawn from the partitions' row counts alone. Each partition then
permutes its own rows and deals them out by its line of the matrix, the rows are
exchanged, and each shard is permuted again. What a shard gets is spread over random
buckets, so no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 40
#: Rows of a shard that one task permutes, about.
BUCKET_ROWS = 20_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; its margins are exact.

    Shard sizes differ by one at most, the first ones being larger. Each partition draws
    without replacement from the places that are left in the shards, which gives the
    whole matrix the distribution that a uniform permutation has.
    """
    rng, total = np.random.default_rng(seed), sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    matrix = []
    for n in counts:
        line = np.zeros(shards, np.int64)
        rest, places = n, int(left.sum())
        for s in range(shards):
            if rest == 0:
                break
            here = int(left[s])
            got = rest if here == places else int(rng.hypergeometric(here, places - here, rest)) if here else 0
            line[s], rest, places = got, rest - got, places - here
        left -= line
        matrix.append(line.tolist())
    return matrix


def shuffle_to_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """All rows and columns of ``rows`` plus shard (0 to shards - 1) and slot (from 0, gapless).

    Row counts of shards differ by one at most and the order is a uniform shuffle.
    ``rows`` is written once with its partition and random keys, so a lost executor
    can't change a draw that others have used. Repeated rows are rows of their own; an
    empty table gives an empty result. Columns named like the added ones are replaced.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = stored(rows.select(*own, F.spark_partition_id().alias("__part"), F.rand(seed).alias("__first"), F.rand(seed + 1).alias("__second")), "shard-rows")
    counts = [(r["__part"], r["count"]) for r in keyed.groupBy("__part").count().orderBy("__part").collect()]
    total = sum(n for _, n in counts)
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = spark.createDataFrame([(p, np.cumsum(line).tolist()) for (p, _), line in zip(counts, matrix)], "__part int, __ends array<long>")
    local = Window.partitionBy("__part").orderBy("__first", "__second")
    dealt = keyed.withColumn("__at", F.row_number().over(local)).join(ends, "__part")
    dealt = dealt.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__at"))).cast("int")).withColumn("__bucket", F.floor(F.col("__second") * buckets).cast("int"))
    dealt = stored(dealt.select(*own, "shard", "__bucket", "__second", "__first"), "shard-dealt")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "__bucket", F.coalesce(before, F.lit(0)).alias("__offset"))
    again = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__second", "__first"))
    return dealt.withColumn("__slot", again).join(offsets, ["shard", "__bucket"]).select(*own, "shard", (F.col("__offset") + F.col("__slot") - 1).cast("long").alias("slot"))
