"""Tables in the shared folder, joins on keys that hold a large share of the rows, and the package on the workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sessions whose workers have the package.
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    # The driver serves this file as long as it lives; workers import the package from it.
    folder, here = tempfile.mkdtemp(prefix="assayer-package-"), Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name))
    _SENT.add(context.applicationId)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and store that Spark takes it to be in, so that all tasks mean the same place."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``, with its scheme.

    Where that is unset, a temporary folder is set as checkpoint folder if the master is
    local; on a cluster that is an error, as executors don't see each other's folders. The
    workers get the package as well, as whoever needs the folder runs jobs.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="assayer-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    send_package(spark)
    return qualified(spark, found.rstrip("/"))


def stored(df: DataFrame, tag: str, partition_by: Sequence[str] = (), **options: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, by the values of ``partition_by`` if any.

    This cuts the lineage: a lost executor costs a reread, never a recomputation
    of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def join_hot(many: DataFrame, one: DataFrame, key: str, copies: Column, rows: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on ``key`` (inner or left), whatever share of ``many`` a key holds.

    ``copies`` (of ``one``) is how many rows of ``many`` a row's key has, about, and ``rows`` how many
    ``many`` has in all. Keys with more than a quarter of a partition's share are hot:
    their rows are dealt to as many tasks as they have such quarters, by a hash of the
    whole row, and the rows of ``one`` are sent to each of these. There are four hot keys a
    partition at most, so what is broadcast (hot keys and their numbers of tasks) is bounded.
    """
    quarter = max(1, rows // (4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tasks, salt = fresh(many, "tasks"), fresh(many, "salt")
    counted = one.withColumn(tasks, F.greatest(F.lit(1), F.ceil(F.coalesce(copies, F.lit(0)) / quarter)).cast("int"))
    hot = F.broadcast(counted.where(F.col(tasks) > 1).select(key, tasks).distinct())
    dealt = many.join(hot, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(tasks)), F.lit(0)).cast("int")).drop(tasks)
    spread = counted.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(tasks) - 1))).drop(tasks)
    return dealt.join(spread, [key, salt], how).drop(salt)
