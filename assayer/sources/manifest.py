"""Corpora that are read again and again: a manifest says which files are new, changed or gone.

A file is read if the manifest doesn't have it with its length and time of change. Its
checksum then tells whether it really differs. Results are kept a file, so what a run adds,
replaces or takes back follows from the files alone. Each run is a folder of its own beside the last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import store_of

FILE = "path string, length long, modified timestamp, sha256 string"


def listed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, length and time of change of the files below ``folder`` that aren't empty; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def differences(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """path, length, modified, known_sha256 and state of every file: new, touched, same or gone."""
    if manifest is None:
        return files.select("path", "length", "modified", F.lit(None).cast("string").alias("known_sha256"), F.lit("new").alias("state"))
    known = manifest.select(F.col("path").alias("p"), F.col("length").alias("l"), F.col("modified").alias("m"), F.col("sha256").alias("known_sha256"))
    both = files.join(known, F.col("path") == F.col("p"), "full")
    same = (F.col("length") == F.col("l")) & (F.col("modified") == F.col("m"))
    state = F.when(F.col("path").isNull(), "gone").when(F.col("p").isNull(), "new").when(same, "same").otherwise("touched")
    return both.select(F.coalesce("path", "p").alias("path"), F.coalesce("length", "l").alias("length"), F.coalesce("modified", "m").alias("modified"), "known_sha256", state.alias("state"))


def update(spark: SparkSession, folder: str, glob: str, store: str, rows_of: Callable[[str, bytes], Iterator[dict]], ddl: str, tasks: int | None = None) -> dict[str, int]:
    """Bring the corpus in ``store`` up to the files below ``folder``; the number of files by what was done.

    ``rows_of(path, content)`` gives a file's rows of the columns ``ddl``. Only new and touched files
    are opened, by the tasks that parse them; a touched file with the checksum that it had
    keeps its rows. ``corpus`` and ``manifest`` read the last run. A run that fails leaves the one
    before it as it was: the number of the run is written last.
    """
    run, before = last_run(spark, store), None
    if run is not None:
        before = spark.read.parquet(f"{store}/run={run}/manifest")
    from ..storage import stored

    files = stored(differences(listed(spark, folder, glob), before), "manifest")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], f"path string, sha256 string, row {_struct(ddl)}").schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for path, known in zip(b.column("path").to_pylist(), b.column("known_sha256").to_pylist()):
                source, at = store_of(path)
                with source.open_input_stream(at, compression=None) as f:
                    content = f.read()
                digest = hashlib.sha256(content).hexdigest()
                rows = [] if digest == known else [{"path": path, "sha256": digest, "row": r} for r in rows_of(path, content)]
                yield pa.RecordBatch.from_pylist([{"path": path, "sha256": digest, "row": None}, *rows], schema)

    wanted = files.where("state in ('new', 'touched')")
    n = wanted.count()
    read = wanted.select("path", "known_sha256").repartition(max(1, min(n, tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(opened, f"path string, sha256 string, row {_struct(ddl)}")
    read = stored(read, "manifest-read")
    digests = read.where("row is null").select("path", "sha256")
    now = files.where("state <> 'gone'").join(digests, "path", "left").withColumn("sha256", F.coalesce("sha256", "known_sha256"))
    changed = now.where("known_sha256 is null or sha256 <> known_sha256").select("path")
    target = f"{store}/run={0 if run is None else run + 1}"
    now.select("path", "length", "modified", "sha256").write.parquet(f"{target}/manifest")
    fresh = read.where("row is not null").select("path", "row.*")
    if run is not None:
        kept = spark.read.parquet(f"{store}/run={run}/rows")
        kept = kept.join(now.select("path"), "path", "left_semi").join(changed, "path", "left_anti")
        fresh = kept.unionByName(fresh)
    fresh.write.parquet(f"{target}/rows")
    counts = {r["state"]: r["n"] for r in files.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts["read"] = n
    counts["parsed"] = changed.count()
    spark.range(1).select(F.lit(0 if run is None else run + 1).alias("run")).write.mode("append").parquet(f"{store}/runs")
    return counts


def _struct(ddl: str) -> str:
    return f"struct<{', '.join(': '.join(c.strip().split(' ', 1)) for c in ddl.split(', '))}>"


def last_run(spark: SparkSession, store: str) -> int | None:
    """The number of the last run that was finished, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("run int").parquet(f"{store}/runs").agg(F.max("run")).first()[0]
    except AnalysisException:
        return None


def corpus(spark: SparkSession, store: str) -> DataFrame:
    """path and the rows of all files, as the last run left them."""
    return spark.read.parquet(f"{store}/run={last_run(spark, store)}/rows")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """FILE rows of the last run."""
    return spark.read.parquet(f"{store}/run={last_run(spark, store)}/manifest")
