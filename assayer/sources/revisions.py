"""A table in numbered revisions that one of several writers wins: ``df.write.format("revisions")``.

Tasks write their parts to a folder of the attempt, which no reader looks into. The commit
checks that the revision which the writer started from is still the last and that every history
goes on from it, and then publishes the new one by a link that can't be made twice. A
writer that comes too late, or whose tasks fail, leaves nothing behind.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..storage import send_package


class StaleRevision(ValueError):
    """Another writer has published a revision since."""


class BrokenHistory(ValueError):
    """A key's history doesn't begin with what it was."""


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file:"):
        raise ValueError("revisions need a shared folder that is mounted on driver and executors, as links are made there")
    return "/" + path.removeprefix("file:").lstrip("/")


def last_revision(path: str) -> int:
    """Number of the last published revision, 0 if there is none."""
    root = _local(path)
    names = os.listdir(root) if os.path.isdir(root) else []
    return max((int(n[9:-5]) for n in names if n.startswith("revision-") and n.endswith(".json")), default=0)


def _published(path: str, revision: int) -> dict:
    with open(f"{_local(path)}/revision-{revision:08d}.json") as f:
        return json.load(f)


class RevisionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.expected = options["path"], int(options["expectedrevision"])
        self.key, self.history = options.get("key"), options.get("history")
        self.folder = f"parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        folder = f"{_local(self.path)}/{self.folder}"
        os.makedirs(folder, exist_ok=True)
        name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            writer = writer or pq.ParquetWriter(f"{folder}/{name}", batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer:
            writer.close()
        return Part(name if writer else "", rows)

    def commit(self, messages: list[Part | None]) -> None:
        """Publish what the tasks that count have written, as one revision or not at all."""
        root, parts = _local(self.path), [m for m in messages if m is not None and m.name]
        os.makedirs(f"{root}/{self.folder}", exist_ok=True)
        try:
            found = last_revision(self.path)
            if found != self.expected:
                raise StaleRevision(f"revision {self.expected} was expected, {found} is the last")
            said = {"revision": self.expected + 1, "folder": self.folder, "parts": sorted(p.name for p in parts), "rows": sum(p.rows for p in parts)}
            draft = f"{root}/{self.folder}/said.json"
            with open(draft, "w") as f:
                json.dump(said, f)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, f"{root}/revision-{self.expected + 1:08d}.json")
            except FileExistsError:
                raise StaleRevision(f"revision {self.expected + 1} was published meanwhile") from None
        except Exception:
            self.abort(messages)
            raise

    def abort(self, messages: list[Part | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            shutil.rmtree(f"{_local(self.path)}/{self.folder}")


class RevisionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revisions"

    def writer(self, schema: StructType, overwrite: bool) -> RevisionWriter:
        return RevisionWriter(self.options, schema)


def load(spark: SparkSession, path: str, revision: int | None = None) -> DataFrame | None:
    """A published revision, the last one if none is named; None if there is none."""
    number = last_revision(path) if revision is None else revision
    if not number:
        return None
    said = _published(path, number)
    root = _local(path)
    return spark.read.parquet(*[f"file://{root}/{said['folder']}/{p}" for p in said["parts"]])


def save(state: DataFrame, path: str, expected_revision: int, key: str | None = None, history: str | None = None) -> int:
    """Publish ``state`` as the revision after the expected one; its number.

    Raises StaleRevision if that isn't the last one, before anything is written or at the
    commit. With ``key`` and ``history`` (an array column) each key of the expected revision must
    still be there and its history begin with what it was, else BrokenHistory names how many do not. A revision needs a row.
    """
    spark = state.sparkSession
    if last_revision(path) != expected_revision:
        raise StaleRevision(f"revision {expected_revision} was expected, {last_revision(path)} is the last")
    before = load(spark, path)
    if before is not None and key and history:
        old, new = before.select(key, F.col(history).alias("old")), state.select(key, F.col(history).alias("new"))
        goes_on = F.slice("new", 1, F.greatest(F.size("old"), F.lit(0))) == F.col("old")
        broken = old.join(new, key, "left").where(~F.coalesce(goes_on, F.lit(False))).count()
        if broken:
            raise BrokenHistory(f"{broken} histories aren't continued")
    send_package(spark)
    spark.dataSource.register(RevisionSource)
    try:
        state.write.format("revisions").option("expectedRevision", expected_revision).mode("append").save(path)
    except Exception as e:
        if "StaleRevision" in str(e):
            raise StaleRevision(str(e).strip().splitlines()[0]) from e
        raise
    return expected_revision + 1
