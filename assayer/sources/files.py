"""Text files by name: the sink for formats that Spark has no writer for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import qualified, send_package


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it. Without a scheme, or with file:, it is a mounted folder."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Write every row of ``files`` (name, content as text) to a file of that name; their number.

    Each task writes its own files; a task that runs again writes the same ones anew.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    send_package(files.sparkSession)
    folder = qualified(files.sparkSession, folder)
    return files.select("name", "content").mapInArrow(written, "n long").agg(F.sum("n")).first()[0] or 0
