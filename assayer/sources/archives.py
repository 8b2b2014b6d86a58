"""Object archives in XML, read by record: a file is split into ranges of bytes that many tasks read.

A record begins where the bytes match a pattern that occurs nowhere else, as a start tag and
the tag that always follows it; it belongs to the task in whose range that match begins, and
that task reads on until the element is closed. So no record is read twice, none is
lost at a border, and a task holds one record and a batch of at most a block at a time. A task takes
as many ranges as make a fair share of all bytes, so many small files are few tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..storage import qualified, send_package
from .files import store_of

# How an entry of an archive begins, and the element that it is.
ENTRY = r"<Single\b[^>]*>\s*<Single\b[^>]*\bName=\"MetaObject\""
ELEMENT = "Single"
#: The name of an entry, in what describes it.
NAME = rb"<Single\b[^>]*\bName=\"Name\"[^>]*>([^<]*)<"
#: Bytes read at once, and the longest match of a record's beginning.
BLOCK, LONGEST = 1 << 20, 1 << 13
#: Tasks that all bytes are shared among, if a task's share is neither below a block nor above LARGEST bytes.
TASKS, LARGEST = 256, 32 << 20


class Ranges(InputPartition):
    """What one task reads: path, start and end of one range or several."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        super().__init__(ranges)
        self.ranges = ranges


def shares(files: Sequence[tuple[str, int]], split: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of all files (path and size), by task.

    Files are cut at multiples of ``split`` bytes; pieces are dealt in order, and those of a file that
    follow each other in a task are one range.
    """
    room = max(split, min(LARGEST, max(BLOCK, sum(size for _, size in files) // TASKS)))
    out: list[list[tuple[str, int, int]]] = []
    left = 0
    for path, size in files:
        for at in range(0, size, split):
            end = min(at + split, size)
            if not out or end - at > left:
                out.append([])
                left = room
            if out[-1] and out[-1][-1][0] == path:
                out[-1][-1] = (path, out[-1][-1][1], end)
            else:
                out[-1].append((path, at, end))
            left -= end - at
    return out


def _close(data: bytes, at: int, tags: re.Pattern[bytes], depth: int) -> tuple[int, int, int]:
    """Where the element that is ``depth`` levels open ends, or -1; how far was read, and the depth there."""
    last = at
    for m in tags.finditer(data, at):
        if m[1]:
            depth -= 1
        elif not m[0].endswith(b"/>"):
            depth += 1
        last = m.end()
        if not depth:
            return last, last, 0
    return -1, last, depth


def records(path: str, start: int, end: int, pattern: str = ENTRY, element: str = ELEMENT) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every record of a file that begins from ``start`` up to ``end``."""
    begins = re.compile(pattern.encode())
    tags = re.compile(rf"<(/?){re.escape(element)}(?=[\s/>])[^>]*>".encode())
    store, at_path = store_of(path)
    with store.open_input_file(at_path) as f:
        data, base = b"", start

        def more() -> bool:
            nonlocal data
            f.seek(base + len(data))
            got = f.read(BLOCK)
            data += got
            return bool(got)

        at = 0
        while True:
            m = begins.search(data, at)
            if m is None:
                # A match may begin in the last bytes that were read, but nowhere before.
                at = max(at, len(data) - LONGEST)
                data, base, at = data[at:], base + at, 0
                if base >= end or not more():
                    return
                continue
            if base + m.start() >= end:
                return
            data, base = data[m.start() :], base + m.start()
            close, seen, depth = _close(data, 0, tags, 0)
            while close < 0:
                if not more():
                    raise ValueError(f"{path}: the record at byte {base} isn't closed")
                close, seen, depth = _close(data, seen, tags, depth)
            yield base, data[:close]
            at = close


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", 32 << 20))
        self.pattern, self.element, self.suffix = options.get("pattern", ENTRY), options.get("element", ELEMENT), options.get("suffix", ".export").lower()
        self.names: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An entry's name is compared before its bytes are decoded; others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.names is None:
                self.names = [f.value]
            else:
                yield f

    def partitions(self) -> Sequence[Ranges]:
        store, root = store_of(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.path.removesuffix(root) if "://" in self.path else ""
        found = [(prefix + i.path, i.size) for i in sorted(files, key=lambda i: i.path) if i.type == fs.FileType.File and i.path.lower().endswith(self.suffix)]
        return [Ranges(r) for r in shares(found, self.split)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("name", pa.string()), ("xml", pa.string())])
        rows: list[tuple] = []
        held = 0
        for path, start, end in partition.ranges:
            for offset, raw in records(path, start, end, self.pattern, self.element):
                m = re.search(NAME, raw)
                name = _text(m[1]) if m else None
                if self.names is None or name in self.names:
                    rows.append((path, offset, name, raw.decode("utf-8", "replace")))
                    held += len(raw)
                if held >= BLOCK:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


def _text(raw: bytes) -> str:
    from html import unescape

    return unescape(raw.decode("utf-8", "replace"))


class ArchiveSource(DataSource):
    """``spark.read.format("archive")``: file, start (byte), name and xml of every entry."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "file string, start long, name string, xml string"

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Entries of all ``.export`` archives below ``path``, whose files are cut at multiples of ``split_bytes``."""
    send_package(spark)
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive").option("splitBytes", split_bytes).load(qualified(spark, path))


VISUAL = "element_ordinal int, element_id int, identifier string, element_type string, properties map<string,string>, bindings array<string>"
BINDING = re.compile(r"\b(?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*\b")
#: Beginnings of names that belong to the tool and bind nothing.
OWN_NAMES = ("System.", "VisuDialogs.")


def visual_elements(entries: DataFrame) -> DataFrame:
    """file, name, width, height and VISUAL of every element of the entries that are visualizations.

    properties are the element's numbered members, bindings its dotted names, each once, in order.
    """
    from xml.etree import ElementTree

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"file string, name string, width int, height int, {VISUAL}"
    schema = to_arrow_schema(entries.sparkSession.createDataFrame([], ddl).schema)

    def value(node: ElementTree.Element, name: str) -> str | None:
        return next((e.text for e in node.iter(ELEMENT) if e.get("Name") == name and e.text), None)

    def number(node: ElementTree.Element, name: str) -> int | None:
        found = value(node, name)
        return int(found) if found and re.fullmatch(r"\s*-?\d+\s*", found) else None

    def rows(file: str, name: str | None, xml: str) -> Iterator[dict]:
        entry = ElementTree.fromstring(xml)
        listed = entry.find("./Single[@Name='Object']/Single[@Name='VisualElemList']/List[@Name='VisualElementList']")
        if listed is None or not name:
            return
        for i, item in enumerate(listed.findall("./Single")):
            members = [(m.get("Name"), m.text or "") for m in item.iter(ELEMENT) if (m.get("Name") or "").isdigit()]
            names = dict.fromkeys(BINDING.findall(ElementTree.tostring(item, encoding="unicode")))
            yield {"file": file, "name": name, "width": number(entry, "Width"), "height": number(entry, "Height"), "element_ordinal": i, "element_id": number(item, "VisualElementId"), "identifier": value(item, "VisualElementIdentifier"), "element_type": value(item, "VisualElementName"), "properties": list(dict(members).items()), "bindings": [b for b in names if not b.startswith(OWN_NAMES)]}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for file, name, xml in zip(*[b.column(c).to_pylist() for c in ("file", "name", "xml")]):
                found += rows(file, name, xml)
                if len(found) >= 1000:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    return entries.select("file", "name", "xml").mapInArrow(parsed, ddl)
