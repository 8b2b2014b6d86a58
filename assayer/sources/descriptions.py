"""Device descriptions and mappings: EDS, GSD, PSJ and gateway CSV files as rows.

A description is a file of kilobytes; each is read by one task, many files by many.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import send_package

ASSIGNMENT = "source string, section string, ordinal long, name string, values array<string>"
#: The byte that every byte of a PSJ document is combined with.
PSJ_BYTE = 0x5A


def _per_file(files: DataFrame, rows_of: Callable[[str, bytes], Iterator[dict]], ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    send_package(files.sparkSession)
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], ddl).schema)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                rows = list(rows_of(path.as_py(), content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(parsed, ddl)


def binary_files(spark: SparkSession, path: str | list[str], suffix: str) -> DataFrame:
    """path and content of all files below ``path`` with a suffix in any case; each once."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).dropDuplicates(["path"])


def _split_quoted(text: str) -> list[str]:
    """Fields between commas that aren't inside quotes, trimmed; quotes stay."""
    out, start, inside = [], 0, False
    for i, c in enumerate(text):
        inside ^= c == '"'
        if c == "," and not inside:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _without_comment(line: str, mark: str) -> str:
    inside = False
    for i, c in enumerate(line):
        inside ^= c == '"'
        if c == mark and not inside:
            return line[:i]
    return line


def _eds_rows(path: str, content: bytes) -> Iterator[dict]:
    section, pending, ordinal = None, "", 0
    for line in content.decode("utf-8-sig", "replace").splitlines():
        line = _without_comment(line, "$").strip()
        if not pending and (m := re.fullmatch(r"\[([^\]]*)\]", line)):
            section = m[1].strip()
        elif section is not None and line:
            pending = f"{pending} {line}".strip()
            while (end := _end_of(pending)) >= 0:
                name, sep, value = pending[:end].partition("=")
                pending = pending[end + 1 :].strip()
                if sep:
                    yield {"source": path, "section": section, "ordinal": ordinal, "name": name.strip(), "values": _split_quoted(value)}
                    ordinal += 1


def _end_of(text: str) -> int:
    inside = False
    for i, c in enumerate(text):
        inside ^= c == '"'
        if c == ";" and not inside:
            return i
    return -1


def read_eds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ASSIGNMENT rows of EDS files: ``name = value, value;`` below a [Section].

    Text after $ is a comment; commas and semicolons in quotes are text; what comes
    before the first section is skipped.
    """
    return _per_file(binary_files(spark, path, "eds"), _eds_rows, ASSIGNMENT)


def unquoted(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(value, '^"|"$', ""), '""', '"'), F.lit(""))


def eds_identity(rows: DataFrame) -> DataFrame:
    """One row a file: vendor, product type, code, revision and name of its [Device]."""
    names = {"VendCode": "vendor_id", "ProdType": "product_type", "ProdCode": "product_code", "MajRev": "major", "MinRev": "minor"}
    first = F.try_element_at("values", F.lit(1))
    device = rows.where("section = 'Device'")
    numbers = [F.max(F.when(F.col("name") == n, first.try_cast("int"))).alias(c) for n, c in names.items()]
    return device.groupBy("source").agg(*numbers, F.max(F.when(F.col("name") == "ProdName", unquoted(first))).alias("product_name"))


def logical_path(text: Column) -> Column:
    """Segments (kind, value) of a connection path of 8-bit logical segments in hex.

    0x20 is a class, 0x24 an instance, 0x2C a connection point, 0x30 an attribute; any
    other byte is taken as ``unknown`` with the byte after it.
    """
    octets = F.transform(F.split(F.trim(unquoted(text)), r"\s+"), lambda x: F.conv(x, 16, 10).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size(octets) / 2).cast("int") - 1), lambda i: F.struct(F.get(octets, i * 2).alias("code"), F.get(octets, i * 2 + 1).alias("value")))
    kinds = F.create_map(*[F.lit(x) for kv in {0x20: "class", 0x24: "instance", 0x2C: "connection_point", 0x30: "attribute"}.items() for x in kv])
    return F.when(F.size(octets) >= 2, F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_element_at(kinds, p["code"]), F.lit("unknown")).alias("kind"), p["value"].alias("value"))))


def assembly_candidates(rows: DataFrame) -> DataFrame:
    """source, connection and connection points of paths with one class segment, which is 4."""
    paths = rows.where("section = 'Connection Manager'").where(F.col("name").rlike(r"^Connection\d+$")).select("source", F.col("name").alias("connection"), logical_path(F.try_element_at("values", F.lit(15))).alias("segments"))
    of = lambda kind: F.transform(F.filter("segments", lambda s: s["kind"] == kind), lambda s: s["value"])
    return paths.where(F.size(of("class")) == 1).where(of("class")[0] == 4).select("source", "connection", of("connection_point").alias("connection_points"))


def _gsd_rows(path: str, content: bytes) -> Iterator[dict]:
    text = re.sub(r"\\\s*\n", " ", content.decode("latin-1").replace("\r\n", "\n"))
    module, ordinal = None, 0
    for line in text.split("\n"):
        line = _without_comment(line, ";").strip()
        if not line or line.startswith("#"):
            continue
        name, sep, value = line.partition("=")
        name = name.strip()
        if name.lower() == "endmodule":
            module = None
        elif sep:
            if name.lower() == "module":
                module = value.strip()
                quoted = re.match(r'"([^"]*)"\s*(.*)', module)
                module, value = (quoted[1], quoted[2]) if quoted else (module, "")
                name = "Module"
            yield {"source": path, "section": module, "ordinal": ordinal, "name": name, "values": _split_quoted(value)}
            ordinal += 1


def read_gsd(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ASSIGNMENT rows of GSD files; section is the module they are in, null outside.

    A row named Module has the module's configuration bytes as values. Text after ; is
    a comment, a backslash at the end joins lines.
    """
    return _per_file(binary_files(spark, path, "gsd"), _gsd_rows, ASSIGNMENT)


def cyclic_identifier(octet: Column) -> dict[str, Column]:
    """direction, unit, count and consistent of a PROFIBUS identifier byte.

    Bits 4 and 5 are the direction (0: special format, not decoded), bit 6 the unit,
    the low nibble the count less one, bit 7 consistency over the whole.
    """
    direction = F.shiftright(octet, 4).bitwiseAND(F.lit(3))
    known = direction != 0
    return {
        "direction": F.when(direction == 1, "input").when(direction == 2, "output").when(direction == 3, "both"),
        "unit": F.when(known, F.when(F.shiftright(octet, 6).bitwiseAND(F.lit(1)) == 1, "word").otherwise("byte")),
        "count": F.when(known, octet.bitwiseAND(F.lit(15)) + 1),
        "consistent": F.when(known, F.shiftright(octet, 7).bitwiseAND(F.lit(1)) == 1),
    }


XML_ELEMENT = "source string, place long, parent_place long, path string, element string, attributes map<string,string>, text string"


def xml_rows(path: str, text: str | bytes) -> Iterator[dict]:
    """All elements of an XML document in order, with the place of their parent."""
    pending, place = [(None, "", ElementTree.fromstring(text))], 0
    while pending:
        parent, above, element = pending.pop()
        tag = element.tag.rpartition("}")[2]
        here = f"{above}/{tag}"
        yield {"source": path, "place": place, "parent_place": parent, "path": here, "element": tag, "attributes": list(element.attrib.items()), "text": (element.text or "").strip() or None}
        pending.extend((place, here, child) for child in reversed(element))
        place += 1


def read_psj(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """XML_ELEMENT rows of PSJ files: Base64 of XML whose bytes are combined with PSJ_BYTE."""
    import base64

    def rows(name: str, content: bytes) -> Iterator[dict]:
        yield from xml_rows(name, bytes(b ^ PSJ_BYTE for b in base64.b64decode(content)))

    return _per_file(binary_files(spark, path, "psj"), rows, XML_ELEMENT)


MAPPING = ("mapping_id", "source_interface", "source_reference", "target_interface", "target_reference", "evidence")
REQUIRED = ("source_interface", "target_interface", "evidence")


def read_gateway_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of gateway mapping files with a header: row_number (from 2), the MAPPING
    columns (blank: null), extra (map of all others) and missing (required ones that are null)."""
    import csv
    import io

    def rows(name: str, content: bytes) -> Iterator[dict]:
        for n, row in enumerate(csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline="")), 2):
            known = {c: (row.get(c) or "").strip() or None for c in MAPPING}
            yield {"source": name, "row_number": n, **known, "extra": [(k, v or "") for k, v in row.items() if k is not None and k not in MAPPING]}

    columns = ", ".join(f"{c} string" for c in MAPPING)
    found = _per_file(binary_files(spark, path, "csv"), rows, f"source string, row_number long, {columns}, extra map<string,string>")
    return found.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])))


def apply_gateway_mappings(rows: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose two interfaces are known by name, and the complete rows of which one isn't."""
    names = interfaces.select(F.col("name").alias("__name")).distinct()
    complete = rows.where(F.size("missing") == 0)
    half = complete.join(names, F.col("source_interface") == F.col("__name"), "left").withColumnRenamed("__name", "__source")
    both = half.join(names, F.col("target_interface") == F.col("__name"), "left")
    good = F.col("__source").isNotNull() & F.col("__name").isNotNull()
    return both.where(good).select(rows.columns), both.where(~good).select(rows.columns)
