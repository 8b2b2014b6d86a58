"""Binary device replies: identity objects, symbol pages and declared layouts."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import unclaimed, unsigned_le

SYMBOL = "page_id string, instance_id long, name string, symbol_type int, symbol_address long, object_address long, software_control long, dimensions array<long>, external_access int, raw_hex string, fault string"
#: Layout of a symbol record after its name; an access byte may follow.
_AFTER_NAME = struct.Struct("<HIIIIII")


def identity(payload: Column) -> dict[str, Column]:
    """Fields of an identity object's attributes, and fault where it is too short.

    The name's length precedes it; state, consistency value and heartbeat follow if the
    payload goes on. All fields are null with a fault.
    """
    size = F.octet_length(payload)
    name_size = unsigned_le(payload, 14, 1)
    end = (F.lit(15) + name_size).cast("int")
    name = F.substring(payload, F.lit(16), name_size.cast("int"))
    fault = F.when(payload.isNull() | (size < 15), "too_short").when(size < end, "name_exceeds_payload").when(~F.is_valid_utf8(name.cast("string")), "name_not_utf8")
    rest = lambda at, width: F.when(size >= end + at + width, sum((F.conv(F.hex(F.substring(payload, end + at + i + 1, F.lit(1))), 16, 10).cast("long") * (1 << 8 * i) for i in range(width)), F.lit(0)))
    fields = {
        "vendor_id": unsigned_le(payload, 0, 2), "device_type": unsigned_le(payload, 2, 2), "product_code": unsigned_le(payload, 4, 2), "major": unsigned_le(payload, 6, 1), "minor": unsigned_le(payload, 7, 1),
        "status": unsigned_le(payload, 8, 2), "serial_number": unsigned_le(payload, 10, 4), "product_name": name.cast("string"), "state": rest(0, 1), "consistency_value": rest(1, 2), "heartbeat_interval": rest(3, 1),
    }
    return {n: F.when(fault.isNull(), c) for n, c in fields.items()} | {"fault": fault}


def _symbols(page: str, payload: bytes, with_access: bool) -> Iterator[dict]:
    at = 0
    while at < len(payload):
        start = at
        try:
            instance, length = struct.unpack_from("<IH", payload, at)
            at += 6
            if at + length > len(payload):
                raise ValueError("symbol name exceeds page")
            name = payload[at : at + length].decode("utf-8")
            kind, address, object_address, control, *dimensions = _AFTER_NAME.unpack_from(payload, at + length)
            at += length + _AFTER_NAME.size
            access = None
            if with_access:
                access = payload[at]
                at += 1
        except (struct.error, ValueError, IndexError) as error:
            yield {"page_id": page, "raw_hex": payload[start:].hex(), "fault": str(error)}
            return
        yield {"page_id": page, "instance_id": instance, "name": name, "symbol_type": kind, "symbol_address": address, "object_address": object_address, "software_control": control, "dimensions": dimensions, "external_access": access, "raw_hex": payload[start:at].hex()}


def symbol_pages(pages: DataFrame, with_access: bool = False) -> DataFrame:
    """SYMBOL rows of pages (page_id, payload): records of a name of any length and fixed fields.

    A record that can't be read ends its page with a row that has a fault and the bytes left.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], SYMBOL).schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for page, payload in zip(b.column("page_id").to_pylist(), b.column("payload").to_pylist()) for r in _symbols(page, payload, with_access)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return pages.where("payload is not null").select(F.col("page_id").cast("string").alias("page_id"), "payload").mapInArrow(rows, SYMBOL)


def inventory_items(symbols: DataFrame) -> DataFrame:
    """capability (programs, routines, tasks or tags) and plain name of every symbol."""
    kinds = {"Program:": "programs", "Routine:": "routines", "Task:": "tasks"}
    capability, name = F.lit("tags"), F.col("name")
    for prefix, kind in kinds.items():
        capability = F.when(F.col("name").startswith(prefix), kind).otherwise(capability)
        name = F.when(F.col("name").startswith(prefix), F.substring("name", len(prefix) + 1, 10_000)).otherwise(name)
    return symbols.where("fault is null").select("page_id", "instance_id", capability.alias("capability"), name.alias("name"))


def declared_fields(payload: Column, profile: Sequence[tuple[str, int, int]]) -> dict[str, Column]:
    """Unsigned little-endian fields (name, offset, width) of a payload, and its unclaimed bytes.

    Fields that overlap are an error; a field beyond the payload is null.
    """
    spans = [(offset, width) for _, offset, width in profile]
    return {name: unsigned_le(payload, offset, width) for name, offset, width in profile} | {"unclaimed": unclaimed(payload, spans)}
