"""Digests and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def relationship_key(fields: dict[str, Column], prefix: str = "ce:", digits: int = 24) -> Column:
    """Prefix and the first hex digits of the SHA-256 of the canonical JSON."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(fields), 256), 1, digits))


def manifest_entry(text: Column) -> Column:
    """struct<sha256, bytes> of a text in UTF-8."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))


def name_uuid(namespace: Column, name: Column) -> Column:
    """Version 5 UUID of a name: SHA-1 over the namespace's bytes and the name."""
    hex_ = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(hex_, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.concat(F.lit("5"), F.substring(hex_, 14, 3)), F.concat(variant, F.substring(hex_, 18, 3)), F.substring(hex_, 21, 12))
