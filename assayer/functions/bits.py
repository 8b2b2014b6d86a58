"""Bit fields, packed images and number literals as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_nibble(status: Column) -> Column:
    """The top four of 16 bits."""
    return F.shiftrightunsigned(status.cast("long").bitwiseAND(F.lit(0xF000)), 12)


def packed_bits(bits: Sequence[Column]) -> Column:
    """A command word: the n-th boolean is bit n; null counts as false."""
    word = F.lit(0).cast("long")
    for n, bit in enumerate(bits):
        word = word + F.when(F.coalesce(bit, F.lit(False)), F.lit(1 << n)).otherwise(F.lit(0))
    return word


def bit_of(word: Column, n: int) -> Column:
    return F.shiftright(word, n).bitwiseAND(F.lit(1)) == 1


def unsigned_le(image: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian integer at a byte offset of a binary image.

    Up to seven bytes fit a long; eight give decimal(20,0). Null where the image is too short.
    """
    octets = [F.conv(F.hex(F.substring(image, offset + i + 1, 1)), 16, 10).cast("decimal(20,0)") for i in range(width)]
    total = octets[0]
    for i, o in enumerate(octets[1:], 1):
        total = total + o * F.lit(1 << (8 * i)).cast("decimal(20,0)")
    value = F.when(F.octet_length(image) >= offset + width, total)
    return value.cast("long") if width < 8 else value.cast("decimal(20,0)")


def signed_le(image: Column, offset: int, width: int) -> Column:
    value = unsigned_le(image, offset, width)
    return F.when(value >= 1 << (8 * width - 1), value - F.lit(1 << (8 * width))).otherwise(value) if width < 8 else F.when(value >= 1 << 63, value - F.lit(1 << 64).cast("decimal(20,0)")).otherwise(value).cast("long")


def unclaimed(image: Column, fields: Sequence[tuple[int, int]]) -> Column:
    """Array of (offset, bytes) that no (offset, width) field claims; overlapping fields are an error."""
    at, gaps = 0, []
    for offset, width in sorted(fields):
        if offset < at:
            raise ValueError(f"field at byte {offset} overlaps the one before it")
        if offset > at:
            gaps.append((at, offset - at))
        at = offset + width
    parts = [F.struct(F.lit(o).alias("offset"), F.substring(image, o + 1, w).alias("bytes")) for o, w in gaps]
    rest = F.struct(F.lit(at).alias("offset"), F.substring(image, at + 1, 2147483647).alias("bytes"))
    return F.filter(F.array(*parts, rest), lambda p: F.octet_length(p["bytes"]) > 0)


def netmask_prefix(mask: Column) -> Column:
    """Prefix length of a dotted netmask, or null where it isn't one."""
    octets = F.split(mask, r"\.")
    word = F.lit(0).cast("long")
    for i in range(4):
        word = word * 256 + F.try_element_at(octets, F.lit(i + 1)).try_cast("long")
    ones = F.bit_count(word)
    whole = F.lit(0xFFFFFFFF) - F.call_function("shiftright", F.lit(0xFFFFFFFF), ones)
    valid = (F.size(octets) == 4) & mask.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (word <= 0xFFFFFFFF)
    return F.when(valid & (word == whole), ones)


def radix_literal(text: Column) -> Column:
    """Integer of a literal like 16#FF, 2#1010, 0x1F or 1_000, or null."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    digits = F.lower(F.regexp_extract(plain, r"^[+-]?(?:\d+#|0[xX])([0-9a-fA-F]+)$", 1))
    base = F.when(plain.rlike(r"^[+-]?0[xX]"), F.lit("16")).otherwise(F.regexp_extract(plain, r"^[+-]?(\d+)#", 1))
    out = F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long"))
    for b, allowed in ((2, "[01]+"), (8, "[0-7]+"), (16, "[0-9a-f]+")):
        value = F.conv(digits, b, 10).try_cast("long")
        out = out if out is None else F.coalesce(out, F.when((base == str(b)) & digits.rlike(f"^{allowed}$"), F.when(plain.startswith("-"), -value).otherwise(value)))
    return out


def clamped_command(value: Column, least: float, most: float, scale: int = 100) -> Column:
    """Value held between two bounds, scaled, truncated toward zero."""
    return (F.least(F.greatest(value, F.lit(least)), F.lit(most)) * scale).cast("int")
