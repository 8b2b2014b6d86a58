"""String functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_:]*(?:\.[A-Za-z_0-9]+|\[[^\]]*\])*)"


def tokens(text: Column) -> Column:
    """Lower-case words of a name, split at camel-case steps and anything but letters and digits."""
    apart = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def has_token(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in words])), F.lit(False))


def classified(text: Column, kinds: dict[str, Sequence[str]]) -> Column:
    """Sorted array of the kinds whose words occur in the text."""
    return F.array_compact(F.array(*[F.when(has_token(text, kinds[k]), F.lit(k)) for k in sorted(kinds)]))


def identifiers(text: Column) -> Column:
    """Identifiers with members and subscripts, without true and false."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin("true", "false"))


def root_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^([^.\[]*)", 1)


def member_of(path: Column) -> Column:
    """What follows the root, or null."""
    return F.nullif(F.regexp_extract(path, r"^[^.\[]*(.*)$", 1), F.lit(""))


def folded(text: Column) -> Column:
    """Lower case with white space trimmed and runs of it made one space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def unit_suffix(description: Column) -> Column:
    """Engineering unit in brackets at the end of a description, or null."""
    return F.nullif(F.regexp_extract(description, r"\(([^()]+)\)\s*$", 1), F.lit(""))


def mac_from_octets(octets: Column) -> Column:
    """aa:bb:cc from a dotted decimal suffix."""
    return F.array_join(F.transform(F.split(octets, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), ":")


def is_ipv4(text: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def pointer_token(key: Column) -> Column:
    """A key as a JSON pointer token."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_path(pointer: str) -> list[str]:
    """Keys of an RFC 6901 pointer, plain or as a percent-encoded fragment."""
    from urllib.parse import unquote

    if pointer.startswith("#"):
        pointer = unquote(pointer[1:])
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def duration_literal(ms: Column) -> Column:
    """T#1234ms."""
    return F.format_string("T#%dms", ms.cast("long"))
