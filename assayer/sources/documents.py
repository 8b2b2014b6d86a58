"""XML documents as rows from which they can be written again: nothing of them is lost.

Elements, texts, comments and instructions are rows in document order. Names keep their
prefixes and attributes their order, so unknown ones survive as any other. A row knows the
place of the last one below it: that tells where its end tag stands, and one sort of a
document's rows writes it, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .descriptions import _per_file, binary_files

NODE = "document string, place long, parent_place long, last_place long, depth int, kind string, name string, attributes array<struct<name:string,value:string>>, text string"


def canonical_digest(content: bytes | str) -> str:
    """SHA-256 of a document's canonical XML, comments included."""
    return hashlib.sha256(ElementTree.canonicalize(content.decode("utf-8-sig") if isinstance(content, bytes) and b"encoding" not in content[:200] else content, with_comments=True).encode()).hexdigest()


def _nodes(path: str, content: bytes) -> Iterator[dict]:
    rows: list[dict] = []
    open_: list[int] = []

    def add(kind: str, name: str | None, text: str | None, attributes: Sequence[str] = ()) -> None:
        place = len(rows)
        rows.append({"document": path, "place": place, "parent_place": open_[-1] if open_ else None, "last_place": place, "depth": len(open_), "kind": kind, "name": name, "attributes": [{"name": n, "value": v} for n, v in zip(attributes[::2], attributes[1::2])], "text": text})

    def start(name: str, attributes: list[str]) -> None:
        add("element", name, None, attributes)
        open_.append(len(rows) - 1)

    def end(name: str) -> None:
        rows[open_.pop()]["last_place"] = len(rows) - 1

    parser = expat.ParserCreate()
    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: add("text", None, text)
    parser.CommentHandler = lambda text: add("comment", None, text)
    parser.ProcessingInstructionHandler = lambda target, text: add("instruction", target, text)
    parser.Parse(content, True)
    yield from rows


def read_documents(spark: SparkSession, path: str | list[str], suffix: str) -> DataFrame:
    """NODE rows of all XML files below ``path`` with a suffix. A malformed document is an error."""
    return _per_file(binary_files(spark, path, suffix), _nodes, NODE)


def document_digests(spark: SparkSession, path: str | list[str], suffix: str) -> DataFrame:
    """document and digest (of its canonical form) of every file."""
    return _per_file(binary_files(spark, path, suffix), lambda p, content: iter([{"document": p, "digest": canonical_digest(content)}]), "document string, digest string")


def _escaped(text: Column, more: Sequence[tuple[str, str]] = ()) -> Column:
    out = text
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;"), *more):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def written(nodes: DataFrame) -> DataFrame:
    """document and content (text) of every document that ``nodes`` (NODE rows) describes.

    Each row is one or two marks: its beginning, and an element's end after its last row, the
    deepest first. A document's marks meet in one row, as the document itself does.
    """
    quoted = lambda v: F.concat(F.lit('"'), _escaped(v, (('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"))), F.lit('"'))
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat(F.lit(" "), a["name"], F.lit("="), quoted(a["value"]))), "")
    begin = (
        F.when(F.col("kind") == "element", F.concat(F.lit("<"), "name", attributes, F.lit(">")))
        .when(F.col("kind") == "text", _escaped(F.col("text")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "text", F.lit("-->")))
        .otherwise(F.concat(F.lit("<?"), "name", F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise(""), F.lit("?>")))
    )
    mark = lambda at, closes, order, text: F.struct(at.alias("at"), F.lit(closes).alias("closes"), order.alias("order"), text.alias("text"))
    ends = F.when(F.col("kind") == "element", mark(F.col("last_place"), 1, -F.col("depth"), F.concat(F.lit("</"), "name", F.lit(">"))))
    marks = nodes.select("document", F.explode(F.array_compact(F.array(mark(F.col("place"), 0, F.lit(0), begin), ends))).alias("m"))
    whole = marks.groupBy("document").agg(F.array_sort(F.collect_list("m")).alias("marks"))
    return whole.select("document", F.array_join(F.transform("marks", lambda m: m["text"]), "").alias("content"))


def digests_of(contents: DataFrame) -> DataFrame:
    """document and digest of the canonical form of each ``content``."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_digest)

    return contents.select("document", digest("content").alias("digest"))


def unknown_content(nodes: DataFrame, known: dict[str, Sequence[str]]) -> DataFrame:
    """document, place, element and attribute of what a reader doesn't know.

    known: attribute names of each element that it knows. An element that it doesn't know is a
    row without attribute, an unknown attribute of a known element one with it.
    """
    elements = nodes.where("kind = 'element'")
    names = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))])
    own = F.try_element_at(names, F.col("name"))
    others = F.array_except(F.transform("attributes", lambda a: a["name"]), own)
    strange = F.when(own.isNull(), F.array(F.lit(None).cast("string"))).otherwise(others)
    return elements.select("document", "place", F.col("name").alias("element"), F.explode(strange).alias("attribute"))
