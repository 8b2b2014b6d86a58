"""JSON evidence as a table of nodes: pointers, records, references and structural diffs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pointer_path

NODE = "doc string, pointer string, parent string, key string, kind string, record_type string, name string, scalar string, place long"


def _nodes(doc: str, text: str) -> Iterator[dict]:
    """All nodes of one document in order; scalar is the value as JSON text."""
    pending, place = [("", None, None, json.loads(text))], 0
    while pending:
        pointer, parent, key, value = pending.pop()
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"
        named = value if kind == "object" else {}
        yield {"doc": doc, "pointer": pointer, "parent": parent, "key": key, "kind": kind, "record_type": named.get("$type"), "name": named.get("name") if isinstance(named.get("name"), str) else None, "scalar": json.dumps(value, ensure_ascii=False) if kind == "scalar" else None, "place": place}
        place += 1
        children = value.items() if kind == "object" else ((str(i), v) for i, v in enumerate(value)) if kind == "array" else ()
        step = [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", pointer, k, v) for k, v in children]
        pending.extend(reversed(step))


def flatten(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A row (NODE) for every node of every document. Documents that aren't JSON are an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in NODE.split(", ")])
        out = []
        for b in batches:
            for name, body in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                for node in _nodes(name, body):
                    out.append(node)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).mapInArrow(rows, NODE)


def select_pointer(text: Column, pointer: str) -> Column:
    """What a pointer selects from JSON text, as text, or null.

    A number in the pointer is an index of an array or a key of an object.
    """
    keys = pointer_path(pointer)
    steps = [[f"['{k}']"] + ([f"[{k}]"] if k.isdigit() else []) for k in keys]
    paths = ["$" + "".join(p) for p in product(*steps)]
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def records(nodes: DataFrame, record_type: str) -> DataFrame:
    """Nodes whose $type is ``record_type`` in full or after its last dot."""
    return nodes.where((F.col("record_type") == record_type) | (F.substring_index("record_type", ".", -1) == record_type))


def inventory(nodes: DataFrame) -> DataFrame:
    """Records by type."""
    return nodes.where("record_type is not null").groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


def dangling_references(nodes: DataFrame) -> DataFrame:
    """References ($ref) whose target isn't there or comes later. Columns doc, pointer, target, reason."""
    refs = nodes.where("key = '$ref' and kind = 'scalar'").select("doc", "pointer", "place", F.regexp_replace(F.get_json_object(F.concat(F.lit('{"v":'), "scalar", F.lit("}")), "$.v"), "^#", "").alias("target"))
    there = nodes.select("doc", F.col("pointer").alias("target"), F.col("place").alias("target_place"))
    joined = refs.join(there, ["doc", "target"], "left")
    reason = F.when(F.col("target_place").isNull(), "dangling").when(F.col("target_place") > F.col("place"), "forward")
    return joined.select("doc", "pointer", "target", reason.alias("reason")).where("reason is not null")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, operation (add, remove or replace) and pointer of the topmost differences.

    Arrays compare by position. A node that is added, removed or of another kind hides
    what is below it; 1 and 1.0 differ. before and after are node tables.
    """
    a = before.select("doc", "pointer", F.col("kind").alias("kind_a"), F.col("scalar").alias("scalar_a"))
    b = after.select("doc", "pointer", F.col("kind").alias("kind_b"), F.col("scalar").alias("scalar_b"))
    both = a.join(b, ["doc", "pointer"], "full")
    operation = F.when(F.col("kind_a").isNull(), "add").when(F.col("kind_b").isNull(), "remove")
    operation = operation.when((F.col("kind_a") != F.col("kind_b")) | ~F.col("scalar_a").eqNullSafe(F.col("scalar_b")), "replace")
    found = both.select("doc", operation.alias("operation"), "pointer").where("operation is not null")
    parts = F.split("pointer", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    hidden = found.select("doc", "pointer", F.explode(above).alias("up")).join(found.select("doc", F.col("pointer").alias("up")), ["doc", "up"], "left_semi").select("doc", "pointer")
    return found.join(hidden, ["doc", "pointer"], "left_anti").select("doc", "operation", "pointer")


def _differences(before: object, after: object) -> Iterator[tuple[str, str]]:
    """operation and pointer of the topmost differences of two JSON values."""
    pending = [("", before, after)]
    while pending:
        pointer, a, b = pending.pop()
        both = (dict, list)
        if isinstance(a, both) and type(a) is type(b):
            named = (lambda x: x) if isinstance(a, dict) else (lambda x: dict(enumerate(x)))
            a, b = named(a), named(b)
            for k in dict.fromkeys([*a, *b]):
                below = f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}"
                if k not in a or k not in b:
                    yield "remove" if k in a else "add", below
                else:
                    pending.append((below, a[k], b[k]))
        elif isinstance(a, both) or isinstance(b, both) or json.dumps(a) != json.dumps(b):
            yield "replace", pointer


def compare_documents(before: DataFrame, after: DataFrame, doc: str, text: str) -> DataFrame:
    """What ``compare`` says of the documents of two tables (unique ``doc``, JSON ``text``).

    The two texts of a document meet in one join and are compared where they meet; equal
    texts aren't parsed. A document that one table lacks, or whose text is null there, is
    added or removed as a whole.
    """
    a = before.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("a"))
    b = after.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("b"))
    both = a.join(b, "doc", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    alone = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("doc", "operation", "pointer")])
        for batch in batches:
            rows = [(d, o, p) for d, x, y in zip(*(batch.column(c).to_pylist() for c in ("doc", "a", "b"))) for o, p in _differences(json.loads(x), json.loads(y))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], schema=schema)

    whole = both.select("doc", alone.alias("operation"), F.lit("").alias("pointer")).where("operation is not null")
    return both.where("a is not null and b is not null").mapInArrow(found, "doc string, operation string, pointer string").union(whole)


def export_model(objects: DataFrame, references: DataFrame, model: str, identity: str, fields: Sequence[str]) -> DataFrame:
    """``model`` and document: one JSON document a model, with each object once and references to it.

    objects: model, identity, $type (record_type), position (unique in a model) and fields;
    references: model, source and target identities, name. An object is written at
    #/objects/<position>; a reference is {"$ref": pointer of its target}, and null where the
    target isn't in the model. Keys are sorted; objects are in the order of their position.
    """
    place = objects.select(model, F.col(identity).alias("target"), F.concat(F.lit("#/objects/"), F.col("position").cast("string")).alias("$ref"))
    resolved = references.join(place, [model, "target"], "left").select(model, F.col("source").alias(identity), "name", F.when(F.col("$ref").isNotNull(), F.struct("$ref")).alias("ref"))
    held = resolved.groupBy(model, identity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "ref")))).alias("references"))
    record = F.to_json(F.struct(F.col("record_type").alias("$type"), *sorted([*fields, "references"])), {"ignoreNullFields": "false"})
    whole = objects.join(held, [model, identity], "left").groupBy(model).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", record.alias("record")))), lambda x: x["record"]).alias("objects"))
    return whole.select(model, F.concat(F.lit('{"objects":['), F.array_join("objects", ","), F.lit("]}")).alias("document"))
