"""Document fingerprints: a quartile bucket digest.

Every byte triplet of a text is hashed into one of 128 buckets. A bucket is encoded by
the quartile of all bucket counts that its own count is in, two bits each; a logarithm
of the length goes before them. Two digests are compared by a difference score that
can't exceed MAX_DIFFERENCE, so a likeness from 0 to 1 follows.

The three bytes of a triplet stand four bytes apart. Neighbouring bytes say little more
than which language a text is in; spaced ones see how its words follow each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored

BUCKETS, SPACING = 128, 4
#: Steps of the logarithm of the length that count, and their weight.
LENGTH_BASE, LENGTH_STEPS, LENGTH_WEIGHT = 1.3, 12, 2
#: Two buckets three quartiles apart count as 6.
FAR_QUARTILES = 6
MAX_DIFFERENCE = FAR_QUARTILES * BUCKETS + LENGTH_STEPS * LENGTH_WEIGHT
#: Bytes hashed at once, and rows a range partition should have.
CHUNK, ROWS = 1 << 20, 2000


def digest(text: str | None) -> str:
    """Fingerprint of a whole text: two hex digits for the length, 64 for the buckets.

    Null is the empty text, whose counts are all 0. Equal texts have equal digests.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    reach = 2 * SPACING
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + reach].astype(np.uint32)
        n = min(CHUNK, len(raw) - at)
        x = np.concatenate([part, np.zeros(n + reach - len(part), np.uint32)]) if len(part) < n + reach else part
        key = (x[:n] << 16 | x[SPACING : n + SPACING] << 8 | x[reach : n + reach]) * np.uint32(2654435761)
        key ^= key >> np.uint32(15)
        key *= np.uint32(2246822519)
        key ^= key >> np.uint32(13)
        counts += np.bincount(key & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, None] > quartiles[None, :]).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    length = min(255, round(math.log(len(raw) + 1) / math.log(LENGTH_BASE)))
    return f"{length:02x}{packed.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """Difference score of two digests, 0 to MAX_DIFFERENCE."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    codes = [np.stack([z[1:] >> s & 3 for s in (6, 4, 2, 0)]).astype(np.int64) for z in (x, y)]
    apart = np.abs(codes[0] - codes[1])
    return int(np.where(apart == 3, FAR_QUARTILES, apart).sum()) + LENGTH_WEIGHT * min(LENGTH_STEPS, abs(int(x[0]) - int(y[0])))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def with_successor(docs: DataFrame, prepare: Callable, combine: Callable, schema: str, rows: int = ROWS) -> DataFrame:
    """One row ``combine(doc_id, a, b)`` for every row of ``docs`` and the row after it.

    a and b are ``prepare(text)`` of the row and of the next one in the order of doc_id
    (nulls first, then by a hash of the text); the first follows the last. The texts are
    range-partitioned once; only the first and the last text of every partition meet
    those of other partitions. Null texts are passed as empty.
    """
    parts = min(20_000, max(1, math.ceil(docs.count() / rows)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = ["doc_id", "tie"]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    full = f"kind int, pid int, text string, doc_id long, {schema}"
    names = [f.split()[0] for f in schema.split(",")]

    def row_of(kind: int, pid: int, doc_id, text, made) -> dict:
        return {"kind": kind, "pid": pid, "text": text, "doc_id": doc_id} | dict(zip(names, made or [None] * len(names)))

    types = to_arrow_schema(docs.sparkSession.createDataFrame([], full).schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before = TaskContext.get().partitionId(), None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                now = (doc_id.as_py(), text.as_py())
                now = (*now, prepare(now[1]))
                if before is None:
                    out.append(row_of(1, pid, now[0], now[1], None))
                else:
                    out.append(row_of(0, pid, before[0], None, combine(before[0], before[2], now[2])))
                before = now
            yield pa.RecordBatch.from_pylist(out, types)
        if before is not None:
            yield pa.RecordBatch.from_pylist([row_of(2, pid, before[0], before[1], None)], types)

    made = stored(ranged.mapInArrow(pairs, full), "successors")
    heads = made.where("kind = 1").select("pid", F.col("text").alias("next_text"))
    pids = heads.select("pid")  # one row a partition
    ordered = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = pids.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(ordered)).alias("next_pid"))
    ends = made.where("kind = 2").select("pid", "doc_id", "text").join(follows, "pid").join(heads.withColumnRenamed("pid", "next_pid"), "next_pid").select("doc_id", "text", "next_text")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [row_of(0, 0, r["doc_id"], None, combine(r["doc_id"], prepare(r["text"]), prepare(r["next_text"]))) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, types)

    return made.where("kind = 0").union(ends.mapInArrow(last, full)).drop("kind", "pid", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its text with the second half replaced.

    The last floor(n_chars / 2) code points make way for the first as many (or all) of
    the next document. near_edited and near_next are the likeness of the document's
    fingerprint to the edited text's and to the next document's. A table of one row is
    followed by itself; an empty table gives an empty result; repeated rows of a doc_id
    follow each other.
    """

    def prepare(text: str) -> tuple[str, str]:
        return text, digest(text)

    def combine(_: int, own: tuple[str, str], following: tuple[str, str]) -> list:
        text, mark = own
        half = len(text) // 2
        edited = text[: len(text) - half] + following[0][:half]
        edited_mark = digest(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return [len(text), sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following[1])]

    return with_successor(docs, prepare, combine, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
