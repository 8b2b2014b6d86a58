"""Near copies among embeddings by sorted projection passes.

A pass gives each vector 64 random hashes, the signs of its projections, and sorts all
vectors of a label by them, concatenated to one number. Near copies agree in most hashes,
so they often agree in the first ones and stand close to each other. Each is compared with a
bounded window of those before it, first by the hashes in which they differ and then by
the cosine of the whole vectors. Each pass draws other hashes; there are as many
passes as the largest label needs for RECALL of the pairs just at the threshold to
stand in one window, and the verified pairs of all passes are joined into groups.

What windows can't show of a crowd is counted afterwards: within a group all pairs are
compared, in blocks that are dealt to tasks, and only counts leave them. Equal vectors of a
label are one class from the start, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, partitions, stored
from .simhash import components

COSINE, WINDOW, LEAST_PASSES, RECALL, SEED = 0.98, 32, 8, 0.999, 13
#: Hashes of a pass.
BITS = 64
#: Share of the pairs just at the threshold that may differ in more hashes than are let through.
LOST = 1e-6
#: Vectors of a block whose pairs are compared in one task, and how many at once.
BLOCK, AT_ONCE = 8192, 1024


def split_chance(cosine: float) -> float:
    """Chance that a random hash differs between two vectors of that cosine."""
    return math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def passes_for(largest: int, cosine: float, window: int, recall: float = RECALL) -> int:
    """Passes in one of which ``recall`` of the pairs at ``cosine`` stand in one window.

    They do where they agree in so many first hashes that half a window of the largest
    label's vectors agrees in them, if vectors spread over the hashes.
    """
    first = max(0.0, math.log2(max(1, largest) / window) + 1)
    meet = (1 - split_chance(cosine)) ** first
    return LEAST_PASSES if meet >= 1 else max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def most_differing(cosine: float, lost: float = LOST) -> int:
    """Hashes of a pass in which no more than ``lost`` of the pairs at ``cosine`` differ beyond."""
    p, rest = split_chance(cosine), 1.0
    for k in range(BITS):
        rest -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if rest <= lost:
            return k
    return BITS


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors as rows of length one, in double precision; all are of one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # A first scale by the largest component keeps squares from overflowing.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def hashes(x: np.ndarray, turn: int, seed: int = SEED) -> np.ndarray:
    """The signs of BITS random projections of each row, the first as the highest bit."""
    planes = np.random.default_rng((seed, turn, x.shape[1])).standard_normal((x.shape[1], BITS))
    return np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def can_link() -> Column:
    """Whether a row has a label and a vector that isn't zero or empty, of finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and key of the rows that can link; key is equal for equal vectors of a label."""
    plain = F.transform("embedding", lambda v: v + F.lit(0).cast("float"))  # minus zero is zero
    rows = vectors.where(can_link()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", plain.alias("embedding"))
    return rows.withColumn("key", F.struct(F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(SEED), "embedding", "label").alias("g")))


def _windows(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs a, b of the sorted rows that stand in one window, of one pass and group, and differ in few hashes.

    Comes with the first and last ``window`` rows of the task, whose window may reach
    into the next one: these have side 0 and 1, pairs have none.
    """
    pid = TaskContext.get().partitionId()
    names = ["turn", "part", "sig", "cls"]
    last = [np.empty(0, np.int64)] * 4
    seen = 0

    def batch(side: int | None, a: np.ndarray, b: np.ndarray, turn: np.ndarray, part: np.ndarray, sig: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        columns = [pa.array([side] * n, pa.int32()), pa.array(np.full(n, pid), pa.int32()), *[pa.array(x, pa.int64()) for x in (a, b, turn, part, sig, place)]]
        return pa.RecordBatch.from_arrays(columns, ["side", "pid", "a", "b", "turn", "part", "sig", "place"])

    def edge(side: int, rows: list[np.ndarray], place: np.ndarray) -> pa.RecordBatch:
        turn, part, sig, cls = rows
        return batch(side, cls, cls, turn, part, sig, place)

    for b in batches:
        own = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        if seen < window:
            head = [x[: window - seen] for x in own]
            yield edge(0, head, seen + np.arange(len(head[0])))
        rows = [np.concatenate(two) for two in zip(last, own)]
        begin = len(last[0])
        seen += len(own[0])
        pairs = _near(rows, begin, window, most)
        none = np.zeros(len(pairs), np.int64)
        yield batch(None, pairs[:, 0], pairs[:, 1], none, none, none, none)
        last = [x[-window:] for x in rows]
    if seen:
        yield edge(1, last, np.arange(len(last[0])))


def _near(rows: list[np.ndarray], begin: int, window: int, most: int) -> np.ndarray:
    """Pairs (smaller first) of the rows from ``begin`` on with one of the ``window`` rows before them."""
    turn, part, sig, cls = rows
    sig = sig.view(np.uint64)
    found = [np.empty((0, 2), np.int64)]
    for back in range(1, min(window, len(cls) - 1) + 1):
        at = np.arange(max(begin, back), len(cls))
        other = at - back
        hit = (turn[at] == turn[other]) & (part[at] == part[other]) & (np.bitwise_count(sig[at] ^ sig[other]) <= most)
        found.append(np.stack([cls[at[hit]], cls[other[hit]]], 1))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def meetings(classes: DataFrame, n: int, passes: int, window: int, cosine: float, seed: int = SEED) -> DataFrame:
    """Pairs a < b of classes that stand in one window of a pass and differ in few of its hashes.

    classes: cls, part (a number for label and length) and embedding, stored. Only hashes
    and numbers are sorted, not vectors. Every task has many windows of rows, and the
    window of its first rows reaches into the task before.
    """
    most = most_differing(cosine)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column("embedding").value_lengths())
            for d in np.unique(lengths):
                some = b.filter(pa.array(lengths == d))
                x = unit(some.column("embedding"))
                sigs = np.stack([hashes(x, t, seed) for t in range(passes)], 1)
                turn = np.tile(np.arange(passes), len(x))
                cls, part = (np.repeat(some.column(c).to_numpy(), passes) for c in ("cls", "part"))
                # Shifted by half the range, so that signed order is the order of the bits.
                yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int64()), pa.array(part), pa.array((sigs.ravel() ^ np.uint64(1 << 63)).view(np.int64)), pa.array(cls)], ["turn", "part", "sig", "cls"])

    tasks = max(1, min(partitions(classes.sparkSession), n * passes // (16 * window)))
    rows = classes.select("cls", "part", "embedding").mapInArrow(signed, "turn long, part long, sig long, cls long")
    order = ["turn", "part", "sig", "cls"]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = "side int, pid int, a long, b long, turn long, part long, sig long, place long"
    found = stored(ordered.mapInArrow(lambda batches: _windows(batches, window, most), schema), "windows")
    edges = found.where("side is not null")
    following = edges.select("pid").distinct().orderBy("pid")
    pids = [r["pid"] for r in following.collect()]
    pairs = found.where("side is null").select("a", "b")
    if len(pids) > 1:
        before = classes.sparkSession.createDataFrame(list(zip(pids[1:], pids[:-1])), "pid int, before int")
        heads = edges.where("side = 0").join(F.broadcast(before), "pid").select(F.col("before").alias("border"), "side", "a", "turn", "part", "sig", "place")
        tails = edges.where("side = 1").select(F.col("pid").alias("border"), "side", "a", "turn", "part", "sig", "place")

        def across(table: pa.Table) -> pa.Table:
            table = table.sort_by([("side", "descending"), ("place", "ascending")])
            side, *own = (table.column(c).to_numpy().astype(np.int64) for c in ("side", "turn", "part", "sig", "a"))
            near = _near(own, int((side == 1).sum()), window, most) if len(side) > 1 else np.empty((0, 2), np.int64)
            return pa.table({"a": near[:, 0], "b": near[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        pairs = pairs.union(heads.union(tails).groupBy("border").applyInArrow(across, "a long, b long"))
    return pairs.distinct()


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs a, b whose whole vectors reach ``cosine``. A class is in as many pairs as passes and windows allow at most."""
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("embedding").alias(f"x_{c}")), c)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column("x_a").value_lengths())
            for d in np.unique(lengths):
                some = b.filter(pa.array(lengths == d))
                reach = (unit(some.column("x_a")) * unit(some.column("x_b"))).sum(1) >= cosine
                yield some.select(["a", "b"]).filter(pa.array(reach))

    return pairs.select("a", "b", "x_a", "x_b").mapInArrow(near, "a long, b long")


def counted(members: DataFrame, sizes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """cls and linked: rows of other classes of its group within ``cosine``, of every class of a group.

    members: cls, root, copies and embedding; sizes: root and n, its classes. A group is cut
    into blocks of about ``block`` by hash, and each pair of blocks is a task's; a class goes to as many
    tasks as its group has blocks.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    total = members.count()
    placed = join_hot(members, sizes.withColumn("blocks", blocks), "root", F.col("n"), total)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("root", "cls", "copies", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        x, copies, own = unit(table.column("embedding")), table.column("copies").to_numpy().astype(np.int64), table.column("own").to_numpy()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        linked = np.zeros(len(x), np.int64)
        for at in range(0, len(x), AT_ONCE):
            for beside in range(0, len(x), AT_ONCE):
                a, b = slice(at, at + AT_ONCE), slice(beside, beside + AT_ONCE)
                near = x[a] @ x[b].T >= cosine
                near &= np.arange(len(x))[a, None] != np.arange(len(x))[None, b] if same else own[a, None] != own[None, b]
                linked[a] += near @ copies[b]
        return pa.table({"cls": table.column("cls"), "linked": linked}, pa.schema([("cls", pa.int64()), ("linked", pa.int64())]))

    return pairs.groupBy("root", "i", "j").applyInArrow(compare, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked"))


def near_copies(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows of one label, not null, and one length are linked if their cosine reaches
    ``cosine`` and a chain of pairs that stood in one window connects them. n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable over links and
    kept is true for the row that has it. A row whose vector is null, empty, zero or has null or
    non-finite components links with nothing, as does one without a label. Rows without a
    vec_id link as others do, but name no component that has others, and are kept where none
    has; rows that share one are rows of their own. Other columns are ignored, an empty table
    gives an empty result. Classes are told apart by a hash of 128 bits.
    """
    rows = keyed(vectors)
    grouped = rows.groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = grouped.select("key", "embedding", "copies", "least", F.monotonically_increasing_id().alias("cls"), F.xxhash64("label", F.size("embedding")).alias("part"))
    classes = stored(classes, "vector-classes")
    n, total = classes.agg(F.count(F.lit(1)), F.sum("copies")).first()
    largest = classes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    met = meetings(classes, n, passes_for(largest, cosine, window, recall), window, cosine, seed)
    links = stored(verified(met, classes, cosine), "vector-links")
    roots = components(links)
    members = stored(classes.join(roots, F.col("cls") == F.col("node")).select("cls", "root", "copies", "least", "embedding"), "vector-members")
    groups = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("first"))
    linked = counted(members.select("cls", "root", "copies", "embedding"), groups.select("root", "n"), cosine)
    named = join_hot(members.select("cls", "root"), groups, "root", F.col("n"), members.count()).select("cls", "first").join(linked, "cls")
    labels = classes.select("key", "cls", "copies", "least").join(named, "cls", "left").select("key", "copies", F.coalesce("first", "least").alias("first"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    labels = stored(labels, "vector-labels")
    found = join_hot(rows.select("vec_id", "key"), labels, "key", F.col("copies"), total or 0).select("vec_id", "n_links", F.col("first").alias("component_id"))
    own = F.col("vec_id").cast("long")
    alone = vectors.where(~can_link()).select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.isnull("component_id")))
