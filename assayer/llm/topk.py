"""Exact top-k search by inner product over norm-sorted blocks.

Vectors are turned by the eigenvectors of their Gram matrix, so their first coordinates
hold most of their length. They are range-partitioned by descending length into blocks.
A query first meets the block of the longest vectors, which gives it a threshold (its
k-th best score so far). The other blocks are compared in grid cells of one query block
and one candidate block: a slice of a block is skipped if no query can reach its
threshold with the slice's greatest length, and a candidate is scored in full only if
the sum over the first coordinates plus the product of the residual lengths (Cauchy and
Schwarz) reaches it. Bounds carry a margin for rounding; scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Candidates in a block, queries in a block, candidates whose bounds are computed at once.
BLOCK, QUERY_BLOCK, SLICE = 8192, 2048, 1024
#: Blocks at most: beyond BLOCK times as many candidates, blocks get larger.
MOST_BLOCKS = 1 << 16
#: Share of the coordinates in the partial sums.
HEAD = 0.5
#: Share of candidates left by the bounds from which all of a slice are scored at once.
DENSE = 0.02
#: Products of lengths below this give exact sums in doubles; margin of the bounds.
EXACT, MARGIN = 2.0**52, 1e-9
LONGEST = (1 << 63) - 1


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null for vectors that take no part.

    Those are null vectors, empty ones, and vectors with a null or non-finite component.
    """
    wide = embedding.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(wide, lambda x: _floor(x * scale))
    return F.when(embedding.isNotNull() & (F.size(wide) > 0) & ~F.coalesce(bad, F.lit(False)), whole)


def _floor(x: Column) -> Column:
    """Floor in doubles: beyond 2^52 every double is whole."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _rotations(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By dimension: number of vectors and eigenvectors of their Gram matrix, largest first.

    Each task adds up its own products, and the lines of a matrix are added up by as many
    tasks; the driver sees one matrix a dimension.
    """
    line = "dim int, line int, n long, v array<double>"

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                x = _matrix(pa.chunked_array([b.column("vec").filter(pa.array(dims == d))]))
                x = x / np.maximum(1.0, np.abs(x).max(1, keepdims=True))
                own = found.setdefault(int(d), [0, np.zeros((d, d))])
                own[0] += len(x)
                own[1] += x.T @ x
        for d, (n, g) in found.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "line": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "v": pa.array(list(g), pa.list_(pa.float64()))})

    def added(rows: pa.Table) -> pa.Table:
        v = _matrix(rows.column("v")).sum(0)
        n = int(rows.column("n").to_numpy().sum())
        return pa.table({"dim": rows.column("dim")[:1], "line": rows.column("line")[:1], "n": pa.array([n], pa.int64()), "v": pa.array([v], pa.list_(pa.float64()))})

    lines = vectors.select("dim", "vec").mapInArrow(grams, line).groupBy("dim", "line").applyInArrow(added, line).collect()
    out = {}
    for d in {r["dim"] for r in lines}:
        own = sorted((r for r in lines if r["dim"] == d), key=lambda r: r["line"])
        gram = np.array([r["v"] for r in own])
        _, vectors_of = np.linalg.eigh((gram + gram.T) / 2)
        out[d] = (own[0]["n"], np.ascontiguousarray(vectors_of[:, ::-1]))
    return out


def _scores(q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of paired rows as long; beyond a long's range, its bound."""
    if safe:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q, x)]
    return np.array([max(-LONGEST - 1, min(LONGEST, v)) for v in whole], np.int64)


def _search(q_ids, q, floor, x_ids, x, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query index, id, score) of every query among candidates sorted by falling length.

    floor: score that a candidate must reach to matter (-inf: none yet), by query.
    """
    head = max(1, math.ceil(HEAD * q.shape[1]))
    qr, xr = q @ turn, x @ turn
    q_len, x_len = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    q_rest, x_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(xr[:, head:], axis=1)
    safe = bool(q_len.max() * x_len.max() < EXACT)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    limit = floor.copy()
    for at in range(0, len(x), SLICE):
        part = slice(at, at + SLICE)
        margin = MARGIN * q_len * x_len[part].max()
        alive = np.flatnonzero(q_len * x_len[part].max() + margin >= limit)
        if not len(alive):
            break  # all that follow are shorter
        bound = qr[alive, :head] @ xr[part, :head].T + q_rest[alive, None] * x_rest[None, part] + margin[alive, None]
        near = (bound >= limit[alive, None]) & (q_ids[alive, None] != x_ids[None, part])
        if safe and near.mean() > DENSE:
            # Many are left: their scores by one product, and a higher threshold at once.
            score = np.where(near, q[alive] @ x[part].T, -np.inf)
            if score.shape[1] > k:
                limit[alive] = np.maximum(limit[alive], np.partition(score, -k, axis=1)[:, -k])
            row, col = np.nonzero(near & (score >= limit[alive, None]))
            s = score[row, col].astype(np.int64)
        else:
            row, col = np.nonzero(near)
            s = _scores(q[alive[row]], x[at + col], safe)
        best.append((alive[row], x_ids[at + col], s))
        if sum(len(b[0]) for b in best) > 4 * k * len(q):
            best = [_top(*(np.concatenate(c) for c in zip(*best)), k)]
            full = np.bincount(best[0][0], minlength=len(q)) == k
            least = np.full(len(q), np.inf)
            np.minimum.at(least, best[0][0], best[0][2].astype(np.float64))
            limit = np.where(full, np.maximum(limit, least), limit)
    return _top(*(np.concatenate(c) for c in zip(*best)), k)


def _top(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best, ties to the smaller id."""
    order = np.lexsort((ids, ~s, row))  # ~s falls as s rises and has no overflow
    row, ids, s = row[order], ids[order], s[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], s[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (long) of the k best of every query.

    vectors: vec_id, embedding. Components are floored after multiplying by ``scale``;
    score is the integer inner product; ties go to the smaller vec_id; a query is no
    candidate of its own. Vectors that are null, empty or hold a null or non-finite
    component, and rows with a null vec_id, take no part. Vectors of other dimensions
    are no candidates of a query. Of repeated rows of a vec_id, those with equal vectors
    count once; different vectors under one vec_id are candidates of their own. Scores
    beyond a long are its bound. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("vec is not null and vec_id is not null").dropDuplicates(["vec_id", "vec"])
    rows = rows.withColumn("dim", F.size("vec")).withColumn("len2", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    rows = stored(rows, "topk-vectors")
    turns = _rotations(rows)
    total = sum(n for n, _ in turns.values())
    blocks = max(1, math.ceil(total / max(BLOCK, total / MOST_BLOCKS)))
    # Of equal vectors only the k + 1 smallest ids can be among a query's k best.
    same = Window.partitionBy("vec").orderBy("vec_id")
    candidates = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    placed = candidates.repartitionByRange(blocks, F.col("dim"), F.desc("len2"), F.col("vec_id")).withColumn("cb", F.spark_partition_id())
    placed = stored(placed.select("dim", "cb", "vec_id", "vec", "len2"), "topk-blocks")
    n_queries = rows.where("q").count()
    if n_queries == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    turn_of = spark.sparkContext.broadcast({d: t for d, (_, t) in turns.items()})
    longest = placed.groupBy("dim").agg(F.min("cb").alias("cb"))
    queries = rows.where("q").select("dim", F.col("vec_id").alias("query_id"), "vec").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))

    def cell(qs: pa.Table, xs: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not qs.num_rows or not xs.num_rows:
            return schema.empty_table()
        xs = xs.sort_by([("len2", "descending"), ("vec_id", "ascending")])
        q_ids, x_ids = qs.column("query_id").to_numpy(), xs.column("vec_id").to_numpy()
        q, x = _matrix(qs.column("vec")), _matrix(xs.column("vec"))
        floor = qs.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        row, ids, s = _search(q_ids, q, floor, x_ids, x, turn_of.value[q.shape[1]], k)
        return pa.table({"query_id": q_ids[row], "vec_id": ids, "score": s}, schema)

    def compared(some_queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """candidates: the rows of the blocks, once for each query block (qb) that wants them."""
        sent = candidates.select("dim", "qb", "cb", "vec_id", "vec", "len2")
        return some_queries.groupBy("dim", "qb", "cb").cogroup(sent.groupBy("dim", "qb", "cb")).applyInArrow(cell, "query_id long, vec_id long, score long")

    nothing = F.lit(float("-inf"))
    every_qb = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    first = stored(compared(queries.join(longest, "dim").withColumn("floor", nothing), placed.join(longest, ["dim", "cb"], "left_semi").withColumn("qb", every_qb)), "topk-first")
    reached = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).otherwise(None).alias("kth"))
    known = queries.join(reached, "query_id", "left").withColumn("floor", F.coalesce(F.col("kth").cast("double"), nothing))
    # A cell is set up only if the block's greatest length could help one of its queries. There
    # are MOST_BLOCKS lengths at most.
    block_len = placed.groupBy("dim", "cb").agg(F.sqrt(F.max("len2")).alias("block_len")).join(longest, ["dim", "cb"], "left_anti")
    lengths = block_len.groupBy("dim").agg(F.collect_list(F.struct("cb", "block_len")).alias("blocks"))
    q_len = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    helped = F.transform(F.filter("blocks", lambda b: F.col("q_len") * b["block_len"] * (1 + MARGIN) >= F.col("floor")), lambda b: b["cb"])
    wanted = known.withColumn("q_len", q_len).join(F.broadcast(lengths), "dim").select("dim", "qb", F.explode(helped).alias("cb"), "query_id", "vec", "floor")
    cells = stored(wanted.select("dim", "qb", "cb").distinct(), "topk-cells")
    rest = compared(wanted, placed.join(cells, ["dim", "cb"]))
    ranked = first.union(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
