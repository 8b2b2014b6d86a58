"""Lloyd's clustering on integers, with the nearest centroid found by partial distances.

A vector is compared with all centroids over the dimensions of the highest variance first.
The centroid that is nearest over these is measured in full and is the current best; any
other is abandoned as soon as its growing sum of squares is strictly above that, and only
those that never are finish all dimensions. Sums are integers, so results are exact and
don't depend on the order of rows, dimensions or tasks.

Vectors never move: each round reads the table and returns one row a cluster and
dimension from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Dimensions that are compared at first, and then at a time; vectors compared at once.
HEAD, STEP, ROWS = 16, 16, 2048
#: Largest integer component: squared distances stay below 2 ** 63.
LARGEST = 1 << 27


def scaled(column: pa.Array, scale: int) -> np.ndarray:
    """A row of floor(scale * x) a vector; all vectors are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (the smaller of equals) and its squared distance.

    order: the dimensions, of the highest variance first.
    """
    x, c = vectors[:, order], centroids[:, order]
    part = np.square(x[:, None, :HEAD] - c[None, :, :HEAD]).sum(2)
    first = part.argmin(1)
    best = np.square(x - c[first]).sum(1)
    part[np.arange(len(x)), first] = -1
    row, number = np.nonzero((part >= 0) & (part <= best[:, None]))
    part = part[row, number]
    for at in range(HEAD, x.shape[1], STEP):
        part = part + np.square(x[row, at : at + STEP] - c[number, at : at + STEP]).sum(1)
        alive = part <= best[row]
        row, number, part = row[alive], number[alive], part[alive]
    row, number, part = (np.concatenate(two) for two in ((np.arange(len(x)), row), (first, number), (best, part)))
    ordered = np.lexsort((number, part, row))
    ordered = ordered[np.concatenate(([True], row[ordered][1:] != row[ordered][:-1]))] if len(row) else ordered
    return number[ordered], part[ordered]


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    x = F.col("embedding")
    fits = F.forall(x, lambda v: v.isNotNull() & F.coalesce(F.abs(v.cast("double")) * scale <= LARGEST, F.lit(False)) & ~F.isnan(v))
    return vectors.where((F.size(x) == dimensions) & fits).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def seeds(kept: DataFrame, clusters: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = kept.where("vec_id is not null").select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(clusters).collect()
    return np.array([np.floor(np.array(r["embedding"], np.float64) * scale).astype(np.int64) for r in found], np.int64)


def by_variance(kept: DataFrame, dimensions: int, scale: int) -> np.ndarray:
    """The dimensions, of the highest variance first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for b in batches:
            x = scaled(b.column("embedding"), scale).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(0), squares + np.square(x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions), pa.int32()), pa.array(np.full(dimensions, n), pa.int64()), pa.array(total), pa.array(squares)], ["dim", "n", "total", "squares"])

    summed = kept.select("embedding").mapInArrow(sums, "dim int, n long, total double, squares double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    spread = {r["dim"]: r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2 for r in summed.collect() if r["n"]}
    return np.array(sorted(range(dimensions), key=lambda d: (-spread.get(d, 0.0), d)))


def moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; empty ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = scaled(b.column("embedding").slice(at, ROWS), scale)
                number, _ = nearest(x, centroids, order)
                n += np.bincount(number, minlength=len(centroids))
                np.add.at(total, number, x)
        cluster, dim = (a.ravel() for a in np.indices(centroids.shape))
        columns = [pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(n[cluster]), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "dim", "n", "total"])

    new = centroids.copy()
    summed = kept.select("embedding").mapInArrow(sums, "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in summed.collect():
        if r["n"]:
            new[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return new


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    vectors: vec_id, embedding. A vector takes part if it has ``dimensions`` components,
    none null or non-finite, and none beyond LARGEST / ``scale`` in size, as squared
    distances wouldn't fit a long. The first centroids are the vectors with the smallest
    sha256 of ``seed:vec_id``; of rows with one vec_id each counts, by its components.
    Rows without a vec_id are clustered, but no centroid starts from them. If fewer vectors
    than ``clusters`` can start one there are as many clusters as these; if there are
    none, or the table is empty, so is the result. Repeated rows are rows of their own,
    other columns are ignored. The driver sees a row a cluster and dimension.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, dimensions, scale)
    centroids = seeds(kept, clusters, scale, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    order = by_variance(kept, dimensions, scale)
    for _ in range(rounds):
        centroids = moved(kept, centroids, order, scale)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                number, distance = nearest(scaled(some.column("embedding"), scale), centroids, order)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(kept.mapInArrow(assigned, schema), "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    said = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
