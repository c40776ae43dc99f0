"""Centroid clustering in whole numbers, with centroids filtered by an n-simplex projection.

A few pivots span a simplex. The distances of a vector to them, computed once and kept beside it, place it as the apex
over that base: its coordinates are one for each pivot, the last its altitude. For two apexes u and v the Euclidean
distance of the coordinates is a lower bound of the distance of the vectors, and the same with the altitudes added in
place of subtracted an upper bound. A centroid whose lower bound exceeds the least upper bound can't be the nearest;
the others are compared exactly, in 64-bit integers. Bounds carry a slack far above their rounding errors.

The kept vectors are written once with their apexes. Each round is one scan of that table: a task adds up the members
of its vectors' clusters, and one row for each task and cluster is summed on Spark. Only the centroids, a fixed number,
are on the driver; the table is the lineage of every round. No vector is shuffled, so a common vector costs nothing.

Defined results: vectors that are null, of another size, or hold a null or non-finite component are left out. Repeated
rows count each. A null ``vec_id`` is kept, and comes last among the first centroids; equal hashes go by components.
With fewer vectors than clusters there are as many centroids as vectors; an empty table gives no rows. A component whose
integer takes more than 27 bits ends the job with an error, as squared distances would leave 64 bits. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written

DIM = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
PIVOTS = 12
#: Integers of components stay below this, so that a squared distance fits 64 bits.
LARGEST = 1 << 27
#: Vectors compared at once in a task.
TILE = 1024
#: Share of the largest squared length by which bounds may be wrong.
SLACK = 1e-6


def kept(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, point: the usable vectors with their integers floor(scale * x)."""
    vector = F.col("embedding")

    def whole(x):
        value = F.floor(x.cast("double") * scale)
        too_large = F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("int")
        return F.when(F.abs(x.cast("double") * scale) >= LARGEST - 1, too_large).otherwise(value.cast("int"))

    usable = (F.size(vector) == dim) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.filter(usable).select("vec_id", F.transform(vector, whole).alias("point"))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The points of the vectors whose seeded ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(key.alias("key"), "point").orderBy(F.asc_nulls_last("key"), "point").limit(clusters).collect()
    return np.array([row["point"] for row in rows], np.int64)


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points (rows) to the others (columns)."""
    out = np.empty((len(points), len(others)), np.int64)
    for i, other in enumerate(others):
        difference = points - other
        out[:, i] = np.einsum("ij,ij->i", difference, difference)
    return out


class Simplex:
    """Base spanned by pivots; ``apexes`` places points over it from their squared distances to the pivots."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        between = squared(pivots, pivots).astype(float)
        self.sides = between[0, 1:]
        gram = (self.sides[:, None] + self.sides[None, :] - between[1:, 1:]) / 2
        self.inverse = np.linalg.inv(np.linalg.cholesky(gram)) if len(pivots) > 1 else np.zeros((0, 0))

    def apexes(self, points: np.ndarray) -> np.ndarray:
        distances = squared(points, self.pivots).astype(float)
        first = distances[:, :1]
        base = (first + self.sides - distances[:, 1:]) / 2 @ self.inverse.T
        altitude = np.sqrt(np.maximum(first[:, 0] - (base * base).sum(axis=1), 0))
        return np.column_stack([base, altitude])


def spanned(candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
    """A simplex of candidates, each chosen for its altitude over those before it; flat ones are left out."""
    found = Simplex(candidates[:1])
    while len(found.pivots) < most:
        altitude = found.apexes(candidates)[:, -1]
        best = int(altitude.argmax())
        if altitude[best] <= 1e-3 * max(np.sqrt(found.sides.max(initial=0)), altitude.max(), 1e-9) or altitude[best] < 1e-3:
            break
        found = Simplex(np.vstack([found.pivots, candidates[best]]))
    return found


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each point the nearest centroid (ties: the smaller number), its squared distance; and the exact comparisons."""
    lengths = (apexes * apexes).sum(axis=1)[:, None] + (tops * tops).sum(axis=1)[None, :]
    lower = lengths - 2 * apexes @ tops.T
    upper = lower + 4 * np.outer(apexes[:, -1], tops[:, -1])
    slack = SLACK * (1 + lengths.max(initial=0))
    row, column = np.nonzero(lower <= upper.min(axis=1)[:, None] + slack)
    difference = points[row] - centroids[column]
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    exact[row, column] = np.einsum("ij,ij->i", difference, difference)
    cluster = exact.argmin(axis=1)
    return cluster, exact[np.arange(len(points)), cluster], len(row)


def matrix(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0)


def tiles(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, simplex: Simplex):
    """Each slice of rows with its points, clusters, distances and the number of exact comparisons."""
    tops = simplex.apexes(centroids)
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            part = batch.slice(start, TILE)
            points = matrix(part, "point", np.int64)
            yield part, points, *nearest(points, matrix(part, "apex", float), centroids, tops)


def with_apexes(points: DataFrame, simplex: Simplex) -> DataFrame:
    """The points with their apexes over the simplex."""
    id_type = points.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apexes = pa.array(list(simplex.apexes(matrix(batch, "point", np.int64))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, apexes], names=["vec_id", "point", "apex"])

    return points.mapInArrow(run, f"vec_id {id_type}, point array<int>, apex array<double>")


def moved(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The floored means of the clusters around the centroids; an empty cluster keeps its centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, points, cluster, _, _ in tiles(batches, centroids, simplex):
            np.add.at(sums, cluster, points)
            counts += np.bincount(cluster, minlength=k)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(counts[there], pa.int64()), pa.array(list(sums[there]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def members(table: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """vec_id, cluster, distance (squared) and ``compared``, the exact comparisons a vector of its slice took on average."""
    id_type = table.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance, compared in tiles(batches, centroids, simplex):
            share = np.full(part.num_rows, compared / part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(share)],
                names=["vec_id", "cluster", "distance", "compared"])

    return table.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long, compared double")


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, pivots: int = PIVOTS,
              dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """``members`` of the vectors after ``rounds`` rounds, written, and the final centroids."""
    points = kept(rows, dim)
    centroids = first_centroids(points, clusters, seed)
    if not len(centroids):
        return members(points.withColumn("apex", F.lit(None).cast("array<double>")).limit(0), np.zeros((1, dim), np.int64),
                       Simplex(np.zeros((1, dim), np.int64))), centroids
    simplex = spanned(centroids, pivots)
    table = written(with_apexes(points, simplex), "apexes")
    for _ in range(rounds):
        centroids = moved(table, centroids, simplex)
    return written(members(table, centroids, simplex), "members"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    hexes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(sums.values()), hexes[c]) for c, s in sums.items()]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row for each cluster, a fixed number.
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
