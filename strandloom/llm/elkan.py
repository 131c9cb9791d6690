"""Centroid clustering by Elkan's bounds, in exact integers.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to each centroid, in a
table of the shared folder that a round reads and a round writes. A distance is computed only where the bounds, or half the
distance between two centroids, can't rule the centroid out. Bounds are rounded away from the truth, and a centroid is ruled out
only if it is strictly farther, so ties stay and go to the smaller number. Distances that decide are integers.

Defined results: a vector counts if it has exactly `width` entries, none null or non-finite; others have no row. floor(scale * x)
is clamped to 62 bits. A null vec_id hashes as an empty one; rows of one vec_id are vectors of their own, first by hash, then by
entries. With fewer than k vectors there are as many centroids as vectors. Distances beyond a long, and sums of them, are null.
An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import forget, written
from strandloom.llm.vectors import exact, floored, matrix, whole, widest

LONG = (1 << 63) - 1


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python integers where 64 bits might not hold them."""
    most = widest(x) + widest(y)
    d = exact(x, x.shape[-1], most) - exact(y, x.shape[-1], most)
    return (d * d).sum(axis=-1)


def root_up(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), np.inf), np.inf)


def root_down(d2: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), -np.inf), -np.inf), 0.0)


def narrow_up(x: np.ndarray) -> np.ndarray:
    """float32, not below x."""
    with np.errstate(over="ignore"):
        out = x.astype(np.float32)
    return np.where(out < x, np.nextafter(out, np.float32(np.inf)), out)


def narrow_down(x: np.ndarray) -> np.ndarray:
    """float32, not above x."""
    with np.errstate(over="ignore"):
        out = x.astype(np.float32)
    return np.where(out > x, np.nextafter(out, np.float32(-np.inf)), out)


class Centroids:
    """k centroids, how far each has moved, and half the distances between them rounded down."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at = at
        self.moved = root_up(squared(at, before)) if before is not None else np.zeros(len(at))
        self.half = root_down(squared(at[:, None], at[None])) / 2  # halving is exact
        other = self.half + np.where(np.eye(len(at)) > 0, np.inf, 0.0)
        self.nearest = other.min(axis=1)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(centroid, upper bound, lower bounds, distances computed) of vectors after the centroids have moved."""
        own, upper = own.copy(), np.nextafter(upper + self.moved[own], np.inf)
        lower = np.maximum(np.nextafter(lower - self.moved, -np.inf), 0.0)
        rows = np.flatnonzero(~(upper < self.nearest[own]))
        best = squared(x[rows], self.at[own[rows]])
        upper[rows], lower[rows, own[rows]] = root_up(best), root_down(best)
        computed = len(rows)
        for j in range(len(self.at)):
            mine = own[rows]
            some = np.flatnonzero((mine != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < self.half[mine, j]))
            if not len(some):
                continue
            r = rows[some]
            d2 = squared(x[r], self.at[j][None])
            computed += len(r)
            lower[r, j] = root_down(d2)
            nearer = (d2 < best[some]) | (d2 == best[some]) & (j < own[r])
            best = best.astype(object) if d2.dtype == object else best
            best[some[nearer]] = d2[nearer]
            own[r[nearer]], upper[r[nearer]] = j, root_up(d2[nearer])
        return own, upper, lower, computed


def assigned(vectors: DataFrame, key: str, cents: Centroids) -> DataFrame:
    """key, x, own, upper, lower of vectors (key, x), or of such rows with bounds of the centroids before."""
    k, width = cents.at.shape
    kind, fresh = vectors.schema[key].dataType.simpleString(), "own" not in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = matrix(batch.column(1), width), batch.num_rows
            if fresh:
                own, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                own, upper = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.float64)
                lower = batch.column(4).flatten().to_numpy().reshape(n, k).astype(np.float64)
            own, upper, lower, _ = cents.assign(x, own, upper, lower)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(narrow_down(lower).ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(narrow_up(upper), pa.float32()), bounds], names=[key, "x", "own", "upper", "lower"])

    return vectors.select(key, "x", *([] if fresh else ["own", "upper", "lower"])).mapInArrow(run, f"{key} {kind}, x array<long>, own int, upper float, lower array<float>")


def sums(state: DataFrame, k: int, width: int) -> dict[tuple[int, int], int]:
    """Exact sums by (centroid, dimension), and the number of vectors under dimension -1.

    A task adds up what it reads and sends k * (width + 1) rows at most; the driver receives as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), object), np.zeros(k, object)
        for batch in batches:
            x, own = matrix(batch.column(0), width), batch.column(1).to_numpy()
            x = x if len(x) * widest(x) < 1 << 62 else x.astype(object)
            for c in np.unique(own).tolist():
                mine = x[own == c]
                total[c] += mine.sum(axis=0)
                n[c] += len(mine)
        rows = [(c, d, Decimal(int(v))) for c in range(k) if n[c] for d, v in [(-1, n[c]), *enumerate(total[c])]]
        if rows:
            c, d, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(v, pa.decimal128(38, 0))], names=["own", "dim", "v"])

    parts = state.select("x", "own").mapInArrow(run, "own int, dim int, v decimal(38,0)")
    return {(r["own"], r["dim"]): int(r["v"]) for r in parts.groupBy("own", "dim").agg(F.sum("v").alias("v")).collect()}


def first_centroids(vectors: DataFrame, key: str, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:key`, by hash and then by entries."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256).alias("h"), "x")
    return np.array([r["x"] for r in hashed.orderBy("h", "x").limit(k).collect()], np.int64)


def cluster(rows: DataFrame, key: str = "vec_id", column: str = "embedding", width: int = 64, k: int = 16, rounds: int = 3, seed: str = "1", scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance decimal(38,0)) of each vector that counts, final centroids).

    k * width numbers go to the driver in each round and back to the tasks with their code; vectors are never shuffled.
    """
    vectors = rows.where((F.size(column) == width) & whole(F.col(column))).select(key, floored(F.col(column), scale).alias("x"))
    kind = rows.schema[key].dataType.simpleString()
    at = first_centroids(vectors, key, k, seed)
    if not len(at):
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance decimal(38,0)"), np.zeros((0, width), np.int64)
    state = written(assigned(vectors, key, Centroids(at)))
    for _ in range(rounds):
        total = sums(state, len(at), width)
        moved = np.array([[total[c, d] // total[c, -1] for d in range(width)] if (c, -1) in total else at[c] for c in range(len(at))], np.int64)
        state, last, at = written(assigned(state, key, Centroids(moved, at))), state, moved
        forget(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            d2 = squared(matrix(batch.column(1), width), at[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([Decimal(v) if v < 10**38 else None for v in d2.tolist()], pa.decimal128(38, 0))], names=[key, "cluster", "distance"])

    return state.select(key, "x", "own").mapInArrow(run, f"{key} {kind}, cluster int, distance decimal(38,0)"), at


def digests(at: np.ndarray) -> list[str]:
    """sha256 of each centroid's entries as decimal integers joined by commas."""
    return [sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]


def report(rows: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that counts."""
    found, at = cluster(rows, key, **options)
    by = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum("distance")).alias("s")).collect()}
    fit = lambda v: None if v is None or v > LONG else int(v)
    total = fit(None if None in by.values() else sum(by.values()))
    side = found.sparkSession.createDataFrame([(c, fit(by.get(c)), total, d) for c, d in enumerate(digests(at))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    told = found.withColumn("distance", F.col("distance").try_cast("long"))
    return told.join(F.broadcast(side), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid
