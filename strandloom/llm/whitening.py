"""Embedding whitening through an exact integer scatter.

Entries become integers x = floor(scale * c) + shift. The fit list is each distinct vector once. With the shift subtracted,
each task adds up sums and cross-products as integers of any size; from their totals n * X'X - S S' is formed exactly, and
only its quotient by n * n becomes floating point, rounded once, and is decomposed by eigh. Rows are projected as (n * x - S) / n.

Defined results: a row counts unless its vector is null or has null or non-finite entries; others have no row. floor(scale * c) is
clamped to 62 bits. Vectors shorter than the longest are as if their missing entries were c = 0; an empty one is all zeros.
Components of a zero eigenvalue (below the rounding error of the largest) have null in `whitened` and no part in identity_error;
where all vectors are equal, explained is null too. Deviations beyond 38 digits are null. An empty table gives no row; rows
of one vec_id are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import written
from strandloom.llm.vectors import floored, matrix, whole, widest

LIMB = 32


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, their sums without the shift, eigenvalues (falling) and unit eigenvectors (columns) up to `most`, the trace, and the number of eigenvalues that aren't zero."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rank: int
    identity_error: float | None = None


def limbs(v: int) -> list[int]:
    """v as numbers of 32 bits, the last one signed, which are summed apart without overflow."""
    out = []
    while not -(1 << LIMB) < v < 1 << LIMB:
        out.append(v & (1 << LIMB) - 1)
        v >>= LIMB
    return [*out, v]


def cross(y: np.ndarray) -> np.ndarray:
    """y'y exactly: in doubles where they hold it, in longs, or in Python integers."""
    most = len(y) * widest(y) ** 2
    if most < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    y = y if most < 1 << 62 else y.astype(object)
    return y.T @ y


def scatter(fit_list: DataFrame, width: int, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of x - shift over a table of x, exactly.

    A task sends one row for each pair of dimensions and limb; the driver receives as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                y = matrix(batch.column(0).slice(i, 4096), width) - shift
                n += len(y)
                total += (y if len(y) * widest(y) < 1 << 62 else y.astype(object)).sum(axis=0)
                products += cross(y)
        if n:
            cells = [(-1, -1, n), *((-1, i, v) for i, v in enumerate(total)), *((i, j, products[i, j]) for i in range(width) for j in range(i, width))]
            rows = [(i, j, k, v) for i, j, value in cells for k, v in enumerate(limbs(int(value))) if v]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if q < 3 else pa.int64()) for q, c in enumerate(zip(*rows))], names=["i", "j", "limb", "v"])

    got = {(-1, -1): 0}
    for r in fit_list.select("x").mapInArrow(run, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect():
        got[r["i"], r["j"]] = got.get((r["i"], r["j"]), 0) + (r["v"] << LIMB * r["limb"])
    at = lambda i, j: got.get((i, j), 0)
    return at(-1, -1), [at(-1, i) for i in range(width)], [[at(min(i, j), max(i, j)) for j in range(width)] for i in range(width)]


def decomposed(n: int, sums: list[int], products: list[list[int]], most: int) -> Fit:
    """Covariance, each entry rounded once from its exact value, and its first `most` eigenvectors; the largest entry of each is positive."""
    width = len(sums)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    rank = int((values > max(float(values[0]), 0.0) * width * np.finfo(float).eps).sum())
    return Fit(n, sums, values, vectors, float(np.trace(v)), rank)


def centred(y: np.ndarray, fit: Fit) -> np.ndarray:
    """n * y - S as exact integers."""
    sums = np.array(fit.sums, object)
    if fit.n * widest(y) + max(map(abs, fit.sums), default=0) < 1 << 62:
        return fit.n * y - sums.astype(np.int64)
    return fit.n * y.astype(object) - sums


def projected(y: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened coordinates of rows of x - shift; columns of zero eigenvalues are NaN."""
    z = (centred(y, fit) / fit.n).astype(np.float64) @ fit.vectors
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.arange(z.shape[1]) < fit.rank, z / np.sqrt(np.maximum(fit.values, 0)), np.nan)


def identity_error(fit_list: DataFrame, fit: Fit, width: int, shift: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; its mean is zero, as x - S/n is projected."""
    if not fit.rank:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fit.rank, fit.rank))
        for batch in batches:
            w = projected(matrix(batch.column(0), width) - shift, fit)[:, : fit.rank]
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    got = fit_list.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r["v"] / fit.n - (r["i"] == r["j"])) for r in got)


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 64, shift: int = 1_000_000, most: int = 16) -> tuple[DataFrame, Fit | None]:
    """((key, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each row and component, the fit).

    The distinct vectors are written once to the shared folder; width * width numbers reach the driver.
    """
    kind = rows.schema[key].dataType.simpleString()
    kept = rows.where(whole(F.col(column))).select(key, F.transform(floored(F.col(column), scale), lambda x: x + shift).alias("x"))
    fit_list = kept.select("x").distinct()
    width = kept.agg(F.max(F.size("x"))).first()[0]
    schema = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not width:
        return rows.sparkSession.createDataFrame([], schema), None
    if kept.where(F.size("x") < width).limit(1).count():
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x"))))
        fit_list = kept.select("x").distinct()
    fit_list = written(fit_list)
    fit = decomposed(*scatter(fit_list, width, shift), most)
    fit = Fit(**{**fit.__dict__, "identity_error": identity_error(fit_list, fit, width, shift)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(fit.values)
        explained = [float(e) / fit.trace if fit.trace > 0 else None for e in fit.values]
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                y, n = matrix(part.column(1), width) - shift, part.num_rows
                d = centred(y, fit)
                square = (d * d if width * widest(d) ** 2 < 1 << 62 else d.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in square.tolist()], pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(n), p))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(again), pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), n)), pa.array(np.full(n * p, fit.n)), deviation.take(again),
                     pa.array(projected(y, fit).ravel(), from_pandas=True), pa.array(explained * n, pa.float64()), pa.array([fit.identity_error] * (n * p), pa.float64())],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.mapInArrow(run, schema), fit
