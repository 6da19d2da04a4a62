"""Embedding whitening by a tall-and-skinny QR decomposition.

Entries become integers, so sums are exact. Every task centres its rows by them and reduces them to the triangular factor R of a
QR decomposition; factors are stacked and decomposed again, eight at a time, until one is left, whose RᵀR is
that of all centred rows. Its singular values and right vectors are the standard deviations (times the
root of n) and the principal axes. The covariance matrix is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Factors that one task of the merge tree stacks.
FAN_IN = 8
#: Values of rows that are decomposed together; bounds the memory of a task.
BLOCK_VALUES = 4_000_000
LIMIT = 2.0**62


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows whose vector is there and holds finite entries only, as integers. An empty vector is no vector."""
    c = F.col(f"`{vector}`").cast("array<double>")
    whole = F.size(c) > 0
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(whole & finite)
    return rows.select("vec_id", F.transform(c, lambda v: F.floor(SCALE * v).cast("long") + F.lit(OFFSET).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _pieces(matrix: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_VALUES // max(1, matrix.shape[1]))
    for start in range(0, len(matrix), step):
        yield matrix[start : start + step]


class Centre(NamedTuple):
    """Number of vectors and exact sums of their dimensions."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in integers."""
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / self.n


def centre(rows: DataFrame) -> Centre | None:
    """Exact sums: added up within each task, then over tasks by dimension. None if there are no rows."""
    sizes = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not sizes[2]:
        return None
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} dimensions in one table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = _matrix(batch["x"]).sum(axis=0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "total": pa.array(total, pa.int64())})

    found = rows.select("x").mapInArrow(run, "dim int, total long").groupBy("dim").agg(F.sum("total").alias("total")).collect()  # one row a dimension
    return Centre(sizes[2], np.array([r["total"] for r in sorted(found)], np.int64))


def _factor(stacked: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stacked, mode="r")


def factor(rows: DataFrame, at: Centre, fan_in: int = FAN_IN) -> np.ndarray:
    """R of the centred rows: one factor a task, merged by a tree whose levels are written down."""
    width = len(at.sums)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for piece in _pieces(_matrix(batch["x"])):
                r = _factor(np.vstack([r, at.centred(piece)]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for own in group["r"]:
            r = _factor(np.vstack([r, np.asarray(own).reshape(-1, width)]))
        return pd.DataFrame({"node": [group["node"].iloc[0] // fan_in], "r": [r.ravel()]})

    # Numbers of partitions are distinct, not gapless; the tree only needs that few share a parent.
    level = materialise(rows.select("x").mapInArrow(reduced, "r array<double>").withColumn("node", F.spark_partition_id().cast("long")), "factors")
    while level.count() > 1:
        parent = F.floor(F.col("node") / fan_in)
        level = materialise(level.select("node", "r").groupBy(parent).applyInPandas(merged, "node long, r array<double>"), "factors")
    return np.asarray(level.first()["r"]).reshape(-1, width)


class Whitening(NamedTuple):
    """The transform: ``axes`` (dimensions x components) turns centred vectors into whitened ones."""

    at: Centre
    axes: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.at.centred(x) @ self.axes


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The transform for the rows of ``usable``; None if there are none.

    Directions in which the vectors don't vary (to the precision of double numbers) can't be whitened and are
    left out, so there may be fewer components than asked for, and none for a single vector.
    """
    at = centre(rows)
    if at is None:
        return None
    _, deviations, right = np.linalg.svd(factor(rows, at), full_matrices=False)
    varied = deviations > (deviations[0] if len(deviations) else 0) * len(at.sums) * np.finfo(float).eps
    kept = np.flatnonzero(varied)[:components]
    shares = deviations**2 / max(np.sum(deviations**2), np.finfo(float).tiny)
    return Whitening(at, right[kept].T * (np.sqrt(at.n) / deviations[kept]), shares[kept])


def identity_error(rows: DataFrame, how: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity.

    Whitened rows are centred, as their vectors are, before they are multiplied; the products are added up
    within each task, then over tasks by entry.
    """
    k = how.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for piece in _pieces(_matrix(batch["x"])):
                y = how.apply(piece)
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"entry": pa.array(range(k * k), pa.int32()), "total": pa.array(total.ravel(), pa.float64())})

    wanted = F.when(F.col("entry") % (k + 1) == 0, 1.0).otherwise(0.0)
    sums = rows.select("x").mapInArrow(run, "entry int, total double").groupBy("entry").agg(F.sum("total").alias("total"))
    return sums.agg(F.max(F.abs(F.col("total") / how.at.n - wanted))).first()[0]


def deviations(x: np.ndarray, at: Centre) -> np.ndarray:
    """Sum over dimensions of (n * x - S)², exact; an error if it doesn't fit a long."""
    scaled = at.scaled(x)
    if (np.square(scaled.astype(float)).sum(axis=1) > LIMIT).any():
        raise OverflowError("a deviation is beyond the range of long")
    return np.square(scaled).sum(axis=1)


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row of ``vectors`` and component.

    Rows whose vector is null, empty, or holds null, NaN or infinite entries are left out. Null and repeated vec_ids
    and repeated vectors count like any others. Vectors of several sizes raise an error, as do numbers beyond
    the range of long. No rows, a single vector, or vectors that are all equal give an empty result. Other columns are ignored.
    """
    rows = usable(vectors, vector)
    how = fit(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if how is None or not how.axes.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    k, error = how.axes.shape[1], identity_error(rows, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _matrix(batch["x"])
            columns = [
                batch["vec_id"].take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, how.at.n)), pa.array(np.repeat(deviations(x, how.at), k)),
                pa.array(how.apply(x).ravel()), pa.array(np.tile(how.explained, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
