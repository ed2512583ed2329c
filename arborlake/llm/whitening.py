"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Components are made integers, so that counts, sums and deviations are exact.  Each
partition of the distinct vectors reduces its rows block by block to a summary: their
number, their exact sums, and the singular values and right vectors of the centred
rows, all dimensions kept.  Two summaries merge without loss: the scaled vectors of
both are stacked with one row for the distance of their means, and decomposed again.
Partitions merge in a tree of small groups, and the last summary (dimensions squared)
is all that comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, scaled, written

FAN_IN = 16  # summaries that one task merges
_DIGITS = 10**38


@dataclass(frozen=True)
class Summary:
    """n rows by their sums (Python integers) and the scaled right vectors of the centred rows."""

    n: int
    sums: np.ndarray  # (d,) of int
    factor: np.ndarray  # (r, d), r <= d: singular values times right vectors

    def merge(self, other: Summary) -> Summary:
        n, both = self.n + other.n, self.n * other.n
        # the difference of the means from integers, rounded once
        apart = ((self.sums * other.n - other.sums * self.n) / both).astype(np.float64)
        rows = [self.factor, other.factor, math.sqrt(both / n) * apart[None, :]]
        return Summary(n, self.sums + other.sums, _factor(np.concatenate(rows)))


def _factor(rows: np.ndarray) -> np.ndarray:
    _, values, right = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * right


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of each column of an int64 matrix as Python integers."""
    if len(x) * (int(np.abs(x).max()) + 1) < 1 << 62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def summarise(x: np.ndarray) -> Summary:
    """The summary of a block of rows of integers."""
    sums = exact_sums(x)
    return Summary(len(x), sums, _factor(x - (sums / len(x)).astype(np.float64)))


_SUMMARY = "part int, n long, sums array<decimal(38,0)>, factor binary"


def _row(part: int, s: Summary) -> pa.RecordBatch:
    columns = [
        pa.array([part], pa.int32()),
        pa.array([s.n], pa.int64()),
        pa.array([[Decimal(v) for v in s.sums]], pa.list_(pa.decimal128(38, 0))),
        pa.array([s.factor.tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "sums", "factor"])


def _summary(n: int, sums: list[Decimal], factor: bytes) -> Summary:
    exact = np.array([int(v) for v in sums], dtype=object)
    return Summary(n, exact, np.frombuffer(factor, np.float64).reshape(-1, len(exact)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _merged(summaries: DataFrame) -> Summary | None:
    """All summaries as one, in rounds of groups of FAN_IN parts."""
    most = summaries.agg(F.max("part")).first()[0]
    if most is None:
        return None

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        found = _summary(rows[0]["n"], rows[0]["sums"], rows[0]["factor"])
        for r in rows[1:]:
            found = found.merge(_summary(r["n"], r["sums"], r["factor"]))
        return pa.Table.from_batches([_row(rows[0]["part"] // FAN_IN, found)])

    while most > 0:
        summaries = summaries.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, _SUMMARY)
        most //= FAN_IN
    (row,) = summaries.collect()
    return _summary(row["n"], row["sums"], row["factor"])


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums, and all components by falling eigenvalue of their covariance.

    Eigenvalues within rounding of zero are zero: rows do not spread along such components.
    """

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray  # (r, d), unit rows
    factor: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def projected(self, x: np.ndarray, components: int) -> np.ndarray:
        """(rows, components) whitened coordinates; not a number along components without spread."""
        k = min(components, len(self.values))
        mean = (self.sums / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            white = (x - mean) @ self.components[:k].T / np.sqrt(self.values[:k])
        return np.where(self.values[:k] > 0, white, np.nan)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n x - S) ** 2 as decimals, exact; null beyond 38 digits."""
        widest = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(abs(int(s)) for s in self.sums)
        if self.dim * widest * widest < 1 << 62:
            away = self.n * x - self.sums.astype(np.int64)
            return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
        away = self.n * x.astype(object) - self.sums
        total = (away * away).sum(axis=1)
        return pa.array([Decimal(t) if t < _DIGITS else None for t in total], pa.decimal128(38, 0))


def fit(vectors: DataFrame, *, vector: str = "embedding", factor: int = 256, components: int = 4) -> Whitening | None:
    """Learn from each distinct integer vector floor(factor * c) once; None if no vector takes part.

    Vectors that are null, empty, of another length than the commonest (the shorter of
    equally common ones), or hold null or non-finite components take no part.
    components: as many as ``identity_error`` looks at, the largest absolute entry of
    the whitened fit list's covariance minus the identity; null if none has spread.
    """
    prepare(vectors.sparkSession)
    kept, dim = scaled(vectors, vector, factor)
    if dim is None:
        return None
    distinct = written(kept.select("x").distinct(), "whitening")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                block = summarise(matrix(batch.column("x"), dim))
                found = block if found is None else found.merge(block)
        if found is not None:
            yield _row(TaskContext.get().partitionId(), found)

    total = _merged(written(distinct.mapInArrow(reduce, _SUMMARY), "summaries"))
    assert total is not None
    values = np.linalg.norm(total.factor, axis=1)
    spread = values > values[0] * max(total.n, dim) * np.finfo(np.float64).eps
    unit = np.zeros_like(total.factor)
    unit[spread] = total.factor[spread] / values[spread, None]
    model = Whitening(total.n, total.sums, np.where(spread, values * values / total.n, 0.0), unit, factor)
    return Whitening(**vars(model) | {"identity_error": _identity_error(distinct, model, components)})


def _identity_error(distinct: DataFrame, model: Whitening, components: int) -> float | None:
    k, dim = int((model.values[:components] > 0).sum()), model.dim
    if not k:
        return None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k + 1, k))
        for batch in batches:
            white = model.projected(matrix(batch.column("x"), dim), k)  # of centred rows
            found += np.concatenate([white.T @ white, white.sum(axis=0, keepdims=True)])
        at = np.arange(found.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel())], names=["at", "value"])

    sums = distinct.mapInArrow(spread, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    table = np.array([r["value"] for r in sums.orderBy("at").collect()]).reshape(k + 1, k) / model.n
    covariance = table[:k] - np.outer(table[k], table[k])
    return float(np.abs(covariance - np.eye(k)).max())


def transform(
    vectors: DataFrame, model: Whitening | None, *, key: str = "vec_id", vector: str = "embedding", components: int = 4
) -> DataFrame:
    """A row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    deviation is the exact sum over dimensions of (n x - S) ** 2 as decimal(38,0), null
    beyond 38 digits.  Rows whose key is null or repeats have their rows as any other.
    There are at most as many components as dimensions or distinct vectors; along one without spread,
    whitened is null.  explained is null if no component has any.  Vectors that take no
    part in ``fit``, and all if there is no model, have no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    if model is None:
        return spark.createDataFrame([], schema)
    kept, _ = scaled(vectors, vector, model.factor, dim=model.dim, extra={"vec_id": F.col(key)})
    k = min(components, len(model.values))
    total = model.values.sum()
    explained = model.values[:k] / total if total > 0 else np.full(k, np.nan)

    def per_batch(batch: pa.RecordBatch) -> dict[str, object]:
        rows = batch.num_rows
        x = matrix(batch.column("x"), model.dim)
        each = pa.array(np.repeat(np.arange(rows), k))
        return {
            "vec_id": batch.column("vec_id").take(each),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
            "n": np.full(rows * k, model.n, np.int64),
            "deviation": model.deviations(x).take(each),
            "whitened": pa.array(model.projected(x, k).ravel(), from_pandas=True),
            "explained": pa.array(np.tile(explained, rows), from_pandas=True),
            "identity_error": pa.array([model.identity_error] * (rows * k), pa.float64()),
        }

    return map_arrow(kept.select("vec_id", "x"), per_batch, schema)
