"""Compression of vectors into short codes: one codebook per part, searched through kd-trees.

Vectors are cut into equal parts; every part has a codebook of integer entries.  In
each round a kd-tree per codebook is broadcast, tasks search the nearest entry of their
parts by branch and bound and add up integer sums, and Spark adds those: what meets in
one place is a number of codebooks' worth, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, map_arrow, prepare, scaled, written

LEAF = 8  # entries in a leaf
_DIGITS = 10**38


@dataclass
class Node:
    """Entries ``at`` (ascending) in their tight box; a leaf holds their points, others two halves."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    points: np.ndarray | None = None
    halves: tuple[Node, ...] = ()

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the box: no entry of the node is nearer."""
        out = np.maximum(np.maximum(self.low - rows, rows - self.high), 0)
        return (out * out).sum(axis=1)


@dataclass
class KdTree:
    """A kd-tree over a codebook's entries, integers in int64 or, where those could overflow, in Python."""

    entries: np.ndarray
    root: Node = field(init=False)
    leaves: list[Node] = field(init=False)

    def __post_init__(self) -> None:
        self.leaves = []
        self.root = self._node(np.arange(len(self.entries)))

    def _node(self, at: np.ndarray) -> Node:
        points = self.entries[at]
        low, high = points.min(axis=0), points.max(axis=0)
        widest = int(np.argmax(high - low))
        if len(at) <= LEAF or low[widest] == high[widest]:
            self.leaves.append(Node(at, low, high, points))
            return self.leaves[-1]
        order = at[np.argsort(points[:, widest], kind="stable")]
        middle = len(order) // 2
        return Node(at, low, high, None, tuple(self._node(np.sort(h)) for h in (order[:middle], order[middle:])))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry; of equally near ones the lowest index.

        Every row first descends to the leaf of the nearer box at each turn, which gives an
        upper bound; then the tree is walked with all rows whose bound to a node is at most
        their best.  Nodes at exactly the best distance are visited too, as they may hold
        an equally near entry of a lower index.
        """
        n = len(rows)
        index = np.full(n, len(self.entries), np.int64)
        best = np.full(n, np.iinfo(np.int64).max) if rows.dtype != object else np.full(n, 1 << 400, object)
        self._descend(self.root, np.arange(n), rows, index, best)
        self._visit(self.root, np.arange(n), rows, index, best)
        return index, best

    def _descend(self, node: Node, who: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(who):
            return
        if node.points is not None:
            self._compare(node, who, rows, index, best)
            return
        left, right = node.halves
        nearer = (left.bound(rows[who]) <= right.bound(rows[who])).astype(bool)
        self._descend(left, who[nearer], rows, index, best)
        self._descend(right, who[~nearer], rows, index, best)

    def _visit(self, node: Node, who: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        who = who[(node.bound(rows[who]) <= best[who]).astype(bool)]
        if not len(who):
            return
        if node.points is not None:
            self._compare(node, who, rows, index, best)
        for half in node.halves:
            self._visit(half, who, rows, index, best)

    @staticmethod
    def _compare(leaf: Node, who: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        apart = rows[who][:, None, :] - leaf.points[None, :, :]
        far = (apart * apart).sum(axis=2)
        first = far.argmin(axis=1)  # the first of equal ones, and entries ascend
        near, at = far[np.arange(len(who)), first], leaf.at[first]
        better = ((near < best[who]) | ((near == best[who]) & (at < index[who]))).astype(bool)
        best[who[better]], index[who[better]] = near[better], at[better]


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts begin and end: equal parts, or the first ones longer by one."""
    return [p * (dim // parts) + min(p, dim % parts) for p in range(parts + 1)]


@dataclass(frozen=True)
class Codebooks:
    """Per part the entries, lists of Python integers."""

    dim: int
    books: list[list[list[int]]]

    @property
    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(v) for b in self.books for e in b for v in e).encode()).hexdigest()

    def trees(self) -> dict[bool, list[KdTree | None]]:
        """Trees over int64 (True) for parts where those suffice and over Python integers (False)."""
        both = {wide: [KdTree(np.array(b, np.int64 if wide else object)) for b in self.books] for wide in (True, False)}
        return both


def _fits(rows: np.ndarray, entries: np.ndarray) -> bool:
    """Whether squared distances of the rows to the entries stay within int64."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    return rows.shape[1] * (2 * most) ** 2 < 1 << 62


def assigned(x: np.ndarray, trees: dict[bool, list[KdTree]], ends: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part (rows, index, squared distance)."""
    for p in range(len(ends) - 1):
        rows = x[:, ends[p] : ends[p + 1]]
        wide = _fits(rows, trees[True][p].entries)
        rows = rows if wide else rows.astype(object)
        yield rows, *trees[wide][p].nearest(rows)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, dim)


def _start(kept: DataFrame, dim: int, parts: int, entries: int) -> Codebooks:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    ends = cuts(dim, parts)
    return Codebooks(dim, [[list(r["x"][a:b]) for r in first] for a, b in zip(ends, ends[1:])])


def _improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts; unused ones stay."""
    dim, parts = books.dim, len(books.books)
    ends, n = cuts(dim, parts), len(books.books[0])
    most = max(b - a for a, b in zip(ends, ends[1:]))
    trees = kept.sparkSession.sparkContext.broadcast(books.trees())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, n), np.int64)
        sums = [np.zeros((n, b - a), object) for a, b in zip(ends, ends[1:])]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, (rows, index, _) in enumerate(assigned(_matrix(batch, dim), trees.value, ends)):
                counts[p] += np.bincount(index, minlength=n)
                # a batch's sums of such integers stay within int64 where distances do
                here = np.zeros(sums[p].shape, rows.dtype)
                np.add.at(here, index, rows)
                sums[p] += here
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            if len(used):
                total = [[Decimal(int(v)) for v in sums[p][e]] for e in used]
                columns = [
                    pa.array(np.full(len(used), p, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(counts[p][used]),
                    pa.array(total, pa.list_(pa.decimal128(38, 0))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    partial = kept.select("x").mapInArrow(add_up, "part int, entry int, n long, sums array<decimal(38,0)>")
    # parts shorter by one have no last component: null there
    totals = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(most)]).alias("sums")
    )
    new = [[list(e) for e in b] for b in books.books]
    for r in totals.collect():  # at most a row per entry
        new[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["sums"] if v is not None]
    trees.unpersist()
    return Codebooks(dim, new)


def fit(kept: DataFrame, dim: int, *, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks after ``rounds`` rounds, from the vectors (vec_id, x) of the smallest keys."""
    books = _start(kept, dim, parts, entries)
    for _ in range(rounds):
        books = _improved(kept, books)
    return books


def compress(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    factor: int = 1024,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a row per vector that takes part.

    code: two hex digits a part.  error: the squared distances to the entries, summed over
    parts; label_error: error summed over equal labels, nulls together; both decimal(38,0),
    null beyond 38 digits.  Vectors that are null, empty, of another length than the
    commonest, or hold null or non-finite components have no row.  Codebooks start from
    the smallest keys, nulls last, and of equal keys the smaller vector; with fewer
    vectors than entries they are smaller.  Rows that repeat count as often as they occur.
    Lengths that parts do not divide give the first parts one component more; there must
    be no more parts than components.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    prepare(spark)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, label)}
    kept, dim = scaled(vectors, vector, factor, extra={"vec_id": F.col(key), "label": F.col(label)})
    if dim is None:
        return spark.createDataFrame(
            [], f"vec_id {kinds[key]}, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string"
        )
    if dim < parts:
        raise ValueError(f"vectors of {dim} components have no {parts} parts")
    kept = written(kept, "vector-codes")
    books = fit(kept, dim, parts=parts, entries=entries, rounds=rounds)
    trees, ends = spark.sparkContext.broadcast(books.trees()), cuts(dim, parts)

    def per_batch(batch: pa.RecordBatch) -> dict[str, object]:
        codes, total = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, object)
        for p, (_, index, far) in enumerate(assigned(_matrix(batch, dim), trees.value, ends)):
            codes[:, p] = index
            total += far
        return {
            "vec_id": batch.column("vec_id"),
            "label": batch.column("label"),
            "code": [c.tobytes().hex() for c in codes],
            "error": pa.array([Decimal(int(t)) if t < _DIGITS else None for t in total], pa.decimal128(38, 0)),
        }

    coded = written(map_arrow(kept, per_batch, f"vec_id {kinds[key]}, label {kinds[label]}, code string, error decimal(38,0)"), "coded")
    # labels are counted before they are broadcast; beyond that, a hot label is split by adaptive execution
    size = F.length(F.col("of").cast("string"))
    labels, _ = if_small(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error")), size)
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")
    )
