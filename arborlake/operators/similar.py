"""Similarity joins through an inverted file: targets lie in lists around centroids, sources look at few lists.

A list that cannot hold a match is passed by without loss: angles obey the triangle
inequality, so a target at an angle of at most ``t`` to a source lies in a list whose
centroid is at most ``t`` and the list's radius away.  Beyond that, a source may look
only at its nearest lists, as many as hold the stated share of true matches of a
bounded sample of sources.

Neighbouring lists are packed, and a source meets a pack once, however many of its
lists can hold a match: where vectors lie so that hardly a list can be passed by, what
is moved grows with the number of packs, not with that of lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_scratch

_SLICE = 512  # sources compared with centroids or targets at a time
_COLUMNS = (1024, 8192)  # targets that a slice of sources is compared with at first and, doubled from piece to piece, at most
_HELD = 1 << 22  # numbers in the vectors of a pack of targets
_SHARES = 8  # least number of shares of sources, and of packs of targets where these hold a block or more
_SCALE = 14  # decimals of a similarity, so that equal vectors tie wherever they meet


def usable(rows: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """(id, doc, h, v) of rows (element_pk, doc_id, embedding) with a finite, nonzero vector of the commonest length (or dim)."""
    v = F.col("embedding").cast("array<double>")
    slim = rows.select(F.col("element_pk").alias("id"), F.col("doc_id").alias("doc"), F.xxhash64("element_pk").alias("h"), v.alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    whole = slim.where(F.col("v").isNotNull() & sound)
    if dim is None:
        first = whole.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
        dim = first["dim"] if first else 0
    return whole.where(F.size("v") == dim), dim


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _angles(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centroids.T, -1, 1))


@dataclass(frozen=True)
class Index:
    """Targets (id, doc, h, v, list) in a checkpoint, and per list its centroid, radius and size."""

    targets: DataFrame
    dim: int
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    block: int
    probes: int | None = None  # lists that a source looks at; None: all that can hold a match

    def packs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per list its first pack and its number of packs.

        A pack has about ``block`` to _HELD / dim targets of lists in a row; a list of
        more is cut into packs of its own.
        """
        most = max(1, min(max(self.block, math.ceil(self.sizes.sum() / _SHARES)), max(self.block, _HELD // self.dim)))
        first, parts = np.zeros(len(self.sizes), np.int64), np.maximum(1, np.ceil(self.sizes / most)).astype(np.int64)
        pack, filled = 0, 0
        for i, n in enumerate(self.sizes.tolist()):
            if filled and filled + n > most:
                pack, filled = pack + 1, 0
            first[i] = pack
            filled += n
            if parts[i] > 1:
                pack, filled = pack + int(parts[i]), 0
        return first, parts

    def allowed(self, unit: np.ndarray, threshold: float) -> np.ndarray:
        """For each row, which lists it looks at."""
        if self.probes is not None:
            row, at = self.lists(unit, threshold)
            out = np.zeros((len(unit), len(self.sizes)), bool)
            out[row, at] = True
            return out
        reach = math.acos(max(-1.0, min(1.0, threshold))) + self.radii + 1e-7
        return (unit @ self.centroids.T >= np.where(reach < math.pi, np.cos(np.minimum(reach, math.pi)), -2) - 1e-14) & (self.sizes > 0)

    def lists(self, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each row looks at, nearest first."""
        angles = _angles(unit, self.centroids)
        order = np.argsort(angles, axis=1, kind="stable")
        can = angles <= math.acos(max(-1.0, min(1.0, threshold))) + self.radii + 1e-7
        allowed = np.take_along_axis(can & (self.sizes > 0), order, 1)
        if self.probes is not None:
            allowed &= np.cumsum(allowed, axis=1) <= self.probes
        row, at = np.nonzero(allowed)
        return row, order[row, at]


def _in_a_row(centroids: np.ndarray) -> np.ndarray:
    """The centroids in an order in which each is followed by the nearest of the rest."""
    left = np.ones(len(centroids), bool)
    order = [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, centroids @ centroids[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return centroids[order]


def build(targets: DataFrame, *, lists: int | None = None, block: int = 4096, seed: int = 7) -> Index | None:
    """Index all targets; None if no vector is usable.

    Centroids are trained by Spark's k-means over at most about 64 targets a list,
    chosen by a hash.  lists: about the square root of the number of targets by default;
    centroids are what is sent to all tasks, and so are as many numbers as that times
    the dimensions.
    """
    shared_scratch(targets.sparkSession)
    rows, dim = usable(targets)
    rows = rows.checkpoint()
    n = rows.count()
    if not n:
        return None
    lists = lists or (1 if n <= block else math.ceil(math.sqrt(n)))
    share = min(1.0, 64 * lists / n)
    some = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    centroids = np.ones((1, dim)) / math.sqrt(dim)
    if lists > 1:
        unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))
        means = KMeans(k=lists, distanceMeasure="cosine", initMode="random", maxIter=6, seed=seed, featuresCol="f")
        found = np.array(means.fit(some.select(array_to_vector(unit).alias("f"))).clusterCenters())
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        centroids = _in_a_row(found[norm[:, 0] > 0] / norm[norm[:, 0] > 0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at, angle = _unit(batch.column("v"), dim), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for s in range(0, batch.num_rows, _SLICE):
                a = _angles(unit[s : s + _SLICE], centroids)
                at[s : s + _SLICE], angle[s : s + _SLICE] = a.argmin(axis=1), a.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(angle)], names=["id", "doc", "h", "v", "list", "angle"])

    kinds = dict(rows.dtypes)
    placed = rows.mapInArrow(assign, f"id {kinds['id']}, doc {kinds['doc']}, h long, v array<double>, list int, angle double").checkpoint()
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["list"]], sizes[r["list"]] = r["radius"], r["n"]
    return Index(placed.drop("angle"), dim, centroids, radii, sizes, block)


def fitted(index: Index, sources: DataFrame, *, threshold: float, top: int, recall: float, sample: int = 256) -> Index:
    """The index with as many probes as meet ``recall`` of the matches of ``sample`` sources, chosen by a hash.

    Their vectors and the lists of their matches, found by an exact scan, come to the driver.
    """
    rows, _ = usable(sources, index.dim)
    asked = rows.orderBy(F.xxhash64("h"), "h").limit(sample).select("doc", "v").toArrow().combine_chunks()
    few = max(1, math.ceil(math.sqrt(len(index.centroids))))
    if not asked.num_rows:
        return replace(index, probes=few)
    q, dim = _unit(asked.column("v").combine_chunks(), index.dim), index.dim
    docs = asked.column("doc").to_pylist()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.round(q @ _unit(batch.column("v"), dim).T, _SCALE)
            s[_same(docs, batch.column("doc").to_pylist())] = -2
            best = np.argsort(-s, axis=1, kind="stable")[:, :top]
            near = np.take_along_axis(s, best, 1)
            row, at = np.nonzero(near >= threshold)
            lists = np.asarray(batch.column("list"))[best[row, at]]
            yield pa.RecordBatch.from_pydict({"q": row.astype(np.int32), "s": near[row, at], "list": lists.astype(np.int32)})

    hits = index.targets.select("doc", "v", "list").mapInArrow(exact, "q int, s double, list int")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "list")
    found = hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).select("q", "list").collect()
    row, at = index.lists(q, threshold)
    nth = np.full((len(q), len(index.centroids)), len(index.centroids))
    starts = np.searchsorted(row, np.arange(len(q)))
    nth[row, at] = np.arange(len(row)) - starts[row]
    ranks = [nth[r["q"], r["list"]] for r in found]
    return replace(index, probes=int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else few)


def _same(left: list, right: list) -> np.ndarray:
    """Whether rows are of one document; null is none."""
    codes: dict = {}
    for d in right:
        codes.setdefault(d, len(codes))
    a = np.array([-2 if d is None else codes.get(d, -3) for d in left])
    b = np.array([-1 if d is None else codes[d] for d in right])
    return a[:, None] == b[None, :]


def _codes(docs: list, known: dict) -> np.ndarray:
    """Numbers of documents; null is none, and each null is another one."""
    return np.array([-1 if d is None else known.setdefault(d, len(known)) for d in docs], dtype=np.int64)


def _nearest(unit: np.ndarray, doc: np.ndarray, targets: np.ndarray, target_doc: np.ndarray, threshold: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, target, similarity): each row's ``top`` most similar targets of other documents, ties to the first.

    Targets are compared piece by piece; of a piece only what beats a row's last hit so far is looked at again.
    """
    row, at, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(unit), threshold - 1e-14)
    end, columns = 0, _COLUMNS[0]
    while end < len(targets):
        start, end, columns = end, end + columns, min(2 * columns, _COLUMNS[1])
        s = unit @ targets[start:end].T
        hit = np.flatnonzero(s >= least[:, None])
        value = np.round(s.ravel()[hit], _SCALE)
        r, c = np.divmod(hit, s.shape[1])
        c += start
        kept = (value >= threshold) & ((doc[r] != target_doc[c]) | (doc[r] < 0))
        if not kept.any():
            continue
        row, at, near = np.append(row, r[kept]), np.append(at, c[kept]), np.append(near, value[kept])
        best = np.lexsort((at, -near, row))
        row, at, near = row[best], at[best], near[best]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        held = nth < top
        last = nth == top - 1
        # later targets of the same similarity come after those held
        least[row[last]] = near[last] + 4e-15
        row, at, near = row[held], at[held], near[held]
    return row, at, near


def search(index: Index, sources: DataFrame, *, threshold: float, top: int) -> DataFrame:
    """(source_id, target_reference, similarity): each source's ``top`` most similar targets of other documents.

    Every pack meets every share of the sources in a cell of its own; a source is sent to
    the packs in which a list can hold a match.  A task holds one pack and streams one share.
    """
    rows, dim = usable(sources, index.dim)
    kinds = dict(index.targets.dtypes)
    first, parts = index.packs()
    packs = int((first + parts).max())
    shares = max(packs, _SHARES)
    lean = replace(index, targets=None)  # what tasks need of the index
    row_schema = f"cell int, kind int, list int, id {kinds['id']}, doc {kinds['doc']}, v array<double>"

    def dealt(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, lists: np.ndarray, kind: int) -> pa.RecordBatch:
        taken = pa.array(at)
        numbers = [pa.array(x.astype(np.int32)) for x in (cell, np.full(len(cell), kind), lists)]
        return pa.RecordBatch.from_arrays([*numbers, *[batch.column(c).take(taken) for c in ("id", "doc", "v")]], names=["cell", "kind", "list", "id", "doc", "v"])

    def targets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("list")).astype(np.int64)
            pack = first[own] + np.asarray(batch.column("h")) % parts[own]
            at = np.repeat(np.arange(batch.num_rows), shares)
            yield dealt(batch, at, pack[at] * shares + np.tile(np.arange(shares), batch.num_rows), own[at], 0)

    def sources_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, _SLICE):
                part = batch.slice(s, _SLICE)
                unit = _unit(part.column("v"), dim)
                row, at = np.nonzero(lean.allowed(unit, threshold))
                met = np.zeros((len(unit), packs), bool)
                met[row, first[at]] = True
                for i in np.unique(at[parts[at] > 1]):
                    met[row[at == i], first[i] : first[i] + parts[i]] = True
                row, pack = np.nonzero(met)
                nearest = (unit @ lean.centroids.T).argmax(axis=1)
                yield dealt(part, row, pack * shares + (np.asarray(part.column("h")) % shares)[row], nearest[row], 1)

    together = index.targets.mapInArrow(targets_in, row_schema).union(rows.select("id", "doc", "h", "v").mapInArrow(sources_in, row_schema))
    # a target's place in its cell is that of its id, which decides ties; sources that look at the same lists come in a row
    met = together.repartitionById(packs * shares, "cell").sortWithinPartitions("cell", "kind", F.when(F.col("kind") == 1, F.col("list")), "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            cells, kind = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            ends = np.append(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kind) != 0)) + 1, batch.num_rows)
            start = 0
            for end in ends:
                part, start = batch.slice(start, end - start), int(end)
                if not part.num_rows:
                    continue
                if cells[end - 1] != now:
                    now, held, ready = cells[end - 1], [], None
                if kind[end - 1] == 0:
                    held.append(part)
                    continue
                if ready is None and held:
                    whole, known = pa.Table.from_batches(held).combine_chunks(), {}
                    ready = (
                        whole.column("id").combine_chunks(),
                        np.asarray(whole.column("list")),
                        _codes(whole.column("doc").to_pylist(), known),
                        _unit(whole.column("v").combine_chunks(), dim),
                        known,
                    )
                    del whole, held[:]
                for s in range(0, part.num_rows if ready else 0, _SLICE):
                    yield compared(part.slice(s, _SLICE), *ready)

    def compared(part: pa.RecordBatch, ids: pa.Array, lists: np.ndarray, docs: np.ndarray, targets: np.ndarray, known: dict) -> pa.RecordBatch:
        unit = _unit(part.column("v"), dim)
        doc = np.array([-1 if d is None else known.get(d, len(known)) for d in part.column("doc").to_pylist()], dtype=np.int64)
        looked = lean.allowed(unit, threshold).any(axis=0)[lists]
        if looked.all():
            row, at, near = _nearest(unit, doc, targets, docs, threshold, top)
        else:
            some = np.flatnonzero(looked)
            row, at, near = _nearest(unit, doc, targets[some], docs[some], threshold, top)
            at = some[at]
        columns = [part.column("id").take(pa.array(row)), ids.take(pa.array(at)), pa.array(near)]
        return pa.RecordBatch.from_arrays(columns, names=["source_id", "target_reference", "similarity"])

    source_kind = dict(rows.dtypes)["id"]
    hits = met.mapInArrow(meet, f"source_id {source_kind}, target_reference {kinds['id']}, similarity double")
    w = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "target_reference")
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).drop("nth")


def join(sources: DataFrame, targets: DataFrame, *, threshold: float, top: int, recall: float | None = None, lists: int | None = None, block: int = 4096) -> DataFrame:
    """(source_id, target_reference, similarity) of rows (element_pk, doc_id, embedding).

    Exact unless ``recall`` asks for that share of the matches only.  Both sides' ids are
    of any one type.  Vectors that are null, zero, of another length than most targets', or
    hold null or non-finite components take no part; a null document is none.
    Similarities are cosines rounded to 14 decimals; ties go to the smaller id.
    """
    index = build(targets, lists=lists, block=block)
    if index is None:
        kinds = [r.schema["element_pk"].dataType.simpleString() for r in (sources, targets)]
        return sources.sparkSession.createDataFrame([], f"source_id {kinds[0]}, target_reference {kinds[1]}, similarity double")
    if recall is not None:
        index = fitted(index, sources, threshold=threshold, top=top, recall=recall)
    return search(index, sources, threshold=threshold, top=top)
