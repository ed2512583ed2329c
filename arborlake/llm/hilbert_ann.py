"""Approximate nearest neighbours along shifted Hilbert curves.

Groups of random orthogonal directions project the vectors to a few dimensions each;
every group is shifted at random, laid on a grid and ordered along a Hilbert curve.
Spark range-partitions (curve, position), so a curve lies in chunks of neighbours,
which carry vectors rounded to 16 bits.  A query meets the chunks within ``reach``
of its own on every curve, the nearest of all curves merge, and the best are reranked
by exact inner products of the original vectors.

``reach`` is a number of chunks on each side, fitted: for a bounded sample of queries
the true neighbours are found by exact search, and the reach is the least at which the
stated share of them is met.  So the work follows the data: clustered vectors need a
few chunks at any size of the table, vectors without structure a good part of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import if_small, prepare, written

CHUNK = 64  # vectors in a chunk
SPAN = 512  # chunks of a curve that meet queries in one group
LEAST_REACH = 4  # chunks on each side, even if the sample's neighbours are all nearer
_SPARE = 12  # more candidates than asked for, as scores of rounded vectors select them


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer cells (n, d), d * bits <= 63.

    Works from the most significant bit down: at each level the cell's corner is
    read in the current frame (a reflection and a rotation of the axes), turned into
    its Gray-code rank, and the frame of the sub-cube follows from the rank.
    """
    n, d = cells.shape
    key = np.zeros(n, dtype=np.int64)
    entry = np.zeros(n, dtype=np.int64)
    turn = np.zeros(n, dtype=np.int64)
    full = (1 << d) - 1
    weights = 1 << np.arange(d)
    for level in range(bits - 1, -1, -1):
        corner = ((cells >> level) & 1) @ weights
        local = corner ^ entry
        shift = (turn + 1) % d
        local = ((local >> shift) | (local << (d - shift))) & full
        rank = local.copy()
        s = 1
        while s < d:
            rank ^= rank >> s
            s *= 2
        key = (key << d) | rank
        # entry point and direction of the sub-cube of this rank
        even = 2 * ((rank - 1) // 2)
        start = np.where(rank == 0, 0, even ^ (even >> 1))
        start = ((start << shift) | (start >> (d - shift))) & full
        entry = entry ^ start
        probe = np.where(rank % 2 == 0, rank - 1, rank)
        ones = np.zeros(n, dtype=np.int64)
        going = np.ones(n, dtype=bool)
        for b in range(d):
            going &= ((probe >> b) & 1) == 1
            ones += going
        ones = np.where(rank == 0, 0, ones)
        turn = (turn + ones + 1) % d
    return key


class Curves:
    """The projections and shifts of all curves; the same for every task."""

    def __init__(self, dim: int, curves: int, axes: int, bits: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        need, parts = curves * axes, []
        while need > 0:
            q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
            parts.append(q)
            need -= dim
        self.curves, self.axes, self.bits = curves, axes, bits
        self.directions = np.concatenate(parts, axis=1)[:, : curves * axes]
        self.shift = rng.uniform(0, 1, curves * axes)
        self.reach = 3 / math.sqrt(dim)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, curves) positions of the directions of nonzero vectors."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        # unit vectors' coordinates lie within three deviations but for a few, which are clipped
        at = np.clip((unit @ self.directions / self.reach + 1) / 2, 0, 1)
        cells = ((at + self.shift) / 2 * (1 << self.bits)).astype(np.int64).clip(0, (1 << self.bits) - 1)
        return np.stack(
            [hilbert_keys(cells[:, c * self.axes : (c + 1) * self.axes], self.bits) for c in range(self.curves)], axis=1
        )


def _valid(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part, of all lengths."""
    slim = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    return slim.where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector as 16-bit integers and the factor that they were divided by."""
    scale = np.abs(vectors).max(axis=1) / 32767
    return np.rint(vectors / scale[:, None]).astype(np.int16), scale


@dataclass(frozen=True)
class Index:
    """The curves' chunks in the scratch folder, and what a search needs beside them.

    distinct: (rep, vector, keys, asked), a row per distinct vector; keys are its k + 1
    smallest, as no more of equal vectors can be in a result.  members: (query_id, rep).
    chunks: (curve, chunk, reps, codes, asked_reps, asked_codes), chunks numbered along
    their curve from 0.
    """

    distinct: DataFrame
    members: DataFrame
    chunks: DataFrame
    dim: int
    curves: int


def build(
    vectors: DataFrame, queries: Column, *, key: str, vector: str, k: int, curves: int, axes: int, bits: int
) -> Index | None:
    """Index every vector that takes part; None if none does."""
    spark = vectors.sparkSession
    prepare(spark)
    of = vectors.schema[vector].dataType
    single = isinstance(of, ArrayType) and isinstance(of.elementType, FloatType)
    whole = _valid(vectors, key, vector, "float" if single else "double")
    lengths = whole.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    dim, n = common["dim"], common["n"]
    plan = Curves(dim, curves, axes, bits)

    usable = whole.where(F.size("vector") == dim)
    same = Window.partitionBy("vector").orderBy("vec_id")
    least = usable.dropDuplicates(["vec_id", "vector"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    distinct = written(
        least.groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("keys"))
        .select(F.monotonically_increasing_id().alias("rep"), "vector", "keys"),
        "vectors",
    )
    asking = usable.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    members = written(asking.join(distinct.select("vector", "rep"), "vector").select("query_id", "rep"), "members")
    asked = members.select("rep").distinct().withColumn("asked", F.lit(True))
    distinct = distinct.join(asked, "rep", "left").select("rep", "vector", "keys", F.coalesce("asked", F.lit(False)).alias("asked"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("vector"), dim)
            codes, scale = rounded(matrix)
            raw = [c.tobytes() + f.tobytes() for c, f in zip(codes, scale)]
            keys = plan.keys(matrix)
            for c in range(curves):
                columns = [
                    pa.array(np.full(batch.num_rows, c, np.int32)),
                    pa.array(keys[:, c]),
                    batch.column("rep"),
                    batch.column("asked"),
                    pa.array(raw, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["curve", "position", "rep", "asked", "code"])

    def chunk_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks along the partition's order, numbered from 0 on each curve of the partition."""
        part, curve_now, nth = TaskContext.get().partitionId(), None, 0
        held: list[tuple] = []

        def close():
            reps = np.array([h[0] for h in held], np.int64)
            asked = np.array([h[1] for h in held], bool)
            codes = [h[2] for h in held]
            row = (curve_now, part, nth, reps.tobytes(), b"".join(codes), reps[asked].tobytes(), b"".join(c for c, x in zip(codes, asked) if x))
            names = ["curve", "part", "nth", "reps", "codes", "asked_reps", "asked_codes"]
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            for curve, rep, is_asked, code in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                if held and (curve != curve_now or len(held) >= CHUNK):
                    yield close()
                    held, nth = [], nth + 1
                if curve != curve_now:
                    curve_now, nth = curve, 0
                held.append((rep, is_asked, code))
        if held:
            yield close()

    # a range has about 2 ** 18 entries, and a small table some on each curve
    ranges = max(2 * curves, math.ceil(n * curves / (1 << 18)))
    chunks = written(
        distinct.select("rep", "vector", "asked")
        .mapInArrow(place, "curve int, position long, rep long, asked boolean, code binary")
        .repartitionByRange(ranges, "curve", "position", "rep")
        .sortWithinPartitions("curve", "position", "rep")
        .mapInArrow(chunk_up, "curve int, part int, nth int, reps binary, codes binary, asked_reps binary, asked_codes binary"),
        "hilbert",
    )
    # one row per curve and range: how many chunks of the curve lie in the ranges before
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    starts, _ = if_small(sizes.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    numbered = chunks.join(starts, ["curve", "part"]).select(
        "curve", (F.col("start") + F.col("nth")).alias("chunk"), "reps", "codes", "asked_reps", "asked_codes"
    )
    return Index(distinct, members, numbered, dim, curves)


def fitted_reach(index: Index, *, k: int, recall: float, sample: int) -> int:
    """Chunks on each side within which, on some curve, lies ``recall`` of the sample's true k nearest.

    The sample is ``sample`` queries chosen by a hash.  Only their vectors, their nearest
    and the chunk numbers of those come to the driver.
    """
    dim = index.dim
    rows = index.distinct.where("asked").orderBy(F.xxhash64("keys"), "rep").limit(sample).select("rep", "vector").collect()
    if not rows:
        return LEAST_REACH
    own = np.array([r["rep"] for r in rows], np.int64)
    q = np.array([r["vector"] for r in rows], np.float64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, reps = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.asarray(batch.column("rep"))
            s = q @ _matrix(batch.column("vector"), dim).T
            s[own[:, None] == found[None, :]] = -np.inf
            score = np.concatenate([score, s], axis=1)
            reps = np.concatenate([reps, np.broadcast_to(found, s.shape)], axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, reps = np.take_along_axis(score, top, 1), np.take_along_axis(reps, top, 1)
        real = ~np.isneginf(score)
        who = np.broadcast_to(own[:, None], score.shape)
        yield pa.RecordBatch.from_pydict({"q": who[real], "rep": reps[real], "score": score[real]})

    hits = index.distinct.select("rep", "vector").mapInArrow(exact, "q long, rep long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    near = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("q", "rep").collect()
    if not near:
        return LEAST_REACH
    wanted = np.unique(np.array([own.tolist() + [r["rep"] for r in near]]))

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for curve, chunk, raw in zip(*[c.to_pylist() for c in batch.columns]):
                here = np.intersect1d(np.frombuffer(raw, np.int64), wanted)
                if len(here):
                    yield pa.RecordBatch.from_pydict(
                        {"curve": np.full(len(here), curve, np.int32), "chunk": np.full(len(here), chunk, np.int64), "rep": here}
                    )

    places = index.chunks.select("curve", "chunk", "reps").mapInArrow(where, "curve int, chunk long, rep long").toPandas()
    at = np.zeros((len(wanted), index.curves), np.int64)
    at[np.searchsorted(wanted, places["rep"]), places["curve"]] = places["chunk"]
    a = at[np.searchsorted(wanted, [r["q"] for r in near])]
    b = at[np.searchsorted(wanted, [r["rep"] for r in near])]
    apart = np.abs(a - b).min(axis=1)
    return max(LEAST_REACH, int(np.quantile(apart, recall, method="higher")))


def met(index: Index, reach: int, *, keep: int) -> DataFrame:
    """(q, hits): per query and span of a curve the ``keep`` best (far, rep) by rounded vectors; far is the negative score."""
    dim = index.dim
    span = lambda c: F.floor(c / SPAN).cast("long")
    spans = F.sequence(span(F.greatest(F.col("chunk") - reach, F.lit(0))), span(F.col("chunk") + reach))
    asks = index.chunks.where(F.length("asked_reps") > 0).select(
        "curve", F.explode(spans).alias("span"), F.lit(1).alias("kind"), "chunk", F.col("asked_reps").alias("reps"), F.col("asked_codes").alias("codes")
    )
    candidates = index.chunks.select("curve", span(F.col("chunk")).alias("span"), F.lit(0).alias("kind"), "chunk", "reps", "codes")
    meetings = candidates.union(asks).repartition("curve", "span").sortWithinPartitions("curve", "span", "kind", "chunk")
    def decoded(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # sums of products of such integers are exact in double precision, however they are added up
        table = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 2 * dim + 8)
        return table[:, : 2 * dim].copy().view(np.int16).astype(np.float64), table[:, 2 * dim :].copy().view(np.float64)[:, 0]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, reps, codes, ready = None, [], [], [], None
        for batch in batches:
            for curve, group, kind, chunk, ids, code in zip(*[c.to_pylist() for c in batch.columns]):
                if (curve, group) != at:
                    at, numbers, reps, codes, ready = (curve, group), [], [], [], None
                if kind == 0:
                    numbers.append(chunk)
                    reps.append(np.frombuffer(ids, np.int64))
                    codes.append(code)
                    continue
                if ready is None and numbers:
                    ends = np.cumsum([0] + [len(r) for r in reps])
                    ready = (ends, np.concatenate(reps), *decoded(codes))
                first, last = np.searchsorted(numbers, [chunk - reach, chunk + reach + 1])
                if first == last:
                    continue
                ends, found, matrix, scale = ready
                part = slice(ends[first], ends[last])
                asked, factor = decoded([code])
                score = (asked @ matrix[part].T) * (factor[:, None] * scale[None, part])
                yield _best(np.frombuffer(ids, np.int64), score, found[part], keep)

    return meetings.mapInArrow(meet, "q long, hits array<struct<far: double, rep: long>>")


def _best(own: np.ndarray, score: np.ndarray, reps: np.ndarray, keep: int) -> pa.RecordBatch:
    """A row per query with its best candidates, in no order; equal scores fall as they come."""
    m = min(keep, score.shape[1])
    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
    far = -np.take_along_axis(score, top, 1)
    hit = pa.StructArray.from_arrays([pa.array(far.ravel()), pa.array(reps[top].ravel())], names=["far", "rep"])
    offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * m, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(offsets, hit)], names=["q", "hits"])


def search(
    vectors: DataFrame,
    queries: Column,  # over the column vec_id, whatever the key's name
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    curves: int = 16,
    axes: int = 6,
    bits: int = 8,
    recall: float = 0.94,
    sample: int = 128,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, nearest first.

    queries: condition over ``vec_id`` that picks the query rows; candidates are all
    rows with another key.  score is the inner product in double precision, ties go
    to the smaller key, rank starts at 1, and a query has min(k, candidates) rows.
    Vectors that are null, empty, zero, of another length than the commonest, or hold
    null or non-finite components take no part.  Equal vectors are searched once; each
    of their rows that asks gets the result without itself.  Rows that repeat key and
    vector are one; a key with several vectors is a candidate with each and asks with
    the one that sorts first.  Curves order directions: for vectors of very unlike norms
    the fitted reach grows, as the nearest then lie in other directions too.

    recall: share of true neighbours that the fitted reach meets for ``sample`` queries.
    """
    spark = vectors.sparkSession
    index = build(vectors, queries, key=key, vector=vector, k=k, curves=curves, axes=axes, bits=bits)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, keep = index.dim, k + 1 + _SPARE
    hits = met(index, fitted_reach(index, k=k, recall=recall, sample=sample), keep=keep)
    # lists per query: two or three a curve while the reach is within a span
    merged = hits.groupBy("q").agg(F.collect_list("hits").alias("all"))
    chosen = merged.select("q", F.explode(F.slice(F.array_sort(F.array_distinct(F.flatten("all"))), 1, keep)["rep"]).alias("rep"))
    pairs = chosen.join(index.distinct.select("rep", "keys", F.col("vector").alias("x")), "rep").join(
        index.distinct.where("asked").select(F.col("rep").alias("q"), F.col("vector").alias("y")), "q"
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # summed one pair at a time, so that a pair has one score wherever it is met
            score = (_matrix(batch.column("x"), dim) * _matrix(batch.column("y"), dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(-score), batch.column("keys")], names=["q", "far", "keys"])

    scored = pairs.select("q", "keys", "x", "y").mapInArrow(rerank, "q long, far double, keys array<long>")
    spread = F.transform("keys", lambda v: F.struct(F.col("far").alias("far"), v.alias("vec_id")))
    listed = scored.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(spread))), 1, k + 2).alias("hits"))
    answers = index.members.join(listed, index.members["rep"] == listed["q"])
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.far")).alias("score"),
    )
