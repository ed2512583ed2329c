"""Texts within an edit distance: a join that loses no pair, and entities merged along its links.

Two texts are alike if one minus their Levenshtein distance over the longer length is
at least a threshold.  The shorter is cut into so many parts that one of them has at
most one edit in the longer text, where it moved no further than the other edits allow.
Up to three edits that is one part or two, long enough to be rare, and a part and its
counterpart meet by equality once the edited character is left out of either or both.
More edits need many parts, of which one stands unchanged.  Texts meet on the hash of
(length, edits, part number, character left out, rest), an equality that Spark shuffles;
only what meets is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..session import shared_scratch

_EPSILON = 1e-9

#: Up to so many edits a part may hold one; beyond, parts are short and stand unchanged.
_FEW_EDITS = 3


def _edits(longer: Column, threshold: float) -> Column:
    """Edits that a threshold allows to a longer text of this length."""
    return F.floor(longer * (1 - threshold) + _EPSILON).cast("int")


def _allowed(longer: int, threshold: float) -> int:
    return int(longer * (1 - threshold) + _EPSILON)


def _parts(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, width) of the parts that the shorter of a pair is cut into, of nearly equal widths, the longer ones last."""
    n = edits // 2 + 1 if edits <= _FEW_EDITS else edits + 1
    starts = [i * (length // n) + max(0, i - (n - length % n)) for i in range(n + 1)]
    return [(start, end - start) for start, end in zip(starts, starts[1:])]


def _without(text: str, begin: int, width: int) -> list[tuple[str, str]]:
    """(rest, character): a stretch of the text without each of its characters in turn."""
    return [(text[begin:at] + text[at + 1 : begin + width], text[at]) for at in range(begin, begin + width)]


def _cut(text: str, threshold: float) -> list[tuple[str, str]]:
    """(key, character replaced or empty) of the shorter text: its parts, and where an edit may fall into one, those without a character."""
    length, keys = len(text), []
    for edits in range(max(1, _allowed(length, threshold)), _allowed(int(length / threshold + _EPSILON), threshold) + 1):
        for nth, (start, width) in enumerate(_parts(length, edits)):
            head = f"{length} {edits} {nth} "
            keys.append((f"{head}- {text[start : start + width]}", ""))
            if edits <= _FEW_EDITS:
                keys += [(f"{head}{at} {rest}", left) for at, (rest, left) in enumerate(_without(text, start, width))]
    return keys


def _probes(text: str, threshold: float) -> set[tuple[str, str]]:
    """(key, character replaced or empty) at which the longer text can meet a partner's part."""
    own, keys = len(text), set()
    edits = _allowed(own, threshold)
    few = edits <= _FEW_EDITS
    for length in range(max(1, own - edits), own + 1) if edits else ():
        parts = _parts(length, edits)
        for nth, (start, width) in enumerate(parts):
            head = f"{length} {edits} {nth} "
            for grown in (0, 1, -1) if few else (0,):
                # the first part's stretch starts the text, the last part's ends it
                end = own - width - grown
                first = max(0, end if nth == len(parts) - 1 else start - edits)
                last = min(end, 0 if nth == 0 else start + edits)
                for q in range(first, last + 1):
                    if abs(q - start) + abs(own - length - grown - q + start) + abs(grown) > edits:
                        continue
                    said = text[q : q + width + grown]
                    if grown == 0:
                        keys.add((f"{head}- {said}", ""))
                        if few:
                            keys.update([(f"{head}{at} {rest}", left) for at, (rest, left) in enumerate(_without(text, q, width))])
                    elif grown == 1:
                        keys.update([(f"{head}- {rest}", "") for rest, _ in _without(text, q, width + 1)])
                    else:
                        keys.update([(f"{head}{at} {said}", "") for at in range(width)])
    return keys


def _keyed(values: DataFrame, name: str, keys: Callable[[str, float], Iterable[tuple[str, str]]], threshold: float) -> DataFrame:
    """(kind, name, left, key): a row for each key of each value."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [list(keys(text, threshold)) for text in part.column("value").to_pylist()]
                owner = pa.array([j for j, of in enumerate(found) for _ in of], pa.int32())
                flat = [pa.array([key[k] for of in found for key in of], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("kind").take(owner), part.column("value").take(owner), *flat], ["kind", name, "key", "left"])

    kind = values.schema["kind"].dataType.simpleString()
    rows = values.select("kind", "value").mapInArrow(per_batch, f"kind {kind}, {name} string, key string, left string")
    return rows.select("kind", name, "left", F.xxhash64("key").alias("key"))


def candidates(values: DataFrame, threshold: float) -> DataFrame:
    """(kind, a, b): distinct values (kind, value) of one kind that share a part, the shorter (or smaller) first; with repeats."""
    if not 0.6 <= threshold <= 1:
        raise ValueError("below 0.6 short texts have more edits than characters to cut at")
    held = values.where(F.length("value") > 0)
    cut = _keyed(held, "a", _cut, threshold)
    probed = _keyed(held, "b", _probes, threshold).withColumnsRenamed({"kind": "__kind", "left": "__left"})
    met = cut.join(probed, "key").where(F.col("kind").eqNullSafe(F.col("__kind")))
    # equal parts meet as they are, and need not once more without each character
    replaced = (F.col("left") == "") | (F.col("__left") == "") | (F.col("left") != F.col("__left"))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return met.where(replaced & ordered & (F.col("a") != F.col("b"))).select("kind", "a", "b")


def alike(values: DataFrame, threshold: float = 0.85, kind: str = "kind", value: str = "value") -> DataFrame:
    """(kind, a, b, ratio): all pairs of distinct values of one kind that are alike; a is the shorter, or the smaller.

    Null and empty values are like none.  Work grows with the pairs that share a part but
    for one edit, not with all pairs nor with those that share a syllable.
    """
    distinct = values.select(F.col(kind).alias("kind"), F.col(value).alias("value")).distinct()
    within = F.call_function("levenshtein", F.col("a"), F.col("b"), _edits(F.length("b"), threshold)) >= 0
    scored = candidates(distinct, threshold).where(within).withColumn("ratio", normalize.levenshtein_ratio(F.col("a"), F.col("b")))
    return scored.where(F.col("ratio") >= threshold).distinct()


def scored_pairs(rows: DataFrame, key: str, value: str, same: list[str]) -> DataFrame:
    """(a, b, ratio): all pairs of keys a < b of rows that agree on the columns ``same``, with the likeness of their values.

    Each two different values of a group are compared once, however many rows have them;
    they are spread over the tasks before their rows are paired.
    """
    held = rows.groupBy(*same, F.col(value).alias("__value")).agg(F.collect_list(key).alias("__keys"))
    other = held.select(*same, F.col("__value").alias("__other"), F.col("__keys").alias("__others"))
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    met = held.join(other, same).repartition(spread, *same, "__value", "__other")
    scored = met.withColumn("ratio", normalize.levenshtein_ratio(F.col("__value"), F.col("__other")))
    left = scored.select("ratio", "__others", F.explode("__keys").alias("a"))
    return left.select("a", F.explode("__others").alias("b"), "ratio").where("a < b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): the smallest node that can be reached, itself included.

    Rounds of two steps: each node hands its larger neighbours to its smallest one, then
    its smaller neighbours.  Edges never grow in number, a hub's edges are rows like
    others, and about log(nodes) rounds, each a checkpoint, leave stars.
    """
    shared_scratch(links.sparkSession)
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().checkpoint()
    sign = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = sign(edges)
    while True:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(a, F.min("b")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = sign(edges)
        if now == seen:
            roots = edges.select(b.alias("node"), b.alias("component")).distinct()
            return edges.select(a.alias("node"), b.alias("component")).union(roots)
        seen = now


def merged(mentions: DataFrame, kind: str = "entity_type", name: str = "normalized", threshold: float = 0.85) -> DataFrame:
    """(entity_type, entity_id, name, forms, mentions): entities whose normal forms are linked by likeness.

    name: the commonest form, of equally common ones the smallest; entity_id: the smallest
    form; forms: how many different ones.  Kinds stay apart.  Null and empty forms are
    entities of their own.
    """
    forms = mentions.groupBy(F.col(kind).alias("kind"), F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    node = lambda v: F.struct(F.col("kind"), F.col(v).alias("value"))
    linked = components(alike(forms, threshold).select(node("a").alias("a"), node("b").alias("b")))
    owner = linked.select(F.col("node.kind").alias("__kind"), F.col("node.value").alias("__value"), F.col("component.value").alias("owner"))
    same = F.col("kind").eqNullSafe(F.col("__kind")) & F.col("value").eqNullSafe(F.col("__value"))
    owned = forms.join(owner, same, "left").withColumn("owner", F.coalesce("owner", "value"))
    return owned.groupBy(F.col("kind").alias("entity_type"), F.col("owner").alias("entity_id")).agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("name"), F.count(F.lit(1)).alias("forms"), F.sum("n").alias("mentions")
    )
