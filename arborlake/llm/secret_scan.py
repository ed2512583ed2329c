"""Secret scans: fixed patterns, and character Markov models for what those miss.

Training reads every text: what the patterns find are the labelled samples of random
strings, one class a pattern, and strings of letters and digits too short for a secret are the
ordinary ones (longer ones teach nothing: an unlabelled secret would vouch for itself;
for the same reason a transition that occurs once in the corpus is not counted).  Each class is an order-2 Markov model over letters and digits that starts
anew after a delimiter, smoothed towards order 1, order 0 and the uniform distribution.
A long run outside the patterns' spans is a secret if the log-likelihood ratio of
random to ordinary, with the strings' shares of the corpus as prior, reaches the odds
that are asked for.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, utf8

#: All patterns name ASCII only, so they work on UTF-8.
_ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")  # of a maximal run, so that no shorter match precedes one
_HEX = re.compile(rb"[0-9a-f]{16,}")
_SHORTEST_VALUE, _SHORTEST_RUN = 12, 16
KINDS = ("assign", "access", "hex", "markov")

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
DELIMITERS = b"+/_.=-"
SIZE = len(LETTERS) + 1  # 0: what is no letter or digit, the context of a start
CUBE = SIZE**3
_CODES = np.zeros(256, np.int64)
_CODES[list(LETTERS)] = np.arange(1, SIZE)
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(LETTERS + DELIMITERS)] = True
ORDINARY = 3  # class of what no pattern finds; classes below are the patterns' kinds
CLASSES = 4
REPEATING = 0.95
CHUNK = 1 << 20  # bytes counted at a time

Span = tuple[int, int, int, int]


def long_runs(data: bytes, least: int, of: np.ndarray = _IN_RUN) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` bytes of a kind, by default identifier characters."""
    inside = of[np.frombuffer(data, np.uint8)]
    width = 1
    while width < least and len(inside):
        step = min(width, least - width)
        inside = inside[:-step] & inside[step:]  # whether width + step characters from here are
        width += step
    at = np.flatnonzero(inside)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)] + least
    return list(zip(starts.tolist(), ends.tolist()))


def _assignments(data: bytes) -> Iterator[Span]:
    """Matches of the assignment pattern from left to right, tried where a keyword stands."""
    low = data.lower()
    places = []
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            places.append(at)
            at = low.find(word, at + 1)
    end = 0
    for at in sorted(places):
        if at >= end and (m := _ASSIGN.match(data, at)):
            end = m.end()
            if end - m.start(1) >= _SHORTEST_VALUE:
                yield at, end, 0, m.start(1)


def base_spans(data: bytes, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """(start, end, kind, start of the value) of the patterns' matches in UTF-8, by start and kind.

    runs: the runs of at least 16 identifier characters, as only they can hold the other patterns.
    """
    found = list(_assignments(data))
    for start, end in long_runs(data, _SHORTEST_RUN) if runs is None else runs:
        found += [(m.start(), m.end(), kind, m.start()) for kind, p in ((1, _ACCESS), (2, _HEX)) for m in p.finditer(data, start, end)]
    return sorted(found)


def free_parts(runs: list[tuple[int, int]], spans: list[Span], least: int) -> Iterator[tuple[int, int]]:
    """What the spans leave of the runs, where it has at least ``least`` characters."""
    nth = 0
    for start, end in runs:
        while nth < len(spans) and spans[nth][1] <= start:
            nth += 1
        at = start
        for s in range(nth, len(spans)):
            if spans[s][0] >= end:
                break
            if spans[s][0] - at >= least:
                yield at, spans[s][0]
            at = max(at, spans[s][1])
        if end - at >= least:
            yield at, end


def _contexts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of each byte the index of (two before, one before, itself); a class starts from nothing."""
    before = np.zeros_like(codes)
    before[1:] = np.where(kinds[1:] == kinds[:-1], codes[:-1], 0)
    two = np.zeros_like(codes)
    two[1:] = np.where(before[1:] > 0, before[:-1], 0)
    return (two * SIZE + before) * SIZE + codes


def count_text(data: bytes, counts: np.ndarray, strings: np.ndarray, least: int) -> None:
    """Add a text's characters to counts (classes, CUBE) and its strings to strings (classes).

    Of ordinary strings those are counted that are long enough to be asked about.
    """
    runs = long_runs(data, min(least, _SHORTEST_RUN))
    spans = base_spans(data, [r for r in runs if r[1] - r[0] >= _SHORTEST_RUN])
    runs = [r for r in runs if r[1] - r[0] >= least]
    strings[ORDINARY] += sum(1 for _ in free_parts(runs, spans, least))
    kinds = np.full(len(data), ORDINARY, np.int8)
    for start, end in long_runs(data, least, _CODES > 0):
        kinds[start:end] = -1
    for _, end, kind, value in reversed(spans):  # of overlapping ones the first by start and kind
        strings[kind] += 1
        kinds[value:end] = kind
    for start in range(0, len(data), CHUNK):
        lead = min(start, 2)  # characters before the chunk, as context only
        piece = slice(start - lead, start + CHUNK)
        codes, of = _CODES[np.frombuffer(data[piece], np.uint8)], kinds[piece]
        used = np.flatnonzero((codes[lead:] > 0) & (of[lead:] >= 0)) + lead
        counts.ravel()[:] += np.bincount(of[used].astype(np.int64) * CUBE + _contexts(codes, of)[used], minlength=CLASSES * CUBE)


@dataclass(frozen=True)
class Markov:
    """Log probabilities (class, context and character) of the patterns' classes and the ordinary one.

    weights: logarithm of each random class's share, the last being uniform strings;
    prior: logarithm of ordinary strings per random string.
    """

    table: np.ndarray
    weights: np.ndarray
    prior: float

    def ratio(self, run: bytes) -> float:
        """Log-likelihood of a run as a random string less that as an ordinary one.

        Ordinary strings may also repeat one character, as padding does: with the
        probability REPEATING, else they go on uniformly.
        """
        codes = _CODES[np.frombuffer(run, np.uint8)]
        said = codes > 0
        n = int(said.sum())
        each = self.table[:, _contexts(codes, np.zeros_like(codes))[said]].sum(axis=1, dtype=np.float64)
        random = np.append(each[:ORDINARY], -n * math.log(SIZE - 1)) + self.weights
        same = int((said[1:] & (codes[1:] == codes[:-1])).sum())
        repeated = same * math.log(REPEATING) + (n - same) * math.log((1 - REPEATING) / (SIZE - 1))
        return float(_log_sum(random) - _log_sum(np.array([each[ORDINARY], repeated])))


def _log_sum(logs: np.ndarray) -> float:
    top = logs.max()
    return float(top + np.log(np.exp(logs - top).sum()))


def train(counts: np.ndarray, strings: np.ndarray, strength: float = 4.0) -> Markov:
    """Models from counts (classes, CUBE) of characters in context and the numbers of strings.

    One is taken from each count of the ordinary class: it may be the asked string's own.
    Each order's distribution is the counts plus ``strength`` times that of the order
    below; order 0 adds one to each character.  The uniform class weighs one string.
    """
    cube = counts.reshape(CLASSES, SIZE, SIZE, SIZE)[..., 1:].astype(np.float64)
    cube[ORDINARY] = np.maximum(cube[ORDINARY] - 1, 0)
    pair = cube.sum(axis=1)
    single = pair.sum(axis=1)
    p0 = (single + 1) / (single.sum(axis=-1, keepdims=True) + SIZE - 1)
    p1 = (pair + strength * p0[:, None, :]) / (pair.sum(axis=-1, keepdims=True) + strength)
    p2 = (cube + strength * p1[:, None, :, :]) / (cube.sum(axis=-1, keepdims=True) + strength)
    table = np.zeros((CLASSES, SIZE, SIZE, SIZE), np.float32)
    table[..., 1:] = np.log(p2)
    shares = np.append(strings[:ORDINARY], 1).astype(np.float64)
    with np.errstate(divide="ignore"):
        weights = np.log(shares / shares.sum())
    return Markov(table.reshape(CLASSES, CUBE), weights, math.log(max(1, int(strings[ORDINARY])) / shares.sum()))


def fit(documents: DataFrame, *, text: str = "text", least: int = 16) -> Markov:
    """Learn from every whole text; counts of characters in context, bounded by the alphabet, meet on the driver."""
    prepare(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, strings = np.zeros((CLASSES, CUBE), np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            # texts are joined to fill chunks: the separators belong to no run and no pattern
            held: list[bytes] = []
            size = 0
            for data in utf8(batch.column(0)):
                held.append(data)
                size += len(data)
                if size >= CHUNK:
                    count_text(b"\0".join(held), counts, strings, least)
                    held, size = [], 0
            count_text(b"\0".join(held), counts, strings, least)
        flat = np.concatenate([counts.ravel(), strings])
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 10_000):
            some = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["at", "n"])

    totals = documents.select(F.col(text)).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(CLASSES * CUBE + CLASSES, np.int64)
    flat[totals["at"].to_numpy(np.int64)] = totals["n"]
    return train(flat[: CLASSES * CUBE].reshape(CLASSES, CUBE), flat[CLASSES * CUBE :])


def found_spans(data: bytes, model: Markov, least: int, odds: float) -> list[tuple[int, int, int]]:
    """(start, end, kind) in UTF-8: the patterns' spans and the model's, by start and kind."""
    runs = long_runs(data, min(least, _SHORTEST_RUN))
    base = base_spans(data, [r for r in runs if r[1] - r[0] >= _SHORTEST_RUN])
    wanted = model.prior + math.log(odds)
    added = [(a, b, 3) for a, b in free_parts(runs, base, least) if model.ratio(data[a:b]) >= wanted]
    return sorted([s[:3] for s in base] + added)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in UTF-8 as spans in code points; each stretch of the text is looked at once."""
    if data.isascii() or not spans:
        return spans
    at = sorted({p for s in spans for p in s[:2]})
    points, before, n = {}, 0, 0
    raw = np.frombuffer(data, np.uint8)
    for p in at:
        n += int(np.count_nonzero((raw[before:p] & 0xC0) != 0x80))
        points[p], before = n, p
    return [(points[a], points[b], k) for a, b, k in spans]


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(
    documents: DataFrame, model: Markov, *, key: str = "doc_id", text: str = "text", least: int = 16, odds: float = 1000.0
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov): a row per document.

    spans: kind:start:end in code points, end exclusive, by start, then kind (assign,
    access, hex, markov), comma-joined; base_sha256: SHA-256 in hex of the same text
    without markov, of the empty text if there are none.  Base spans are the patterns'
    matches, leftmost and not overlapping per kind; markov ones are runs of at least
    ``least`` identifier characters outside them that are random by the wanted odds.
    A null text is empty; null and repeated keys have their rows as any other.
    """
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch: pa.RecordBatch) -> dict[str, object]:
        each, base = [], []
        for data in utf8(batch.column(1)):
            spans = in_code_points(data, found_spans(data, shared.value, least, odds))
            each.append(spans)
            base.append([s for s in spans if s[2] < 3])
        kinds = [[s[2] for s in spans] for spans in each]
        return {
            "doc_id": batch.column(0),
            "base_sha256": [hashlib.sha256(_told(s).encode()).hexdigest() for s in base],
            "spans": [_told(s) for s in each],
        } | {f"n_{name}": [k.count(i) for k in kinds] for i, name in enumerate(KINDS)}

    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    )
    return map_arrow(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), per_batch, schema)
