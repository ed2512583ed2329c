"""Language identification by prediction by partial matching (PPM).

Each language gets a variable-order byte context tree (order 3 at most) whose
counts are frozen after training.  A byte costs ``-log2`` of its PPM-C
probability: in the longest known context it has ``count / (n + d)``, with n the
context's total and d its distinct successors; a byte not seen there costs the
escape ``d / (n + d)`` and is coded in the next shorter context, where the bytes that
were possible before are left out of n and d, down to a uniform code over the bytes
never seen.  So the costs in a context are those of a proper distribution.  The
language with the shortest code wins.

The code length of a byte is a function of the context node and the byte only,
so the trees of all languages are tabulated over one union tree and whole
batches are scored with array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sampled_per_class, utf8

ORDER = 3
UNKNOWN = "und"
#: Bytes of the frozen tables beyond which a fit is refused rather than shortened.
MODEL_BYTES = 1 << 30
_LETTER = regex.compile(r"\p{L}")
#: Bytes scored at once; a longer text is scored in several steps.
_STEP = 1 << 20


@dataclass(frozen=True)
class PpmModel:
    """Frozen trees of all languages.

    symbol: byte -> dense symbol, 0 for bytes never seen in training.
    steps: per depth, [node * symbols + symbol] -> node of the longer context, or
    the node itself where the union tree has no longer context.
    bits: [node * symbols + symbol, language] -> code length.
    """

    languages: list[str]
    symbol: np.ndarray
    steps: list[np.ndarray]
    bits: np.ndarray


def _windows(data: bytes) -> np.ndarray:
    """For each byte, it and its three predecessors as one number (0 before the start)."""
    a = np.zeros(len(data) + ORDER, dtype=np.uint32)
    a[ORDER:] = np.frombuffer(data, dtype=np.uint8)
    n = len(data)
    return (a[0:n] << np.uint32(24)) | (a[1 : n + 1] << np.uint32(16)) | (a[2 : n + 2] << np.uint32(8)) | a[3:]


def window_counts(training: DataFrame, text: str, label: str) -> DataFrame:
    """(label, window, n): how often each four-byte window occurs in each language."""

    def per_batch(batch):
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, data in zip(batch.column("label").to_pylist(), utf8(batch.column("text"))):
            for start in range(0, len(data), _STEP):
                before = min(start, ORDER)
                windows = _windows(data[start - before : start + _STEP])[before:]
                found.setdefault(name, []).append(np.unique(windows, return_counts=True))
        labels, windows, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, parts in found.items():
            labels += [name] * sum(len(w) for w, _ in parts)
            windows += [w.astype(np.int64) for w, _ in parts]
            counts += [n.astype(np.int64) for _, n in parts]
        return {"label": labels, "window": np.concatenate(windows), "n": np.concatenate(counts)}

    slim = training.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    parts = map_arrow(slim, per_batch, "label string, window long, n long")
    return parts.groupBy("label", "window").agg(F.sum("n").alias("n"))


def fit(
    training: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    max_docs_per_language: int = 400,
) -> PpmModel:
    """Train on about ``max_docs_per_language`` whole texts of each language.

    The sample is chosen by a hash of the key; all contexts of its texts are kept.
    Rows whose text or label is null are not used.
    """
    usable = training.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    sample = sampled_per_class(usable.select(key, text, label), label, key, max_docs_per_language)
    rows = window_counts(sample, text, label).toPandas()
    return build(rows["label"].to_numpy(), rows["window"].to_numpy(), rows["n"].to_numpy())


def build(labels: np.ndarray, windows: np.ndarray, counts: np.ndarray) -> PpmModel:
    """The tables of window counts (label, four-byte window, count)."""
    languages = sorted(set(labels.tolist()))
    lang = np.searchsorted(np.array(languages, dtype=object), labels) if languages else np.zeros(0, np.int64)
    width = max(1, len(languages))
    last = (windows & 0xFF).astype(np.int64)
    symbol = np.zeros(256, dtype=np.int64)
    seen = np.unique(last)
    seen = seen[seen > 0]
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    # symbols of the window, newest first; a context never holds symbol 0
    s = [symbol[(windows >> (8 * k)) & 0xFF].astype(np.int64) for k in range(ORDER + 1)]
    real = s[0] > 0

    # union tree, depth by depth: a context is its parent's and one byte before it
    node, inside = np.zeros(len(windows), dtype=np.int64), np.ones(len(windows), dtype=bool)
    total, starts, steps = 1, [0, 1], []
    parent = [np.zeros(1, dtype=np.int64)]
    visits = [(node[real], s[0][real], lang[real], counts[real])]
    for depth in range(1, ORDER + 1):
        inside &= s[depth] > 0
        codes, where = np.unique(node[inside] * size + s[depth][inside], return_inverse=True)
        step = np.repeat(np.arange(total, dtype=np.int32), size)
        step[codes] = total + np.arange(len(codes), dtype=np.int32)
        steps.append(step)
        parent.append(codes // size)
        node[inside] = total + where
        total += len(codes)
        starts.append(total)
        here = real & inside
        visits.append((node[here], s[0][here], lang[here], counts[here]))
        if total * size * width * 4 > MODEL_BYTES:
            raise ValueError("the tables are too large to broadcast: train on fewer texts a language")

    counted = np.zeros((total, size, width), dtype=np.float32)
    for n_at, s_at, l_at, c in visits:
        np.add.at(counted, (n_at, s_at, l_at), c)
    bits, escaped = np.zeros_like(counted), np.zeros_like(counted)
    with np.errstate(divide="ignore", invalid="ignore"):
        for depth in range(ORDER + 1):
            for start in range(starts[depth], starts[depth + 1], 1024):
                at = slice(start, min(start + 1024, starts[depth + 1]))
                c = counted[at]
                n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                if depth:
                    up = parent[depth][at.start - starts[depth] : at.stop - starts[depth]]
                    above = np.where(c > 0, 0, counted[up])
                    left, kinds = above.sum(axis=1, keepdims=True), (above > 0).sum(axis=1, keepdims=True)
                    further = np.where(kinds > 0, np.log2((left + kinds) / kinds), 0) + escaped[up]
                    escaped[at] = np.where(above > 0, np.log2((left + kinds) / above), further)
                else:
                    escaped[at] = np.log2(np.maximum(256 - d, 1))
                own = np.where(c > 0, np.log2((n + d) / c), np.log2((n + d) / d) + escaped[at])
                bits[at] = np.where(n > 0, own, bits[up] if depth else 8.0)
    return PpmModel(languages, symbol, steps, bits.reshape(total * size, width))


def code_lengths(model: PpmModel, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language."""
    size = int(model.symbol.max()) + 1
    out = np.zeros((len(texts), model.bits.shape[1]), dtype=np.float64)
    group: list[int] = []
    held = 0
    for i, data in enumerate(texts):
        if len(data) > _STEP:
            symbols = np.zeros(len(data) + ORDER, dtype=np.int64)
            symbols[ORDER:] = model.symbol[np.frombuffer(data, dtype=np.uint8)]
            for start in range(0, len(data), _STEP):
                part = symbols[start : min(start + _STEP, len(data)) + ORDER]
                out[i] += _bits(model, size, part).sum(axis=0, dtype=np.float64)
        elif data:
            group.append(i)
            held += len(data)
        if held >= _STEP or (i == len(texts) - 1 and group):
            _score_group(model, size, texts, group, out)
            group, held = [], 0
    if group:
        _score_group(model, size, texts, group, out)
    return out


def _score_group(model: PpmModel, size: int, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
    # three zero symbols before each text end every context at its start
    gap = bytes(ORDER)
    data = gap + gap.join(texts[i] for i in group)
    symbols = model.symbol[np.frombuffer(data, dtype=np.uint8)]
    lengths = np.array([len(texts[i]) for i in group])
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    # a NUL inside a text stands for an unseen byte; between texts the costs are left out
    costs = _bits(model, size, symbols)
    edges = np.empty(2 * len(group), dtype=np.int64)
    edges[0::2] = starts
    edges[1::2] = starts + lengths
    edges = edges[edges < len(costs)]
    sums = np.add.reduceat(costs, edges, axis=0, dtype=np.float64)
    out[group] = sums[0::2]


def _bits(model: PpmModel, size: int, symbols: np.ndarray) -> np.ndarray:
    """Costs of symbols[ORDER:] given the symbols before each."""
    n = len(symbols) - ORDER
    node = np.zeros(n, dtype=np.int64)
    for depth in range(1, ORDER + 1):
        node = model.steps[depth - 1][node * size + symbols[ORDER - depth : ORDER - depth + n]]
        node = node.astype(np.int64)
    return model.bits[node * size + symbols[ORDER:]]


def identify(
    documents: DataFrame, model: PpmModel, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, lang_pred, score, bits_per_byte) for every row.

    Null texts and texts without a letter give ``und`` with score 0; so does every
    text if no language was learned.  score is the winner's share of the posterior
    over the learned languages.  Equal code lengths go to the language that sorts
    first.  Only key and text are read, so other columns cannot clash.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch):
        frozen = shared.value
        raw = utf8(batch.column("text"))
        n = len(raw)
        names, scores, rates = [UNKNOWN] * n, [0.0] * n, [None] * n
        if frozen.languages:
            bits = code_lengths(frozen, raw)
            best = bits.argmin(axis=1)
            gap = np.exp2(-np.clip(bits - bits[np.arange(n), best][:, None], 0, 1000))
            share = 1 / gap.sum(axis=1)
            for i, data in enumerate(raw):
                if data and _LETTER.search(data.decode("utf-8", "replace")):
                    names[i], scores[i] = frozen.languages[best[i]], float(share[i])
                    rates[i] = float(bits[i, best[i]] / len(data))
        return {"key": batch.column("key"), "lang_pred": names, "score": scores, "bits_per_byte": rates}

    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    scored = map_arrow(slim, per_batch, f"key {kind}, lang_pred string, score double, bits_per_byte double")
    return scored.withColumnRenamed("key", key)
