"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors of its hash and of the hashes of
its character 3- to 5-grams; a word bigram's is that of its hash; a document's is the
mean over its words and bigrams, and a softmax layer scores it.  Training is numpy
stochastic gradient descent in one task over a bounded, hash-chosen sample of labelled
rows.  The model is linear after averaging, so scoring needs one number per bucket and
looks each word up once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sampled_per_class, utf8

_REMEMBER, _KEY = 200_000, 48


@dataclass(frozen=True)
class QualityModel:
    """weight: logit of label 1 against label 0 that each bucket adds; bias: of the softmax layer."""

    weight: np.ndarray
    bias: float
    shortest: int
    longest: int


def subwords(word: bytes, buckets: int, shortest: int, longest: int) -> list[int]:
    """Buckets of a word: itself and the n-grams of <word>."""
    crc = zlib.crc32
    out = [crc(word, 1) % buckets]
    marked = b"<" + word + b">"
    size = len(marked)
    for n in range(shortest, min(longest, size) + 1):
        out += [crc(marked[i : i + n]) % buckets for i in range(size - n + 1)]
    return out


def bigrams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the word bigrams of a sequence of word hashes."""
    both = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    return (((both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64) % buckets


def features(text: bytes, buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the weight of each in its average vector."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    pairs = bigrams(np.array([zlib.crc32(w) for w in words], np.uint64), buckets)
    total = len(words) + len(pairs)
    ids = [pairs]
    shares = [np.full(len(pairs), 1 / total)]
    for word, n in Counter(words).items():
        own = subwords(word, buckets, shortest, longest)
        ids.append(own)
        shares.append(np.full(len(own), n / (total * len(own))))
    unique, where = np.unique(np.concatenate(ids).astype(np.int64), return_inverse=True)
    return unique, np.bincount(where, weights=np.concatenate(shares)).astype(np.float32)


def gradients(
    rows: np.ndarray, share: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: int, weight: float
) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted cross entropy of a document with these bucket vectors, and its gradients by rows, layer and bias."""
    hidden = share @ rows
    logits = hidden @ layer + bias
    odds = np.exp(logits - logits.max())
    error = odds / odds.sum()
    loss = -weight * float(np.log(error[label]))
    error[label] -= 1
    error *= weight
    return loss, np.outer(share, layer @ error), np.outer(hidden, error), error


def train(
    texts: list[bytes],
    labels: list[int],
    *,
    buckets: int,
    dims: int,
    epochs: int,
    rate: float,
    favour: float,
    shortest: int,
    longest: int,
) -> QualityModel:
    """favour: weight of an error on label 1 against one on label 0.

    Each document is one step along the negative gradient of its loss.  The step size
    falls linearly; for the bucket vectors it is divided by the square of the document's
    weights (as in normalised least mean squares), as otherwise the vectors of long
    documents, whose weights are small, would hardly move; the bias takes a tenth.
    """
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
    layer = np.zeros((dims, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    bags = [features(t, buckets, shortest, longest) for t in texts]
    steps, done = epochs * len(bags), 0
    weight = (1.0, favour)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            if not len(ids):
                continue
            lr = rate * (1 - done / steps)
            done += 1
            rows = vectors[ids]
            _, by_rows, by_layer, by_bias = gradients(rows, share, layer, bias, labels[i], weight[labels[i]])
            layer -= lr * by_layer
            bias -= lr * 0.1 * by_bias
            vectors[ids] = rows - (lr / (share @ share)) * by_rows
    return QualityModel(
        (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]), shortest, longest
    )


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_docs_per_class: int = 2000,
    buckets: int = 1 << 16,
    dims: int = 12,
    epochs: int = 4,
    rate: float = 0.2,
    favour: float = 2.0,
    shortest: int = 3,
    longest: int = 5,
) -> QualityModel | None:
    """Train on about ``max_docs_per_class`` labelled whole texts of each class.

    Rows with a null key, text or label, and labels other than 0 and 1, are not
    used.  Returns None when a class has no rows.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    chosen = sampled_per_class(known, "__label", "__key", max_docs_per_class).dropDuplicates()
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    # chosen holds about two times max_docs_per_class keys, whatever the size of the input
    # and only these rows, not the scan, meet in one task
    sample = texts.join(F.broadcast(chosen), "__key").select("__key", "__label", "__text").repartition(1)

    def fitted(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)))
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1], r[2]))
        if len({r[1] for r in rows}) == 2:
            model = train(
                [r[2] for r in rows],
                [int(r[1]) for r in rows],
                buckets=buckets,
                dims=dims,
                epochs=epochs,
                rate=rate,
                favour=favour,
                shortest=shortest,
                longest=longest,
            )
            yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()], "bias": [model.bias]})

    row = sample.mapInArrow(fitted, "weight binary, bias double").first()
    if row is None:
        return None
    return QualityModel(np.frombuffer(bytes(row["weight"]), dtype=np.float32), row["bias"], shortest, longest)


class _WordLogits(dict):
    """Mean bucket weight and hash of each word, remembered while there is room."""

    def __init__(self, model: QualityModel) -> None:
        super().__init__()
        self.model = model
        self.weight = model.weight.astype(float).tolist()

    def __missing__(self, word: bytes) -> tuple[float, int]:
        weight, model = self.weight, self.model
        own = subwords(word, len(weight), model.shortest, model.longest)
        value = sum([weight[i] for i in own]) / len(own), zlib.crc32(word)
        if len(self) < _REMEMBER and len(word) <= _KEY:
            self[word] = value
        return value


_words: dict[int, _WordLogits] = {}


def _word_logits(model: QualityModel) -> _WordLogits:
    """One memory of words per model and worker."""
    mark = zlib.crc32(model.weight.tobytes())
    if mark not in _words:
        _words.clear()
        _words[mark] = _WordLogits(model)
    return _words[mark]


def score_text(model: QualityModel, text: bytes) -> float:
    return _scores(model, [text])[0]


def _scores(model: QualityModel, texts: list[bytes]) -> list[float]:
    known = _word_logits(model).__getitem__
    out = []
    for text in texts:
        words = text.split()
        if not words:
            out.append(0.0)
            continue
        logits, hashes = zip(*map(known, words))
        pairs = bigrams(np.array(hashes, np.uint64), len(model.weight))
        z = (sum(logits) + float(model.weight[pairs].sum(dtype=np.float64))) / (len(words) + len(pairs)) + model.bias
        out.append(float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))))
    return out


def score(
    documents: DataFrame,
    model: QualityModel | None,
    *,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.7,
    keep: list[str] | None = None,
) -> DataFrame:
    """(key, other kept columns, score, predicted) for every row, repeated rows included.

    score is the probability of label 1; predicted is 1 where it reaches the
    threshold.  Texts that are null or without words score 0.  Without a model
    (nothing to learn from) every text with words scores 1, so a filter keeps it.
    ``keep`` names further columns to carry along; no other column is read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    carried = keep or []

    def per_batch(batch):
        texts = utf8(batch.column("__text"))
        frozen = shared.value
        values = [float(bool(t.split())) for t in texts] if frozen is None else _scores(frozen, texts)
        return {name: batch.column(name) for name in names} | {"__score": values}

    slim = documents.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carried)], F.col(text).alias("__text"))
    names = [c for c in slim.columns if c != "__text"]
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in names)
    scored = map_arrow(slim, per_batch, f"{schema}, __score double")
    return scored.select(
        F.col("__key").alias(key),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)],
        F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )
