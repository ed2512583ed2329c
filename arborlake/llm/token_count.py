"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its UTF-8 bytes in a linked list.  A heap holds the ranks
of adjacent pairs; the lowest rank (leftmost on ties) is popped and merged until
no pair has a rank.  The count is the number of initial symbols minus the number
of merges; no token identifiers are produced.
"""

from __future__ import annotations

import functools
import json
import re
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Fixed value: the split pattern of byte-level vocabularies, with Unicode's own white space.
_PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A space beside other white space or at an end: only such texts need the careful split.
_IRREGULAR = re.compile(r" \s|\s |\A\s|\s\Z")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Entries a worker remembers, and the longest remembered key.
_REMEMBER, _KEY = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by their rule:
    visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class MergeRanks:
    """Merge table of a byte-level vocabulary file: pair of symbols -> rank, merged symbol."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = spec["model"]["vocab"]
        self.start = [number[c] for c in byte_symbols()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((number[left], number[right]), (rank, number[left + right]))
        self.specials = [x["content"] for x in spec.get("added_tokens", ())]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def count(self, data: bytes) -> int:
        """Symbols left after all merges."""
        symbols: list[int] = [self.start[b] for b in data]
        size = len(symbols)
        if size < 2:
            return size
        ranks = self.ranks
        get = ranks.get
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        left = symbols[0]
        for i in range(1, size):
            right = symbols[i]
            found = get((left, right))
            if found is not None:
                heap.append((found[0], i - 1, left, right))
            left = right
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= size or symbols[j] != b:
                continue  # one of the two has been merged since
            merged = ranks[a, b][1]
            symbols[i] = merged
            symbols[j] = -1
            k = after[i] = after[j]
            merges += 1
            if k < size:
                before[k] = i
                found = get((merged, symbols[k]))
                if found is not None:
                    heappush(heap, (found[0], i, merged, symbols[k]))
            h = before[i]
            if h >= 0:
                found = get((symbols[h], merged))
                if found is not None:
                    heappush(heap, (found[0], h, symbols[h], merged))
        return size - merges


class _Remembered(dict):
    """A dict that computes missing values and keeps them while there is room."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> int:
        value = self.compute(key)
        if len(self) < _REMEMBER and len(key) <= _KEY:
            self[key] = value
        return value


class Counter:
    """Counts the tokens of whole texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.merge = MergeRanks(path)
        self.pretokens = _Remembered(lambda s: self.merge.count(s.encode("utf-8", "surrogatepass")))
        self.words = _Remembered(lambda s: self._direct(" " + s))

    def _direct(self, piece: str) -> int:
        return sum(map(self.pretokens.__getitem__, _PRETOKEN.findall(piece)))

    def _segment(self, text: str) -> int:
        # A single space between two visible characters starts a pre-token of its own, so
        # the parts between such spaces are counted apart and remembered.
        parts = _LONE_SPACE.split(text) if _IRREGULAR.search(text) else text.split(" ")
        return self._direct(parts[0]) + sum(map(self.words.__getitem__, parts[1:]))

    def count(self, text: str) -> int:
        split = self.merge.split
        if split is None or not split.search(text):
            return self._segment(text) if text else 0
        parts = split.split(text)
        return len(parts) - 1 + sum(self._segment(p) for p in parts if p)


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    documents: DataFrame,
    vocabulary: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 512,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row, repeated rows included.

    vocabulary: path of a byte-level BPE file that every executor can open.  Null
    counts as the empty text: 0 bytes, 0 tokens.  A special token's string inside a
    text counts as one token.  Only key and text are read.
    """

    def per_batch(batch):
        count = _counter(vocabulary).count
        tokens = [count(x) if x else 0 for x in batch.column("text").to_pylist()]
        return {"key": batch.column("key"), "n_bytes": batch.column("n_bytes"), "n_tokens": tokens}

    slim = documents.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    kind = slim.schema["key"].dataType.simpleString()
    counted = map_arrow(slim, per_batch, f"key {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("key", key)
