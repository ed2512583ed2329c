"""Packing documents into training sequences by order-preserving dynamic programming.

Documents keep their order; only the cuts between windows are chosen.  Candidate
cuts are document ends (free), sentence ends (a small penalty) and, in long
stretches without either, every few hundred tokens (a larger penalty).  A window
of L tokens costs window - L of padding, or nothing where L is a power of two.
Since padding is linear in L, the best earlier cut is the minimum of
cost + position over a sliding window, which a monotone queue gives; windows whose
length is a power of two are looked at apart.

Each task packs its own input split, block by block; nothing is shuffled.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
SENTENCE_PENALTY, CUT_PENALTY = 4, 64
#: Longest stretch without a candidate cut.
STRETCH = 256
#: Tokens packed at once; the last two windows of a block are packed again with the next.
BLOCK = 1 << 17
_REMEMBER, _KEY = 400_000, 48
# Fixed value: the split pattern of the word vocabulary.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for words of ASCII in lower case.
_ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Characters for which lower case, composition and splitting need no library.
_PLAIN_END = "ɐ"
#: What byte-level vocabularies write for the bytes that are not shown as themselves.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def _packed(ids: list[int]) -> bytes:
    """Unsigned 32-bit numbers, little-endian."""
    numbers = array("I", ids)
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers.tobytes()


class WordIds:
    """Token ids of whole texts under a vocabulary that drops white space, word by word.

    White space never joins what it parts in such a vocabulary, so a text's ids are
    its words' ids in a row; words are remembered while there is room.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        #: The model alone, for parts that normalisation and splitting leave as they are.
        self.model = self.tokenizer.model if steps[-1].get("type") == "ByteLevel" else None
        vocabulary = spec["model"]["vocab"]
        size = max([*vocabulary.values(), *[x["id"] for x in spec.get("added_tokens", ())], END]) + 1
        self.ends_sentence = np.zeros(size, dtype=bool)
        for piece, number in vocabulary.items():
            mark = piece.removesuffix("</w>")
            if piece != mark and mark and set(mark) & set(".!?") and not regex.search(r"[\p{L}\p{N}]", mark):
                self.ends_sentence[number] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if self.model is None:
                ids = self._encode(part)
            else:
                plain = part.isascii() and part.isprintable()  # bytes that are shown as themselves
                shown = part if plain else part.encode().decode("latin-1").translate(_SHOWN)
                ids = _packed([t.id for t in self.model.tokenize(shown)])
            if len(self.parts) < _REMEMBER and len(part) <= _KEY:
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if "<|" in word or not word.isascii() and max(word) >= _PLAIN_END:
            ids = self._encode(word)
        elif word.isascii():
            low = word.lower()
            ids = self._part(low) if low.isalpha() else b"".join(map(self._part, _ASCII_PRETOKEN.findall(low)))
        else:
            ids = b"".join(map(self._part, _PRETOKEN.findall(word.lower())))
        if len(self.words) < _REMEMBER and len(word) <= _KEY:
            self.words[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._encode(text)
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in text.split()])


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> tuple[list[int], int]:
    """Indices of the chosen cuts (the first and last candidate included) and the cost.

    ends: increasing candidate positions, neighbours at most ``window`` apart.  The
    cost is padding plus the penalties of the chosen cuts.
    """
    n = len(ends)
    pairs_at, pairs_from = [], []
    length = 1
    while length < window:
        where = np.searchsorted(ends, ends - length)
        hit = np.nonzero((ends[np.minimum(where, n - 1)] == ends - length))[0]
        pairs_at.append(hit)
        pairs_from.append(where[hit])
        length *= 2
    at = np.concatenate(pairs_at)
    order = np.argsort(at, kind="stable")
    exact_at, exact_from = at[order].tolist(), np.concatenate(pairs_from)[order].tolist()
    exact_at.append(n)
    position, penalty = ends.tolist(), penalties.tolist()
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque()  # cost + position, position, index
    push = queue.append
    push((position[0], position[0], 0))
    e = 0
    while exact_at[e] == 0:
        e += 1
    for j in range(1, n):
        p = position[j]
        low = p - window
        while queue[0][1] < low:
            queue.popleft()
        best, _, i = queue[0]
        best += window - p
        while exact_at[e] == j:
            if cost[exact_from[e]] < best:
                i = exact_from[e]
                best = cost[i]
            e += 1
        best += penalty[j]
        cost[j], back[j] = best, i
        best += p
        while queue and queue[-1][0] >= best:
            queue.pop()
        push((best, p, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1], cost[n - 1]


def candidates(
    lengths: np.ndarray, ends_sentence: np.ndarray, total: int, stretch: int = STRETCH
) -> tuple[np.ndarray, np.ndarray]:
    """Candidate positions and penalties of a run of tokens.

    lengths: of the document pieces in it; ends_sentence: positions after a sentence end.
    """
    documents = np.cumsum(lengths)
    known = np.unique(np.concatenate([[0], documents, ends_sentence]))
    gaps = np.diff(known)
    wide = np.nonzero(gaps > stretch)[0]
    filler = [np.arange(known[w] + stretch, known[w + 1], stretch) for w in wide]
    ends = np.unique(np.concatenate([known, *filler])) if filler else known
    penalties = np.full(len(ends), CUT_PENALTY, dtype=np.int64)
    penalties[np.searchsorted(ends, ends_sentence)] = SENTENCE_PENALTY
    penalties[np.searchsorted(ends, documents)] = 0
    penalties[0] = 0
    return ends, penalties


def _tail(length: int, window: int) -> list[int]:
    """The last window's parts: powers of two, if their cuts cost less than its padding."""
    parts = [1 << b for b in range(window.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if CUT_PENALTY * (len(parts) - 1) < window - length else [length]


class Packer:
    """Packs a stream of documents; ``out`` holds finished pieces column by column."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int, window: int = WINDOW, block: int = BLOCK) -> None:
        self.ends_sentence, self.window, self.block = ends_sentence, window, block
        self.sequence = first_sequence
        self.runs: list[bytes] = []
        self.pieces: list[tuple] = []  # key, tokens of the document, start in it, length
        self.held = 0
        self.out: list[tuple] = []

    def add(self, key: object, ids: bytes) -> None:
        tokens = len(ids) // 4
        self.runs.append(ids)
        self.pieces.append((key, tokens, 0, tokens))
        self.held += tokens
        if self.held >= self.block:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        if not self.held:
            return
        tokens = np.frombuffer(b"".join(self.runs), dtype="<u4")
        lengths = np.array([p[3] for p in self.pieces], dtype=np.int64)
        sentence = np.nonzero(self.ends_sentence[tokens])[0] + 1
        ends, penalties = candidates(lengths, sentence, len(tokens), min(STRETCH, self.window))
        chosen, _ = choose_cuts(ends, penalties, self.window)
        cuts = ends[chosen].tolist()
        if last:
            size = cuts[-1] - cuts[-2]
            for part in _tail(size, self.window)[:-1]:
                cuts.insert(-1, cuts[-2] + part)
        else:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        self._emit(tokens, cuts)

    def _emit(self, tokens: np.ndarray, cuts: list[int]) -> None:
        """Write the windows between cuts; keep what is beyond the last cut."""
        queue = deque(self.pieces)
        raw = memoryview(tokens.tobytes())
        crc = zlib.crc32
        at = 0
        for low, high in zip(cuts, cuts[1:]):
            offset = 0
            while low + offset < high:
                key, whole, start, length = queue.popleft()
                take = min(length, high - low - offset)
                if take < length:
                    queue.appendleft((key, whole, start + take, length - take))
                self.out.append(
                    (key, start, take, crc(raw[4 * at : 4 * (at + take)]), whole, self.sequence, offset)
                )
                at += take
                offset += take
            self.sequence += 1
        self.pieces = list(queue)
        self.runs = [bytes(raw[4 * at :])]
        self.held = len(tokens) - at


def pack(documents: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document is its token ids and the end id; null and empty texts are the end id
    alone.  Pieces of a sequence lie side by side from offset 0; every id is in one
    piece; repeated rows are packed as often as they come.  A sequence is padded to
    ``window`` unless its length is a power of two.  sequence_id holds the number of
    the input split in its upper bits.  vocabulary: path that every executor can open.
    Only key and text are read; an empty table gives no rows.
    """
    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        words = _word_ids(vocabulary)
        end = np.array([END], dtype="<u4").tobytes()
        packer = Packer(words.ends_sentence, TaskContext.get().partitionId() << 33, window)

        def done():
            columns = zip(*packer.out)
            batch = pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], schema=arrow)
            packer.out = []
            return batch

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(k, words.ids(t) + end if t else end)
            if len(packer.out) > 20_000:
                yield done()
        packer.flush(last=True)
        if packer.out:
            yield done()

    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)
