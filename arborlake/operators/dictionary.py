"""Terms of a dictionary found in texts: all lists, types and lengths in one pass and one join.

Texts and terms are compared as sequences of lower-case words.  Every stretch of a text
that has as many words as some term meets the dictionary by equality, so the dictionary
may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_scratch
from .positions import words

#: Terms up to which the dictionary is sent to all tasks, after it was counted, and the words of a term then.
_SENT_TERMS, _SENT_WORDS = 50_000, 400_000


def normal(term: Column) -> Column:
    """A term's words in lower case, with one space between them."""
    return F.lower(F.array_join(words(term), " "))


def matches(elements: DataFrame, terms: DataFrame, key: str = "element_pk", text: str = "text", longest: bool = True) -> DataFrame:
    """(key, entity_type, term, begin, n_words, raw): where the terms (term, entity_type) stand in the texts.

    begin: the first word's number, from 0; raw: the words as the text has them.  With
    ``longest`` a match inside a longer one of the same element is left out, whatever
    their types.  Terms without words are nowhere; a term that repeats counts once.
    """
    shared_scratch(elements.sparkSession)
    listed = terms.select(normal(F.col("term")).alias("term"), "entity_type").where("term <> ''").distinct().checkpoint()
    size = F.size(F.split("term", " "))
    counted = listed.groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("terms")).orderBy("n").collect()  # a row per length
    lengths = [r["n"] for r in counted]
    small = sum(r["terms"] for r in counted) <= _SENT_TERMS and sum(r["n"] * r["terms"] for r in counted) <= _SENT_WORDS
    if small:
        return _walked(elements, listed.collect(), key, text, longest)
    split = elements.select(F.col(key).alias("__key"), words(F.col(text)).alias("__words"))
    said = split.withColumn("__low", F.transform("__words", F.lower))

    def of_length(n: int) -> Column:
        at = F.when(F.size("__low") >= n, F.sequence(F.lit(0), F.size("__low") - n)).otherwise(F.array().cast("array<int>"))
        part = lambda of, i: F.array_join(F.slice(of, i + 1, n), " ")
        return F.transform(at, lambda i: F.struct(i.alias("begin"), F.lit(n).alias("n_words"), part("__low", i).alias("term"), part("__words", i).alias("raw")))

    if not lengths:
        stretches = said.select("__key", F.inline(of_length(1))).where("false")
    else:
        stretches = said.select("__key", F.inline(F.flatten(F.array(*map(of_length, lengths)))))
    found = stretches.join(listed, "term")
    if longest:
        # a match lies inside a longer one if an earlier start, or the same start and a later end, reaches its end
        end = F.col("begin") + F.col("n_words")
        place = Window.partitionBy("__key").orderBy("begin", F.desc("n_words"))
        before = F.max(end).over(place.rowsBetween(Window.unboundedPreceding, -1))
        places = found.select("__key", "begin", "n_words").distinct().withColumn("__reached", before)
        outer = places.where(F.col("__reached").isNull() | (F.col("__reached") < end)).select("__key", "begin", "n_words")
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("__key", "begin", "n_words")]
        found = found.alias("f").join(outer.alias("o"), same, "left_semi")
    return found.select(F.col("__key").alias(key), "entity_type", "term", "begin", "n_words", "raw")


def _walked(elements: DataFrame, listed: list, key: str, text: str, longest: bool) -> DataFrame:
    """The same for a small dictionary: each text's words are looked up once, nothing is shuffled."""
    # by first word: the lengths to try, longest first
    types: dict[str, list[str]] = {}
    tries: dict[str, list[int]] = {}
    for term, kind in listed:
        types.setdefault(term, []).append(kind)
        first, n = term.split(" ", 1)[0], term.count(" ") + 1
        if n not in tries.setdefault(first, []):
            tries[first].append(n)
    for lengths in tries.values():
        lengths.sort(reverse=True)
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]+", " "))
    rows = elements.select(F.col(key).alias("key"), spaced.alias("raw")).where("raw <> ''").withColumn("low", F.lower("raw"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, entity_type string, term string, begin int, n_words int, raw string"

    def hits(raw: str, low: str) -> Iterator[tuple]:
        said, word = None, low.split(" ")
        reached, whole = 0, len(word)
        for i, first in enumerate(word):
            lengths = tries.get(first)
            if lengths is None:
                continue
            for n in lengths:
                end = i + n
                if end > whole or (longest and end <= reached):
                    continue
                term = first if n == 1 else " ".join(word[i:end])
                of = types.get(term)
                if of is None:
                    continue
                # what starts here or later and ends by then lies inside this one
                reached = max(reached, end)
                said = said or raw.split(" ")
                there = said[i] if n == 1 else " ".join(said[i:end])
                for t in of:
                    yield t, term, i, n, there

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, out = batch.column("key"), [], []
            for i, (raw, low) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("low").to_pylist())):
                out.extend(hits(raw, low))
                at.extend([i] * (len(out) - len(at)))
                if len(out) >= 50_000 or i == len(own) - 1 and out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(at, pa.int64())), *columns], names=["key", "entity_type", "term", "begin", "n_words", "raw"])
                    at, out = [], []

    return rows.mapInArrow(find, schema).withColumnRenamed("key", key)
