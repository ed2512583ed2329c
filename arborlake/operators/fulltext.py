"""Full-text search over a postings table: BM25 with all query terms required."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_scratch

# The usual BM25 constants.
K1, B = 1.2, 0.75


_SPLIT = r"[^\p{L}\p{N}]+"


def terms_of(words: list[str]) -> list[str]:
    """The distinct tokens of query words, split and lowered as the index is: ``U.S.`` asks for u and s."""
    found = [t for w in words for t in regex.split(r"[^\p{L}\p{N}]+", w.lower()) if t]
    return list(dict.fromkeys(found))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda t: t != "")


def postings(elements: DataFrame, key: str = "element_pk", text: str = "text") -> DataFrame:
    """(token, element_pk, length, tf): one row per token and element; elements of one key and length count as one.

    Spark splits the texts, which are shuffled by key and counted element by element; tokens are not shuffled.
    """
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPLIT, " "))
    split = elements.select(F.col(key).alias("element_pk"), spaced.alias("tokens")).where("tokens <> ''")
    gaps = F.length("tokens") - F.length(F.replace("tokens", F.lit(" "), F.lit("")))
    sized = split.select("element_pk", (gaps + 1).alias("length"), "tokens")
    kind = sized.schema["element_pk"].dataType.simpleString()
    names = ["token", "element_pk", "length", "tf"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        found: Counter = Counter()
        out: tuple[list, list, list, list] = ([], [], [], [])
        kinds = None

        def close() -> None:
            n = len(found)
            for column, values in zip(out, (found, [own[0]] * n, [own[1]] * n, found.values())):
                column.extend(values)

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            kinds = (pa.string(), batch.column(0).type, pa.int32(), pa.int64())
            for pk, length, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if own != (pk, length):
                    if own is not None:
                        close()
                    own, found = (pk, length), Counter()
                    if len(out[0]) >= 100_000:
                        yield flushed()
                found.update(text.split(" "))
        if own is not None:
            close()
            yield flushed()

    laid = sized.repartition("element_pk").sortWithinPartitions("element_pk", "length")
    return laid.mapInArrow(count, f"token string, element_pk {kind}, length int, tf long")


def index_statistics(elements: DataFrame, text: str = "text") -> DataFrame:
    """One row (docs, mean_length), to be written beside the postings when they are built."""
    return elements.select(F.size(tokens(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean_length"))


def bm25(index: DataFrame, statistics: DataFrame, terms: list[str], require_all: bool = True) -> DataFrame:
    """(element_pk, text_score) of the elements that hold all (or any) terms; texts are not read again.

    statistics: the one row of index_statistics.
    """
    asked = terms_of(terms)
    wanted = index.where(F.col("token").isin(asked))
    sizes = statistics
    spread = wanted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    # sizes is one row, spread one row per term
    scored = wanted.join(F.broadcast(spread.crossJoin(sizes)), "token")
    found = scored.groupBy("element_pk").agg(F.sum(idf * tf).alias("text_score"), F.count(F.lit(1)).alias("n"))
    need = len(asked) if require_all else 1
    return found.where(F.col("n") >= need).drop("n")


def bm25_scan(elements: DataFrame, terms: list[str], key: str = "element_pk", text: str = "text", require_all: bool = True) -> DataFrame:
    """The result of bm25 without an index: texts are read and split once, into their length and the counts of the terms.

    What is kept per element is one number a term; only the totals come to the driver.
    """
    shared_scratch(elements.sparkSession)
    asked = terms_of(terms)
    split = elements.select(F.col(key).alias("element_pk"), tokens(F.col(text)).alias("tokens"))
    wanted = F.array(*map(F.lit, asked))
    counted = split.select(
        "element_pk", F.size("tokens").alias("length"), F.transform(wanted, lambda a: F.size(F.filter("tokens", lambda t: t == a))).alias("tf")
    ).checkpoint()
    totals = counted.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(asked))]
    ).first()
    held, score = F.lit(0), F.lit(0.0)
    for i in range(len(asked)):
        tf, df = F.col("tf")[i], totals[f"df{i}"]
        idf = math.log(1 + (totals["docs"] - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col("length") / (totals["mean"] or 1.0))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
        held = held + (tf > 0).cast("int")
    found = counted.where(held >= (len(asked) if require_all else 1)).where(held > 0)
    return found.select("element_pk", score.alias("text_score"))


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Whole-word occurrences of the terms between marks, without regard to case."""
    words = "|".join(map(re.escape, sorted(terms, key=len, reverse=True)))
    safe = [m.replace("\\", "\\\\").replace("$", "\\$") for m in (before, after)]
    return F.regexp_replace(text, rf"(?i)(?<!\w)({words})(?!\w)", f"{safe[0]}$1{safe[1]}")
