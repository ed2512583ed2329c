"""Full text with positions: an index of weighted fields, cover density, phrases, proximity and fragments.

A word is a run of letters and digits, compared in lower case.  An element's fields are
laid one after another, so a position is unique in it and carries its field's weight.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fulltext import terms_of

_WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def positional(elements: DataFrame, fields: dict[str, float], key: str = "element_pk") -> DataFrame:
    """(token, element_pk, places): a row per word and element, places being (position, weight) in order.

    fields: columns with their weights, in the order in which they are laid; keys are unique.
    """
    def weighed(column: str, weight: float) -> Column:
        return F.transform(words(F.col(column)), lambda w: F.struct(F.lower(w).alias("token"), F.lit(float(weight)).alias("weight")))

    weighted = [weighed(c, weight) for c, weight in fields.items()]
    laid = elements.select(F.col(key).alias("element_pk"), F.posexplode(F.concat(*weighted)).alias("position", "word"))
    place = F.struct("position", F.col("word.weight").alias("weight"))
    return laid.groupBy(F.col("word.token").alias("token"), "element_pk").agg(F.sort_array(F.collect_list(place)).alias("places"))


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Write an index so that a search reads the buckets of its terms only."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)


def read_index(index: DataFrame, terms: list[str], buckets: int = 64) -> DataFrame:
    """The rows of a written index that a search for the terms needs: a partition and a row-group filter."""
    asked = terms_of(terms)
    numbers = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in asked]
    return index.where(F.col("bucket").isin(numbers) & F.col("token").isin(asked)).drop("bucket")


def _occurrences(index: DataFrame, asked: list[str]) -> DataFrame:
    """(element_pk, token, position, weight) of the asked words, placed by element."""
    wanted = index.where(F.col("token").isin(asked))
    return wanted.select("element_pk", "token", F.inline("places")).repartition("element_pk")


def covers(index: DataFrame, terms: list[str]) -> DataFrame:
    """(element_pk, begin, end, hits, density): the minimal covers of all terms.

    A cover holds every term and no shorter stretch of it does; hits counts the terms'
    occurrences in it.  density is the harmonic mean of their weights, divided by one
    more than the number of other words between them.
    """
    asked = terms_of(terms)
    if not asked:
        return index.select("element_pk", *[F.lit(0).alias(c) for c in ("begin", "end", "hits")], F.lit(0.0).alias("density")).where("false")
    order = Window.partitionBy("element_pk").orderBy("position")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (
        _occurrences(index, asked)
        .withColumn("nth", F.row_number().over(order))
        .withColumn("inverse", F.sum(1 / F.col("weight")).over(so_far))
        .withColumn("here", F.struct("position", "nth", (F.col("inverse") - 1 / F.col("weight")).alias("before")))
    )
    # the latest place of each term up to here; a cover that ends here begins at the earliest of those
    latest = [F.max(F.when(F.col("token") == t, F.col("here"))).over(so_far) for t in asked]
    placed = counted.withColumn("latest", F.array(*latest))
    first = F.when(F.forall("latest", lambda p: p.isNotNull()), F.array_min("latest"))
    ended = placed.withColumn("first", first)
    ended = ended.withColumn("earlier", F.lag("first.position").over(order))
    minimal = ended.where(F.col("first").isNotNull() & (F.col("earlier").isNull() | (F.col("earlier") < F.col("first.position"))))
    hits = F.col("nth") - F.col("first.nth") + 1
    others = F.col("position") - F.col("first.position") + 1 - hits
    return minimal.select(
        "element_pk",
        F.col("first.position").alias("begin"),
        F.col("position").alias("end"),
        hits.alias("hits"),
        (hits / (F.col("inverse") - F.col("first.before")) / (1 + others)).alias("density"),
    )


def cover_density(index: DataFrame, terms: list[str]) -> DataFrame:
    """(element_pk, text_score): elements that hold all terms, by the sum of their covers' densities.

    What is shuffled, once and by element, are the places of the terms asked for.
    """
    return covers(index, terms).groupBy("element_pk").agg(F.sum("density").alias("text_score"))


def near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(element_pk, begin, end): elements where all terms stand within so many words, with the first of the shortest covers."""
    shortest = F.min(F.struct((F.col("end") - F.col("begin")).alias("span"), "begin"))
    found = covers(index, terms).where(F.col("end") - F.col("begin") < within).groupBy("element_pk").agg(shortest.alias("s"))
    return found.select("element_pk", F.col("s.begin").alias("begin"), (F.col("s.begin") + F.col("s.span")).alias("end"))


def phrase(index: DataFrame, text: str) -> DataFrame:
    """(element_pk, begins): elements where the words of the text follow one another, with the positions where they start."""
    asked = terms_in_order(text)
    if not asked:
        return index.select("element_pk", F.array(F.lit(0)).alias("begins")).where("false")
    offsets = F.create_map(*[x for t in dict.fromkeys(asked) for x in (F.lit(t), F.array(*[F.lit(i) for i, a in enumerate(asked) if a == t]))])
    starts = _occurrences(index, asked).select("element_pk", "position", F.explode(F.element_at(offsets, F.col("token"))).alias("offset"))
    whole = starts.groupBy("element_pk", (F.col("position") - F.col("offset")).alias("begin")).agg(F.count(F.lit(1)).alias("n"))
    return whole.where(F.col("n") == len(asked)).groupBy("element_pk").agg(F.sort_array(F.collect_list("begin")).alias("begins"))


def terms_in_order(text: str) -> list[str]:
    """The words of a phrase, repeated ones too."""
    return [w.lower() for w in regex.findall(_WORD, text)]


def fragments(
    text: Column, terms: list[str], *, most: int = 50, least: int = 10, count: int = 2, before: str = "<b>", after: str = "</b>", between: str = " ... "
) -> Column:
    """The best stretches of a text that hold terms, at most ``count``, of ``least`` to ``most`` words each, in the text's order.

    Each occurrence of a term starts a stretch that ends with the last one among its next
    ``most`` words, widened on both sides to ``least`` words.  Better is one with more
    distinct terms, then more occurrences, then fewer words, then the earlier; a stretch
    that overlaps a better one is left out.  A text without any term gives its first
    ``least`` words.  Every step is an expression over the row: a stretch holds at most
    ``most`` occurrences, so the work is linear in the text.
    """
    asked = F.array(*map(F.lit, terms_of(terms))) if terms_of(terms) else F.array().cast("array<string>")
    # each word with what follows it, so that the text can be put together again
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD + r"[^\p{L}\p{N}]*"), F.lit(0))
    bare = lambda p: F.regexp_extract(p, _WORD, 0)

    # transform over an array of one binds a value that is read several times
    once = lambda value, f: F.transform(F.array(value), f)[0]

    def described(held: Column) -> Column:
        return F.struct(
            (-F.size(F.array_distinct(held["token"]))).alias("distinct"),
            (-F.size(held)).alias("occurrences"),
            (F.element_at(held, -1)["at"] - held[0]["at"] + 1).alias("length"),
            held[0]["at"].alias("start"),
        )

    def chosen(pieces: Column, hits: Column) -> Column:
        n = F.size(pieces)
        ends = F.transform(hits, lambda h, i: once(F.filter(F.slice(hits, i + 1, F.lit(most)), lambda x: x["at"] - h["at"] < most), described))

        def widened(e: Column) -> Column:
            length = F.greatest(e["length"], F.lit(least))
            start = F.greatest(e["start"] - F.floor((length - e["length"]) / 2), F.lit(0))
            end = F.least(start + length, n)
            return F.struct(F.greatest(end - length, F.lit(0)).cast("int").alias("start"), end.cast("int").alias("end"))

        best = F.transform(F.array_sort(ends), widened)
        none = F.array().cast("array<struct<start:int,end:int>>")

        def take(kept: Column, e: Column) -> Column:
            overlaps = F.exists(kept, lambda k: (k["start"] < e["end"]) & (e["start"] < k["end"]))
            return F.when((F.size(kept) < count) & ~overlaps, F.concat(kept, F.array(e))).otherwise(kept)

        first = F.array(F.struct(F.lit(0).alias("start"), F.least(F.lit(least), n).cast("int").alias("end")))
        return once(F.array_sort(F.aggregate(best, none, take)), lambda found: F.when(F.size(found) == 0, first).otherwise(found))

    def shown(pieces: Column, e: Column) -> Column:
        def mark(p: Column) -> Column:
            w = bare(p)
            return F.when(F.array_contains(asked, F.lower(w)), F.concat(F.lit(before), w, F.lit(after), F.substring(p, F.length(w) + 1, F.length(p)))).otherwise(p)

        said = F.transform(F.slice(pieces, e["start"] + 1, e["end"] - e["start"]), mark)
        last = bare(F.element_at(pieces, e["end"]))
        closed = F.when(F.array_contains(asked, F.lower(last)), F.concat(F.lit(before), last, F.lit(after))).otherwise(last)
        return F.concat(F.array_join(F.slice(said, 1, F.size(said) - 1), ""), closed)

    def whole(pieces: Column) -> Column:
        marked = F.transform(pieces, lambda p, i: F.struct(i.alias("at"), F.lower(bare(p)).alias("token")))
        hits = F.filter(marked, lambda m: F.array_contains(asked, m["token"]))
        stretches = once(hits, lambda h: chosen(pieces, h))
        return F.when(F.size(pieces) == 0, F.lit("")).otherwise(F.array_join(F.transform(stretches, lambda e: shown(pieces, e)), between))

    return once(pieces, whole)
