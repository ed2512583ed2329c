"""Mixing sources to target weights.

Words are summed per source; targets follow the sources' weights, each at most
``most`` times its source's size, the excess shared again by weight.  A document
is emitted floor(rate) times, plus one Bernoulli copy whose probability is the
rate's fraction, drawn from a hash of its key and a seed.  All of it is DataFrame
work: one pass for sizes, one row per source in between.

A single seed leaves a source as far from its target as chance does: with few or very
unequal documents by a tenth and more.  So ``seeds`` draws are summed per source in one
pass, and the one nearest the target is taken; ``seeds=1`` is the plain draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, if_small, prepare, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources sort by code point, null last, and take the weights in turn.  With
    ``level`` the common target per unit of weight, a source gets the lesser of
    level * weight and its cap; sources reach their caps in order of cap / weight,
    so running sums in that order give the level.  The windows span the sources
    (one row each), not the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn(
        "cap", F.col("source_size") * most
    )
    order = (F.col("cap") / F.col("weight")).alias("at")
    up_to = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("at", order)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything))
    )
    # without a level at or under its cap every source stops at its cap
    share = F.coalesce(F.col("final.level") * F.col("weight"), F.col("cap").cast("double"))
    return levels.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"))


def draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 digest of key and seed; four seeds share a digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.floor(seed / 4).cast("string")))
    return F.conv(F.substr(digest, (8 * (seed % 4) + 1).cast("int"), F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)


def source_rates(sized: DataFrame, weights: tuple[int, ...], most: int, seeds: int) -> DataFrame:
    """(s, source_size, target, whole, part, seed): one row per source of sized (key, source, size).

    whole and part are the floor and fraction of the rate; seed is the hash seed whose
    draw over the source's documents comes nearest to the target.
    """
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.select(
        F.col("source").alias("s"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")
    )
    # one row per source: broadcast where those are few, so that rows stay where they are; else
    # joined and written, so that Spark can split a hot source before it is summed
    aims, few = if_small(aims)
    rated = sized.join(aims, sized["source"].eqNullSafe(aims["s"])).drop("s")
    rated = rated if few else written(rated, "rated")
    extra = [F.sum(F.when(draw(F.col("key"), F.lit(i)) < F.col("part"), F.col("size")).otherwise(0)) for i in range(seeds)]
    tried = rated.groupBy("source").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.first("whole").alias("whole"),
        F.first("part").alias("part"),
        F.array(*extra).alias("extra"),
    )
    base = F.col("whole") * F.col("source_size")
    missed = F.transform("extra", lambda x, i: F.struct(F.abs(base + x - F.col("target")).alias("off"), i.alias("seed")))
    rates = tried.select(
        F.col("source").alias("s"), "source_size", "target", "whole", "part", F.array_min(missed)["seed"].alias("seed")
    )
    return if_small(rates)[0]


def _sized(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return written(
        documents.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
        ),
        "mix",
    )


def _copies(key: Column) -> Column:
    """floor(rate) copies and the Bernoulli one, from the columns whole, part and seed."""
    return (F.col("whole") + F.when(draw(key, F.col("seed")) < F.col("part"), 1).otherwise(0)).cast("long")


def plan(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seeds: int = 32,
) -> DataFrame:
    """(key, source, size, source_size, target, copies) for every row.

    size is the number of words of the text (null: 0).  A source without words has
    target 0 and no copies.  Rows that repeat a key draw alike; a null key draws as
    the empty string.  Only key, text and source are read; null is a source.
    """
    prepare(documents.sparkSession)
    sized = _sized(documents, key, text, source)
    rates = source_rates(sized, weights, most, seeds)
    return sized.join(rates, sized["source"].eqNullSafe(rates["s"])).select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        _copies(F.col("key")).alias("copies"),
    )


def mix(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seeds: int = 32,
) -> DataFrame:
    """The mixed documents: each row of the input as often as its plan says, same columns.

    Rows meet their source's rate where they are; no text is shuffled while sources
    are few enough to broadcast.
    """
    prepare(documents.sparkSession)
    rates = source_rates(_sized(documents, key, text, source), weights, most, seeds)
    columns = documents.columns
    plain = documents.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    own_key, own_source = F.col(f"__c{columns.index(key)}"), plain[f"__c{columns.index(source)}"]
    rated = plain.join(rates, own_source.eqNullSafe(rates["s"])).withColumn("__n", _copies(own_key))
    repeated = rated.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return repeated.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
