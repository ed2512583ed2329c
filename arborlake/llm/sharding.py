"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 60-bit key hash.  A bucket splits
on one more bit only if it is over its byte limit, so a shard is the shortest
prefix whose documents fit.  The directory grows in rounds: a round sums bytes at
a depth that should do, rolls the sums up to all shorter prefixes, and only
buckets still too large at that depth enter the next, deeper round.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the key's MD5 digest."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftright(value, HASH_BITS - depth)


def shard_map(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int, bits_per_round: int = 8
) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_docs, fits) for every row.

    n_bytes: UTF-8 length of the text, null as 0.  shard: the bucket's prefix in
    binary digits, empty for the root.  Rows with the same key share all 60 bits and
    stay together; a bucket that still exceeds the limit at full depth (one document
    or one key that is larger) is a shard with fits = false.  A null key hashes as
    the empty string.  Only key and text are read.
    """
    spark = documents.sparkSession
    prepare(spark)
    slim = documents.select(
        F.col(key).alias("key"),
        key_hash(F.col(key)).alias("hash"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
    ).checkpoint()
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + bits_per_round // 2))
    rounds, shallow, open_docs = [], 0, slim
    while True:
        sums = open_docs.groupBy(_prefix(F.col("hash"), depth).alias("fine")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")
        )
        sums = sums.checkpoint()
        # buckets at or under the depth of the round before are known to be too large
        levels = sums.select(
            "fine", "bytes", "docs", F.explode(F.sequence(F.lit(shallow), F.lit(depth))).alias("depth")
        ).withColumn("prefix", F.expr(f"shiftright(fine, {depth} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")
        )
        fitting = buckets.where((F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS)).checkpoint()
        inside = fitting.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        shards = fitting.join(inside, ["depth", "prefix"], "left_anti").checkpoint()
        # fine rows look for their shard at the depths that have any: 61 numbers at most
        used = sorted(r[0] for r in shards.select("depth").distinct().collect())
        found = (
            sums.select("fine", F.explode(F.array(*map(F.lit, used))).alias("depth") if used else F.lit(-1).alias("depth"))
            .withColumn("prefix", F.expr(f"shiftright(fine, {depth} - depth)"))
            .join(shards, ["depth", "prefix"])
            .select("fine", F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias("bucket"), F.lit(depth).alias("round"))
            .checkpoint()
        )
        rounds.append((depth, found))
        if depth == HASH_BITS:
            break
        oversized = sums.join(found.select("fine"), "fine", "left_anti").select("fine").checkpoint()
        if oversized.isEmpty():
            break
        open_docs = open_docs.join(
            oversized, _prefix(open_docs["hash"], depth) == oversized["fine"], "left_semi"
        )
        shallow, depth = depth + 1, min(HASH_BITS, depth + bits_per_round)
    directory = reduce(DataFrame.unionByName, [found for _, found in rounds])
    places = F.explode(
        F.array(*[F.struct(F.lit(d).alias("round"), _prefix(F.col("hash"), d).alias("fine")) for d, _ in rounds])
    )
    placed = slim.select("key", "n_bytes", places.alias("place")).select("key", "n_bytes", "place.round", "place.fine")
    bucket = F.col("bucket")
    return placed.join(directory, ["round", "fine"]).select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(bucket["depth"] == 0, F.lit(""))
        .otherwise(F.expr("lpad(bin(bucket.prefix), bucket.depth, '0')"))
        .alias("shard"),
        bucket["depth"].cast("int").alias("depth"),
        bucket["shard_bytes"].alias("shard_bytes"),
        bucket["shard_docs"].alias("shard_docs"),
        (bucket["shard_bytes"] <= limit).alias("fits"),
    )


def write_shards(
    documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int
) -> DataFrame:
    """Write every row under ``path/shard=<prefix>`` (the root shard is ``root``) and return the shard map.

    A shard fits its limit, so dealing by shard gathers no more than that in a task.
    """
    shards = shard_map(documents, key=key, text=text, limit=limit).checkpoint()
    place = shards.select(
        F.col(key).alias("__k"), F.when(F.col("shard") == "", "root").otherwise(F.col("shard")).alias("shard")
    ).dropDuplicates()
    rows = documents.join(place, documents[key].eqNullSafe(place["__k"])).drop("__k")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
    return shards
