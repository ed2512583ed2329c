"""Continuous ingest: the work queue as streams, retries with growing delays, windowed metrics.

Claims, leases and workers of a queue are Spark's own task scheduling; what remains is
deciding what is new, what is retried when, and how the queue is doing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Retries before a document fails, seconds of the first delay.
MAX_RETRIES, FIRST_DELAY = 3, 60


def run_id(config: dict) -> str:
    """16 hexadecimal digits that name a configuration."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def delay_seconds(retries: Column) -> Column:
    """Seconds until the next try after that many failures: 60, 120, 240 and so on."""
    return (F.lit(FIRST_DELAY) * F.pow(F.lit(2.0), retries)).cast("long")


def after_failure(failed: DataFrame) -> DataFrame:
    """Failed rows (retries, created_at) with status retry and next_attempt_at, or failed for good."""
    again = F.col("retries") < MAX_RETRIES
    due = F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + delay_seconds(F.col("retries")) * 1_000_000)
    return failed.withColumn("next_attempt_at", F.when(again, due.cast("timestamp_ntz"))).withColumn(
        "status", F.when(again, "retry").otherwise("failed")
    )


def claimable(queue: DataFrame, now: Column, stale_seconds: int = 300) -> DataFrame:
    """Pending rows, due retries and stale claims, in claim order: priority, then age."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    due = (
        (F.col("status") == "pending")
        | ((F.col("status") == "retry") & (F.col("next_attempt_at") <= now))
        | ((F.col("status") == "processing") & (age > stale_seconds))
    )
    return queue.where(due).orderBy(F.desc("priority"), "created_at", "queue_id")


def enqueue(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (run_id, source_id): the least link depth of old and new rows, the first status known."""
    both = queue.select("run_id", "source_id", "link_depth", "status", F.lit(0).alias("__new")).union(
        incoming.select("run_id", "source_id", "link_depth", F.lit("pending").alias("status"), F.lit(1).alias("__new"))
    )
    return both.groupBy("run_id", "source_id").agg(
        F.min("link_depth").alias("link_depth"), F.min_by("status", F.struct("__new", "status")).alias("status")
    )


def claim_order(queue: DataFrame) -> DataFrame:
    """The first claimable row of each run."""
    w = Window.partitionBy("run_id").orderBy(F.desc("priority"), "created_at", "queue_id")
    return queue.where("status = 'pending'").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def advice(reason: Column) -> Column:
    """What to do about a failure, from words in its reason."""
    low = F.lower(reason)
    return (
        F.when(low.rlike("timeout|timed out"), "raise the time limit or split the document")
        .when(low.rlike("permission|denied|forbidden|401|403"), "check the credentials")
        .when(low.rlike("not found|404|no such"), "remove the source or mend its path")
        .when(low.rlike("memory"), "split the document")
        .when(low.rlike("parse|decode|encoding|syntax"), "check the file's format")
        .otherwise("look at the log")
    )


def events_stream(spark: SparkSession, sf_dir: str, files: str = "events.parquet") -> DataFrame:
    """The events files of a folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(sf_dir)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, total): counts per window; rows later than ``late`` are left out by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    ).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet below a shared folder, and read the result."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def ingest(stream: DataFrame, path: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Process each micro-batch and append it under its batch number, so that a repeated batch overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def failure_state(events: DataFrame) -> DataFrame:
    """(source_id, failures, status, delay): retry state of every source after each batch of (source_id, ok).

    A success clears the state; the fourth failure in a row is final.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for batch in batches:
            for ok in batch.sort_values("at")["ok"]:
                failures = 0 if ok else failures + 1
        state.update((failures,))
        status = "ok" if failures == 0 else "retry" if failures <= MAX_RETRIES else "failed"
        delay = FIRST_DELAY * 2 ** (failures - 1) if status == "retry" else 0
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "status": [status], "delay": [delay]})

    return events.groupBy("source_id").applyInPandasWithState(
        step, "source_id long, failures int, status string, delay long", "failures int", "update", "NoTimeout"
    )


# Kinds of failures and the words that tell them.
FAILURES = {
    "timeout": ["timeout", "timed out"],
    "connection": ["connection", "network", "unreachable"],
    "permission": ["permission", "forbidden", "unauthorized", "access denied"],
    "not_found": ["not found", "no such file", "404"],
    "memory": ["out of memory", "memoryerror"],
    "parse": ["parse", "invalid", "malformed", "decode"],
}


def failure_kind(message: Column) -> Column:
    """The first kind whose words the message holds, else unknown."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for kind, words in reversed(FAILURES.items()):
        out = F.when(low.rlike("|".join(words)), kind).otherwise(out)
    return out


def is_transient(message: Column) -> Column:
    """Whether another attempt may help."""
    return failure_kind(message).isin("timeout", "connection", "memory", "unknown")


def dead_letters(failed: DataFrame, most: int = 3) -> DataFrame:
    """Failed rows that go to the dead letters: those with ``most`` retries, and those that another attempt cannot help."""
    return failed.where((F.col("retries") >= most) | ~is_transient(F.col("reason"))).withColumn("kind", failure_kind(F.col("reason")))


def revived(dead: DataFrame, chosen: DataFrame, key: str = "queue_id") -> tuple[DataFrame, DataFrame]:
    """(dead letters left, rows to enqueue again): chosen keys return as pending with no retries."""
    back = dead.join(chosen.select(key).distinct(), key, "left_semi")
    again = back.withColumns({"status": F.lit("pending"), "retries": F.lit(0)}).drop("kind")
    return dead.join(chosen.select(key).distinct(), key, "left_anti"), again


def purged(dead: DataFrame, before: Column, at: str = "created_at") -> DataFrame:
    """Dead letters without those older than ``before``."""
    return dead.where(F.col(at) >= before)


def dependencies(links: DataFrame) -> DataFrame:
    """(source_id, target_id, link_depth): one edge per document and linked document, at the least depth found."""
    return links.where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.min("link_depth").alias("link_depth"))
