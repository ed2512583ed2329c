"""Statistics over documents, elements, dates, topics, terms and queue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal


def date_basics(dates: DataFrame) -> DataFrame:
    """elements, extractions, earliest and latest ISO string of rows (element_pk, ts); one row."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return dates.where("ts IS NOT NULL").agg(
        F.count_distinct("element_pk").alias("elements_with_dates"),
        F.count(F.lit(1)).alias("total_extractions"),
        F.min(iso).alias("earliest_date"),
        F.max(iso).alias("latest_date"),
    )


def distribution(dates: DataFrame, name: str, value: Column, distinct: bool = True, top: int | None = None) -> DataFrame:
    """(name, n): distinct elements (or rows) per value, most frequent first if ``top`` is given."""
    n = F.count_distinct("element_pk") if distinct else F.count(F.lit(1))
    out = dates.where(value.isNotNull()).groupBy(value.alias(name)).agg(n.alias("n"))
    return out.orderBy(F.desc("n"), name).limit(top) if top else out


def date_statistics(dates: DataFrame) -> DataFrame:
    """(dimension, value, elements, extractions) of year, season, quarter and month in one pass over the dates."""
    wide = dates.where("ts IS NOT NULL").select(
        "element_pk",
        F.year("ts").cast("string").alias("year"),
        temporal.season(F.col("ts")).alias("season"),
        F.quarter("ts").cast("string").alias("quarter"),
        F.month("ts").cast("string").alias("month"),
    )
    names = ["year", "season", "quarter", "month"]
    sets = wide.groupingSets([[c] for c in names], *names).agg(
        F.count_distinct("element_pk").alias("elements"), F.count(F.lit(1)).alias("extractions")
    )
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])
    return sets.select(which.alias("dimension"), F.coalesce(*names).alias("value"), "elements", "extractions")


def topic_statistics(topics: DataFrame) -> DataFrame:
    """(topic, occurrences, document_count, avg_confidence) of rows (doc_id, topics, confidence)."""
    return (
        topics.select("doc_id", "confidence", F.explode("topics").alias("topic"))
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.count_distinct("doc_id").alias("document_count"),
            F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        )
    )


def term_statistics(mappings: DataFrame, by: list[str]) -> DataFrame:
    """count, mean, least and greatest confidence per term (and further columns)."""
    return mappings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )


def document_statistics(elements: DataFrame) -> DataFrame:
    """Per document: elements, characters, words, mean and greatest length, element types, has_header."""
    length = F.length("text")
    return elements.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("elements"),
        F.sum(length).alias("characters"),
        F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("words"),
        F.round(F.avg(length), 6).alias("avg_length"),
        F.max(length).cast("long").alias("max_length"),
        F.count_distinct("element_type").alias("types"),
        F.bool_or(F.col("element_type") == "header").alias("has_header"),
    )


def type_histogram(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id", "element_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def worker_metrics(queue: DataFrame) -> DataFrame:
    """Per worker: rows done, mean seconds, sum of a JSON counter ``k`` of the row's result."""
    k = F.get_json_object("result", "$.k").try_cast("long")
    return queue.groupBy("worker_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.round(F.avg(F.when(F.col("status") == "completed", F.col("seconds"))), 6).alias("avg_seconds"),
        F.coalesce(F.sum(k), F.lit(0)).alias("items"),
    )


def run_metrics(queue: DataFrame) -> DataFrame:
    """Per run: rows by status, mean seconds, throughput per hour between first and last row."""
    span = F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))
    done = F.count_if(F.col("status") == "completed")
    return queue.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.round(F.avg("seconds"), 6).alias("avg_seconds"),
        F.round(F.when(span > 0, done * 3.6e9 / span), 6).alias("per_hour"),
    )


def queue_health(queue: DataFrame, now: Column, stale_seconds: int = 600, alive_seconds: int = 60) -> DataFrame:
    """One row: counts by status, stale claims, live workers, age in seconds of the oldest pending row."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    status = F.col("status")
    return queue.agg(
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "processing").alias("processing"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if((status == "processing") & (age > stale_seconds)).alias("stale"),
        F.count_distinct(F.when(age < alive_seconds, F.col("worker_id"))).alias("active_workers"),
        F.max(F.when(status == "pending", age)).alias("oldest_pending_seconds"),
    )


def alerts(health: DataFrame, most_failed: float = 0.1, oldest: int = 3600) -> DataFrame:
    """(alert): which health thresholds are exceeded."""
    total = F.col("pending") + F.col("processing") + F.col("completed") + F.col("failed")
    rules = {
        "stale_documents": F.col("stale") > 0,
        "failure_rate": F.col("failed") > total * most_failed,
        "no_workers": F.col("active_workers") < 1,
        "backlog": F.col("oldest_pending_seconds") > oldest,
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return health.select(F.explode(hits).alias("alert"))


def hourly(queue: DataFrame) -> DataFrame:
    return queue.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def failure_patterns(queue: DataFrame) -> DataFrame:
    """Per source: failures, distinct reasons in order, first and last failure."""
    return (
        queue.where("status = 'failed'")
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
            F.min("created_at").alias("first_failure"),
            F.max("created_at").alias("last_failure"),
        )
    )


def value_summary(values: DataFrame) -> DataFrame:
    """count, least, greatest and mean per value_type."""
    return values.groupBy("value_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("value"), 4).alias("least"),
        F.round(F.max("value"), 4).alias("greatest"),
        F.round(F.avg("value"), 4).alias("mean"),
    )


def term_usage(mappings: DataFrame, term: str = "term", confidence: str = "confidence") -> DataFrame:
    """(terms, mappings, mean_confidence): one row over all mappings; a term's partial counts and sums meet, not its rows."""
    per = mappings.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("s"), F.count(confidence).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("mappings"), (F.sum("s") / F.sum("c")).alias("mean_confidence"))


def speakers(turns: DataFrame, document: str, speaker: str) -> DataFrame:
    """(document, speakers, turns, roles): how many speak in each document, how often, and who, in order and parted by commas."""
    return turns.groupBy(document).agg(
        F.count_distinct(speaker).alias("speakers"),
        F.count(F.lit(1)).alias("turns"),
        F.array_join(F.array_sort(F.collect_set(speaker)), ",").alias("roles"),
    )


def date_ranges(dates: DataFrame, element: str = "element_pk", at: str = "ts") -> DataFrame:
    """(element, first_date, last_date, n): the span of each element's dates."""
    return dates.groupBy(element).agg(F.min(at).alias("first_date"), F.max(at).alias("last_date"), F.count(F.lit(1)).alias("n"))
