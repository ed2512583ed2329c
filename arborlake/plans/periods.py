"""Sessions, events that follow one another, sketches of periods, and upserts that touch a part of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sketches, storage
from ..registry import Registry, table
from ..session import shared_scratch
from ..streaming import queue as streaming
from ..streaming import sessions as timed

R = Registry()


def _folder(spark) -> str:
    shared_scratch(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/periods/{uuid.uuid4().hex}"


def _zoned(events):
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(rows):
    """Timestamps without a zone, as the tables have them; totals to four places."""
    return rows.withColumns({"started": F.col("started").cast("timestamp_ntz"), "ended": F.col("ended").cast("timestamp_ntz"), "total": F.round("total", 4)})


ISLANDS = """fresh AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events
), island AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM fresh
), session AS (
  SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n, round(sum(value), 4) AS total FROM island GROUP BY user_id, nth
)"""


@R.query("event_sessions", f"WITH {ISLANDS} SELECT * FROM session")
def event_sessions(spark, sf_dir):
    return _plain(timed.sessions(_zoned(table(spark, sf_dir, "events")), "6 hours", "1 hour"))


@R.query("stream_sessions", f"WITH {ISLANDS} SELECT * FROM session WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(spark, sf_dir):
    found = timed.sessions(_zoned(streaming.events_stream(spark, sf_dir)), "6 hours", "1 hour")
    return _plain(streaming.drained(found, _folder(spark)))


@R.query("stream_followed", """SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR""")
def stream_followed(spark, sf_dir):
    of = lambda kind: _zoned(streaming.events_stream(spark, sf_dir)).where(F.col("event_type") == kind)
    return streaming.drained(timed.followed(of("click"), of("purchase"), "12 HOURS", "1 hour"), _folder(spark))


@R.query("sketched_months", """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, true AS customers_within, true AS median_within, true AS tail_within
FROM orders GROUP BY ALL""")
def sketched_months(spark, sf_dir):
    """Sketches per day merged to months; whether their estimates lie within three standard errors, or the error in rank, of the exact values."""
    month = lambda c: F.trunc(c, "month").alias("month")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_custkey", "o_totalprice")
    daily = sketches.sketched(orders, {"day": F.col("day")}, "o_custkey", "o_totalprice")
    monthly = sketches.estimated(sketches.merged(daily, {"month": month("day")}), [0.5, 0.9])
    price = F.col("o_totalprice")
    held = orders.withColumn("month", month("day")).join(monthly, "month")
    rank = lambda c: [F.count_if(price < F.col(c)).alias(f"{c}_below"), F.count_if(price <= F.col(c)).alias(f"{c}_upto")]
    exact = held.groupBy("month", "n", "distinct_estimate").agg(F.count_distinct("o_custkey").alias("customers"), *rank("q_50"), *rank("q_90"))

    def within(c: str, q: float):
        error = sketches.RANK_ERROR * F.col("n")
        return (F.col(f"{c}_below") <= q * F.col("n") + error) & (F.col(f"{c}_upto") >= q * F.col("n") - error)

    near = F.abs(F.col("distinct_estimate") - F.col("customers")) <= 3 * sketches.distinct_error() * F.col("customers")
    return exact.select("month", "n", near.alias("customers_within"), within("q_50", 0.5).alias("median_within"), within("q_90", 0.9).alias("tail_within"))


@R.query("upserted_buckets", """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders
UNION ALL SELECT -1, 'added'""")
def upserted_buckets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = _folder(spark)
    storage.write_buckets(orders, path, ["o_orderkey"], buckets=16)
    changed = orders.where("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("new"))
    added = spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("added").alias("o_orderstatus"))
    storage.upsert_buckets(path, changed.union(added), ["o_orderkey"], buckets=16)
    return spark.read.parquet(path).drop("bucket")
