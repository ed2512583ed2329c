"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import stats
from ..registry import Registry
from . import bindings as b

R = Registry()
NOW = "2024-02-01 00:00:00"


@R.query("date_basics", f"""WITH {b.DATES}
SELECT count(DISTINCT element_pk) AS elements_with_dates, count(*) AS total_extractions,
       min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS earliest_date, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS latest_date
FROM dates WHERE ts IS NOT NULL""")
def date_basics(spark, sf_dir):
    return stats.date_basics(b.dates(spark, sf_dir))


SEASON = """CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) BETWEEN 3 AND 5 THEN 'spring'
                 WHEN month(ts) BETWEEN 6 AND 8 THEN 'summer' ELSE 'fall' END"""


@R.query("elements_by_year", f"""WITH {b.DATES} SELECT year(ts)::INT AS year, count(DISTINCT element_pk) AS n
FROM dates GROUP BY 1 ORDER BY n DESC, year LIMIT 10""")
def elements_by_year(spark, sf_dir):
    return stats.distribution(b.dates(spark, sf_dir), "year", F.year("ts"), top=10)


@R.query("extractions_by_year", f"""WITH {b.DATES} SELECT year(ts)::INT AS year, count(*) AS n
FROM dates GROUP BY 1 ORDER BY n DESC, year LIMIT 10""")
def extractions_by_year(spark, sf_dir):
    return stats.distribution(b.dates(spark, sf_dir), "year", F.year("ts"), distinct=False, top=10)


@R.query("season_distribution", f"WITH {b.DATES} SELECT {SEASON} AS season, count(DISTINCT element_pk) AS n FROM dates GROUP BY 1")
def season_distribution(spark, sf_dir):
    return stats.distribution(b.dates(spark, sf_dir), "season", temporal.season(F.col("ts")))


@R.query("quarter_distribution", f"WITH {b.DATES} SELECT quarter(ts)::INT AS quarter, count(DISTINCT element_pk) AS n FROM dates GROUP BY 1")
def quarter_distribution(spark, sf_dir):
    return stats.distribution(b.dates(spark, sf_dir), "quarter", F.quarter("ts"))


@R.query("date_statistics", f"""WITH {b.DATES}, wide AS (
  SELECT element_pk, year(ts)::VARCHAR AS y, {SEASON} AS s, quarter(ts)::VARCHAR AS q, month(ts)::VARCHAR AS m FROM dates)
SELECT 'year' AS dimension, y AS value, count(DISTINCT element_pk) AS elements, count(*) AS extractions FROM wide GROUP BY y
UNION ALL SELECT 'season', s, count(DISTINCT element_pk), count(*) FROM wide GROUP BY s
UNION ALL SELECT 'quarter', q, count(DISTINCT element_pk), count(*) FROM wide GROUP BY q
UNION ALL SELECT 'month', m, count(DISTINCT element_pk), count(*) FROM wide GROUP BY m""")
def date_statistics(spark, sf_dir):
    return stats.date_statistics(b.dates(spark, sf_dir))


@R.query("approximate_date_statistics")
def approximate_date_statistics(spark, sf_dir):
    return b.dates(spark, sf_dir).agg(
        F.approx_count_distinct("element_pk").alias("elements"), F.percentile_approx(F.year("ts"), 0.5).alias("median_year")
    )


@R.query("date_components", f"""WITH {b.DATES} SELECT date_pk, year(ts)::INT AS year_value, month(ts)::INT AS month_value,
  day(ts)::INT AS day_value, quarter(ts)::INT AS quarter_value, weekofyear(ts)::INT AS week_of_year,
  dayofyear(ts)::INT AS day_of_year, (isodow(ts) - 1)::INT AS day_of_week, isodow(ts) >= 6 AS is_weekend,
  (year(ts) // 10 * 10)::INT AS decade, ((year(ts) - 1) // 100 + 1)::INT AS century, {SEASON} AS season,
  (year(ts) + CASE WHEN month(ts) >= 10 THEN 1 ELSE 0 END)::INT AS fiscal_year,
  (((month(ts) - 10 + 12) % 12) // 3 + 1)::INT AS fiscal_quarter,
  (year(ts) - CASE WHEN month(ts) >= 8 THEN 0 ELSE 1 END) || '-' || (year(ts) + CASE WHEN month(ts) >= 8 THEN 1 ELSE 0 END) AS academic_year,
  CASE WHEN month(ts) >= 8 THEN 'fall' WHEN month(ts) <= 5 THEN 'spring' ELSE 'summer' END AS academic_semester,
  CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon'
       WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day,
  isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 16 AS is_business_hours FROM dates""")
def date_components(spark, sf_dir):
    d = b.dates(spark, sf_dir)
    return d.select("date_pk", *[c.alias(n) for n, c in temporal.components(F.col("ts")).items()])


@R.query("event_time_of_day", """SELECT event_id,
  CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon'
       WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day,
  isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 16 AS is_business_hours FROM events""")
def event_time_of_day(spark, sf_dir):
    ts = F.col("ts")
    return b.table(spark, sf_dir, "events").select(
        "event_id", temporal.time_of_day(ts).alias("time_of_day"), temporal.is_business_hours(ts).alias("is_business_hours")
    )


@R.query("spoken_dates", f"""WITH {b.DATES}, d AS (SELECT date_pk, ts, day(ts) AS day, quarter(ts) AS q, (day(ts) - 1) // 7 + 1 AS week, len(list_filter(range(day(ts)), lambda i: isodow(date_trunc('month', ts) + to_days(i::INT)) < 6)) AS n FROM dates)
SELECT date_pk, array_to_string(list_filter([strftime(ts, '%Y-%m-%d'), 'Q' || q, (['first', 'second', 'third', 'fourth'])[q] || ' quarter', strftime(ts, '%b'), (['winter', 'spring', 'summer', 'fall'])[q],
  (['first', 'second', 'third', 'fourth', 'fifth'])[week] || ' week', CASE WHEN week <= 2 THEN 'early month' WHEN week >= 4 THEN 'late month' ELSE 'mid month' END,
  CASE WHEN day <= 7 THEN 'beginning of month' WHEN day >= 22 THEN 'end of month' WHEN day BETWEEN 10 AND 20 THEN 'mid month' END, CASE WHEN day >= 22 AND month(ts) = 12 THEN 'year end' END,
  strftime(ts, '%A'), CASE WHEN isodow(ts) < 6 THEN 'business day, weekday' ELSE 'weekend' END, CASE WHEN n <= 5 THEN 'early business days' WHEN n BETWEEN 17 AND 22 THEN 'late business days' END,
  CASE n WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' WHEN 5 THEN 'fifth' WHEN 10 THEN 'tenth' WHEN 15 THEN 'fifteenth' WHEN 20 THEN 'twentieth' END || ' business day',
  year(ts)::VARCHAR, strftime(ts, '%Y-%m'), CASE q WHEN 4 THEN 'fiscal year end, year end' WHEN 1 THEN 'fiscal year start' END], lambda x: x IS NOT NULL), ', ') AS spoken FROM d""")
def spoken_dates(spark, sf_dir):
    return b.dates(spark, sf_dir).select("date_pk", temporal.spoken_date(F.col("ts")).alias("spoken"))


@R.query("topic_statistics", f"""WITH {b.VECTORS} SELECT topic, count(*) AS occurrences, count(DISTINCT doc_id) AS document_count,
  round(avg(confidence), 6) AS avg_confidence FROM (SELECT doc_id, confidence, unnest(topics) AS topic FROM vectors) GROUP BY topic""")
def topic_statistics(spark, sf_dir):
    return stats.topic_statistics(b.vectors(spark, sf_dir))


@R.query("term_statistics", """SELECT p_brand AS term, p_type AS domain, count(*) AS n, round(avg(p_size / 50.0), 6) AS avg_confidence,
  min(p_size / 50.0) AS min_confidence, max(p_size / 50.0) AS max_confidence FROM part GROUP BY 1, 2""")
def term_statistics(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    terms = part.select(
        F.col("p_brand").alias("term"), F.col("p_type").alias("domain"), (F.col("p_size") / F.lit(50.0)).alias("confidence")
    )
    return stats.term_statistics(terms, ["term", "domain"])


@R.query("term_usage_report", """SELECT count(DISTINCT p_brand) AS terms, count(*) AS mappings, round(avg(p_size / 50.0), 6) AS mean_confidence FROM part""")
def term_usage_report(spark, sf_dir):
    mappings = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), (F.col("p_size") / F.lit(50.0)).alias("confidence"))
    return stats.term_usage(mappings).withColumn("mean_confidence", F.round("mean_confidence", 6))


@R.query("document_statistics", f"""WITH {b.ELEMENTS} SELECT doc_id, count(*) AS elements, sum(length(text))::BIGINT AS characters,
  sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length,
  count(DISTINCT element_type) AS types, bool_or(element_type = 'header') AS has_header FROM elements GROUP BY doc_id""")
def document_statistics(spark, sf_dir):
    return stats.document_statistics(b.elements(spark, sf_dir))


@R.query("element_type_histogram", f"""WITH {b.ELEMENTS} SELECT doc_id, element_type, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM elements GROUP BY ALL""")
def element_type_histogram(spark, sf_dir):
    return stats.type_histogram(b.elements(spark, sf_dir))


@R.query("worker_metrics", f"""WITH {b.QUEUE} SELECT worker_id, count(*) FILTER (status = 'completed') AS completed,
  round(avg(seconds) FILTER (status = 'completed'), 6) AS avg_seconds,
  coalesce(sum((result->>'$.k')::BIGINT), 0)::BIGINT AS items FROM queue GROUP BY worker_id""")
def worker_metrics(spark, sf_dir):
    return stats.worker_metrics(b.queue(spark, sf_dir))


@R.query("run_metrics", f"""WITH {b.QUEUE} SELECT run_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, round(avg(seconds), 6) AS avg_seconds,
  round(count(*) FILTER (status = 'completed') * 3.6e9::DOUBLE / (epoch_us(max(created_at)) - epoch_us(min(created_at))), 6) AS per_hour
FROM queue GROUP BY run_id""")
def run_metrics(spark, sf_dir):
    return stats.run_metrics(b.queue(spark, sf_dir))


HEALTH = f"""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'processing' AND age > 600) AS stale,
  count(DISTINCT CASE WHEN age < 60 THEN worker_id END) AS active_workers,
  max(CASE WHEN status = 'pending' THEN age END) AS oldest_pending_seconds
FROM (SELECT *, epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(created_at))::BIGINT AS age FROM queue)"""


@R.query("queue_health", f"WITH {b.QUEUE} {HEALTH}")
def queue_health(spark, sf_dir):
    return stats.queue_health(b.queue(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@R.query("queue_alerts", f"""WITH {b.QUEUE}, health AS ({HEALTH})
SELECT unnest(list_filter([CASE WHEN stale > 0 THEN 'stale_documents' END,
  CASE WHEN failed > (pending + processing + completed + failed) * 0.1 THEN 'failure_rate' END,
  CASE WHEN active_workers < 1 THEN 'no_workers' END, CASE WHEN oldest_pending_seconds > 3600 THEN 'backlog' END],
  lambda x: x IS NOT NULL)) AS alert FROM health""")
def queue_alerts(spark, sf_dir):
    return stats.alerts(stats.queue_health(b.queue(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")))


@R.query("queue_hourly", f"""WITH {b.QUEUE} SELECT date_trunc('hour', created_at) AS hour, count(*) AS n,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM queue GROUP BY 1""")
def queue_hourly(spark, sf_dir):
    return stats.hourly(b.queue(spark, sf_dir))


@R.query("failure_patterns", f"""WITH {b.QUEUE} SELECT source_id, count(*) AS failures,
  string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, min(created_at) AS first_failure, max(created_at) AS last_failure
FROM queue WHERE status = 'failed' GROUP BY source_id""")
def failure_patterns(spark, sf_dir):
    return stats.failure_patterns(b.queue(spark, sf_dir))


@R.query("failure_reasons", f"""WITH {b.QUEUE} SELECT reason, count(*) AS n, round(avg(retries), 6) AS avg_retries FROM queue
WHERE status = 'failed' GROUP BY reason ORDER BY n DESC, reason LIMIT 10""")
def failure_reasons(spark, sf_dir):
    failed = b.queue(spark, sf_dir).where("status = 'failed'").groupBy("reason")
    out = failed.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("retries"), 6).alias("avg_retries"))
    return out.orderBy(F.desc("n"), "reason").limit(10)


@R.query("speakers_per_conversation", """SELECT conv_id, count(DISTINCT role) AS speakers, count(*) AS turns,
  string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id""")
def speakers_per_conversation(spark, sf_dir):
    return stats.speakers(b.table(spark, sf_dir, "conversations"), "conv_id", "role")
