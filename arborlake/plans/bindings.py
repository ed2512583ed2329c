"""How the driver's tables stand for documents, elements, dates, topics and queue rows.

Each binding exists twice, as a DataFrame and as the SQL of a common table
expression, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of documents: doc_id, source, pos (from 0 within all lines), text."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .where("trim(text) <> ''")
    )


LINES = """lines AS (
  SELECT doc_id, source, pos - 1 AS pos, text FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(text) <> '')"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and lines: element_id, doc_id, parent_id, element_type, position, level, text, source.

    Lines under 40 characters are headers of level 1, under 80 of level 2, the rest paragraphs.
    """
    n = F.length("text")
    body = lines(spark, sf_dir).select(
        F.concat_ws("#", "doc_id", "pos").alias("element_id"),
        "doc_id",
        F.col("doc_id").cast("string").alias("parent_id"),
        F.when(n < 80, "header").otherwise("paragraph").alias("element_type"),
        (F.col("pos") + 1).alias("position"),
        F.when(n < 40, 1).when(n < 80, 2).alias("level"),
        "text",
        "source",
    )
    roots = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("element_id"),
        "doc_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("root").alias("element_type"),
        F.lit(0).alias("position"),
        F.lit(None).cast("int").alias("level"),
        F.lit("").alias("text"),
        "source",
    )
    return roots.unionByName(body)


ELEMENTS = (
    LINES
    + """, elements AS (
  SELECT doc_id::VARCHAR AS element_id, doc_id, NULL::VARCHAR AS parent_id, 'root' AS element_type, 0 AS position,
         NULL::INT AS level, '' AS text, source FROM documents
  UNION ALL
  SELECT doc_id || '#' || pos, doc_id, doc_id::VARCHAR, CASE WHEN length(text) < 80 THEN 'header' ELSE 'paragraph' END,
         pos + 1, CASE WHEN length(text) < 40 THEN 1 WHEN length(text) < 80 THEN 2 END, text, source FROM lines)"""
)


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as date mentions: element_pk (customer), date_pk (order), ts."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("element_pk"), F.col("o_orderkey").alias("date_pk"), F.col("o_orderdate").alias("ts")
    )


DATES = "dates AS (SELECT o_custkey AS element_pk, o_orderkey AS date_pk, o_orderdate AS ts FROM orders)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with topics and confidence: element_pk, doc_id, embedding, topics, confidence."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("element_pk"),
        (F.col("vec_id") % 100).alias("doc_id"),
        "embedding",
        F.array(
            F.concat(F.lit("label_"), label.cast("string")), F.when(label % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
        ).alias("topics"),
        (F.lit(0.5) + label * F.lit(0.05)).alias("confidence"),
        "label",
    )


VECTORS = """vectors AS (
  SELECT vec_id AS element_pk, vec_id % 100 AS doc_id, embedding,
         ['label_' || label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END] AS topics,
         0.5::DOUBLE + label * 0.05::DOUBLE AS confidence, label FROM embeddings)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue rows: their type is the status, their user the worker."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("queue_id"),
        (F.col("event_id") % 5).alias("run_id"),
        (F.col("user_id") % 40).alias("source_id"),
        F.col("user_id").alias("worker_id"),
        F.when(kind == "error", "failed")
        .when(kind == "purchase", "completed")
        .when(kind == "click", "processing")
        .otherwise("pending")
        .alias("status"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("seconds"),
        F.col("props").alias("result"),
        F.concat(F.lit("reason_"), (F.col("event_id") % 7).cast("string")).alias("reason"),
        (F.col("event_id") % 4).cast("int").alias("retries"),
        (F.col("event_id") % 3).cast("int").alias("priority"),
    )


QUEUE = """queue AS (
  SELECT event_id AS queue_id, event_id % 5 AS run_id, user_id % 40 AS source_id, user_id AS worker_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing'
                         ELSE 'pending' END AS status,
         ts AS created_at, value AS seconds, props AS result, 'reason_' || (event_id % 7) AS reason,
         (event_id % 4)::INT AS retries, (event_id % 3)::INT AS priority FROM events)"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences written from orders and customers: element_pk, text with amounts, dates, percentages, names.

    The narrow rows are spread before the sentences are written, as what reads those is
    many patterns a row and would else keep to the few splits of a small file.
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_custkey", "o_orderdate", "c_name")
    return own.repartition(spark.sparkContext.defaultParallelism, "o_orderkey").select(
        F.col("o_orderkey").alias("element_pk"),
        F.concat_ws(
            " ",
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
            F.concat(F.lit("of $"), F.format_string("%d.5", F.col("o_orderkey") % 97), F.lit(" million")),
            F.concat(F.lit("was placed on "), F.date_format("o_orderdate", "yyyy-MM-dd")),
            F.concat(F.lit("by "), F.regexp_replace("c_name", "#0*", " "), F.lit(" Holdings Inc.")),
            F.concat(F.lit("with "), (F.col("o_orderkey") % 60).cast("string"), F.lit("% margin,")),
            F.concat(F.lit("up "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("x since Q"), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(" 1997.")),
            F.concat(F.lit("See 18 U.S.C. § "), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(" and Rule 10b-5.")),
            F.concat(F.lit("Take aspirin "), (F.col("o_orderkey") % 50 + 1).cast("string"), F.lit("mg BID for E11.9, BP 120/80.")),
            F.concat(F.lit("Mail user"), F.col("o_custkey").cast("string"), F.lit("@example.com or see https://example.org/o/"), F.col("o_orderkey").cast("string"), F.lit(".")),
        ).alias("text"),
    )


RENDERED = """rendered AS (
  SELECT o_orderkey AS element_pk,
    'Order ' || o_orderkey || ' of $' || (o_orderkey % 97) || '.5 million was placed on ' || strftime(o_orderdate, '%Y-%m-%d')
    || ' by ' || regexp_replace(c_name, '#0*', ' ', 'g') || ' Holdings Inc. with ' || (o_orderkey % 60) || '% margin, up '
    || (o_orderkey % 9 + 1) || 'x since Q' || (o_orderkey % 4 + 1) || ' 1997. See 18 U.S.C. § ' || (o_orderkey % 900 + 1)
    || ' and Rule 10b-5. Take aspirin ' || (o_orderkey % 50 + 1) || 'mg BID for E11.9, BP 120/80. Mail user' || o_custkey
    || '@example.com or see https://example.org/o/' || o_orderkey || '.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
