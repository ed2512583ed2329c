"""Queries over structured documents, contexts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import context, vectors
from ..registry import Registry
from ..session import shared_scratch
from ..sources import structured
from ..streaming import queue as streaming
from . import bindings as b

R = Registry()


@R.query("json_elements", """SELECT event_id AS doc_id, '$' AS path, 'json_object' AS element_type, '' AS name, NULL AS value FROM events
UNION ALL SELECT event_id, '$.k', 'json_field', 'k', props->>'$.k' FROM events""")
def json_elements(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("content"))
    return structured.json_elements(rows)


@R.query("json_nested", """WITH n AS (SELECT n_nationkey AS doc_id, n_name, n_regionkey AS r FROM nation)
SELECT doc_id, '$' AS path, NULL AS value FROM n UNION ALL SELECT doc_id, '$.name', n_name FROM n UNION ALL SELECT doc_id, '$.tags', NULL FROM n
UNION ALL SELECT doc_id, '$.tags[0]', r::VARCHAR FROM n UNION ALL SELECT doc_id, '$.tags[1]', 'x' FROM n""")
def json_nested(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    body = F.concat(F.lit('{"name":"'), "n_name", F.lit('","tags":['), F.col("n_regionkey").cast("string"), F.lit(',"x"]}'))
    rows = structured.json_elements(n.select(F.col("n_nationkey").alias("doc_id"), body.alias("content")))
    return rows.select("doc_id", "path", "value")


def _csv(spark, sf_dir):
    """One CSV document per market segment: a header and a line per customer."""
    c = b.table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(', Ltd"')), F.format_string("%.2f", "c_acctbal"), F.lit("2024-01-05"))
    rows = c.groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("customer_id,customer_name,balance,opened\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return rows.select(F.col("c_mktsegment").alias("doc_id"), body.alias("content"))


CSV = """c AS (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1)::INT AS r FROM customer)"""
CSV_CELLS = f"""WITH {CSV} SELECT c_mktsegment AS doc_id, r AS row, 0 AS col, 'customer_id' AS header, c_custkey::VARCHAR AS value FROM c
UNION ALL SELECT c_mktsegment, r, 1, 'customer_name', c_name || ', Ltd' FROM c UNION ALL SELECT c_mktsegment, r, 2, 'balance', printf('%.2f', c_acctbal) FROM c
UNION ALL SELECT c_mktsegment, r, 3, 'opened', '2024-01-05' FROM c"""
CSV_TYPES = """SELECT s AS doc_id, c AS col, h AS header, t AS type FROM (SELECT DISTINCT c_mktsegment AS s FROM customer),
(VALUES (0, 'customer_id', 'integer'), (1, 'customer_name', 'string'), (2, 'balance', 'float'), (3, 'opened', 'date')) v(c, h, t)"""
CSV_RELATIONS = """SELECT s AS doc_id, a AS source, z AS target, 'related_to' AS relationship_type, 0.7::DOUBLE AS confidence FROM (SELECT DISTINCT c_mktsegment AS s FROM customer),
(VALUES ('customer_id', 'customer_name'), ('customer_name', 'customer_id')) v(a, z)"""


# each under two names, as both were in use
@R.query("csv_cells", CSV_CELLS)
def csv_cells(spark, sf_dir):
    return structured.csv_cells(_csv(spark, sf_dir)).select("doc_id", "row", "col", "header", "value")


@R.query("csv_types", CSV_TYPES)
def csv_types(spark, sf_dir):
    return structured.csv_types(structured.csv_cells(_csv(spark, sf_dir)))


@R.query("csv_relations", CSV_RELATIONS)
def csv_relations(spark, sf_dir):
    return structured.csv_relations(structured.csv_cells(_csv(spark, sf_dir)))


def _dialects(spark, sf_dir):
    """One CSV document per nation of its customers: delimiter, quote and header vary, and quoted names hold delimiters and quotes."""
    c = b.table(spark, sf_dir, "customer")
    key = F.col("c_nationkey")
    mark = F.element_at(F.array(*map(F.lit, structured.DELIMITERS)), (key % 4 + 1).cast("int"))
    quote = F.when(key % 3 == 0, "'").otherwise('"')
    name = F.concat(quote, "c_name", F.lit(",a;b|c "), quote, quote, F.lit("x"), quote)
    line = F.concat(F.col("c_custkey").cast("string"), mark, name, mark, "c_mktsegment")
    rows = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    head = F.when(key % 2 == 0, F.concat(F.lit("id"), mark, F.lit("name"), mark, F.lit("segment\n"))).otherwise("")
    return rows.select(key.alias("doc_id"), F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("content"))


@R.query("csv_dialects", """SELECT DISTINCT c_nationkey AS doc_id, [',', ';', chr(9), '|'][c_nationkey % 4 + 1] AS delimiter,
  CASE WHEN c_nationkey % 3 = 0 THEN '''' ELSE '"' END AS quote, c_nationkey % 2 = 0 OR count(*) OVER (PARTITION BY c_nationkey) = 1 AS header FROM customer""")
def csv_dialects(spark, sf_dir):
    found = structured.csv_dialect(F.col("content"))
    return _dialects(spark, sf_dir).select("doc_id", found.alias("d")).select("doc_id", "d.*")


@R.query("csv_dialect_cells", """WITH c AS (
  SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS r, CASE WHEN c_nationkey % 3 = 0 THEN '''' ELSE '"' END AS q FROM customer)
SELECT c_nationkey AS doc_id, r AS row, j::INT AS col, CASE WHEN c_nationkey % 2 = 0 THEN ['id', 'name', 'segment'][j + 1] ELSE 'column_' || (j + 1) END AS header,
  [c_custkey::VARCHAR, c_name || ',a;b|c ' || q || 'x', c_mktsegment][j + 1] AS value FROM c, range(3) AS t(j)""")
def csv_dialect_cells(spark, sf_dir):
    return structured.csv_cells(_dialects(spark, sf_dir)).drop("error")


@R.query("csv_tree", """WITH c AS (SELECT c_mktsegment AS doc_id, count(*) AS n FROM customer GROUP BY 1)
SELECT doc_id, t AS element_type, CASE t WHEN 'root' THEN 1 WHEN 'table' THEN 1 WHEN 'table_header_row' THEN 1 WHEN 'table_header' THEN 4 WHEN 'table_row' THEN n ELSE 4 * n END AS elements,
  CASE t WHEN 'root' THEN 0 WHEN 'table' THEN 1 WHEN 'table_header_row' THEN 2 WHEN 'table_header' THEN 3 WHEN 'table_row' THEN 7 ELSE 8 END AS first_position
FROM c, (VALUES ('root'), ('table'), ('table_header_row'), ('table_header'), ('table_row'), ('table_cell')) v(t)""")
def csv_tree(spark, sf_dir):
    e = structured.csv_tree(structured.csv_cells(_csv(spark, sf_dir)))
    return e.groupBy("doc_id", "element_type").agg(F.count(F.lit(1)).alias("elements"), F.min("position").alias("first_position"))


def _pages(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))


@R.query("html_elements")
def html_elements(spark, sf_dir):
    return structured.html_elements(_pages(spark, sf_dir))


@R.query("html_list_items", r"""SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li[\s>]')) AS n FROM pages WHERE len(regexp_extract_all(html, '<li[\s>]')) > 0""")
def html_list_items(spark, sf_dir):
    rows = structured.html_elements(_pages(spark, sf_dir)).where("element_type = 'list_item'")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@R.query("html_headings", r"""SELECT page_id AS doc_id, len(regexp_extract_all(html, '<h[1-6][\s>]')) AS n FROM pages WHERE len(regexp_extract_all(html, '<h[1-6][\s>]')) > 0""")
def html_headings(spark, sf_dir):
    rows = structured.html_elements(_pages(spark, sf_dir)).where("element_type = 'header'")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@R.query("xml_elements", """SELECT n_nationkey AS doc_id, 0 AS position, 'xml_object' AS element_type, '/nation' AS location, '' AS text FROM nation
UNION ALL SELECT n_nationkey, 1, 'xml_element', '/nation/name', n_name FROM nation UNION ALL SELECT n_nationkey, 2, 'xml_element', '/nation/region', n_regionkey::VARCHAR FROM nation""")
def xml_elements(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    body = F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></nation>"))
    rows = structured.xml_elements(n.select(F.col("n_nationkey").alias("doc_id"), body.alias("content")))
    return rows.select("doc_id", "position", "element_type", "location", "text")


def _markdown(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations")
    text = F.regexp_replace("text", r"\s+", " ")
    block = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), "role", F.lit("\n\n- "), text, F.lit("\n```\n# code\n```"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("blocks"))
    body = F.concat(F.lit("---\ntitle: x\n---\n"), F.array_join(F.transform("blocks", lambda x: x["block"]), "\n"))
    return rows.select(F.col("conv_id").alias("doc_id"), body.alias("content"))


MARKDOWN = r"""WITH c AS (SELECT conv_id AS doc_id, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 6)::INT AS p, turn, role, regexp_replace(text, '\s+', ' ', 'g') AS raw FROM conversations)
SELECT doc_id, p::INT AS position, 'header' AS element_type, (turn % 3 + 1)::INT AS level, role AS text FROM c
UNION ALL SELECT doc_id, p + 2, 'list_item', NULL, raw FROM c UNION ALL SELECT doc_id, p + 4, 'code_block', NULL, '# code' FROM c"""
FRONT = "SELECT conv_id AS doc_id, 'title: x' AS front FROM conversations GROUP BY conv_id"


@R.query("markdown_elements", MARKDOWN)
def markdown_elements(spark, sf_dir):
    return structured.markdown_elements(_markdown(spark, sf_dir))


@R.query("markdown_front_matter", FRONT)
def markdown_front_matter(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", structured.front_matter(F.col("content")).alias("front"))


@R.query("markdown_tree", r"""WITH c AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i, (turn % 3 + 1)::INT AS level, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS raw FROM conversations),
h AS (SELECT c.doc_id, c.i, c.level, c.role, c.raw, max(a.i) AS above FROM c LEFT JOIN c a ON a.doc_id = c.doc_id AND a.i < c.i AND a.level < c.level GROUP BY ALL)
SELECT 'root_' || doc_id AS element_id, doc_id, NULL AS parent_id, 'root' AS element_type, 0 AS position, NULL::INT AS level, '' AS text FROM c GROUP BY doc_id
UNION ALL SELECT doc_id || '#' || (4 * i), doc_id, CASE WHEN above IS NULL THEN 'root_' || doc_id ELSE doc_id || '#' || (4 * above) END, 'header', 4 * i + 1, level, role FROM h
UNION ALL SELECT doc_id || '#' || (4 * i + 1), doc_id, doc_id || '#' || (4 * i), 'list', 4 * i + 2, NULL, '' FROM h
UNION ALL SELECT doc_id || '#' || (4 * i + 2), doc_id, doc_id || '#' || (4 * i + 1), 'list_item', 4 * i + 3, 1, raw FROM h
UNION ALL SELECT doc_id || '#' || (4 * i + 3), doc_id, doc_id || '#' || (4 * i), 'code_block', 4 * i + 4, NULL, '# code' FROM h""")
def markdown_tree(spark, sf_dir):
    return structured.element_tree(structured.markdown_nodes(_markdown(spark, sf_dir))).drop("attributes")


@R.query("row_documents", """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
r AS (SELECT *, sum((p IS NULL OR p <> role)::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c)
SELECT conv_id AS doc_id, turn * 2 + 1 AS position, run AS section_run, 'paragraph' AS element_type, text FROM r
UNION ALL SELECT conv_id, min(turn) * 2, run, 'header', min(role) FROM r GROUP BY conv_id, run""")
def row_documents(spark, sf_dir):
    rows = structured.row_document(b.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "role")
    return rows.select("doc_id", "position", "section_run", "element_type", "text")


ROLES = ["main", "parent", "child", "sibling", "preceding", "following", "references", "referenced_by", "contains", "contained_by", "related", "other"]
KINDS = ["header", "title", "h1", "h2", "h3", "table_header", "section", "paragraph", "list"]


@R.query("context_strength", f"""SELECT event_id, round(least(1, CASE ({ROLES!r})[event_id % 12 + 1] WHEN 'main' THEN 1.0 WHEN 'parent' THEN 0.9 WHEN 'child' THEN 0.7 WHEN 'sibling' THEN 0.6 WHEN 'references' THEN 0.8
  WHEN 'referenced_by' THEN 0.8 WHEN 'contains' THEN 0.9 WHEN 'contained_by' THEN 0.7 WHEN 'related' THEN 0.4 ELSE 0.5 END::DOUBLE
  * greatest(0.1::DOUBLE, 1 - (event_id % 7)::DOUBLE * 0.2::DOUBLE) * CASE WHEN ({KINDS!r})[event_id % 9 + 1] IN ('paragraph', 'list') THEN 1::DOUBLE ELSE 1.1::DOUBLE END), 2) AS strength FROM events""")
def context_strength(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    strength = context.strength(pick(ROLES, 12), F.col("event_id") % 7 + 1, pick(KINDS, 9))
    return b.table(spark, sf_dir, "events").select("event_id", strength.alias("strength"))


@R.query("context_tags", f"""WITH {b.ELEMENTS} SELECT element_id, '[SELF:' || element_type || ':' || element_id || CASE WHEN level IS NULL THEN '' ELSE ':level=' || level END || ']' AS tag, element_type AS parsed FROM elements""")
def context_tags(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    tagged = e.select("element_id", context.tag(F.lit("self"), F.col("element_type"), F.col("element_id"), F.col("level")).alias("tag"))
    return tagged.withColumn("parsed", context.parse_tag(F.col("tag"))["element_type"])


@R.query("truncated_texts", r"""WITH w AS (SELECT doc_id, trim(text) AS t, regexp_split_to_array(trim(text), '\s+') AS s FROM documents)
SELECT doc_id, CASE WHEN len(s) <= 30 THEN t ELSE array_to_string(s[1:20], ' ') || ' ... ' || array_to_string(s[len(s) - 9:len(s)], ' ') END AS short FROM w""")
def truncated_texts(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", context.truncate(F.col("text"), 30).alias("short"))


@R.query("greedy_context")
def greedy_context(spark, sf_dir):
    e = b.elements(spark, sf_dir).where("element_type <> 'root'")
    item = F.struct(
        context.priority(F.lit("sibling"), F.col("position"), F.col("element_type"), F.col("text")).alias("priority"),
        F.col("position").alias("distance"),
        F.col("element_id").alias("id"),
        vectors.token_estimate(F.col("text")).alias("tokens"),
    )
    return e.groupBy("doc_id").agg(context.greedy(F.collect_list(item), 150).alias("chosen"))


def _folder(spark) -> str:
    shared_scratch(spark)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"


@R.query("stream_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50")
def stream_filter(spark, sf_dir):
    stream = streaming.events_stream(spark, sf_dir).where("event_type = 'error' AND value > 50").select("event_id", "user_id", "value")
    return streaming.drained(stream, _folder(spark))


@R.query("stream_hourly", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, (SELECT max(ts) FROM events) AS latest FROM events GROUP BY 1, 2)
SELECT hour, event_type, n, total FROM h WHERE hour + INTERVAL 1 HOUR <= latest - INTERVAL 2 HOUR""")
def stream_hourly(spark, sf_dir):
    rows = streaming.drained(streaming.windowed(streaming.events_stream(spark, sf_dir)), _folder(spark))
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@R.query("stream_ingest", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def stream_ingest(spark, sf_dir):
    path = _folder(spark)
    streaming.ingest(streaming.events_stream(spark, sf_dir), path, lambda batch: batch.select("event_type", "user_id").dropDuplicates())
    return spark.read.parquet(f"{path}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@R.query("retry_schedule", f"""WITH {b.QUEUE} SELECT queue_id, CASE WHEN retries < 3 THEN 'retry' ELSE 'failed' END AS status,
  CASE WHEN retries < 3 THEN created_at + to_seconds(60 * (1 << retries)) END AS next_attempt_at FROM queue WHERE status = 'failed'""")
def retry_schedule(spark, sf_dir):
    failed = b.queue(spark, sf_dir).where("status = 'failed'")
    return streaming.after_failure(failed).select("queue_id", "status", "next_attempt_at")


@R.query("claim_order", f"""WITH {b.QUEUE} SELECT run_id, queue_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, created_at, queue_id) AS nth FROM queue WHERE status = 'pending') WHERE nth = 1""")
def claim_order(spark, sf_dir):
    return streaming.claim_order(b.queue(spark, sf_dir)).select("run_id", "queue_id")


@R.query("enqueued", f"""WITH {b.QUEUE} SELECT run_id, source_id, min(retries) AS link_depth, min(status) AS status FROM queue GROUP BY ALL""")
def enqueued(spark, sf_dir):
    q = b.queue(spark, sf_dir)
    known = q.groupBy("run_id", "source_id").agg(F.max("retries").alias("link_depth"), F.min("status").alias("status"))
    return streaming.enqueue(known, q.select("run_id", "source_id", F.col("retries").alias("link_depth")))


@R.query("failure_advice", f"WITH {b.QUEUE} SELECT 'look at the log' AS advice, count(*) AS n FROM queue WHERE status = 'failed'")
def failure_advice(spark, sf_dir):
    failed = b.queue(spark, sf_dir).where("status = 'failed'")
    return failed.groupBy(streaming.advice(F.col("reason")).alias("advice")).agg(F.count(F.lit(1)).alias("n"))
