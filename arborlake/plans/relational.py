"""The relational surface that user SQL reaches at ingest, on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import Registry
from . import bindings as b

R = Registry()


def _views(spark, sf_dir, *names):
    for n in names:
        b.table(spark, sf_dir, n).createOrReplaceTempView(n)


def _sql(name: str, tables: tuple[str, ...], text: str, duck: str | None = None) -> None:
    """A query given as SQL that both engines run."""

    @R.query(name, duck or text)
    def run(spark, sf_dir):
        _views(spark, sf_dir, *tables)
        return spark.sql(text)


_sql("sql_filter", ("documents",), "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND source LIKE 'src1%' AND text IS NOT NULL AND length(text) > 500")
_sql("sql_inner_join", ("orders", "customer"), "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
_sql("sql_left_join", ("documents", "labels"), "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_sql("sql_full_join", ("part", "lineitem"), "SELECT p_partkey, q.n FROM part FULL OUTER JOIN (SELECT l_partkey + 1000 AS k, count(*) AS n FROM lineitem GROUP BY 1) q ON p_partkey = q.k")
_sql("sql_semi_join", ("documents", "labels"), "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
_sql("sql_anti_join", ("documents", "labels"), "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
_sql(
    "sql_conditional_aggregates",
    ("lineitem",),
    """SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
_sql("sql_grouping_sets", ("orders",), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_cube", ("orders",), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_rollup", ("lineitem",), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_order_limit", ("part",), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 10")
_sql("sql_union", ("customer", "supplier"), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("sql_intersect_all", ("customer", "supplier"), "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_sql("sql_except", ("customer", "supplier"), "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_sql("sql_scalar_subquery", ("part",), "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
_sql("sql_correlated", ("orders",), "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("sql_cte", ("orders", "customer"), "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_name, top FROM customer JOIN big ON c_custkey = o_custkey WHERE top > 400000")
_sql(
    "sql_recursive",
    ("nation",),
    "WITH RECURSIVE w(k, d) AS (SELECT 0, 0 UNION ALL SELECT (n_nationkey * 2 + 1) % 25, d + 1 FROM w JOIN nation ON n_nationkey = k WHERE d < 8) SELECT k, d FROM w",
)
_sql(
    "sql_windows",
    ("conversations",),
    """SELECT conv_id, turn, CAST(rank() OVER (PARTITION BY conv_id ORDER BY length(text)) AS INT) AS r, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS INT) AS dr,
    CAST(ntile(3) OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS third, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM conversations""",
)
_sql("sql_string_functions", ("customer",), "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 8) AS s, replace(c_name, '#', '-') AS r, lpad(CAST(c_nationkey AS STRING), 3, '0') AS p, concat(c_name, '/', c_mktsegment) AS j FROM customer")
_sql("sql_math_functions", ("lineitem",), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_quantity), 6) AS root, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k, round(ln(l_extendedprice), 6) AS lg, abs(l_discount - 0.05) < 0.001 AS five FROM lineitem")
_sql("sql_case", ("orders",), "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS state FROM orders")


@R.query("range_join", """WITH bands AS (SELECT * FROM (VALUES (0, 10), (10, 25), (25, 60), (60, 100)) t(low, high))
SELECT low, high, count(*) AS n FROM events JOIN bands ON value >= low AND value < high GROUP BY low, high""")
def range_join(spark, sf_dir):
    bands = spark.createDataFrame([(0, 10), (10, 25), (25, 60), (60, 100)], "low int, high int")
    events = b.table(spark, sf_dir, "events")
    # four rows, written above
    return events.join(F.broadcast(bands), (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high"))).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


@R.query("as_of_join", """SELECT e.event_id, arg_max(p.event_id, {'t': p.ts, 'i': p.event_id}) AS last_purchase FROM events e JOIN events p
ON e.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id""")
def as_of_join(spark, sf_dir):
    """The last purchase at or before each error: one window over both, no pairs."""
    e = b.table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'error' AND last_purchase IS NOT NULL").select("event_id", "last_purchase")


@R.query("lateral_topics", f"WITH {b.VECTORS} SELECT element_pk, unnest(topics) AS topic FROM vectors")
def lateral_topics(spark, sf_dir):
    return b.vectors(spark, sf_dir).select("element_pk", F.explode("topics").alias("topic"))


@R.query("listed_sources", "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def listed_sources(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@R.query("exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def exact_quantiles(spark, sf_dir):
    return b.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.percentile("value", 0.5), 4).alias("median"), F.round(F.percentile("value", 0.9), 4).alias("p90"), F.count_distinct("user_id").alias("users")
    )


@R.query("json_and_arrays", """SELECT e.event_id, (props->>'$.k')::INT AS k, v.label, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding) AS dims
FROM events e JOIN embeddings v ON e.event_id = v.vec_id""")
def json_and_arrays(spark, sf_dir):
    e, v = b.table(spark, sf_dir, "events"), b.table(spark, sf_dir, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return e.join(v, e["event_id"] == v["vec_id"]).select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "label", F.round(total, 4).alias("total"), F.size("embedding").cast("long").alias("dims")
    )


@R.query("sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = b.table(spark, sf_dir, "events").withColumn("fresh", F.when(gap > 30 * 60 * 1_000_000, 1).otherwise(0))
    s = e.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).drop("session")


@R.query("pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
