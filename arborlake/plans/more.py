"""Entry points, exports and joins with documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract
from ..operators import api, edges, find, stats, tree
from ..registry import Registry
from ..sources import connectors, structured
from . import bindings as b
from . import search as plans

R = Registry()


@R.query("unified_search", f"""WITH {plans.BASE} SELECT e.element_pk, round((e.s + t.s * 0.5 + 1) / 2.5, 6) AS final_score FROM e JOIN t USING (element_pk) JOIN el USING (element_pk)
WHERE e.s >= 0.01 AND element_type = 'paragraph' ORDER BY (e.s + t.s * 0.5 + 1) / 2.5 DESC, element_pk LIMIT 10""")
def unified_search(spark, sf_dir):
    page = api.unified(plans.store(spark, sf_dir), vector=plans.QUERY_VECTOR, topics=["even"], types=["paragraph"], threshold=0.01)
    return page.select("element_pk", F.round("final_score", 6).alias("final_score"))


def _hits(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    return e, e.where(F.length("text").between(60, 64)).select("element_id", F.length("text").cast("double").alias("score"))


@R.query("hits_with_content", f"""WITH {b.ELEMENTS}, n AS (SELECT element_id, (lead(element_id) OVER w IS NOT NULL)::INT + (lag(element_id) OVER w IS NOT NULL)::INT AS edges
  FROM elements WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY position, element_id))
SELECT element_id, source, text, edges FROM elements JOIN n USING (element_id) WHERE length(text) BETWEEN 60 AND 64""")
def hits_with_content(spark, sf_dir):
    e, hits = _hits(spark, sf_dir)
    rows = api.with_content(hits, e, b.table(spark, sf_dir, "documents"), tree.siblings(e))
    return rows.select("element_id", "source", "text", F.coalesce(F.size("edges"), F.lit(0)).alias("edges"))


@R.query("hit_sources", f"WITH {b.ELEMENTS} SELECT DISTINCT source FROM elements WHERE length(text) BETWEEN 60 AND 64")
def hit_sources(spark, sf_dir):
    e, hits = _hits(spark, sf_dir)
    return api.sources_of(hits, e, b.table(spark, sf_dir, "documents"))


@R.query("flattened_elements", f"WITH {b.ELEMENTS} SELECT element_id, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN parent_id IS NULL THEN element_id ELSE parent_id || '/' || element_id END AS path FROM elements")
def flattened_elements(spark, sf_dir):
    return api.flattened(b.elements(spark, sf_dir))


@R.query("document_xml", f"""WITH {b.ELEMENTS} SELECT doc_id, '<document>' || string_agg('<' || element_type || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || element_type || '>', '' ORDER BY position) || '</document>' AS xml
FROM elements GROUP BY doc_id""")
def document_xml(spark, sf_dir):
    return api.as_xml(b.elements(spark, sf_dir))


@R.query("document_json", f"WITH {b.ELEMENTS} SELECT doc_id, count(*)::INT AS n, max(CASE WHEN position = 0 THEN element_type END) AS first FROM elements GROUP BY doc_id")
def document_json(spark, sf_dir):
    rows = api.as_json(b.elements(spark, sf_dir))
    return rows.select("doc_id", F.json_array_length("json").alias("n"), F.get_json_object("json", "$[0].element_type").alias("first"))


@R.query("document_previews", f"""WITH {b.ELEMENTS} SELECT doc_id, left(string_agg(text, chr(10) || chr(10) ORDER BY position), 120) AS preview FROM elements WHERE trim(text) <> '' GROUP BY doc_id""")
def document_previews(spark, sf_dir):
    return api.previews(b.elements(spark, sf_dir), 120)


@R.query("export_advice", f"""WITH {b.ELEMENTS} SELECT doc_id, CASE WHEN bool_or(element_type = 'header') THEN 'markdown' ELSE 'text' END AS recommended,
  CASE WHEN bool_or(element_type = 'header') THEN 'html,json,markdown,text,xml' ELSE 'json,text,xml' END AS formats FROM elements GROUP BY doc_id""")
def export_advice(spark, sf_dir):
    return api.export_advice(b.elements(spark, sf_dir))


@R.query("merged_entities", f"""WITH {b.RENDERED} SELECT 'medical_code' AS entity_type, 'E11.9' AS normalized, 'E11.9' AS first_raw, count(*) AS mentions, count(DISTINCT element_pk) AS elements FROM rendered""")
def merged_entities(spark, sf_dir):
    return api.merge_entities(extract.entities(b.rendered(spark, sf_dir), ["medical_code"]))


@R.query("recent_executions", """SELECT o_orderkey AS execution_id, c_name AS name, o_orderdate AS started_at, 60 * (o_orderkey % 50) AS seconds FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def recent_executions(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    end = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 50 * 60_000_000)
    runs = o.select(F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("pipeline_id"), F.col("o_orderdate").alias("started_at"), end.alias("completed_at"))
    names = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pipeline_id"), F.col("c_name").alias("name"))
    return api.recent_executions(runs, names, 25)


@R.query("json_references", """SELECT o_orderkey::VARCHAR AS doc_id, 'cust_id' AS field, o_custkey::VARCHAR AS target FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'owner', 'x' || o_custkey FROM orders""")
def json_references(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_custkey").cast("string")
    body = F.concat(F.lit('{"_id": 5, "cust_id": '), k, F.lit(', "owner": {"$oid": "x'), k, F.lit('"}}'))
    return connectors.references(o.select(F.col("o_orderkey").cast("string").alias("doc_id"), body.alias("content")))


XML_FORMS = [
    "<orders><order>1</order><order>2</order></orders>",
    "<customerData><name>x</name><zip>y</zip></customerData>",
    "<allParts><part/><part/><part/><part/><part/><other/></allParts>",
    "<results><row/><col/></results>",
    "<address><city/></address>",
]


@R.query("xml_containers", """SELECT n_nationkey AS doc_id, p AS position, k AS kind FROM nation JOIN (VALUES (0, 0, 'array'), (0, 1, 'element'), (0, 2, 'element'),
  (1, 0, 'object'), (1, 1, 'element'), (1, 2, 'element'), (2, 0, 'array'), (2, 1, 'element'), (2, 2, 'element'), (2, 3, 'element'), (2, 4, 'element'), (2, 5, 'element'), (2, 6, 'element'),
  (3, 0, 'object'), (3, 1, 'element'), (3, 2, 'element'), (4, 0, 'element'), (4, 1, 'element')) v(f, p, k) ON n_nationkey % 5 = f""")
def xml_containers(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    body = F.element_at(F.array(*map(F.lit, XML_FORMS)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return structured.container_kinds(structured.xml_elements(n.select(F.col("n_nationkey").alias("doc_id"), body.alias("content"))))


@R.query("element_date_ranges", f"WITH {b.DATES} SELECT element_pk, min(ts) AS first_date, max(ts) AS last_date, count(*) AS n FROM dates GROUP BY element_pk")
def element_date_ranges(spark, sf_dir):
    return stats.date_ranges(b.dates(spark, sf_dir))


@R.query("elements_with_dates", f"WITH {b.DATES} SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT element_pk FROM dates WHERE ts >= TIMESTAMP '1998-06-01') ORDER BY c_custkey LIMIT 40")
def elements_with_dates(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").select("c_custkey")
    return find.with_dates(customers, b.dates(spark, sf_dir), F.col("ts") >= F.expr("timestamp_ntz'1998-06-01'"), key="c_custkey", limit=40)


@R.query("top_neighbours", f"""WITH {b.VECTORS}, p AS (SELECT doc_id, element_pk, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, element_pk) AS nth FROM vectors) SELECT doc_id, element_pk FROM p WHERE nth <= 3""")
def top_neighbours(spark, sf_dir):
    return edges.surest(b.vectors(spark, sf_dir), "doc_id", "confidence", "element_pk", 3).select("doc_id", "element_pk")
