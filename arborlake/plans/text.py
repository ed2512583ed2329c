"""Text, extraction and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, normalize, temporal, vectors
from ..operators import fuzzy, stats
from ..registry import Registry
from ..sources import readers, text
from . import bindings as b

R = Registry()


def _documents(spark, sf_dir):
    return b.table(spark, sf_dir, "documents")


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@R.query("paragraphs", rf"""WITH parts AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)),
         lambda x: {SQUEEZE.format('x')}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, i::INT AS index, p[i + 1] AS text, length(p[i + 1])::INT AS length,
       len(regexp_extract_all(p[i + 1], '\S+'))::INT AS word_count,
       regexp_matches(p[i + 1], 'https?://[^\s<>"'')\]]+[^\s<>"'')\].,;:!?]') AS has_urls,
       regexp_matches(p[i + 1], '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS has_emails, md5(p[i + 1]) AS content_hash,
       CASE WHEN length(p[i + 1]) > 100 THEN left(p[i + 1], 100) || '...' ELSE p[i + 1] END AS preview
FROM parts, unnest(range(len(p))) AS t(i)""")
def paragraphs(spark, sf_dir):
    return text.paragraphs(_documents(spark, sf_dir), separator="\n")


@R.query("text_statistics", r"""SELECT doc_id, length(text)::INT AS char_count, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INT AS word_count,
  len(string_split(text, chr(10)))::INT AS line_count,
  len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> ''))::INT AS paragraph_count,
  left(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 100) AS title FROM documents""")
def text_statistics(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in text.statistics(F.col("text")).items()])


@R.query("text_links", rf"""WITH {b.RENDERED}
SELECT element_pk, 'url' AS link_type, unnest(regexp_extract_all(text, 'https?://[^\s<>"'')\]]+[^\s<>"'')\].,;:!?]')) AS target FROM rendered
UNION ALL SELECT element_pk, 'email', 'mailto:' || unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) FROM rendered""")
def text_links(spark, sf_dir):
    return text.links(b.rendered(spark, sf_dir))


@R.query("document_emails", r"""SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email FROM documents""")
def document_emails(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.explode(temporal.find_all(F.col("text"), text.EMAIL)).alias("email"))


@R.query("line_ranges", """SELECT doc_id, string_split(text, chr(10))[2] AS second,
  array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS middle FROM documents""")
def line_ranges(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", text.line_at(t, 2).alias("second"), text.line_range(t, 2, 4).alias("middle"))


@R.query("token_estimates", r"""SELECT doc_id, greatest(length(text) // 4, len(regexp_extract_all(text, '\S+')) * 4 // 3)::BIGINT AS tokens FROM documents""")
def token_estimates(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", vectors.token_estimate(F.col("text")).alias("tokens"))


@R.query("content_types")
def content_types(spark, sf_dir):
    html = b.table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    props = b.table(spark, sf_dir, "events").select(F.col("props").alias("text"))
    rows = _documents(spark, sf_dir).select("text").union(html).union(props)
    return rows.groupBy(text.content_type(F.col("text")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


@R.query("types_by_path", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'markdown' ELSE 'text' END AS doc_type FROM pages""")
def types_by_path(spark, sf_dir):
    name = F.concat(F.lit("/data/f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".bin"))), (F.col("page_id") % 3 + 1).cast("int")))
    return b.table(spark, sf_dir, "pages").select("page_id", text.type_by_path(name).alias("doc_type"))


SCALED = """CASE WHEN raw ILIKE '%million' THEN 1e6 ELSE 1 END"""
VALUES = rf"""{b.RENDERED}, vals AS (
  SELECT element_pk, 'currency' AS value_type, raw, regexp_extract(raw, '(\d[\d,]*(?:\.\d+)?)', 1)::DOUBLE * {SCALED} AS value, 'USD' AS unit, 0.95::DOUBLE AS confidence
  FROM (SELECT element_pk, unnest(regexp_extract_all(text, '(?i)\$\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:million|billion)\b)?')) AS raw FROM rendered)
  UNION ALL SELECT element_pk, 'percentage', raw, regexp_extract(raw, '(\d+)', 1)::DOUBLE, '%', 0.95
  FROM (SELECT element_pk, unnest(regexp_extract_all(text, '\d+(?:\.\d+)?\s*%')) AS raw FROM rendered)
  UNION ALL SELECT element_pk, 'multiplier', raw, regexp_extract(raw, '(\d+)', 1)::DOUBLE, 'x', 0.9
  FROM (SELECT element_pk, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?\s*(?:x|times|fold)\b')) AS raw FROM rendered))"""


@R.query("extracted_values", f"WITH {VALUES} SELECT * FROM vals")
def extracted_values(spark, sf_dir):
    return extract.values(b.rendered(spark, sf_dir), positions=False)


@R.query("value_positions", f"""WITH {VALUES.replace("vals AS", "vals AS", 1)} SELECT v.element_pk, v.raw, (instr(r.text, v.raw) - 1)::INT AS start,
  substr(r.text, greatest(instr(r.text, v.raw) - 50, 1), instr(r.text, v.raw) + length(v.raw) + 50 - greatest(instr(r.text, v.raw) - 50, 1)) AS context FROM vals v JOIN rendered r USING (element_pk)""")
def value_positions(spark, sf_dir):
    return extract.values(b.rendered(spark, sf_dir)).select("element_pk", "raw", "start", "context")


@R.query("value_summary", f"""WITH {VALUES} SELECT value_type, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS greatest,
  round(avg(value), 4) AS mean FROM vals GROUP BY value_type""")
def value_summary(spark, sf_dir):
    return stats.value_summary(extract.values(b.rendered(spark, sf_dir), positions=False))


# RE2 forms of the patterns that match the rendered sentences
ENTITY_SQL = {
    "company_name": (r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc|Corp|Company|Co|Ltd|LLC|Group)\b\.?", "suffix"),
    "medical_code": (r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b", "icd10"),
    "vital_sign": (r"(?i)\b(?:BP|blood pressure):?\s*\d{2,3}/\d{2,3}(?:\s*mmHg)?", "blood_pressure"),
    "date": (r"\b\d{4}-\d{2}-\d{2}\b", "iso"),
    "financial_quarter": (r"(?i)\bQ[1-4]\s*\d{4}\b", "quarter"),
}


def _entities(kind: str, pattern: str, name: str) -> None:
    @R.query(f"entities_{kind}", f"""WITH {b.RENDERED} SELECT element_pk, '{kind}' AS entity_type, '{name}' AS pattern,
      unnest(regexp_extract_all(text, '{pattern}')) AS raw FROM rendered""")
    def run(spark, sf_dir):
        return extract.entities(b.rendered(spark, sf_dir), [kind]).select("element_pk", "entity_type", "pattern", "raw")


for _kind, (_pattern, _name) in ENTITY_SQL.items():
    _entities(_kind, _pattern, _name)


@R.query("entities_statute", f"""WITH {b.RENDERED} SELECT element_pk, '18 USC § ' || (element_pk % 900 + 1) AS normalized FROM rendered""")
def entities_statute(spark, sf_dir):
    return extract.entities(b.rendered(spark, sf_dir), ["statute"]).select("element_pk", "normalized")


@R.query("entities_dosage", f"""WITH {b.RENDERED} SELECT element_pk, 'amount' AS pattern, (element_pk % 50 + 1) || 'mg' AS raw FROM rendered
UNION ALL SELECT element_pk, 'abbreviation', 'BID' FROM rendered""")
def entities_dosage(spark, sf_dir):
    return extract.entities(b.rendered(spark, sf_dir), ["dosage"]).select("element_pk", "pattern", "raw")


@R.query("entities_regulation", f"WITH {b.RENDERED} SELECT element_pk, 'RULE_10B-5' AS normalized FROM rendered")
def entities_regulation(spark, sf_dir):
    return extract.entities(b.rendered(spark, sf_dir), ["regulation"]).select("element_pk", "normalized")


def _entity_counts_sql() -> str:
    """Each type's patterns counted on its own; validity as the types state it."""
    valid = {"ticker_symbol": "regexp_extract(raw, '([A-Z]{1,5})\\)?$', 1) NOT IN ('I', 'A', 'THE', 'AND', 'OR', 'BUT', 'CEO', 'CFO', 'IPO', 'ETF')"}
    endings = "|".join(extract.DRUG_ENDINGS)
    valid["drug_name"] = f"length(raw) >= 4 AND (pattern <> 'brand' OR regexp_matches(lower(raw), '({endings})$') OR regexp_matches(raw, '^[A-Z][a-z]+[A-Z]'))"
    parts = [
        f"SELECT '{x.entity_type}' AS entity_type, '{name}' AS pattern, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS raw FROM rendered"
        for x in extract.EXTRACTORS.values()
        for name, p in x.patterns.items()
    ]
    kept = " AND ".join(f"(entity_type <> '{t}' OR ({c}))" for t, c in valid.items())
    return f"WITH {b.RENDERED}, hit AS ({' UNION ALL '.join(parts)}) SELECT entity_type, pattern, count(*) AS n FROM hit WHERE {kept} GROUP BY ALL"


@R.query("entity_counts", _entity_counts_sql())
def entity_counts(spark, sf_dir):
    return extract.counted(b.rendered(spark, sf_dir), list(extract.EXTRACTORS.values()))


@R.query("text_dates", f"""WITH {b.RENDERED} SELECT element_pk, regexp_extract(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS raw,
  regexp_extract(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS iso, 'date_only' AS specificity_level, 'ISO' AS locale FROM rendered""")
def text_dates(spark, sf_dir):
    rows = b.rendered(spark, sf_dir).select("element_pk", F.explode(temporal.find_all(F.col("text"), temporal.DATE_FORMS["iso"])).alias("raw"))
    raw = F.col("raw")
    return rows.select(
        "element_pk", "raw", temporal.to_iso(raw).alias("iso"), temporal.specificity(raw).alias("specificity_level"), temporal.locale_of(raw).alias("locale")
    )


@R.query("date_forms", f"WITH {b.DATES} SELECT date_pk, strftime(ts, '%Y-%m-%d') AS iso, CASE WHEN date_pk % 6 = 0 THEN 'ISO' WHEN date_pk % 6 = 1 THEN 'US' WHEN date_pk % 6 = 2 THEN 'EU' END AS locale FROM dates")
def date_forms(spark, sf_dir):
    spark_forms = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM dd, yyyy", "dd MMMM yyyy", "MMM. dd, yyyy")
    shown = F.element_at(F.array(*[F.date_format("ts", f) for f in spark_forms]), (F.col("date_pk") % 6 + 1).cast("int"))
    rows = b.dates(spark, sf_dir).select("date_pk", shown.alias("shown"))
    return rows.select("date_pk", temporal.to_iso(F.col("shown")).alias("iso"), temporal.locale_of(F.col("shown")).alias("locale"))


@R.query("vague_dates", f"""WITH {b.DATES}, t AS (SELECT date_pk, 'the ' || (year(ts) // 10 * 10) || 's and Q' || quarter(ts) || ' ' || year(ts) || ', spring ' || year(ts) AS t FROM dates)
SELECT date_pk, regexp_extract(t, '((?:19|20)\\d)0s', 1)::INT * 10 AS decade, regexp_extract(t, 'Q([1-4])\\s', 1)::INT AS quarter,
       regexp_extract(t, 'Q[1-4]\\s+(\\d{{4}})', 1)::INT AS quarter_year, 'spring' AS season FROM t""")
def vague_dates(spark, sf_dir):
    ts = F.col("ts")
    said = F.concat(
        F.lit("the "), temporal.decade(ts).cast("string"), F.lit("s and Q"), F.quarter(ts).cast("string"), F.lit(" "), F.year(ts).cast("string"), F.lit(", spring "), F.year(ts).cast("string")
    )
    rows = b.dates(spark, sf_dir).select("date_pk", said.alias("t"))
    return rows.select(
        "date_pk",
        (F.regexp_extract("t", temporal.DECADE, 1).cast("int") * 10).alias("decade"),
        F.regexp_extract("t", temporal.QUARTER, 1).cast("int").alias("quarter"),
        F.regexp_extract("t", temporal.QUARTER, 2).cast("int").alias("quarter_year"),
        F.lower(F.regexp_extract("t", temporal.SEASON, 1)).alias("season"),
    )


@R.query("normalized_names", r"""SELECT c_custkey,
  trim(regexp_replace(lower(c_name), '[^\w\s]', ' ', 'g')) AS company,
  trim(regexp_replace(lower('Dr. ' || c_name || ' Jr.'), '^dr\. | jr\.$|[^\w\s]', ' ', 'g')) AS person,
  regexp_replace('1-' || (2000000000 + c_custkey), '^1-', '') AS phone,
  'c' || c_custkey || '@example.com' AS email, 'example.org/' || c_custkey AS url,
  printf('%.4f', (c_custkey % 100) / CASE WHEN c_custkey % 100 > 1 THEN 100.0 ELSE 1 END) AS percentage,
  'customer_' || lpad(c_custkey::VARCHAR, 9, '0') AS slug FROM customer""")
def normalized_names(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return b.table(spark, sf_dir, "customer").select(
        "c_custkey",
        normalize.company(F.concat("c_name", F.lit(", Inc."))).alias("company"),
        normalize.person(F.concat(F.lit("Dr. "), F.col("c_name"), F.lit(" Jr."))).alias("person"),
        normalize.phone(F.concat(F.lit("+1 ("), (F.col("c_custkey") + 2000000000).cast("string"), F.lit(")"))).alias("phone"),
        normalize.email(F.concat(F.lit("C"), k, F.lit(" [at] Example[dot]com"))).alias("email"),
        normalize.url(F.concat(F.lit("https://www.Example.org/"), k, F.lit("/"))).alias("url"),
        normalize.percentage(F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%"))).alias("percentage"),
        normalize.slug(F.regexp_replace("c_name", "#", " ")).alias("slug"),
    )


@R.query("levenshtein_pairs", """SELECT a.p_partkey AS a, b.p_partkey AS b,
  round(CASE WHEN a.p_name = b.p_name THEN 1 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END, 6) AS ratio
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def levenshtein_pairs(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return fuzzy.scored_pairs(part, "p_partkey", "p_name", ["p_brand", "p_size"]).withColumn("ratio", F.round("ratio", 6))


@R.query("composite_ids", "SELECT 'docs/source=' || source || '/doc_id=' || doc_id AS id, length(text)::INT AS n FROM documents WHERE length(text) > 100")
def composite_ids(spark, sf_dir):
    rows = _documents(spark, sf_dir).where(F.length("text") > 100)
    return rows.select(readers.composite_id("docs", ["source", "doc_id"]).alias("id"), F.length("text").alias("n"))


@R.query("mapped_rows", """SELECT o_orderkey::VARCHAR AS doc_id, o_orderstatus || chr(10) || chr(10) || o_orderpriority AS content,
  '{"o_custkey":' || o_custkey || '}' AS metadata FROM orders""")
def mapped_rows(spark, sf_dir):
    return readers.mapped(b.table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["o_custkey"])


@R.query("rows_as_json", """SELECT n_nationkey::VARCHAR AS doc_id, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS content FROM nation""")
def rows_as_json(spark, sf_dir):
    return readers.rows_as_json(b.table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_name"])


@R.query("changed_documents", """SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 4 = 1""")
def changed_documents(spark, sf_dir):
    now = _documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.md5("text").alias("content_hash"))
    before = now.where("source_id % 4 <> 1").withColumn("content_hash", F.when(F.col("source_id") % 10 == 3, "old").otherwise(F.col("content_hash")))
    return readers.changed(now, before).select(F.col("source_id").alias("doc_id"))


@R.query("newer_documents", """SELECT event_id FROM events WHERE user_id % 2 = 1 OR ts > TIMESTAMP '2024-01-10'""")
def newer_documents(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", F.col("ts").alias("modified"))
    history = events.where("source_id % 2 = 0").select("source_id", F.lit("2024-01-10").cast("timestamp_ntz").alias("last_modified")).distinct()
    return readers.newer(events, history).select("event_id")


# RFC 3986 in SQL: scheme, authority and path of the page, the reference by its first characters, dot segments folded
RESOLVED = r"""parts AS (SELECT *, regexp_extract(url, '^(https?:)//', 1) AS scheme, regexp_extract(url, '^https?:(//[^/?#]*)', 1) AS host,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM refs),
merged AS (SELECT *, CASE WHEN regexp_matches(ref, '^(?i)https?://') THEN ref WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN ref LIKE '//%' THEN scheme || ref WHEN ref LIKE '/%' THEN scheme || host || ref WHEN ref LIKE '?%' THEN scheme || host || path || ref
  WHEN ref = '' OR ref LIKE '#%' THEN scheme || host || path || query || ref
  ELSE scheme || host || CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END || ref END AS whole FROM parts),
cut AS (SELECT *, regexp_extract(whole, '^(https?://[^/?#]*)', 1) AS front, regexp_extract(whole, '^https?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(whole, '^[^?#]*([?#].*)$', 1) AS rest FROM merged WHERE whole IS NOT NULL),
folded AS (SELECT *, CASE WHEN contains(p, '/.') THEN list_reduce(list_prepend(['-'], [[x] FOR x IN string_split(p, '/')[2:]]),
  lambda acc, x: CASE x[1] WHEN '.' THEN acc WHEN '..' THEN CASE WHEN len(acc) > 1 THEN acc[:len(acc) - 1] ELSE acc END ELSE list_concat(acc, x) END) END AS segs FROM cut),
resolved AS (SELECT *, CASE WHEN segs IS NULL THEN whole ELSE front || '/' || array_to_string(segs[2:], '/') || CASE WHEN regexp_matches(p, '/\.\.?$') AND len(segs) > 1 THEN '/' ELSE '' END || rest END AS target FROM folded)"""


@R.query("page_links", rf"""WITH found AS (
  SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1))) AS raw FROM pages),
refs AS (SELECT page_id, url, trim(replace(regexp_replace(regexp_replace(raw, '^["'']', ''), '["'']$', ''), '&amp;', '&')) AS ref FROM found), {{RESOLVED}}
SELECT DISTINCT page_id, target FROM resolved WHERE target <> url AND NOT starts_with(target, url || '#')
  AND lower(regexp_extract(target, '^https?://([^/?#]+)', 1)) = lower(regexp_extract(url, '^https?://([^/?#]+)', 1))""".replace("{{RESOLVED}}", RESOLVED).replace("{RESOLVED}", RESOLVED))
def page_links(spark, sf_dir):
    return readers.page_links(b.table(spark, sf_dir, "pages"))


REFERENCES = ["https://other.org/x", "//evil.com/z", "/top", "b.html", "../up/c.html?q=1", "./d/./e/../f", "?only=1", "#here", "mailto:a@b.c", "HTTP://a.org/Y", "../../../../z", "g/", "."]


@R.query("resolved_urls", rf"""WITH refs AS (SELECT n_nationkey, 'https://a.org/' || n_name || '/sub/page' || n_regionkey || '.html?v=2' AS url, r AS ref FROM nation, (SELECT unnest({REFERENCES!r}) AS r)), {RESOLVED}
SELECT n_nationkey, ref, CASE WHEN ref = 'HTTP://a.org/Y' THEN 'HTTP://a.org/Y' ELSE target END AS target FROM refs LEFT JOIN resolved USING (n_nationkey, url, ref)""")
def resolved_urls(spark, sf_dir):
    url = F.concat(F.lit("https://a.org/"), "n_name", F.lit("/sub/page"), F.col("n_regionkey").cast("string"), F.lit(".html?v=2"))
    rows = b.table(spark, sf_dir, "nation").select("n_nationkey", url.alias("url"), F.explode(F.array(*map(F.lit, REFERENCES))).alias("ref"))
    return rows.select("n_nationkey", "ref", readers.resolved(F.col("url"), F.col("ref")).alias("target"))


@R.query("allowed_urls", r"SELECT page_id FROM pages WHERE regexp_matches(url, 'example\.org|/en/') AND NOT regexp_matches(url, 'utm_source')")
def allowed_urls(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").where(readers.url_allowed(F.col("url"), [r"example\.org", "/en/"], ["utm_source"])).select("page_id")


@R.query("nations_reached", """WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS t FROM nation),
w AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 6)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY node""")
def nations_reached(spark, sf_dir):
    edges = b.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("source"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("target")
    )
    return readers.reachable(spark.range(1).select(F.col("id").alias("node")), edges, 6)
