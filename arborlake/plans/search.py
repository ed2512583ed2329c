"""Find and search queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import find, fulltext, search
from ..registry import Registry
from . import bindings as b

R = Registry()
NOW = datetime(1998, 8, 1)


def _documents(spark, sf_dir):
    return b.table(spark, sf_dir, "documents")


@R.query("find_documents", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND text ILIKE '%the%'")
def find_documents(spark, sf_dir):
    rows = find.find(_documents(spark, sf_dir), {"lang": "en", "source": ["src1", "src2"], "text_like": "%the%"}, limit=None)
    return rows.select("doc_id", "source")


@R.query("find_documents_page", "SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 100")
def find_documents_page(spark, sf_dir):
    return find.find(_documents(spark, sf_dir), {"lang": "fr"}, order="doc_id").select("doc_id")


@R.query("find_elements", f"WITH {b.ELEMENTS} SELECT element_id, doc_id FROM elements WHERE element_type IN ('header', 'root') AND source = 'src3'")
def find_elements(spark, sf_dir):
    rows = find.find(b.elements(spark, sf_dir), {"element_type": ["header", "root"], "source": "src3"}, limit=None)
    return rows.select("element_id", "doc_id")


@R.query("content_search", f"WITH {b.ELEMENTS} SELECT element_id FROM elements WHERE text ILIKE '%tion%' AND element_type = 'header'")
def content_search(spark, sf_dir):
    return find.containing(find.find(b.elements(spark, sf_dir), {"element_type": "header"}, limit=None), "tion").select("element_id")


@R.query("elements_by_category", f"WITH {b.ELEMENTS} SELECT element_id, element_type FROM elements WHERE element_type IN ('paragraph', 'header', 'blockquote', 'text_box')")
def elements_by_category(spark, sf_dir):
    return find.by_category(b.elements(spark, sf_dir), "text").select("element_id", "element_type")


@R.query("leaf_elements", f"WITH {b.ELEMENTS} SELECT element_id FROM elements WHERE element_id NOT IN (SELECT parent_id FROM elements WHERE parent_id IS NOT NULL)")
def leaf_elements(spark, sf_dir):
    return find.leaves(b.elements(spark, sf_dir)).select("element_id")


@R.query("metadata_exact", "SELECT event_id FROM events WHERE props->>'$.k' = '42'")
def metadata_exact(spark, sf_dir):
    return b.table(spark, sf_dir, "events").where(find.metadata_conditions(F.col("props"), exact={"k": 42})).select("event_id")


@R.query("metadata_range", "SELECT event_id FROM events WHERE (props->>'$.k')::DOUBLE >= 10 AND (props->>'$.k')::DOUBLE < 20")
def metadata_range(spark, sf_dir):
    kept = find.metadata_conditions(F.col("props"), ranges={"k": {"gte": 10, "lt": 20}})
    return b.table(spark, sf_dir, "events").where(kept).select("event_id")


@R.query("metadata_like_exists", "SELECT event_id FROM events WHERE props->>'$.k' ILIKE '1%' AND (props->>'$.k') IS NOT NULL")
def metadata_like_exists(spark, sf_dir):
    kept = find.metadata_conditions(F.col("props"), like={"k": "1%"}, exists=["k"])
    return b.table(spark, sf_dir, "events").where(kept).select("event_id")


@R.query("element_filters", f"WITH {b.ELEMENTS} SELECT element_id FROM elements WHERE element_type = 'paragraph' AND doc_id NOT IN (1, 2) AND length(text) BETWEEN 100 AND 200 AND source IN ('src4', 'src5')")
def element_filters(spark, sf_dir):
    kept = find.element_conditions(types="paragraph", exclude_doc_ids=[1, 2], min_length=100, max_length=200, sources=["src4", "src5"])
    return b.elements(spark, sf_dir).where(kept).select("element_id")


@R.query("topic_filter", f"""WITH {b.VECTORS} SELECT element_pk FROM vectors WHERE confidence >= 0.6
  AND len(list_filter(topics, lambda t: t ILIKE 'label%')) > 0 AND len(list_filter(topics, lambda t: t ILIKE 'odd')) = 0""")
def topic_filter(spark, sf_dir):
    kept = find.topic_conditions(F.col("topics"), F.col("confidence"), include=["label%"], exclude=["odd"], minimum=0.6)
    return b.vectors(spark, sf_dir).where(kept).select("element_pk")


@R.query("topic_filter_all", f"""WITH {b.VECTORS} SELECT element_pk FROM vectors WHERE confidence >= 0.7
  AND list_contains(topics, 'even') AND list_contains(topics, 'label_8')""")
def topic_filter_all(spark, sf_dir):
    kept = find.topic_conditions(F.col("topics"), F.col("confidence"), include=["even", "label_8"], require_all=True)
    return b.vectors(spark, sf_dir).where(kept).select("element_pk")


DATE_CASES = {
    "within": ({"start": datetime(1997, 1, 1), "end": datetime(1997, 6, 30)}, "ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'"),
    "after": ({"exact": datetime(1998, 1, 1)}, "ts >= TIMESTAMP '1998-01-01'"),
    "before": ({"exact": datetime(1993, 1, 1)}, "ts <= TIMESTAMP '1993-01-01'"),
    "exactly": ({"exact": datetime(1997, 5, 28, 12)}, "ts >= TIMESTAMP '1997-05-28' AND ts < TIMESTAMP '1997-05-29'"),
    "relative_days": ({"days": 90, "now": NOW}, "ts BETWEEN TIMESTAMP '1998-05-03' AND TIMESTAMP '1998-08-01'"),
    "relative_months": ({"months": 6, "now": NOW}, "ts BETWEEN TIMESTAMP '1998-02-02' AND TIMESTAMP '1998-08-01'"),
    "fiscal_year": ({"year": 1996}, "ts BETWEEN TIMESTAMP '1995-07-01' AND TIMESTAMP '1996-06-30 23:59:59'"),
    "calendar_year": ({"year": 1996}, "year(ts) = 1996"),
    "quarter": ({"year": 1997, "quarter": 4}, "year(ts) = 1997 AND quarter(ts) = 4"),
}


def _date_query(operator: str, options: dict, condition: str) -> None:
    @R.query(f"dates_{operator}", f"WITH {b.DATES} SELECT DISTINCT element_pk FROM dates WHERE {condition}")
    def run(spark, sf_dir):
        kept = find.in_bounds(F.col("ts"), find.date_bounds(operator, **options))
        return b.dates(spark, sf_dir).where(kept).select("element_pk").distinct()


for _operator, (_options, _condition) in DATE_CASES.items():
    _date_query(_operator, _options, _condition)


QUERY_VECTOR = [((i * 7) % 11 - 5) / 10 for i in range(64)]
SQL_VECTOR = "[" + ", ".join(f"{x}" for x in QUERY_VECTOR) + "]::DOUBLE[]"


@R.query("vector_search", f"""SELECT vec_id AS element_pk, round(list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}), 6) AS similarity
FROM embeddings WHERE label IN (1, 2, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}) DESC, vec_id LIMIT 20""")
def vector_search(spark, sf_dir):
    hits = search.vector_search(b.vectors(spark, sf_dir), vectors.literal(QUERY_VECTOR), 20, F.col("label").isin(1, 2, 3))
    return hits.withColumn("similarity", F.round("similarity", 6))


@R.query("vector_search_dot", f"""SELECT vec_id AS element_pk, round(list_inner_product(embedding::DOUBLE[], {SQL_VECTOR}), 6) AS similarity
FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {SQL_VECTOR}) DESC, vec_id LIMIT 15""")
def vector_search_dot(spark, sf_dir):
    hits = search.vector_search(b.vectors(spark, sf_dir), vectors.literal(QUERY_VECTOR), 15, metric="dot_product")
    return hits.withColumn("similarity", F.round("similarity", 6))


@R.query("vector_search_euclidean", f"""SELECT vec_id AS element_pk, round(1 / (1 + list_distance(embedding::DOUBLE[], {SQL_VECTOR})), 6) AS similarity
FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {SQL_VECTOR}), vec_id LIMIT 15""")
def vector_search_euclidean(spark, sf_dir):
    hits = search.vector_search(b.vectors(spark, sf_dir), vectors.literal(QUERY_VECTOR), 15, metric="euclidean")
    return hits.withColumn("similarity", F.round("similarity", 6))


@R.query("vector_search_in_dates", f"""WITH {b.DATES} SELECT vec_id AS element_pk, round(list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}), 6) AS similarity
FROM embeddings WHERE vec_id IN (SELECT element_pk FROM dates WHERE year(ts) = 1996)
ORDER BY list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}) DESC, vec_id LIMIT 10""")
def vector_search_in_dates(spark, sf_dir):
    kept = b.dates(spark, sf_dir).where(find.in_bounds(F.col("ts"), find.date_bounds("calendar_year", year=1996)))
    rows = b.vectors(spark, sf_dir).join(kept.select("element_pk"), "element_pk", "left_semi")
    hits = search.vector_search(rows, vectors.literal(QUERY_VECTOR), 10)
    return hits.withColumn("similarity", F.round("similarity", 6))


@R.query("vector_search_with_topic", f"""WITH {b.VECTORS} SELECT element_pk, round(list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}), 6) AS similarity
FROM vectors WHERE confidence >= 0.7 AND list_contains(topics, 'even')
ORDER BY list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}) DESC, element_pk LIMIT 10""")
def vector_search_with_topic(spark, sf_dir):
    kept = find.topic_conditions(F.col("topics"), F.col("confidence"), include=["even"])
    hits = search.vector_search(b.vectors(spark, sf_dir), vectors.literal(QUERY_VECTOR), 10, kept)
    return hits.withColumn("similarity", F.round("similarity", 6))


def store(spark, sf_dir) -> search.Store:
    """Embeddings as elements: type by label, metadata in JSON, dates from the orders of the same number."""
    v = b.vectors(spark, sf_dir)
    elements = v.select(
        "element_pk",
        "doc_id",
        F.when(F.col("label") < 5, "paragraph").otherwise("header").alias("element_type"),
        F.concat(F.lit("element "), F.col("element_pk").cast("string")).alias("text"),
        F.concat(F.lit('{"k": '), (F.col("element_pk") % 10).cast("string"), F.lit("}")).alias("metadata"),
        F.lit("embeddings").alias("source"),
        F.lit(None).cast("string").alias("parent_id"),
    )
    return search.Store(elements, v.select("element_pk", "embedding", "topics", "confidence"), b.dates(spark, sf_dir))


BASE = f"""{b.VECTORS}, {b.DATES}, el AS (
  SELECT element_pk, doc_id, CASE WHEN label < 5 THEN 'paragraph' ELSE 'header' END AS element_type, element_pk % 10 AS k FROM vectors),
e AS (SELECT element_pk, list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}) AS s FROM vectors),
t AS (SELECT element_pk, confidence AS s FROM vectors WHERE confidence >= 0.7 AND list_contains(topics, 'even')),
d AS (SELECT DISTINCT element_pk FROM dates WHERE year(ts) = 1996)"""
VECTOR = search.Embedding(tuple(QUERY_VECTOR), threshold=0.05)
EVEN = search.Topic(("even",))
IN_1996 = search.Date("calendar_year", year=1996)


def _search(name: str, group: search.Group, sql: str, **options) -> None:
    @R.query(name, f"WITH {BASE} {sql}")
    def run(spark, sf_dir):
        ranked = store(spark, sf_dir).ranked(search.Query(group, **options))
        return ranked.withColumn("final_score", F.round("final_score", 6))


_search(
    "search_and_weighted",
    search.Group((VECTOR, EVEN, IN_1996)),
    """SELECT e.element_pk, round((e.s + t.s * 0.5 + 0.3) / 1.8, 6) AS final_score
    FROM e JOIN t USING (element_pk) JOIN d USING (element_pk) WHERE e.s >= 0.05""",
)
for _fusion, _expression in {
    "add": "e.s + t.s * 0.5",
    "multiply": "e.s * (t.s * 0.5)",
    "max": "greatest(e.s, t.s * 0.5)",
}.items():
    _search(
        f"search_and_{_fusion}",
        search.Group((VECTOR, EVEN)),
        f"SELECT e.element_pk, round({_expression}, 6) AS final_score FROM e JOIN t USING (element_pk) WHERE e.s >= 0.05",
        fusion=_fusion,
    )
_search(
    "search_or",
    search.Group((VECTOR, EVEN), "OR"),
    """SELECT element_pk, round((coalesce(es, 0) + coalesce(ts, 0) * 0.5) / ((es IS NOT NULL)::INT + (ts IS NOT NULL)::INT * 0.5), 6) AS final_score
    FROM (SELECT element_pk, e.s AS es, t.s AS ts FROM (SELECT * FROM e WHERE s >= 0.05) e FULL JOIN t USING (element_pk))""",
)
_search(
    "search_not",
    search.Group((VECTOR, EVEN, IN_1996), "NOT"),
    """SELECT element_pk, round(s, 6) AS final_score FROM e WHERE s >= 0.05
    AND element_pk NOT IN (SELECT element_pk FROM t) AND element_pk NOT IN (SELECT element_pk FROM d)""",
)
_search(
    "search_single_not",
    search.Group((EVEN,), "NOT"),
    "SELECT element_pk, 1.0::DOUBLE AS final_score FROM el WHERE element_pk NOT IN (SELECT element_pk FROM t)",
)
_search(
    "search_nested",
    search.Group(
        (search.Element(types=("paragraph",)),),
        groups=(search.Group((EVEN, search.Metadata(ranges={"k": {"gte": 7}})), "OR"), search.Group((VECTOR, IN_1996), "NOT")),
    ),
    """SELECT el.element_pk, round((1 + e.s + coalesce(t.s * 0.5, 0) + (k >= 7)::INT)
        / (2 + (t.s IS NOT NULL)::INT * 0.5 + (k >= 7)::INT), 6) AS final_score
    FROM el JOIN e USING (element_pk) LEFT JOIN t USING (element_pk)
    WHERE element_type = 'paragraph' AND e.s >= 0.05 AND (t.s IS NOT NULL OR k >= 7) AND element_pk NOT IN (SELECT element_pk FROM d)""",
)
_search(
    "search_custom_weights",
    search.Group((VECTOR, EVEN)),
    "SELECT e.element_pk, round((e.s * 2 + t.s) / 3, 6) AS final_score FROM e JOIN t USING (element_pk) WHERE e.s >= 0.05",
    weights={"embedding_similarity": 2.0, "topic_confidence": 1.0},
)


@R.query("search_page", f"""WITH {BASE} SELECT e.element_pk, round((e.s + t.s * 0.5) / 1.5, 6) AS final_score, doc_id, element_type
FROM e JOIN t USING (element_pk) JOIN el USING (element_pk) WHERE e.s >= 0.05 ORDER BY (e.s + t.s * 0.5) / 1.5 DESC, element_pk LIMIT 5 OFFSET 5""")
def search_page(spark, sf_dir):
    query = search.Query(search.Group((VECTOR, EVEN)), limit=5, offset=5)
    page = store(spark, sf_dir).run(query)
    return page.select("element_pk", F.round("final_score", 6).alias("final_score"), "doc_id", "element_type")


FTS = f"""{b.LINES}, el AS (SELECT doc_id * 100000 + pos AS element_pk, text FROM lines),
tok AS (SELECT element_pk, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM el),
stat AS (SELECT count(*) AS docs, avg(len(tokens)) AS mean_length FROM tok),
post AS (SELECT token, element_pk, length, count(*) AS tf FROM (SELECT element_pk, len(tokens) AS length, unnest(tokens) AS token FROM tok) GROUP BY ALL)"""


def _fts_elements(spark, sf_dir):
    rows = b.lines(spark, sf_dir)
    return rows.select((F.col("doc_id") * 100000 + F.col("pos")).alias("element_pk"), "text")


@R.query("bm25", f"""WITH {FTS}, df AS (SELECT token, count(*) AS df FROM post WHERE token IN ('the', 'was') GROUP BY token)
SELECT element_pk, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 5) AS text_score
FROM post JOIN df USING (token), stat GROUP BY element_pk HAVING count(*) = 2""")
def bm25(spark, sf_dir):
    scored = fulltext.bm25_scan(_fts_elements(spark, sf_dir), ["the", "was"])
    return scored.withColumn("text_score", F.round("text_score", 5))


@R.query("bm25_indexed", f"""WITH {FTS}, df AS (SELECT token, count(*) AS df FROM post WHERE token IN ('the', 'was') GROUP BY token)
SELECT element_pk, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 5) AS text_score
FROM post JOIN df USING (token), stat GROUP BY element_pk""")
def bm25_indexed(spark, sf_dir):
    rows = _fts_elements(spark, sf_dir)
    scored = fulltext.bm25(fulltext.postings(rows), fulltext.index_statistics(rows), ["The", "was"], require_all=False)
    return scored.withColumn("text_score", F.round("text_score", 5))


@R.query("postings_summary", f"WITH {FTS} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY token HAVING count(*) >= 20")
def postings_summary(spark, sf_dir):
    index = fulltext.postings(_fts_elements(spark, sf_dir))
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where("df >= 20")


@R.query("highlight", r"SELECT doc_id, regexp_replace(text, '\b(the|was)\b', '<b>\1</b>', 'gi') AS marked FROM documents")
def highlight(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", fulltext.highlight(F.col("text"), ["the", "was"]).alias("marked"))


@R.query("hybrid_search", f"""WITH {FTS.replace("el AS (SELECT doc_id * 100000 + pos AS element_pk, text FROM lines)", "el AS (SELECT doc_id AS element_pk, text FROM documents)")}, df AS (SELECT token, count(*) AS df FROM post WHERE token IN ('the', 'was') GROUP BY token),
y AS (SELECT element_pk, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS text_score
  FROM post JOIN df USING (token), stat GROUP BY element_pk HAVING count(*) = 2),
x AS (SELECT vec_id AS element_pk, list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR}) AS s FROM embeddings)
SELECT element_pk, round(least(coalesce(text_score / 10, 0), 1) * 0.4 + coalesce(s, 0) * 0.6, 6) AS final_score FROM y FULL JOIN x USING (element_pk)""")
def hybrid_search(spark, sf_dir):
    hits = b.vectors(spark, sf_dir).select("element_pk", vectors.cosine(F.col("embedding"), vectors.literal(QUERY_VECTOR)).alias("similarity"))
    text = fulltext.bm25_scan(_documents(spark, sf_dir), ["the", "was"], key="doc_id")
    return search.hybrid(text, hits, 0.4, 0.6, cap=True).withColumn("final_score", F.round("final_score", 6))


@R.query("hashing_embedding_table", """WITH tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM tok),
c AS (SELECT doc_id, (h % 16)::INT AS i, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n FROM h GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM c GROUP BY ALL)
SELECT doc_id, i, round(n / z, 6) AS x FROM c JOIN z USING (doc_id) WHERE n <> 0""".replace("\\\\p", "\\p"))
def hashing_embedding_table(spark, sf_dir):
    found = vectors.hashing_embeddings(_documents(spark, sf_dir), "doc_id", "text", 16)
    return found.select("doc_id", F.posexplode("embedding").alias("i", "x")).where("x <> 0").select("doc_id", "i", F.round("x", 6).alias("x"))


@R.query("hashing_embedding", """WITH tok AS (
  SELECT turn, conv_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS tokens FROM conversations),
h AS (SELECT conv_id, turn, ('0x' || substr(md5(unnest(tokens)), 1, 8))::BIGINT AS h FROM tok),
c AS (SELECT conv_id, turn, h % 8 AS i, sum(CASE WHEN (h // 8) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n FROM h GROUP BY ALL),
z AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS z FROM c GROUP BY ALL)
SELECT conv_id, turn, i, round(CASE WHEN z > 0 THEN n / z ELSE 0 END, 6) AS x FROM c JOIN z USING (conv_id, turn) WHERE n <> 0""".replace("\\\\p", "\\p"))
def hashing_embedding(spark, sf_dir):
    rows = b.table(spark, sf_dir, "conversations")
    found = vectors.hashing_embeddings(rows.select(F.struct("conv_id", "turn").alias("key"), "text"), "key", "text", 8)
    long = found.select("key.conv_id", "key.turn", F.posexplode("embedding").alias("i", "x"))
    return long.where("x <> 0").select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
