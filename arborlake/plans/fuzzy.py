"""Entities by name: long words of documents merged by likeness, and a dictionary of phrases found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, fuzzy
from ..registry import Registry, table

R = Registry()


def _mentions(spark, sf_dir):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{10,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("entity_type"), F.explode(words).alias("normalized"))


PAIRS = """mention AS (
  SELECT lang AS kind, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{10,}')) AS value FROM documents
), form AS (
  SELECT kind, value, count(*) AS n, length(value) AS l FROM mention GROUP BY kind, value
), pair AS (
  SELECT a.kind, a.value AS a, b.value AS b, 1 - levenshtein(a.value, b.value) / b.l AS ratio
  FROM form a JOIN form b ON a.kind IS NOT DISTINCT FROM b.kind AND b.l BETWEEN a.l AND a.l / 0.85 + 1 AND (a.l < b.l OR a.value < b.value)
  WHERE 1 - levenshtein(a.value, b.value) / b.l >= 0.85
)"""


@R.query("alike_names", f"WITH {PAIRS} SELECT kind, a, b, round(ratio, 6) AS ratio FROM pair")
def alike_names(spark, sf_dir):
    found = fuzzy.alike(_mentions(spark, sf_dir), 0.85, "entity_type", "normalized")
    return found.withColumn("ratio", F.round("ratio", 6))


@R.query("fuzzy_entities", f"""WITH RECURSIVE {PAIRS}, link AS (
  SELECT kind, a, b FROM pair UNION ALL SELECT kind, b, a FROM pair
), reach AS (
  SELECT kind, a AS value, a AS other FROM link UNION SELECT r.kind, r.value, l.b FROM reach r JOIN link l ON r.kind IS NOT DISTINCT FROM l.kind AND r.other = l.a
), owner AS (
  SELECT kind, value, min(other) AS owner FROM reach GROUP BY kind, value
)
SELECT f.kind AS entity_type, coalesce(owner, f.value) AS entity_id, arg_min(f.value, (-n, f.value)) AS name, count(*) AS forms, sum(n)::BIGINT AS mentions
FROM form f LEFT JOIN owner o ON f.kind IS NOT DISTINCT FROM o.kind AND f.value = o.value GROUP BY ALL""")
def fuzzy_entities(spark, sf_dir):
    return fuzzy.merged(_mentions(spark, sf_dir))


def _terms(spark, sf_dir):
    """The first one, two and three words of the benchmark's passages, a type for each length."""
    item = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    first = lambda n: F.struct(F.array_join(F.slice("w", 1, n), " - ").alias("term"), F.lit(f"words{n}").alias("entity_type"))
    return item.select(F.inline(F.array(*map(first, (1, 2, 3)))))


@R.query("dictionary_matches", r"""WITH item AS (
  SELECT regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM benchmark
), term AS (
  SELECT DISTINCT lower(array_to_string(w[1:n], ' ')) AS term, 'words' || n AS entity_type, n FROM item, range(1, 4) AS t(n) WHERE len(w) >= n
), word AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS first
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+') AS w FROM documents)
), three AS (
  SELECT doc_id, first, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY first)
), stretch AS (
  SELECT doc_id, first, 1 AS n, w AS raw FROM three UNION ALL SELECT doc_id, first, 2, w || ' ' || w2 FROM three
  UNION ALL SELECT doc_id, first, 3, w || ' ' || w2 || ' ' || w3 FROM three
), hit AS (
  SELECT doc_id, entity_type, term, first, s.n, raw FROM stretch s JOIN term t ON s.n = t.n AND lower(raw) = term
)
SELECT doc_id, entity_type, term, first, n AS n_words, raw FROM hit h
WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.n > h.n AND o.first <= h.first AND o.first + o.n >= h.first + h.n)""")
def dictionary_matches(spark, sf_dir):
    found = dictionary.matches(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), key="doc_id")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return found.select("doc_id", "entity_type", "term", long("begin", "first"), long("n_words", "n_words"), "raw")
