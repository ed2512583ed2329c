"""Full text with positions over documents: their first line is the title, of more weight than the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions
from ..registry import Registry, table

R = Registry()
TERMS = ["the", "was", "and"]
WEIGHTS = {"title": 1.0, "body": 0.4}


def _titled(spark, sf_dir):
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", title.alias("title"), F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\n', 1)) + 2)").alias("body")
    )


def _index(spark, sf_dir):
    return positions.positional(_titled(spark, sf_dir), WEIGHTS, "doc_id")


WORDS = r"""split AS (
  SELECT doc_id, len(regexp_extract_all(string_split(coalesce(text, ''), chr(10))[1], '[\p{L}\p{N}]+')) AS n_title,
         list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: lower(w)) AS words FROM documents
), word AS (
  SELECT doc_id, n_title, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM split
), occ AS (
  SELECT doc_id, token, pos, CASE WHEN pos < n_title THEN 1.0 ELSE 0.4 END AS weight FROM word WHERE token IN ('the', 'was', 'and')
)"""

COVERS = (
    WORDS
    + """, latest AS (
  SELECT doc_id, pos, max(CASE WHEN token = 'the' THEN pos END) OVER o AS a, max(CASE WHEN token = 'was' THEN pos END) OVER o AS b,
         max(CASE WHEN token = 'and' THEN pos END) OVER o AS c
  FROM occ WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), cover AS (
  SELECT doc_id, least(a, b, c) AS first, min(pos) AS last FROM latest
  WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY ALL
)"""
)


@R.query("cover_density", f"""WITH {COVERS}, dense AS (
  SELECT c.doc_id, first, count(*) / sum(1 / weight) / (1 + last - first + 1 - count(*)) AS density
  FROM cover c JOIN occ o ON c.doc_id = o.doc_id AND pos BETWEEN first AND last GROUP BY c.doc_id, first, last
)
SELECT doc_id, round(sum(density), 6) AS text_score FROM dense GROUP BY doc_id""")
def cover_density(spark, sf_dir):
    scored = positions.cover_density(_index(spark, sf_dir), TERMS)
    return scored.select(F.col("element_pk").alias("doc_id"), F.round("text_score", 6).alias("text_score"))


@R.query("proximity_search", f"""WITH {COVERS}
SELECT doc_id, min(last - first) + 1 AS n_words, arg_min(first, (last - first) * 1000000000 + first) AS first FROM cover
WHERE last - first < 8 GROUP BY doc_id""")
def proximity_search(spark, sf_dir):
    found = positions.near(_index(spark, sf_dir), TERMS, within=8)
    width = F.col("end") - F.col("begin") + 1
    return found.select(F.col("element_pk").alias("doc_id"), width.cast("long").alias("n_words"), F.col("begin").cast("long").alias("first"))


@R.query("phrase_search", rf"""WITH {WORDS}
SELECT x.doc_id, count(*) AS times, min(x.pos) AS first FROM word x
JOIN word y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND y.token = 'was'
WHERE x.token = 'the' GROUP BY x.doc_id""")
def phrase_search(spark, sf_dir):
    found = positions.phrase(_index(spark, sf_dir), "the was")
    return found.select(
        F.col("element_pk").alias("doc_id"), F.size("begins").cast("long").alias("times"), F.array_min("begins").cast("long").alias("first")
    )


FRAGMENTS = r"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS pieces FROM documents
), occ AS (
  SELECT doc_id, n, token, pos FROM (
    SELECT doc_id, len(pieces) AS n, generate_subscripts(pieces, 1) - 1 AS pos, lower(regexp_extract(unnest(pieces), '[\p{L}\p{N}]+')) AS token FROM cut)
  WHERE token IN ('the', 'was', 'and')
), run AS (
  SELECT doc_id, n, pos, max(pos) OVER o - pos + 1 AS length, count(*) OVER o AS hits,
         max(CASE token WHEN 'the' THEN 1 ELSE 0 END) OVER o + max(CASE token WHEN 'was' THEN 1 ELSE 0 END) OVER o
           + max(CASE token WHEN 'and' THEN 1 ELSE 0 END) OVER o AS terms
  FROM occ WINDOW o AS (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), wide AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, hits DESC, length, pos) AS nth, greatest(length, 10) AS w,
         greatest(pos - (greatest(length, 10) - length) // 2, 0) AS f FROM run
), stretch AS (
  SELECT doc_id, nth, greatest(least(f + w, n) - w, 0) AS f, least(f + w, n) AS t FROM wide
), one AS (
  SELECT * FROM stretch WHERE nth = 1
), two AS (
  SELECT s.doc_id, arg_min(s.f, s.nth) AS f, arg_min(s.t, s.nth) AS t FROM stretch s JOIN one o ON s.doc_id = o.doc_id AND (s.t <= o.f OR s.f >= o.t)
  GROUP BY s.doc_id
), taken AS (
  SELECT doc_id, f, t FROM one UNION ALL SELECT doc_id, f, t FROM two
  UNION ALL SELECT doc_id, 0, least(10, len(pieces)) FROM cut WHERE len(pieces) > 0 AND doc_id NOT IN (SELECT doc_id FROM one)
), said AS (
  SELECT doc_id, f, list_transform(list_concat(pieces[f + 1:t - 1], [regexp_extract(pieces[t], '[\p{L}\p{N}]+')]), lambda p:
    CASE WHEN lower(regexp_extract(p, '[\p{L}\p{N}]+')) IN ('the', 'was', 'and')
         THEN '<b>' || regexp_extract(p, '[\p{L}\p{N}]+') || '</b>' || regexp_replace(p, '^[\p{L}\p{N}]+', '') ELSE p END) AS marked
  FROM taken JOIN cut USING (doc_id)
)
SELECT doc_id, coalesce(string_agg(array_to_string(marked, ''), ' ... ' ORDER BY f), '') AS fragments
FROM cut LEFT JOIN said USING (doc_id) GROUP BY doc_id"""


@R.query("fragments", FRAGMENTS)
def fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", positions.fragments(F.col("text"), TERMS).alias("fragments"))
