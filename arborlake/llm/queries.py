"""The operators of this package bound to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    hilbert_ann,
    language_id,
    line_dedup,
    mixing,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    token_count,
    vector_codes,
    whitening,
)
from .common import prepare, table

#: Bytes of text in a shard of op7.
SHARD_LIMIT = 1 << 20


def _fold(key: str, folds: int):
    return F.crc32(F.col(key).cast("string")) % folds


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents = table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 5) == 0
    model = language_id.fit(documents.where(~held_out))
    found = language_id.identify(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_count.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512
    )


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, radius=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _fold("doc_id", 4) == 2
    model = quality.fit(documents, labels.where(~held_out))
    scored = quality.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_map(table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(
        table(spark, sf_dir, "pages"),
        host=line_dedup.host_of(F.col("url")),
        text=line_dedup.text_of_html(F.col("html")),
    )
    return cleaned.select(
        "page_id", "host", "host_pages", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"), factor=1024, parts=4, entries=256, rounds=4)
    long = lambda c: F.expr(f"try_cast({c} AS BIGINT)").alias(c)
    return coded.select("vec_id", "code", long("error"), long("label_error"), "codebooks_sha256")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_scan.scan(documents, secret_scan.fit(documents))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    found = whitening.transform(embeddings, whitening.fit(embeddings, factor=256, components=4), components=4)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_language_id,
        op2_token_count,
        op3_hilbert_ann,
        op4_simhash,
        op5_quality,
        op6_mixing,
        op7_sharding,
        op8_line_dedup,
        op9_exact_dedup,
        op10_packing,
        op11_vector_codes,
        op12_secret_scan,
        op13_whitening,
    )
    return {f.__name__: f for f in own}


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size) / weight AS reached,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER before, 0) AS capped,
         coalesce(sum(weight) OVER before, 0) AS capped_weight
  FROM sources
  WINDOW before AS (ORDER BY (3 * source_size) / weight, source ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (total - capped)::DOUBLE / (weights - capped_weight)::DOUBLE AS level FROM ordered
), final AS (
  SELECT min({'reached': reached, 'level': level}).level AS level FROM leveled WHERE level <= reached
), aims AS (
  SELECT source, source_size, least(coalesce(final.level * weight, cap::DOUBLE), cap::DOUBLE) AS target
  FROM leveled LEFT JOIN final ON true
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aims
), draws AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, floor(r.rate)::BIGINT AS whole,
         r.rate - floor(r.rate) AS part, seed,
         ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':' || (seed // 4)), 8 * (seed % 4) + 1, 8))::BIGINT
           / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(32) AS t(seed)
), tried AS (
  SELECT source, seed, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN u < part THEN size ELSE 0 END)
                           - any_value(target)) AS off
  FROM draws GROUP BY source, seed
), best AS (
  SELECT source, arg_min(seed, {'off': off, 'seed': seed}) AS seed FROM tried GROUP BY source
)
SELECT d.doc_id, d.size, d.source_size, d.target,
       d.size * (d.whole + CASE WHEN d.u < d.part THEN 1 ELSE 0 END) AS taken,
       d.whole + CASE WHEN d.u < d.part THEN 1 ELSE 0 END AS copies
FROM draws d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.seed = b.seed
"""

SHARDING_SQL = f"""
WITH slim AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), buckets AS (
  SELECT d AS depth, hash >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM slim, range(61) AS t(d) GROUP BY d, hash >> (60 - d)
), placed AS (
  SELECT s.doc_id, s.n_bytes, b.*,
         row_number() OVER (PARTITION BY s.rowid_ ORDER BY b.depth) AS nth
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM slim) s
  JOIN buckets b ON s.hash >> (60 - b.depth) = b.prefix
  WHERE b.shard_bytes <= {SHARD_LIMIT} OR b.depth = 60
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::INT AS depth, shard_bytes, shard_docs, shard_bytes <= {SHARD_LIMIT} AS fits
FROM placed WHERE nth = 1
"""

LINE_DEDUP_SQL = r"""
WITH lined AS (
  SELECT page_id, row_number() OVER () AS nth,
         lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')) AS host,
         list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''),
           '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', chr(10), 'g'), chr(10)),
           lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages
), totals AS (
  SELECT host, count(*) AS host_pages FROM lined GROUP BY host
), spread AS (
  SELECT host, unnest(list_distinct(lines)) AS line FROM lined
), common AS (
  SELECT s.host, s.line FROM spread s JOIN totals t ON s.host = t.host
  GROUP BY s.host, s.line, t.host_pages HAVING count(*) >= 3 AND count(*) > 0.3 * t.host_pages
), sets AS (
  SELECT host, list(line) AS lines FROM common GROUP BY host
), kept AS (
  SELECT l.page_id, l.host, t.host_pages, l.lines,
         list_filter(l.lines, lambda x: s.lines IS NULL OR NOT list_contains(s.lines, x)) AS kept
  FROM lined l JOIN totals t ON l.host = t.host LEFT JOIN sets s ON l.host = s.host
)
SELECT page_id, host, host_pages, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM kept
"""

EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id ASC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


def vector_codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Rounds of assignment and update, each a pair of common table expressions."""
    near = """
, near{i} AS (
  SELECT nth, vec_id, label, part, x, unnest(e, recursive := true) FROM (
    SELECT v.nth, v.vec_id, v.label, v.part, v.x,
           min({{'far': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
                'entry': b.entry}}) AS e
    FROM cut v JOIN book{i} b ON v.part = b.part GROUP BY ALL)
)"""
    book = """
, mean{j} AS (
  SELECT part, entry, list(m ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, (sum(c) // count(*) - CASE WHEN sum(c) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m
    FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM near{i}) GROUP BY part, entry, pos)
  GROUP BY part, entry
), book{j} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{j} m ON b.part = m.part AND b.entry = m.entry
)"""
    steps = "".join(near.format(i=i) + book.format(i=i, j=i + 1) for i in range(rounds)) + near.format(i=rounds)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS nth, vec_id, label,
         list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cut AS (
  SELECT nth, vec_id, label, p AS part, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) AS t(p)
), book0 AS (
  SELECT part, nth - 1 AS entry, x FROM cut WHERE nth <= {entries}
){steps}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
  FROM near{rounds} GROUP BY nth, vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": MIXING_SQL,
        "op7_sharding": SHARDING_SQL,
        "op8_line_dedup": LINE_DEDUP_SQL,
        "op9_exact_dedup": EXACT_DEDUP_SQL,
        "op11_vector_codes": vector_codes_sql(),
    }
