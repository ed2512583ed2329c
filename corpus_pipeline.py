"""A training corpus from raw documents: quality, exact duplicates, near duplicates, mixture, packing.

STAGES run in order; each gets what its predecessor kept as written Parquet.  All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import exact_dedup, mixing, packing, quality, simhash
from arborlake.llm.common import prepare, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the input's folder."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id."""
    return exact_dedup.deduplicate(docs.select(*COLUMNS))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of at least 0.8: that with the smallest doc_id.

    Rows that share a doc_id stay or go together; those with a null one stay, and so do
    texts without words.
    """
    groups = simhash.similar_groups(docs, words_per_shingle=5, least=(4, 5))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.select(*COLUMNS).join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs.select(*COLUMNS), weights=(5, 2, 1), most=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores, fingerprints by XXH64 and tokenization have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
