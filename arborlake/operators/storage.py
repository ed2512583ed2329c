"""Keeping tables current: upserts, cascading deletes, history, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_scratch


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], latest_by: str | None = None) -> DataFrame:
    """Current rows with those of the same key replaced by the latest incoming row of the key.

    latest_by: column of incoming whose largest value is the latest (it need not be in
    current); rows that tie on it, or all without it, go by the values of all columns.
    """
    order = ([latest_by] if latest_by else []) + [c for c in incoming.columns if c != latest_by]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    latest = incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return current.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*current.columns))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Write a table in ``buckets`` partitions by a hash of its keys, so that an upsert rewrites those it touches only."""
    df.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def upsert_buckets(path: str, incoming: DataFrame, keys: list[str], latest_by: str | None = None, buckets: int = 64) -> list[int]:
    """``upsert`` into a table of write_buckets, with the same keys and buckets: the partitions of incoming keys are replaced, others not read.

    The new partitions are complete in a checkpoint before any is replaced.  Gives the
    buckets that were touched.  Keys must have the types they were written with, as
    their hash depends on those.
    """
    spark = incoming.sparkSession
    shared_scratch(spark)
    placed = incoming.withColumn("bucket", _bucket(keys, buckets))
    touched = sorted(r[0] for r in placed.select("bucket").distinct().collect())  # at most one per partition
    if not touched:
        return []
    current = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    new = upsert(current, placed, keys, latest_by).checkpoint()
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame, edges: str | None = None) -> dict[str, DataFrame]:
    """Every table without the rows of the given documents; edges go with their source elements."""
    gone = doc_ids.select("doc_id").distinct()
    out = {name: t.join(gone, "doc_id", "left_anti") for name, t in tables.items() if name != edges}
    if edges:
        dead = tables["elements"].join(gone, "doc_id", "left_semi").select(F.col("element_id").alias("source_id"))
        out[edges] = tables[edges].join(dead, "source_id", "left_anti")
    return out


def history(runs: DataFrame) -> DataFrame:
    """(source_id, content_hash, last_modified, processing_count): latest state of each source."""
    return runs.groupBy("source_id").agg(
        F.max_by("content_hash", F.struct("modified", "content_hash")).alias("content_hash"),
        F.max("modified").alias("last_modified"),
        F.count(F.lit(1)).alias("processing_count"),
    )


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite", **options) -> None:
    """Write a table; format is parquet, orc, json, csv or jdbc (options then name url and dbtable)."""
    writer = df.write.format(format).mode(mode).options(**options)
    if format == "jdbc":
        writer.save()
    else:
        writer.partitionBy(*(partition_by or [])).save(path)


def graph_tables(elements: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label, doc_id) and edges (src, dst, type) for graph stores."""
    vertices = elements.select(F.col("element_id").alias("id"), F.col("element_type").alias("label"), "doc_id")
    return vertices, edges.select(F.col("source_id").alias("src"), F.col("target_reference").alias("dst"), F.col("relationship_type").alias("type"))
