"""Search entry points that bundle criteria, joins with documents, and exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search, tree


def unified(
    store: search.Store,
    *,
    vector: list[float] | None = None,
    text: str | None = None,
    topics: list[str] | None = None,
    year: int | None = None,
    between: tuple[datetime, datetime] | None = None,
    types: list[str] | None = None,
    metadata: dict | None = None,
    threshold: float = 0.7,
    limit: int = 10,
    offset: int = 0,
) -> DataFrame:
    """The page of elements that meet all criteria given by name."""
    b = search.Builder().options(limit=limit, offset=offset)
    if vector is not None:
        b.embedding(vector, threshold=threshold)
    if text is not None:
        b.text(text, threshold=threshold)
    if topics:
        b.topics(*topics)
    if year is not None:
        b.calendar_year(year)
    if between is not None:
        b.date("within", start=between[0], end=between[1])
    if types:
        b.elements(types=tuple(types))
    if metadata:
        b.metadata(exact=metadata)
    return store.run(b.build())


def with_content(hits: DataFrame, elements: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits (element_id, score) with their element, their document's source and their outgoing edges in order."""
    out = (
        edges.join(hits.select(F.col("element_id").alias("source_id")), "source_id", "left_semi")
        .groupBy(F.col("source_id").alias("element_id"))
        .agg(F.array_sort(F.collect_list(F.struct("relationship_type", "target_reference"))).alias("edges"))
    )
    own = elements.select("element_id", "doc_id", "element_type", "text").join(hits, "element_id")
    return own.join(documents.select("doc_id", "source"), "doc_id").join(out, "element_id", "left")


def sources_of(hits: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """(source): distinct sources of the documents that hold hits."""
    docs = elements.join(hits.select("element_id"), "element_id", "left_semi").select("doc_id").distinct()
    return documents.join(docs, "doc_id", "left_semi").select("source").distinct()


def flattened(elements: DataFrame, depth: int | None = None) -> DataFrame:
    """(element_id, depth, path): every element with its path from the root."""
    paths = tree.ancestry(elements, depth)
    return paths.select(
        "element_id",
        F.size("ancestor_ids").alias("depth"),
        F.array_join(F.concat(F.reverse("ancestor_ids"), F.array("element_id")), "/").alias("path"),
    )


def as_json(elements: DataFrame) -> DataFrame:
    """(doc_id, json): a document's elements in order as a JSON array."""
    item = F.struct("position", "element_id", "element_type", "text")
    return elements.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))


def as_yaml(elements: DataFrame) -> DataFrame:
    """(doc_id, yaml): a document's elements in order as a YAML list; texts are quoted as JSON, which YAML reads."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("x"))), r'^\{"x":|\}$', "")
    lines = F.concat(*[x for i, c in enumerate(("element_id", "element_type", "text")) for x in (F.lit(f"{'- ' if i == 0 else '  '}{c}: "), quoted(c), F.lit("\n"))])
    inner = F.transform(F.array_sort(F.collect_list(F.struct("position", "element_id", lines.alias("b")))), lambda x: x["b"])
    return elements.groupBy("doc_id").agg(F.array_join(inner, "").alias("yaml"))


def projected(hits: DataFrame, elements: DataFrame, *, score: bool = True, text: bool = True, metadata: bool = False, embeddings: DataFrame | None = None, dates: DataFrame | None = None, topics: bool = False) -> DataFrame:
    """Hits (element_pk, final_score) with the parts of their elements that are asked for, and no more.

    text and metadata are columns of elements, embedding and topics those of embeddings;
    dates (element_pk, ts) come as a sorted array.  Without score the order is by key.
    """
    wanted = ["element_pk", "doc_id", "element_type", *(["text"] if text else []), *(["metadata"] if metadata else [])]
    out = hits.select("element_pk", *(["final_score"] if score else [])).join(elements.select(*wanted), "element_pk")
    if embeddings is not None:
        out = out.join(embeddings.select("element_pk", "embedding", *(["topics"] if topics else [])), "element_pk", "left")
    if dates is not None:
        listed = dates.join(hits.select("element_pk"), "element_pk", "left_semi").groupBy("element_pk").agg(F.sort_array(F.collect_list("ts")).alias("dates"))
        out = out.join(listed, "element_pk", "left")
    return out.orderBy(*([F.desc("final_score")] if score else []), "element_pk")


def as_xml(elements: DataFrame) -> DataFrame:
    """(doc_id, xml): a document's elements in order, text escaped."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<"), "element_type", F.lit(">"), safe, F.lit("</"), "element_type", F.lit(">"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "element_id", body.alias("b")))), lambda x: x["b"]), "")
    return elements.groupBy("doc_id").agg(F.concat(F.lit("<document>"), inner, F.lit("</document>")).alias("xml"))


def previews(elements: DataFrame, length: int) -> DataFrame:
    """(doc_id, preview): the first characters of a document's text."""
    return tree.full_text(elements).select("doc_id", F.left("text", F.lit(length)).alias("preview"))


def export_advice(elements: DataFrame) -> DataFrame:
    """(doc_id, recommended, formats): which reconstructions a document's elements allow."""
    found = tree.detected_format(elements)
    has = elements.groupBy("doc_id").agg(F.bool_or(F.col("element_type").isin("header", "list", "table", "code_block")).alias("shaped"))
    formats = F.when(F.col("shaped"), F.array(F.lit("html"), F.lit("json"), F.lit("markdown"), F.lit("text"), F.lit("xml"))).otherwise(
        F.array(F.lit("json"), F.lit("text"), F.lit("xml"))
    )
    return has.join(found, "doc_id").select("doc_id", F.when(F.col("shaped"), "markdown").otherwise("text").alias("recommended"), F.array_join(formats, ",").alias("formats"))


def merge_entities(mentions: DataFrame, kind: str = "entity_type", name: str = "normalized", order: str = "element_pk") -> DataFrame:
    """(entity_type, normalized, first_raw, mentions, elements): mentions of one type and normal form as one entity."""
    return mentions.groupBy(kind, name).agg(
        F.min_by("raw", F.struct(order, "raw")).alias("first_raw"), F.count(F.lit(1)).alias("mentions"), F.count_distinct(order).alias("elements")
    )


def recent_executions(executions: DataFrame, pipelines: DataFrame, most: int) -> DataFrame:
    """The latest executions with their pipeline's name and duration in seconds."""
    joined = executions.join(pipelines.select("pipeline_id", "name"), "pipeline_id")
    seconds = (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).alias("seconds")
    return joined.orderBy(F.desc("started_at"), "execution_id").limit(most).select("execution_id", "name", "started_at", seconds)
