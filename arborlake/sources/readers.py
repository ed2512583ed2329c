"""Scans of files, Parquet collections and relational queries as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_scratch
from . import text as tx


def files(spark: SparkSession, path: str, *, pattern: str | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(doc_id, path, content, size, modified, doc_type) of the files below a path.

    include and exclude are regular expressions over the whole path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    if include:
        rows = rows.where(F.col("path").rlike(include))
    if exclude:
        rows = rows.where(~F.col("path").rlike(exclude))
    return rows.select(
        F.md5("path").alias("doc_id"),
        "path",
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        tx.type_by_path(F.col("path")).alias("doc_type"),
    )


def url_allowed(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any include pattern matches (if there are some) and no exclude pattern does."""
    out = F.lit(True)
    if include:
        out = out & url.rlike("|".join(f"(?:{p})" for p in include))
    for p in exclude or []:
        out = out & ~url.rlike(p)
    return out


def composite_id(query: str, columns: list[str]) -> Column:
    """query/column=value/column=value, in the given order; null values are empty."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.concat_ws("/", F.lit(query), *parts)


def partition_values(path: Column) -> Column:
    """map of the name=value folders in a path."""
    pattern = F.lit(r"([^/=]+)=([^/]+)")
    return F.map_from_arrays(F.regexp_extract_all(path, pattern, F.lit(1)), F.regexp_extract_all(path, pattern, F.lit(2)))


def rows_as_json(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(doc_id, content): each row's columns as one JSON object."""
    return rows.select(F.col(key).cast("string").alias("doc_id"), F.to_json(F.struct(*columns)).alias("content"))


def mapped(rows: DataFrame, key: str, contents: list[str], metadata: list[str], most: int | None = None) -> DataFrame:
    """(doc_id, content, metadata): content columns joined by blank lines (null and empty ones left out), others as JSON."""
    filled = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in contents]
    content = F.concat_ws("\n\n", *filled)
    if most is not None:
        content = F.left(content, F.lit(most))
    return rows.select(F.col(key).cast("string").alias("doc_id"), content.alias("content"), F.to_json(F.struct(*metadata)).alias("metadata"))


def sql_documents(spark: SparkSession, query: str, name: str, id_columns: list[str], content: str, metadata: list[str]) -> DataFrame:
    """Documents of a SQL query over registered views; rows without content are left out."""
    rows = spark.sql(query)
    return rows.where(F.trim(F.coalesce(F.col(content).cast("string"), F.lit(""))) != "").select(
        composite_id(name, id_columns).alias("doc_id"),
        F.col(content).cast("string").alias("content"),
        F.to_json(F.struct(*metadata)).alias("metadata"),
    )


def changed(current: DataFrame, history: DataFrame, key: str = "source_id", mark: str = "content_hash") -> DataFrame:
    """Rows that history does not hold with the same mark: new and changed documents."""
    seen = history.select(F.col(key), F.col(mark)).distinct()
    return current.join(seen, [key, mark], "left_anti")


def newer(current: DataFrame, history: DataFrame, key: str = "source_id", at: str = "modified", last: str = "last_modified") -> DataFrame:
    """Rows with a later time than history has, no history, or no time of their own."""
    seen = history.groupBy(key).agg(F.max(last).alias("__last"))
    kept = F.coalesce(F.col(at) > F.col("__last"), F.lit(True))
    return current.join(seen, key, "left").where(kept).drop("__last")


def resolved(base: Column, reference: Column) -> Column:
    """The absolute http(s) URL that a reference on the page ``base`` names (RFC 3986); null for other schemes.

    Dot segments of paths are removed; an empty reference names the page itself.
    """
    whole = r"^(https?:)(//[^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    own = lambda i: F.regexp_extract(base, whole, i)
    ref = F.trim(F.coalesce(reference, F.lit("")))
    folder = F.concat(F.regexp_extract(own(3), r"^(.*/)", 1))
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    absolute = (
        F.when(ref.rlike(r"^(?i)https?://"), ref)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(ref.startswith("//"), F.concat(own(1), ref))
        .when(ref.startswith("/"), F.concat(own(1), own(2), ref))
        .when(ref.startswith("?"), F.concat(own(1), own(2), own(3), ref))
        .when((ref == "") | ref.startswith("#"), F.concat(own(1), own(2), own(3), own(4), tail))
        .otherwise(F.concat(own(1), own(2), folder, ref))
    )
    path = F.regexp_extract(absolute, whole, 3)
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))),
    )
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    plain = F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), end))
    whole_url = F.concat(F.lower(F.regexp_extract(absolute, r"^(?i)(https?:)", 1)), F.regexp_extract(absolute, r"^(?i)https?:(//[^/?#]*)", 1), plain, F.regexp_extract(absolute, r"^[^?#]*([?#].*)$", 1))
    return F.when(absolute.rlike(r"^(?i)https?://[^/?#]"), F.when(parts.isNull() | ~path.contains("/."), absolute).otherwise(whole_url))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", same_host: bool = True) -> DataFrame:
    """(key, target): distinct absolute targets of a page's links, in either quotes or none.

    Relative references are resolved against the page's URL.  Anchors of the page itself
    and other schemes (mailto, javascript) are left out, and other hosts if asked.
    """
    form = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    hrefs = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(form), F.lit(1)),
        lambda h: F.replace(F.regexp_replace(h, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")),
    )
    rows = pages.select(F.col(key), F.col(url).alias("__base"), F.explode(F.array_distinct(hrefs)).alias("__href"))
    rows = rows.select(key, "__base", resolved(F.col("__base"), F.col("__href")).alias("target")).where("target IS NOT NULL")
    rows = rows.where((F.col("target") != F.col("__base")) & ~F.col("target").startswith(F.concat("__base", F.lit("#"))))
    if same_host:
        host = lambda c: F.lower(F.regexp_extract(c, r"^(?i)https?://([^/?#]+)", 1))
        rows = rows.where(host(F.col("target")) == host(F.col("__base")))
    return rows.select(key, "target").distinct()


def file_links(documents: DataFrame, key: str = "doc_id", content: str = "content", kind: str = "doc_type") -> DataFrame:
    """(key, target): local files that a text refers to, by its kind: Markdown links, HTML href and src, wiki [[links]].

    URLs, anchors and mail addresses are left out, fragments and queries cut off.
    """
    body = F.coalesce(F.col(content).cast("string"), F.lit(""))
    found = lambda form: F.regexp_extract_all(body, F.lit(form), F.lit(1))
    marked = F.concat(found(r"\[[^\]]*\]\(\s*<?([^)\s>]+)"), found(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"))
    tagged = found(r"""(?i)\s(?:href|src)\s*=\s*["']([^"']+)["']""")
    targets = F.when(F.col(kind) == "html", tagged).otherwise(F.concat(marked, tagged))
    rows = documents.select(F.col(key), F.explode(F.array_distinct(targets)).alias("target"))
    rows = rows.where(~F.col("target").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)"))
    return rows.select(key, F.trim(F.regexp_replace("target", r"[?#].*$", "")).alias("target")).where("target <> ''").distinct()


def parsed_id(doc_id: Column) -> Column:
    """(query, values): the query name and the column values of a composite id."""
    parts = F.split(doc_id, "/")
    pairs = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    keys = F.transform(pairs, lambda p: F.regexp_extract(p, "^([^=]*)=", 1))
    return F.struct(parts[0].alias("query"), F.map_from_arrays(keys, F.transform(pairs, lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1))).alias("values"))


def by_composite_id(rows: DataFrame, doc_id: str, query: str) -> DataFrame:
    """The rows that a composite id names: its values as a filter that reaches the scan, each cast to its column's type.

    An empty value names null.  An id of another query names no row.
    """
    name, *pairs = doc_id.split("/")
    if name != query:
        return rows.limit(0)
    for pair in pairs:
        column, _, value = pair.partition("=")
        kind = rows.schema[column].dataType
        rows = rows.where(F.col(column).isNull() if value == "" else F.col(column) == F.lit(value).cast(kind))
    return rows


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` links of the seeds at their least depth.

    seeds: column node; edges: columns source, target.  Each round joins the frontier
    only and is checkpointed; a round without new nodes ends the walk.
    """
    shared_scratch(seeds.sparkSession)
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.join(edges, frontier["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier).checkpoint()
    return seen
