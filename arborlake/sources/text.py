"""Plain text and sniffing: paragraphs, statistics, links, content types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of links in plain text.
URL = r"https?://[^\s<>\"')\]]+[^\s<>\"')\].,;:!?]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# Document types by extension.
EXTENSIONS = {
    "pdf": "pdf",
    "docx": "docx",
    "pptx": "pptx",
    "xlsx": "xlsx",
    "md": "markdown",
    "markdown": "markdown",
    "html": "html",
    "htm": "html",
    "json": "json",
    "xml": "xml",
    "csv": "csv",
    "tsv": "csv",
    "parquet": "parquet",
    "txt": "text",
    "text": "text",
    "log": "text",
}


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def paragraphs(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    separator: str = "\n\n",
    min_length: int = 1,
    normalise: bool = True,
    compat: bool = False,
) -> DataFrame:
    """(doc_id, index, text, length, word_count, has_urls, has_emails, content_hash, preview): one row per paragraph.

    Texts are split at the separator and white space is then collapsed inside each
    paragraph; ``compat`` collapses it before the split, which gives one paragraph.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    if compat and normalise:
        body = squeeze(body)
    parts = F.split(body, separator)
    clean = F.transform(parts, squeeze if normalise else F.trim)
    kept = F.filter(clean, lambda x: (F.length(x) >= min_length) & (x != ""))
    rows = documents.select(F.col(key).alias("doc_id"), F.posexplode(kept).alias("index", "text"))
    return rows.select(
        "doc_id",
        "index",
        "text",
        F.length("text").alias("length"),
        F.regexp_count("text", F.lit(r"\S+")).alias("word_count"),
        F.col("text").rlike(URL).alias("has_urls"),
        F.col("text").rlike(EMAIL).alias("has_emails"),
        F.md5("text").alias("content_hash"),
        preview(F.col("text")).alias("preview"),
    )


def statistics(text: Column) -> dict[str, Column]:
    """Characters, words, lines, paragraphs and title (the first non-empty line, 100 characters)."""
    rows = F.split(text, "\n")
    full = F.filter(rows, lambda x: F.trim(x) != "")
    return {
        "char_count": F.length(text),
        "word_count": F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")),
        "line_count": F.size(rows),
        "paragraph_count": F.size(F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != "")),
        "title": F.left(F.trim(F.get(full, F.lit(0))), F.lit(100)),
    }


def links(rows: DataFrame, key: str = "element_pk", text: str = "text") -> DataFrame:
    """(key, link_type, target): URLs and mail addresses in order of kind and place."""
    found = F.concat(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(URL), F.lit(0)), lambda x: F.struct(F.lit("url").alias("link_type"), x.alias("target"))),
        F.transform(
            F.regexp_extract_all(F.col(text), F.lit(EMAIL), F.lit(0)),
            lambda x: F.struct(F.lit("email").alias("link_type"), F.concat(F.lit("mailto:"), x).alias("target")),
        ),
    )
    return rows.select(F.col(key), F.inline(found))


def line_at(text: Column, number: int) -> Column:
    """A line by number from 1; null beyond the end."""
    return F.get(F.split(text, "\n"), F.lit(number - 1))


def line_range(text: Column, first: int, last: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def type_by_path(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, extension), F.lit("text"))


def csv_likely(text: Column) -> Column:
    """The first five non-empty lines (two at least) hold as many delimiters, give or take one."""
    head = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 5)

    def even(mark: str) -> Column:
        counts = F.transform(head, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        return (F.array_min(counts) > 0) & (F.array_max(counts) - F.array_min(counts) <= 1)

    return (F.size(head) >= 2) & (even(",") | even("\t") | even(";") | even("|"))


def content_type(text: Column) -> Column:
    """json, xml, html, csv, markdown or text, by the first test that holds."""
    start = F.ltrim(text)
    markdown = sum(
        text.rlike(p).cast("int") for p in (r"(?m)^#{1,6}\s", r"(?m)^[-*+]\s", r"\[[^\]]+\]\([^)]+\)", r"(?m)^```", r"\*\*[^*]+\*\*")
    )
    return (
        F.when(text.isNull() | (start == ""), "text")
        .when(start.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "json")
        .when(start.rlike(r"(?i)^<!doctype html|^<html"), "html")
        .when(start.rlike(r"^<\?xml"), "xml")
        .when(start.rlike(r"(?i)<(?:html|body|div|p|table|a|span|h[1-6])\b"), "html")
        .when(start.rlike(r"(?s)^<([A-Za-z_][\w.-]*)\b.*</\1>\s*$"), "xml")
        .when(csv_likely(text), "csv")
        .when(markdown >= 2, "markdown")
        .when(text.rlike(r"(?m)^#{1,6}\s"), "markdown")
        .otherwise("text")
    )


def binary_type(content: Column) -> Column:
    """Type of a file by its first bytes; zip containers by the parts they name."""
    head = F.hex(F.substring(content, 1, 8))
    names = F.decode(content, "ISO-8859-1")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304") & names.contains("word/"), "docx")
        .when(head.startswith("504B0304") & names.contains("xl/"), "xlsx")
        .when(head.startswith("504B0304") & names.contains("ppt/"), "pptx")
        .when(head.startswith("50415231"), "parquet")
        .when(head.startswith("504B0304"), "zip")
        .otherwise("binary")
    )
