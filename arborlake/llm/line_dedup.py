"""Line deduplication by site-relative frequency.

Pages are grouped by host.  A line's ratio is the number of the host's pages that
contain it over the host's pages; lines above a boilerplate ratio are dropped from
all pages of that host.  Lines are counted by hash first and by their text only
where the hash is frequent.  The lines that go are few per host (at most distinct
lines per page / ratio), so pages meet them as one set per host: no page's text is
shuffled, unless the sets of all hosts together are too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, prepare, written

#: Tags, comments and unseen elements, each of which ends a line.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host (with port) of a URL; empty if it has none or is null."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(text: Column) -> Column:
    """Non-empty lines, spaces trimmed at both ends; null text has none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def text_of_html(html: Column) -> Column:
    return F.regexp_replace(html, F.lit(MARKUP), F.lit("\n"))


def drop_boilerplate(
    pages: DataFrame,
    *,
    key: str = "page_id",
    host: Column,
    text: Column,
    ratio: float = 0.3,
    min_pages: int = 3,
) -> DataFrame:
    """(key, host, host_pages, n_lines, n_dropped, text) for every row, repeated rows included.

    A line is dropped where the share of the host's pages that contain it exceeds
    ``ratio`` and at least ``min_pages`` of them do; the rest keep their order and are
    joined by line feeds.  Pages without a host form one group, named "".  Null or
    empty texts have no lines and give the empty text.  Every row counts as a page.
    """
    prepare(pages.sparkSession)
    lined = written(
        pages.select(F.col(key).alias("key"), host.alias("host"), lines_of(text).alias("lines")), "lines"
    )
    totals = lined.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))

    def frequent(lines: DataFrame, value: str) -> DataFrame:
        counts = lines.groupBy("host", value).agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= min_pages)
        return counts.join(totals, "host").where(F.col("on") > F.lit(ratio) * F.col("host_pages"))

    # first by hash: equal lines have equal hashes, so this finds every frequent line and few others
    hashes = lined.select("host", F.explode(F.transform(F.array_distinct("lines"), lambda x: F.xxhash64(x))).alias("hash"))
    likely = frequent(hashes, "hash").groupBy("host").agg(F.collect_list("hash").alias("likely"))
    candidates, _ = if_small(likely, 8 * F.size("likely"))
    exact = lined.join(candidates, "host").select(
        "host",
        F.explode(F.filter(F.array_distinct("lines"), lambda x: F.array_contains(F.col("likely"), F.xxhash64(x)))).alias("line"),
    )
    sets = frequent(exact, "line").groupBy("host").agg(F.collect_list("line").alias("common"))
    sites, _ = if_small(totals.join(sets, "host", "left"), F.coalesce(F.octet_length(F.array_join("common", "")), F.lit(0)))
    kept = F.when(
        F.col("common").isNotNull(),
        F.filter("lines", lambda x: ~F.array_contains(F.col("common"), x)),
    ).otherwise(F.col("lines"))
    return (
        lined.join(sites, "host")
        .withColumn("kept", kept)
        .select(
            F.col("key").alias(key),
            "host",
            "host_pages",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )
