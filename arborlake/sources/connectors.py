"""Collections behind paged services as a Spark data source.

A service (wiki, mail, tickets, drive) is described by a client class: how many
items there are and how to fetch a page.  Each page is one input partition, so pages
are fetched by executors and retried like any other task.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from . import structured

SCHEMA = "doc_id string, title string, content string, doc_type string, modified timestamp, metadata string"


class Page(InputPartition):
    def __init__(self, offset: int, size: int) -> None:
        self.offset, self.size = offset, size


#: Filters that a client can be asked for, as it sees them.
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class _Pages:
    """What batch and stream readers share: the client and its pages as rows."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.where: list[tuple] = []

    def _client(self):
        module, _, name = self.options["client"].rpartition(".")
        return getattr(importlib.import_module(module), name)(self.options)

    def _asked(self) -> dict:
        return {"where": self.where} if self.where else {}

    def _pages(self, start: int, end: int) -> list[Page]:
        size = int(self.options.get("pagesize", 100))
        return [Page(at, min(size, end - at)) for at in range(start, end, size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for item in self._client().page(partition.offset, partition.size, **self._asked()):
            yield (
                str(item["id"]),
                item.get("title"),
                item.get("content"),
                item.get("doc_type", "text"),
                item.get("modified"),
                json.dumps(item.get("metadata", {}), sort_keys=True),
            )


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self._pages(0, self._client().count(**self._asked()))


class _FilteringReader(_Reader):
    """Sessions that do not push filters to Python sources refuse a reader that takes any."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the columns that the client names in ``pushable``; Spark applies the others."""
        can = getattr(self._client(), "pushable", ())
        for f in filters:
            if type(f) in _OPERATORS and len(f.attribute) == 1 and f.attribute[0] in can:
                self.where.append((f.attribute[0], _OPERATORS[type(f)], f.value))
            else:
                yield f


class _StreamReader(_Pages, DataSourceStreamReader):
    """A service that only grows: the offset is the number of items that were read."""

    def initialOffset(self) -> dict:
        return {"items": int(self.options.get("startingitems", 0))}

    def latestOffset(self) -> dict:
        return {"items": self._client().count()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self._pages(start["items"], end["items"])

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """format("paged").option("client", "package.module.Client"): count() and page(offset, size) of the client are called.

    A client that names columns in ``pushable`` gets comparisons of those as
    ``where=[(column, operator, value), ...]`` in both calls.  As a stream, items are
    numbered in the order in which the service got them, and each is read once.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushfilters") == "true" else _Reader)(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def paged(spark: SparkSession, client: str, **options: str) -> DataFrame:
    """Documents of a service through its client class; filters are pushed where the session allows it for Python sources."""
    spark.dataSource.register(PagedSource)
    options = {"pushfilters": spark.conf.get("spark.sql.python.filterPushdown.enabled"), **options}
    return spark.read.format("paged").option("client", client).options(**options).load()


def paged_stream(spark: SparkSession, client: str, **options: str) -> DataFrame:
    """New documents of a service that only grows, as a stream."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").option("client", client).options(**options).load()


def references(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, field, target): values of ``*_id`` fields and of {"$oid": ...} objects at any depth of JSON texts.

    Texts are parsed, so what stands inside a string value is no reference.
    """
    nodes = structured.json_nodes(documents, key, content).where("error IS NULL AND element_type = 'json_field' AND text IS NOT NULL")
    path = F.regexp_replace("location", r"(?:\[\d+\])+$", "")
    oid = F.col("name") == "$oid"
    holder = F.regexp_extract("location", r"([^.\[\]]+)(?:\[\d+\])*\.\$oid$", 1)
    field = F.when(oid, holder).otherwise(F.regexp_extract(path, r"([^.]+)$", 1))
    rows = nodes.select("doc_id", field.alias("field"), F.col("text").alias("target"), oid.alias("oid"))
    return rows.where("field <> '_id' AND field <> '$' AND (oid OR field LIKE '%\\_id')").select("doc_id", "field", "target").distinct()
