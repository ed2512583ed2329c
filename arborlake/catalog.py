"""All queries of the package outside the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import extra, fulltext, fuzzy, graph, more, periods, relational, search, stats, structured, text
from .registry import Query

_PLANS = (stats, search, fulltext, fuzzy, periods, text, graph, relational, structured, more, extra)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["vector_search"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for plan in _PLANS for name, q in plan.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.R.sql.items()}
