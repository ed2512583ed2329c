"""Finding documents and elements: conditions from plain dictionaries, lists and ranges.

Text patterns compare without regard to case and their ``%`` and ``_`` are wildcards.
All conditions are Columns, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element types by category.
CATEGORIES = {
    "text": ["paragraph", "header", "blockquote", "text_box"],
    "structural": ["root", "page", "body", "headers", "footers", "page_header", "page_footer"],
    "list": ["list", "list_item"],
    "table": ["table", "table_row", "table_header_row", "table_cell", "table_header"],
    "media": ["image", "chart"],
    "code": ["code_block"],
    "presentation": ["presentation_body", "slide", "slide_notes"],
    "data": ["json_object", "json_array", "json_field", "json_item"],
    "xml": ["xml_element", "xml_text", "xml_list", "xml_object"],
}


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def element_types(types: object) -> list[str]:
    """A type, an enumeration member or several of them as a list of names."""
    if types is None:
        return []
    if isinstance(types, str):
        return [types]
    if hasattr(types, "value"):
        return [str(types.value)]
    return [t for x in types for t in element_types(x)]  # type: ignore[union-attr]


def metadata_value(metadata: Column, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}")


def metadata_conditions(
    metadata: Column,
    *,
    exact: dict | None = None,
    like: dict | None = None,
    ranges: dict | None = None,
    exists: Iterable[str] = (),
) -> Column:
    """Exact, pattern, range (gte, lte, gt, lt) and existence conditions on JSON keys, all required."""
    out = [metadata_value(metadata, k) == F.lit(_text(v)) for k, v in (exact or {}).items()]
    out += [metadata_value(metadata, k).ilike(v) for k, v in (like or {}).items()]
    for key, bounds in (ranges or {}).items():
        value = metadata_value(metadata, key).try_cast("double")
        compare = {"gte": value.__ge__, "lte": value.__le__, "gt": value.__gt__, "lt": value.__lt__}
        out += [compare[op](F.lit(float(x))) for op, x in bounds.items()]
    out += [metadata_value(metadata, k).isNotNull() for k in exists]
    return all_of(out)


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def find(rows: DataFrame, query: dict, limit: int | None = 100, order: str | None = None) -> DataFrame:
    """Rows that meet every entry of a query.

    A scalar must be equal, a list holds the allowed values, ``<column>_like`` is a
    pattern, ``metadata`` and ``metadata_like`` look into the JSON column of that name.
    A limit keeps the first rows in order, by default that of the rows' key.
    """
    conditions = []
    for name, wanted in query.items():
        if name == "metadata":
            conditions.append(metadata_conditions(F.col("metadata"), exact=wanted))
        elif name == "metadata_like":
            conditions.append(metadata_conditions(F.col("metadata"), like=wanted))
        elif name.endswith("_like"):
            conditions.append(F.col(name.removesuffix("_like")).ilike(wanted))
        elif name == "element_type":
            conditions.append(F.col(name).isin(element_types(wanted)))
        elif isinstance(wanted, (list, tuple, set)):
            conditions.append(F.col(name).isin(list(wanted)))
        else:
            conditions.append(F.col(name) == F.lit(wanted))
    found = rows.where(all_of(conditions))
    if limit is not None:
        order = order or next((c for c in ("element_pk", "element_id", "doc_id") if c in rows.columns), rows.columns[0])
    if order:
        found = found.orderBy(order)
    return found if limit is None else found.limit(limit)


def by_category(elements: DataFrame, category: str) -> DataFrame:
    return elements.where(F.col("element_type").isin(CATEGORIES[category]))


def containing(elements: DataFrame, text: str, column: str = "text") -> DataFrame:
    return elements.where(F.col(column).ilike(f"%{text}%"))


def leaves(elements: DataFrame) -> DataFrame:
    parents = elements.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("element_id")).distinct()
    return elements.join(parents, "element_id", "left_anti")


def element_conditions(
    *,
    types: object = None,
    doc_ids: Iterable | None = None,
    exclude_doc_ids: Iterable | None = None,
    sources: Iterable | None = None,
    parents: Iterable | None = None,
    min_length: int | None = None,
    max_length: int | None = None,
    text: str = "text",
) -> Column:
    out = []
    if types is not None:
        out.append(F.col("element_type").isin(element_types(types)))
    if doc_ids is not None:
        out.append(F.col("doc_id").isin(list(doc_ids)))
    if exclude_doc_ids is not None:
        out.append(~F.col("doc_id").isin(list(exclude_doc_ids)))
    if sources is not None:
        out.append(F.col("source").isin(list(sources)))
    if parents is not None:
        out.append(F.col("parent_id").isin(list(parents)))
    if min_length is not None:
        out.append(F.length(text) >= min_length)
    if max_length is not None:
        out.append(F.length(text) <= max_length)
    return all_of(out)


def topic_conditions(
    topics: Column, confidence: Column, *, include: Iterable[str] = (), exclude: Iterable[str] = (), minimum: float = 0.7, require_all: bool = False
) -> Column:
    """Confidence, and patterns over a topic array: any (or all) included, none excluded."""
    def some(pattern: str) -> Column:
        return F.exists(topics, lambda t: t.ilike(pattern))

    hits = [some(p) for p in include]
    out = [confidence >= minimum]
    if hits:
        out.append(all_of(hits) if require_all else any_of(hits))
    out += [~some(p) for p in exclude]
    return all_of(out)


def date_bounds(
    operator: str,
    *,
    exact: datetime | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    days: int | None = None,
    months: int | None = None,
    year: int | None = None,
    quarter: int | None = None,
    now: datetime | None = None,
    fiscal_start: int = 7,
) -> tuple[datetime | None, datetime | None]:
    """Inclusive bounds of a date operator: within, after, before, exactly, relative_days,
    relative_months, fiscal_year, calendar_year or quarter.  A month counts 30 days; a
    fiscal year is named after the calendar year in which it ends."""
    from datetime import timedelta

    second = timedelta(seconds=1)

    def need(value, name):
        if value is None:
            raise ValueError(f"{operator} needs {name}")
        return value

    if operator == "within":
        return need(start, "start"), need(end, "end")
    if operator == "after":
        return need(exact, "exact"), None
    if operator == "before":
        return None, need(exact, "exact")
    if operator == "exactly":
        day = need(exact, "exact").replace(hour=0, minute=0, second=0, microsecond=0)
        return day, day + timedelta(days=1, microseconds=-1)
    if operator == "relative_days":
        return need(now, "now") - timedelta(days=need(days, "days")), now
    if operator == "relative_months":
        return need(now, "now") - timedelta(days=30 * need(months, "months")), now
    if operator == "fiscal_year":
        last = need(year, "year") if fiscal_start > 1 else year + 1
        return datetime(last - 1, fiscal_start, 1), datetime(last, fiscal_start, 1) - second
    if operator == "calendar_year":
        return datetime(need(year, "year"), 1, 1), datetime(year + 1, 1, 1) - second
    if operator == "quarter":
        first = 3 * need(quarter, "quarter") - 2
        after = datetime(need(year, "year") + (first == 10), (first + 2) % 12 + 1, 1)
        return datetime(year, first, 1), after - second
    raise ValueError(f"unknown date operator {operator}")


def in_bounds(ts: Column, bounds: tuple[datetime | None, datetime | None]) -> Column:
    low, high = bounds
    out = [ts.isNotNull()]
    if low is not None:
        out.append(ts >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        out.append(ts <= F.lit(high).cast("timestamp_ntz"))
    return all_of(out)


def compare(score: Column, operator: str, threshold: float) -> Column:
    """> >= < <= of scores; = allows a difference under 0.001."""
    table = {
        ">": score > threshold,
        ">=": score >= threshold,
        "<": score < threshold,
        "<=": score <= threshold,
        "=": F.abs(score - threshold) < 0.001,
    }
    return table[operator]


def with_dates(elements: DataFrame, dates: DataFrame, condition: Column, key: str = "element_pk", limit: int | None = None) -> DataFrame:
    """Elements that have a date which meets a condition, in the order of their keys, the first ``limit`` of them."""
    found = elements.join(dates.where(condition).select(F.col("element_pk").alias(key)), key, "left_semi").orderBy(key)
    return found if limit is None else found.limit(limit)


def by_term(mappings: DataFrame, term: str, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """(element_id, confidence) of the elements mapped to a term, the surest first, ties by id."""
    found = mappings.where((F.col("term") == term) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "element_id")
    return (found if limit is None else found.limit(limit)).select("element_id", "confidence")
