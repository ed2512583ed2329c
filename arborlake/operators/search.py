"""Structured search: a tree of criteria compiled to one DataFrame plan.

Every criterion becomes rows (element_pk, branch, score_type, score); groups combine
them by AND, OR or NOT with set semantics; scores of one type are averaged, then the
types are fused.  Nothing is collected: a query is a plan until its caller acts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import find

# Weights of score types in fusion; others weigh 1.
WEIGHTS = {"text_similarity": 1.0, "embedding_similarity": 1.0, "topic_confidence": 0.5, "date_relevance": 0.3}
FUSIONS = ("weighted_avg", "multiply", "add", "max")
SCORED = "element_pk, score_type, score"


@dataclass(frozen=True)
class Text:
    query: str
    threshold: float = 0.7
    operator: str = ">="
    boost: float = 1.0


@dataclass(frozen=True)
class Embedding:
    vector: tuple[float, ...]
    threshold: float = 0.7
    metric: str = "cosine"
    boost: float = 1.0

    def __post_init__(self) -> None:
        if self.metric not in vectors.METRICS:
            raise ValueError(f"unknown metric {self.metric}")


@dataclass(frozen=True)
class Date:
    operator: str
    exact: datetime | None = None
    start: datetime | None = None
    end: datetime | None = None
    days: int | None = None
    months: int | None = None
    year: int | None = None
    quarter: int | None = None
    now: datetime | None = None
    levels: tuple[str, ...] = ()
    boost: float = 1.0

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("operator", "levels", "boost")}
        return find.date_bounds(self.operator, **own)


@dataclass(frozen=True)
class Topic:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    minimum: float = 0.7
    require_all: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Metadata:
    exact: dict = field(default_factory=dict)
    like: dict = field(default_factory=dict)
    ranges: dict = field(default_factory=dict)
    exists: tuple[str, ...] = ()


@dataclass(frozen=True)
class Element:
    types: tuple[str, ...] | None = None
    doc_ids: tuple | None = None
    exclude_doc_ids: tuple | None = None
    sources: tuple | None = None
    parents: tuple | None = None
    min_length: int | None = None
    max_length: int | None = None


CRITERIA = {"text": Text, "embedding": Embedding, "date": Date, "topic": Topic, "metadata": Metadata, "element": Element}


@dataclass(frozen=True)
class Group:
    """Criteria and sub-groups under one operator: AND, OR or NOT (the first without the rest)."""

    criteria: tuple = ()
    operator: str = "AND"
    groups: tuple[Group, ...] = ()

    def __post_init__(self) -> None:
        if self.operator not in ("AND", "OR", "NOT"):
            raise ValueError(f"unknown operator {self.operator}")
        if not self.criteria and not self.groups:
            raise ValueError("a group needs a criterion")

    def kinds(self) -> set[str]:
        own = {name for name, kind in CRITERIA.items() for c in self.criteria if isinstance(c, kind)}
        return own.union(*[g.kinds() for g in self.groups])


@dataclass(frozen=True)
class Query:
    root: Group
    limit: int = 10
    offset: int = 0
    fusion: str = "weighted_avg"
    weights: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.fusion not in FUSIONS:
            raise ValueError(f"unknown fusion {self.fusion}")
        if self.limit < 1 or self.offset < 0:
            raise ValueError("limit must be positive and offset not negative")


def to_dict(query: Query) -> dict:
    def group(g: Group) -> dict:
        return {
            "operator": g.operator,
            "criteria": [{"kind": k} | asdict(c) for c in g.criteria for k, t in CRITERIA.items() if isinstance(c, t)],
            "groups": [group(x) for x in g.groups],
        }

    return {"root": group(query.root), "limit": query.limit, "offset": query.offset, "fusion": query.fusion, "weights": query.weights}


def from_dict(spec: dict) -> Query:
    def value(x):
        return tuple(x) if isinstance(x, list) else x

    def criterion(c: dict):
        own = {k: value(v) for k, v in c.items() if k != "kind"}
        if c["kind"] == "date":
            for name in ("exact", "start", "end", "now"):
                if isinstance(own.get(name), str):
                    own[name] = datetime.fromisoformat(own[name])
        return CRITERIA[c["kind"]](**own)

    def group(g: dict) -> Group:
        return Group(tuple(map(criterion, g.get("criteria", ()))), g.get("operator", "AND"), tuple(map(group, g.get("groups", ()))))

    rest = {k: v for k, v in spec.items() if k != "root"}
    return Query(group(spec["root"]), **rest)


def to_json(query: Query) -> str:
    return json.dumps(to_dict(query), default=lambda x: x.isoformat())


def from_json(text: str) -> Query:
    return from_dict(json.loads(text))


class Builder:
    """Collects criteria step by step; build() checks the result."""

    def __init__(self) -> None:
        self._stack: list[tuple[str, list, list]] = [("AND", [], [])]
        self._options: dict = {}

    def _add(self, criterion) -> Builder:
        self._stack[-1][1].append(criterion)
        return self

    def text(self, query: str, **options) -> Builder:
        return self._add(Text(query, **options))

    def embedding(self, vector, **options) -> Builder:
        return self._add(Embedding(tuple(vector), **options))

    def date(self, operator: str, **options) -> Builder:
        return self._add(Date(operator, **options))

    def last_days(self, days: int, now: datetime) -> Builder:
        return self.date("relative_days", days=days, now=now)

    def calendar_year(self, year: int) -> Builder:
        return self.date("calendar_year", year=year)

    def fiscal_year(self, year: int) -> Builder:
        return self.date("fiscal_year", year=year)

    def in_quarter(self, year: int, quarter: int) -> Builder:
        return self.date("quarter", year=year, quarter=quarter)

    def topics(self, *include: str, **options) -> Builder:
        return self._add(Topic(include, **options))

    def metadata(self, **options) -> Builder:
        return self._add(Metadata(**options))

    def elements(self, **options) -> Builder:
        return self._add(Element(**options))

    def begin(self, operator: str) -> Builder:
        self._stack.append((operator, [], []))
        return self

    def end(self) -> Builder:
        operator, criteria, groups = self._stack.pop()
        self._stack[-1][2].append(Group(tuple(criteria), operator, tuple(groups)))
        return self

    def operator(self, operator: str) -> Builder:
        _, criteria, groups = self._stack.pop()
        self._stack.append((operator, criteria, groups))
        return self

    def options(self, **options) -> Builder:
        self._options |= options
        return self

    def build(self) -> Query:
        if len(self._stack) != 1:
            raise ValueError("a group was not ended")
        operator, criteria, groups = self._stack[0]
        return Query(Group(tuple(criteria), operator, tuple(groups)), **self._options)


class Store:
    """The tables that a search runs over; element_pk names elements in all of them.

    elements: element_pk, doc_id, element_type, text, metadata and further columns.
    embeddings: element_pk, embedding, topics, confidence.  dates: element_pk, ts,
    specificity_level.
    """

    def __init__(self, elements: DataFrame, embeddings: DataFrame | None = None, dates: DataFrame | None = None, embed: Callable[[Column], Column] = vectors.hashing_embedding) -> None:
        self.elements, self.embeddings, self.dates, self.embed = elements, embeddings, dates, embed

    def supports(self) -> set[str]:
        out = {"element", "metadata"}
        if self.embeddings is not None:
            out |= {"text", "embedding", "topic"}
        return out | ({"date"} if self.dates is not None else set())

    def check(self, query: Query) -> None:
        if missing := query.root.kinds() - self.supports():
            raise ValueError(f"not supported: {', '.join(sorted(missing))}")

    # criteria, each to (element_pk, score_type, score)

    def _similar(self, query: Column, kind: str, metric: str, operator: str, threshold: float, boost: float) -> DataFrame:
        scored = self.embeddings.select(
            "element_pk", F.lit(kind).alias("score_type"), vectors.METRICS[metric](F.col("embedding"), query).alias("score")
        )
        return scored.where(find.compare(F.col("score"), operator, threshold)).withColumn("score", F.col("score") * boost)

    def criterion(self, c) -> DataFrame:
        if isinstance(c, Text):
            return self._similar(vectors.constant(self.embeddings.sparkSession, self.embed(F.lit(c.query))), "text_similarity", "cosine", c.operator, c.threshold, c.boost)
        if isinstance(c, Embedding):
            return self._similar(vectors.literal(list(c.vector)), "embedding_similarity", c.metric, ">=", c.threshold, c.boost)
        if isinstance(c, Date):
            kept = find.in_bounds(F.col("ts"), c.bounds())
            if c.levels:
                kept = kept & F.col("specificity_level").isin(list(c.levels))
            return self._scored(self.dates.where(kept).select("element_pk").distinct(), "date_relevance", F.lit(c.boost))
        if isinstance(c, Topic):
            kept = find.topic_conditions(
                F.col("topics"), F.col("confidence"), include=c.include, exclude=c.exclude, minimum=c.minimum, require_all=c.require_all
            )
            return self._scored(self.embeddings.where(kept), "topic_confidence", F.col("confidence") * c.boost)
        if isinstance(c, Metadata):
            kept = find.metadata_conditions(F.col("metadata"), exact=c.exact, like=c.like, ranges=c.ranges, exists=c.exists)
            return self._scored(self.elements.where(kept), "metadata_relevance", F.lit(1.0))
        kept = find.element_conditions(**{f.name: getattr(c, f.name) for f in fields(c)})
        return self._scored(self.elements.where(kept), "element_match", F.lit(1.0))

    @staticmethod
    def _scored(rows: DataFrame, kind: str, score: Column) -> DataFrame:
        return rows.select("element_pk", F.lit(kind).alias("score_type"), score.cast("double").alias("score"))

    def group(self, g: Group) -> DataFrame:
        branches = [self.criterion(c) for c in g.criteria] + [self.group(x) for x in g.groups]
        if g.operator == "NOT":
            first, rest = branches[0], branches[1:]
            if not rest:
                everything = self._scored(self.elements, "element_match", F.lit(1.0))
                return everything.join(first.select("element_pk").distinct(), "element_pk", "left_anti")
            gone = reduce(DataFrame.union, [b.select("element_pk") for b in rest]).distinct()
            return first.join(gone, "element_pk", "left_anti")
        both = reduce(DataFrame.union, [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)])
        if g.operator == "OR" or len(branches) == 1:
            return both.drop("branch")
        # in all branches: one shuffle by element finds them, scores ride along
        rows = both.groupBy("element_pk").agg(
            F.collect_list(F.struct("score_type", "score")).alias("scores"), F.count_distinct("branch").alias("n")
        )
        return rows.where(F.col("n") == len(branches)).select("element_pk", F.inline("scores"))

    def ranked(self, query: Query) -> DataFrame:
        """(element_pk, final_score) of all hits, unordered."""
        self.check(query)
        return fuse(self.group(query.root), query.fusion, query.weights)

    def run(self, query: Query) -> DataFrame:
        """The page of hits, best first, ties by element_pk, joined with their elements."""
        page = self.ranked(query).orderBy(F.desc("final_score"), "element_pk").offset(query.offset).limit(query.limit)
        return page.join(self.elements, "element_pk").orderBy(F.desc("final_score"), "element_pk")


def search_terms(query: Query) -> list[str]:
    """The words that a query asks for, in order: of texts, topics and metadata values, without patterns' marks and repeats."""
    found: list[str] = []

    def walk(g: Group) -> None:
        branches = [*g.criteria, *g.groups]
        if g.operator == "NOT":  # what it leaves out is not asked for
            branches = branches[:1] if len(branches) > 1 else []
        for c in branches:
            if isinstance(c, Group):
                walk(c)
            elif isinstance(c, Text):
                found.extend(c.query.split())
            elif isinstance(c, Topic):
                found.extend(t.replace("%", "") for t in c.include)
            elif isinstance(c, Metadata):
                found.extend(str(v).replace("%", "") for v in [*c.exact.values(), *c.like.values()])

    walk(query.root)
    return list(dict.fromkeys(t for t in found if t))


def fuse(scores: DataFrame, fusion: str = "weighted_avg", weights: dict | None = None) -> DataFrame:
    """(element_pk, final_score) from rows (element_pk, score_type, score)."""
    own = WEIGHTS | (weights or {})
    by_type = scores.groupBy("element_pk", "score_type").agg(F.avg("score").alias("score"))
    weight = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("score_type")), F.lit(1.0)
    )
    weighed = by_type.withColumn("w", weight)
    value = F.col("score") * F.col("w")
    final = {
        "weighted_avg": F.sum(value) / F.sum("w"),
        "add": F.sum(value),
        "max": F.max(value),
        "multiply": F.product(value),
    }[fusion]
    return weighed.groupBy("element_pk").agg(final.alias("final_score"))


def vector_search(embeddings: DataFrame, query: Column, k: int, condition: Column | None = None, metric: str = "cosine") -> DataFrame:
    """(element_pk, similarity): the k most similar of the rows that meet the condition."""
    rows = embeddings if condition is None else embeddings.where(condition)
    scored = rows.select("element_pk", vectors.METRICS[metric](F.col("embedding"), query).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "element_pk").limit(k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, text_weight: float, vector_weight: float, cap: bool) -> DataFrame:
    """(element_pk, final_score): weighted sum of a text score over 10 (capped at 1 if asked) and a similarity."""
    text = F.coalesce(F.col("text_score") / 10, F.lit(0.0))
    text = F.least(text, F.lit(1.0)) if cap else text
    both = text_hits.join(vector_hits, "element_pk", "full_outer")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return both.select("element_pk", (text * text_weight + similarity * vector_weight).alias("final_score"))
