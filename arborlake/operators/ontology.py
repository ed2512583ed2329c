"""Ontologies: declarative term rules, entity derivation and relationship rules as Columns.

An ontology is a small driver-side object; applying it compiles every rule to one
Column expression, so element tables of any size are mapped in one pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize, vectors
from . import tree


Embed = Callable[[Column], Column]


def _spark() -> SparkSession:
    return SparkSession.active()


@dataclass(frozen=True)
class Rule:
    """keywords, regex or semantic; element_type limits it: ``*``, a name or a pattern from the start.

    A semantic rule holds one phrase and hits where the element's embedding is at least
    ``threshold`` similar to the phrase's, but for the rounding of doubles; the similarity is its confidence.
    """

    kind: str
    values: tuple[str, ...]
    confidence: float = 1.0
    element_type: str = "*"
    threshold: float = 0.7

    def __post_init__(self) -> None:
        if self.kind not in ("keywords", "regex", "semantic"):
            raise ValueError(f"unknown rule {self.kind}")

    def score(self, embed: Embed, embedding: Column) -> Column:
        """The rule's confidence in an element, null where it does not hit."""
        if self.kind == "semantic":
            near = vectors.cosine(embedding, vectors.constant(_spark(), embed(F.lit(self.values[0]))))
            found = F.when(near >= self.threshold - 1e-12, near)
        elif self.kind == "keywords":
            found = F.when(F.col("text").rlike(rf"(?i)\b(?:{'|'.join(map(re.escape, self.values))})\b"), self.confidence)
        else:
            found = F.when(F.col("text").rlike("|".join(f"(?:{v})" for v in self.values)), self.confidence)
        if self.element_type == "*":
            return found
        if re.search(r"[^\w]", self.element_type):
            return F.when(F.col("element_type").rlike(f"^(?:{self.element_type})"), found)
        return F.when(F.col("element_type") == self.element_type, found)


@dataclass(frozen=True)
class RelationshipRule:
    """Elements of one term related to elements of another.

    within: ``document``, ``parent``, ``ancestor`` (that ``level`` steps above the parent),
    or ``other`` documents; direction: ``forward`` (source first), ``backward`` or ``any``.
    With phrases, an end's score is the similarity of its embedding to its phrase, which
    must reach its threshold; without, the confidence of its mapping.  combine: average,
    minimum, maximum, product or weighted (by ``weights`` of source and target).
    """

    kind: str
    source: str
    target: str
    within: str = "document"
    direction: str = "any"
    combine: str = "average"
    minimum: float = 0.7
    both_ways: bool = False
    source_phrase: str | None = None
    target_phrase: str | None = None
    source_threshold: float = 0.0
    target_threshold: float = 0.0
    weights: tuple[float, float] = (0.5, 0.5)
    level: int = 0

    def __post_init__(self) -> None:
        if self.within not in ("document", "parent", "ancestor", "other"):
            raise ValueError(f"unknown scope {self.within}")
        if self.combine not in ("average", "minimum", "maximum", "product", "weighted"):
            raise ValueError(f"unknown combination {self.combine}")

    def combined(self, x: Column, y: Column) -> Column:
        a, b = self.weights
        return {
            "average": (x + y) / 2,
            "minimum": F.least(x, y),
            "maximum": F.greatest(x, y),
            "product": x * y,
            "weighted": (x * a + y * b) / (a + b),
        }[self.combine]


@dataclass(frozen=True)
class Ontology:
    name: str
    terms: dict[str, str]
    rules: dict[str, tuple[Rule, ...]] = field(default_factory=dict)
    relationships: tuple[RelationshipRule, ...] = ()

    def __post_init__(self) -> None:
        used = set(self.rules) | {t for r in self.relationships for t in (r.source, r.target)}
        if unknown := used - set(self.terms):
            raise ValueError(f"unknown terms: {', '.join(sorted(unknown))}")


def from_dict(spec: dict) -> Ontology:
    terms = {t["id"]: t["label"] for t in spec["terms"]}
    rules = {
        m["term_id"]: tuple(
            Rule(
                r["type"],
                tuple(r.get("keywords") or [r.get("pattern") or r["semantic_phrase"]]),
                float(r.get("confidence", 1.0)),
                r.get("element_type", "*"),
                float(r.get("confidence_threshold", 0.7)),
            )
            for r in m["rules"]
        )
        for m in spec.get("element_mappings", [])
    }
    relationships = tuple(RelationshipRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in spec.get("relationship_rules", []))
    return Ontology(spec["name"], terms, rules, relationships)


def from_json(text: str) -> Ontology:
    return from_dict(json.loads(text))


def from_yaml(text: str) -> Ontology:
    """Like from_dict, of a YAML text; needs the yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the yaml package; JSON needs none") from e
    return from_dict(yaml.safe_load(text))


class Domains:
    """Ontologies by name, of which some are active; only active ones are applied and searched for terms."""

    def __init__(self, ontologies: list[Ontology] | None = None) -> None:
        self._known = {o.name: o for o in ontologies or []}
        self._active = set(self._known)

    def add(self, ontology: Ontology, active: bool = True) -> None:
        self._known[ontology.name] = ontology
        (self._active.add if active else self._active.discard)(ontology.name)

    def activate(self, name: str) -> None:
        if name not in self._known:
            raise KeyError(name)
        self._active.add(name)

    def deactivate(self, name: str) -> None:
        self._active.discard(name)

    def active(self) -> list[Ontology]:
        return [o for n, o in sorted(self._known.items()) if n in self._active]

    def find_term(self, term: str) -> tuple[str, str] | None:
        """(ontology, label) of the first active ontology, by name, that has the term."""
        return next(((o.name, o.terms[term]) for o in self.active() if term in o.terms), None)

    def map_terms(self, elements: DataFrame, embed: Embed = vectors.hashing_embedding) -> DataFrame | None:
        """The mappings of all active ontologies; None if none is active."""
        out = None
        for o in self.active():
            found = map_terms(elements, o, embed)
            out = found if out is None else out.unionByName(found)
        return out


def merge(name: str, *parts: Ontology) -> Ontology:
    """One ontology of all terms and rules; a later part's term replaces an earlier one's."""
    terms: dict[str, str] = {}
    rules: dict[str, tuple[Rule, ...]] = {}
    relationships: tuple[RelationshipRule, ...] = ()
    for p in parts:
        terms |= p.terms
        for term, own in p.rules.items():
            rules[term] = tuple(dict.fromkeys(rules.get(term, ()) + own))
        relationships += p.relationships
    return Ontology(name, terms, rules, tuple(dict.fromkeys(relationships)))


def _embedded(elements: DataFrame, embed: Embed) -> DataFrame:
    """Elements with their embedding column; without one the texts are embedded, by the hashing embedder in one grouped pass."""
    if "embedding" in elements.columns:
        return elements
    if embed is vectors.hashing_embedding:
        return elements.join(vectors.hashing_embeddings(elements, "element_id"), "element_id")
    return elements.withColumn("embedding", embed(F.col("text")))


def map_terms(elements: DataFrame, ontology: Ontology, embed: Embed = vectors.hashing_embedding) -> DataFrame:
    """(element_id, term, domain, confidence, mapping_rule): the surest rule of each term that hits an element."""
    semantic = any(r.kind == "semantic" for rules in ontology.rules.values() for r in rules)
    if semantic:
        elements = _embedded(elements, embed)
    named, hits = {}, []
    for term, rules in ontology.rules.items():
        own = []
        for i, r in enumerate(rules):
            score = r.score(embed, F.col("embedding") if semantic else F.lit(None)).cast("double")
            if r.kind == "semantic":  # walked once a row, whatever refers to it
                named[f"__{term}_{i}"], score = score, F.col(f"__{term}_{i}")
            own.append(F.when(score.isNotNull(), F.struct(score.alias("confidence"), F.lit(f"{r.kind}:{i}").alias("mapping_rule"))))
        best = F.array_max(F.array_compact(F.array(*own)))
        hits.append(F.when(best.isNotNull(), F.struct(F.lit(term).alias("term"), best["confidence"].alias("confidence"), best["mapping_rule"].alias("mapping_rule"))))
    if named:
        elements = elements.withColumns(named)
    found = elements.select("element_id", F.explode(F.array_compact(F.array(*hits))).alias("m"))
    return found.select("element_id", "m.term", F.lit(ontology.name).alias("domain"), "m.confidence", "m.mapping_rule")


def _ends(elements: DataFrame, mappings: DataFrame, rule: RelationshipRule, embed: Embed) -> tuple[DataFrame, DataFrame]:
    """(element_id, doc_id, parent_id, position, score) of the rule's sources and targets, those below a threshold left out."""
    own = elements if rule.source_phrase is None and rule.target_phrase is None else _embedded(elements, embed)

    def end(term: str, phrase: str | None, threshold: float) -> DataFrame:
        placed = mappings.where(F.col("term") == term).select("element_id", "confidence").join(own, "element_id")
        score = F.col("confidence") if phrase is None else vectors.cosine(F.col("embedding"), vectors.constant(own.sparkSession, embed(F.lit(phrase))))
        return placed.select("element_id", "doc_id", "parent_id", "position", score.alias("score")).where(F.col("score") >= threshold)

    return end(rule.source, rule.source_phrase, rule.source_threshold), end(rule.target, rule.target_phrase, rule.target_threshold)


def relate(elements: DataFrame, mappings: DataFrame, rule: RelationshipRule, embed: Embed = vectors.hashing_embedding, most: int | None = None) -> DataFrame:
    """(source_id, relationship_type, target_reference, confidence) of one rule inside documents.

    Pairs meet on the document, the parent or the ancestor ``level`` steps above the parent.
    By default all pairs that the rule allows; with ``most`` only so many of each document
    (parent, ancestor), found without forming the others: the surest, of equally sure ones
    those of the surer source, then of the surer target, then of the smaller ids.
    Rules across documents go through relate_across.
    """
    if rule.within == "other":
        raise ValueError("use relate_across for pairs of different documents")
    sources, targets = _ends(elements, mappings, rule, embed)
    key = {"document": "doc_id", "parent": "parent_id", "ancestor": "__ancestor"}[rule.within]
    if rule.within == "ancestor":
        above = tree.ancestry(elements).select("element_id", F.try_element_at("ancestor_ids", F.lit(rule.level + 1)).alias("__ancestor"))
        sources, targets = (side.join(above.where("__ancestor IS NOT NULL"), "element_id") for side in (sources, targets))
    if most is not None:
        if rule.combine == "product" and min(rule.source_threshold, rule.target_threshold) < 0:
            raise ValueError("a product of scores below zero has no order by its factors")
        edges = _best_pairs(sources, targets, key, rule, most)
        return _both_ways(edges) if rule.both_ways else edges
    a, b = sources.alias("a"), targets.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.element_id") != F.col("b.element_id"))
    if rule.direction != "any":
        first, second = ("a", "b") if rule.direction == "forward" else ("b", "a")
        on = on & (F.col(f"{first}.position") < F.col(f"{second}.position"))
    edges = a.join(b, on).select(
        F.col("a.element_id").alias("source_id"),
        F.lit(rule.kind).alias("relationship_type"),
        F.col("b.element_id").alias("target_reference"),
        rule.combined(F.col("a.score"), F.col("b.score")).alias("confidence"),
    ).where(F.col("confidence") >= rule.minimum)
    return _both_ways(edges) if rule.both_ways else edges


def _halves(sources: DataFrame, targets: DataFrame, key: str, forward: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into halves (key, level, node), so that two that meet in one are in the wanted order, and any two in order meet in one.

    Positions of a key are numbered; the highest bit in which two numbers differ gives
    level and node, and the one with that bit unset comes first.
    """
    both = sources.withColumn("__side", F.lit(0)).unionByName(targets.withColumn("__side", F.lit(1)))
    of_key = Window.partitionBy(key)
    numbered = both.withColumn("__at", F.dense_rank().over(of_key.orderBy("position"))).withColumn("__last", F.max("__at").over(of_key))
    levels = F.sequence(F.lit(0), F.length(F.bin("__last")) - 1)
    spread = numbered.withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(__at, level + 1)"))
    later = F.expr("shiftright(__at, level) & 1")
    mine = spread.where(later == (F.col("__side") if forward else 1 - F.col("__side")))
    return mine.where("__side = 0"), mine.where("__side = 1")


def _best_pairs(sources: DataFrame, targets: DataFrame, key: str, rule: RelationshipRule, most: int) -> DataFrame:
    """The ``most`` surest pairs of each key, as ``relate`` states their order.

    Combinations never fall as a score rises.  With both sides in order, the pair of the
    i-th source and the j-th target comes after all pairs of earlier ones, i * j - 1 of
    them, or at least (i - 1) * (j - 1) if an element may not meet itself.  So a source
    looks at targets up to most / (i - 1) + 1 only, by their number: in all about
    most * ln(most) meetings, whatever the sides' sizes.
    """
    nodes = [key]
    if rule.direction != "any":
        sources, targets = _halves(sources, targets, key, rule.direction == "forward")
        nodes = [key, "level", "node"]
    listed = Window.partitionBy(*nodes).orderBy(F.desc("score"), "element_id")
    a = sources.withColumn("nth", F.row_number().over(listed)).where(F.col("nth") <= most + 1)
    b = targets.withColumn("nth", F.row_number().over(listed)).where(F.col("nth") <= most + 1)
    reach = F.sequence(F.lit(1), (F.floor(F.lit(most) / F.greatest(F.col("nth") - 1, F.lit(1))) + 1).cast("int"))
    asked = a.select(*nodes, F.col("element_id").alias("source_id"), F.col("score").alias("x"), F.explode(reach).alias("nth"))
    met = asked.join(b.select(*nodes, "nth", F.col("element_id").alias("target_reference"), F.col("score").alias("y")), [*nodes, "nth"])
    pairs = met.withColumn("confidence", rule.combined(F.col("x"), F.col("y")))
    pairs = pairs.where((F.col("source_id") != F.col("target_reference")) & (F.col("confidence") >= rule.minimum))
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc("x"), F.desc("y"), "source_id", "target_reference")
    best = pairs.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
    return best.select("source_id", F.lit(rule.kind).alias("relationship_type"), "target_reference", "confidence")


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target_reference").alias("source_id"), "relationship_type", F.col("source_id").alias("target_reference"), "confidence")
    return edges.union(back).dropDuplicates(["source_id", "target_reference"])


def relate_across(elements: DataFrame, mappings: DataFrame, rule: RelationshipRule, top: int = 20, embed: Embed = vectors.hashing_embedding) -> DataFrame:
    """(source_id, relationship_type, target_reference, confidence): for each source its ``top`` surest targets in other documents.

    Equally sure targets are ordered by their own score, then by id.  As no combination
    falls when the target's score rises, that is one order of the targets for all sources:
    the first 2 * top targets, with at most ``top`` of a document, hold every source's
    best, whatever lies in its own document.  Only these meet the sources.
    """
    sources, targets = _ends(elements, mappings, rule, embed)
    order = [F.desc("score"), "element_id"]
    few = targets.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("nth") <= top)
    best = few.orderBy(*order).limit(2 * top).select(F.col("element_id").alias("target_reference"), F.col("doc_id").alias("__doc"), F.col("score").alias("__score"))
    pairs = sources.join(F.broadcast(best), F.col("doc_id") != F.col("__doc")).select(
        F.col("element_id").alias("source_id"),
        F.lit(rule.kind).alias("relationship_type"),
        "target_reference",
        rule.combined(F.col("score"), F.col("__score")).alias("confidence"),
        "__score",
    ).where(F.col("confidence") >= rule.minimum)
    mine = Window.partitionBy("source_id").orderBy(F.desc("confidence"), F.desc("__score"), "target_reference")
    edges = pairs.withColumn("nth", F.row_number().over(mine)).where(F.col("nth") <= top).drop("nth", "__score")
    return _both_ways(edges) if rule.both_ways else edges


def derive_entities(rows: DataFrame, entity_type: str, name: Column, element: str, attributes: list[str]) -> DataFrame:
    """(entity_id, entity_type, name, attributes, elements, mentions): one entity per normal form of its name.

    The first element (by id) gives name and attributes; mentions counts them all.
    """
    keyed = rows.withColumn("__name", name).withColumn("__key", normalize.slug(name)).where("__key <> ''")
    first = F.min_by(F.struct("__name", F.to_json(F.struct(*attributes)).alias("attributes")), element)
    return keyed.groupBy("__key").agg(first.alias("f"), F.min(element).alias("first_element"), F.count(F.lit(1)).alias("mentions")).select(
        F.concat_ws(":", F.lit(entity_type), "__key").alias("entity_id"),
        F.lit(entity_type).alias("entity_type"),
        F.col("f.__name").alias("name"),
        F.col("f.attributes").alias("attributes"),
        "first_element",
        "mentions",
    )


def changed_entities(current: DataFrame, incoming: DataFrame, model: str | None = None) -> DataFrame:
    """Incoming entities (entity_id, name, entity_type, domain, attributes) that are new or differ from the current ones.

    Attributes are compared as JSON objects, whatever the order of their keys.  With
    ``model``, entities embedded by another one (current column embedding_model) count too.
    """
    plain = lambda c: F.to_json(F.transform(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>"))), lambda e: e))
    old = current.select("entity_id", *[F.col(c).alias(f"__{c}") for c in current.columns if c != "entity_id"])
    both = incoming.join(old.withColumn("__known", F.lit(True)), "entity_id", "left")
    same = F.col("__known")
    for c in ("name", "entity_type", "domain"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    same = same & plain(F.col("attributes")).eqNullSafe(plain(F.col("__attributes")))
    if model is not None:
        same = same & F.col("__embedding_model").eqNullSafe(F.lit(model))
    return both.where(~F.coalesce(same, F.lit(False))).select(*incoming.columns)


def entities_of(entities: DataFrame, mapping: DataFrame, elements: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, entity columns, elements): the entities of each document (or element, by="element_id") and how many of its elements hold them."""
    held = mapping.select("entity_id", "element_id").distinct().join(elements.select(*dict.fromkeys(["element_id", by])), "element_id")
    counted = held.groupBy(by, "entity_id").agg(F.count(F.lit(1)).alias("elements"))
    return counted.join(entities, "entity_id")


def entity_relationships(relationships: DataFrame, entities: DataFrame, entity_id: str | None = None) -> DataFrame:
    """(source_id, relationship_type, target_id, source_name, source_type, target_name, target_type), of one entity at either end if asked.

    An entity's relationships are those from it and those to it, each read by an equality.
    """
    rows = relationships.select("source_id", "relationship_type", "target_id")
    if entity_id is not None:
        rows = rows.where(F.col("source_id") == entity_id).union(rows.where((F.col("target_id") == entity_id) & (F.col("source_id") != entity_id)))
    for end in ("source", "target"):
        named = entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type"))
        rows = rows.join(named, f"{end}_id")
    return rows.select("source_id", "relationship_type", "target_id", "source_name", "source_type", "target_name", "target_type")


def similar_entities(entities: DataFrame, query: Column, k: int, entity_type: str | None = None, threshold: float = 0.0) -> DataFrame:
    """(entity_id, name, similarity): the k entities whose embedding is nearest to the query, ties by id."""
    rows = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    scored = rows.select("entity_id", "name", vectors.cosine(F.col("embedding"), query).alias("similarity")).where(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), "entity_id").limit(k)


def domain_graph(elements: DataFrame, ontology: Ontology, embed: Embed = vectors.hashing_embedding) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mappings, entities, edges) of one ontology: terms mapped, an entity per term and normal text, all rules applied."""
    mappings = map_terms(elements, ontology, embed)
    named = mappings.join(elements.select("element_id", "text"), "element_id")
    entities = None
    for term, label in ontology.terms.items():
        own = derive_entities(named.where(F.col("term") == term).withColumn("label", F.lit(label)), term, F.col("text"), "element_id", ["label"])
        entities = own if entities is None else entities.unionByName(own)
    edges = None
    for rule in ontology.relationships:
        own = (relate_across if rule.within == "other" else relate)(elements, mappings, rule, embed=embed)
        edges = own if edges is None else edges.unionByName(own)
    return mappings, entities, edges
