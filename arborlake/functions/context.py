"""Context for embeddings: tags, truncation, strengths and priorities of related elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract, vectors

# Strength of a related element by its role, and the element types that add a tenth.
ROLE_STRENGTH = {
    "main": 1.0,
    "parent": 0.9,
    "child": 0.7,
    "sibling": 0.6,
    "preceding": 0.5,
    "following": 0.5,
    "references": 0.8,
    "referenced_by": 0.8,
    "contains": 0.9,
    "contained_by": 0.7,
    "related": 0.4,
}
STRONG_TYPES = ["header", "title", "h1", "h2", "h3", "table_header", "section"]


def strength(role: Column, distance: Column, element_type: Column) -> Column:
    """Role's strength, a fifth less per step beyond the first (a tenth at least), a tenth more for headers, 1 at most."""
    base = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ROLE_STRENGTH.items() for x in (F.lit(k), F.lit(v))]), role), F.lit(0.5))
    faded = base * F.greatest(F.lit(0.1), 1 - (distance - 1) * 0.2)
    raised = faded * F.when(element_type.isin(STRONG_TYPES), 1.1).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), raised), 2)


# Element types and phrases that matter for the order of a context.
IMPORTANT_TYPES = ["header", "title", "heading", "summary", "abstract", "conclusion", "definition", "theorem", "equation"]
REFERENCE_PHRASES = ["refers to", "see also", "as defined in", "according to", "based on", "derived from"]
#: critical is the element itself
CRITICAL, HIGH, MEDIUM, LOW, OPTIONAL = 1, 2, 3, 4, 5


def priority(role: Column, distance: Column, element_type: Column, text: Column) -> Column:
    """1 (critical, role main) to 5 (optional) by element type, cue phrases, role and distance (0 is next to it)."""
    by_type = F.when((role == "parent") | ((role == "sibling") & (distance <= 1)), HIGH).otherwise(MEDIUM)
    by_phrase = F.when(distance <= 2, MEDIUM).otherwise(LOW)
    by_role = (
        F.when(role == "parent", F.when(distance == 0, HIGH).otherwise(MEDIUM))
        .when(role == "sibling", F.when(distance <= 1, HIGH).when(distance <= 3, MEDIUM).otherwise(LOW))
        .when(role == "child", F.when(distance == 0, MEDIUM).otherwise(LOW))
        .otherwise(OPTIONAL)
    )
    return (
        F.when(role == "main", CRITICAL)
        .when(F.lower(element_type).isin(IMPORTANT_TYPES), by_type)
        .when(F.lower(text).rlike("|".join(REFERENCE_PHRASES)), by_phrase)
        .otherwise(by_role)
    )


def tag(role: Column, element_type: Column, element_id: Column, level: Column) -> Column:
    """[ROLE:type:id:level=n], 100 characters at most; the level is left out if null."""
    parts = F.concat_ws(":", F.upper(role), element_type, element_id, F.concat(F.lit("level="), level.cast("string")))
    return F.concat(F.lit("["), F.left(parts, F.lit(98)), F.lit("]"))


def parse_tag(text: Column) -> dict[str, Column]:
    form = r"^\[([A-Z_]+):([^:\]]+):([^:\]]+)(?::level=(\d+))?\]"
    names = ("role", "element_type", "element_id", "level")
    return {n: F.nullif(F.regexp_extract(text, form, i + 1), F.lit("")) for i, n in enumerate(names)}


def truncate(text: Column, words: int, marker: str = " ... ") -> Column:
    """Two thirds of the allowed words from the start, the rest from the end."""
    split = F.split(F.trim(text), r"\s+")
    head = words * 2 // 3
    tail = words - head
    short = F.concat(
        F.array_join(F.slice(split, 1, head), " "), F.lit(marker), F.array_join(F.slice(split, F.size(split) - tail + 1, F.lit(tail)), " ")
    )
    return F.when(F.size(split) <= words, F.trim(text)).otherwise(short)


def is_empty_container(element_type: Column, text: Column) -> Column:
    return element_type.isin("div", "span", "section", "article", "body", "list", "table") & (F.trim(F.coalesce(text, F.lit(""))) == "")


def greedy(items: Column, budget: int) -> Column:
    """Ids of the items (structs priority, distance, id, tokens) that fit, in order of priority and distance.

    What does not fit is passed over and smaller later ones may still fit; a critical item
    (priority 1) is cut to what is left instead.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("chosen"))

    def step(s: Column, x: Column) -> Column:
        with_it = F.concat(s["chosen"], F.array(x["id"]))
        return (
            F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).cast("long").alias("used"), with_it.alias("chosen")))
            .when((x["priority"] == CRITICAL) & (s["used"] < budget), F.struct(F.lit(budget).cast("long").alias("used"), with_it.alias("chosen")))
            .otherwise(s)
        )

    return F.aggregate(F.array_sort(items), start, step)["chosen"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(text: Column, words: Column, now: Column, tokens: Column) -> Column:
    most = F.floor(F.size(words) * tokens / F.greatest(now, F.lit(1))).cast("int")
    return F.when(now <= tokens, text).otherwise(F.array_join(F.slice(words, 1, F.greatest(most, F.lit(0))), " "))


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def first_tokens(text: Column, tokens: Column) -> Column:
    """About ``tokens`` tokens of a text's start: words in proportion to the estimate; the text itself if it is shorter."""
    return _let(vectors.token_estimate(text), lambda now: F.when(now <= tokens, text).otherwise(_let(_words(text), lambda words: _cut(text, words, now, tokens))))


ELLIPSIS, ELLIPSIS_TOKENS = "\n[...truncated...]\n", 4


def both_ends(text: Column, tokens: Column) -> Column:
    """A text cut to about ``tokens``: two thirds from its start and one third from its end."""
    return _let(vectors.token_estimate(text), lambda now: _both_ends(text, now, tokens))


def _both_ends(text: Column, now: Column, tokens: Column) -> Column:
    def parts(words: Column) -> Column:
        room = tokens - ELLIPSIS_TOKENS
        head = F.floor(room * 2 / 3)
        tail = F.floor((room - head) * F.size(words) / F.greatest(now, F.lit(1))).cast("int")
        end = F.when(tail > 0, F.array_join(F.slice(words, F.size(words) - tail + 1, tail), " ")).otherwise("")
        cut = F.concat(_cut(text, words, now, head), F.lit(ELLIPSIS), end)
        return F.when(tokens <= ELLIPSIS_TOKENS, _cut(text, words, now, tokens)).otherwise(cut)

    return F.when(now <= tokens, text).otherwise(_let(_words(text), parts))


def fitting(texts: Column, budget: Column, least: int = 50) -> Column:
    """The texts, in order, whose tokens fit the budget; the first that does not is cut if over ``least`` tokens are left.

    Parted by a line of dashes; empty if nothing fits.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("chosen")
    )

    def step(s: Column, x: Column) -> Column:
        left = budget - s["used"]
        state = lambda used, full, more: F.struct(used.cast("long").alias("used"), F.lit(full).alias("full"), F.concat(s["chosen"], more).alias("chosen"))
        nothing = F.array().cast("array<string>")

        def taken(n: Column) -> Column:
            cut = _let(_words(x), lambda words: _cut(x, words, n, left))
            return (
                F.when(n <= left, state(s["used"] + n, False, F.array(x)))
                .when(left > least, state(s["used"], True, F.array(F.concat(cut, F.lit(" [...]")))))
                .otherwise(state(s["used"], True, nothing))
            )

        return F.when(s["full"], s).otherwise(_let(vectors.token_estimate(x), taken))

    return F.array_join(F.aggregate(texts, start, step)["chosen"], "\n---\n")


#: Shares of a context's tokens: the element, its parents, siblings and children.
SHARES = (0.40, 0.25, 0.20, 0.15)


def budgets(now: Column, most: int, shares: tuple[float, ...] = SHARES) -> Column:
    """Tokens for element (of ``now`` tokens), parents, siblings and children, as an array; what the element leaves goes to the others by thirds."""
    own, *others = [int(most * s) for s in shares]

    def rooms(unused: Column) -> Column:
        third = F.floor(unused / 3)
        extra = [third, third, unused - 2 * third]
        return F.array(F.lit(own).cast("long"), *[(F.lit(o) + e).cast("long") for o, e in zip(others, extra)])

    return _let(F.greatest(F.lit(own) - now, F.lit(0)), rooms)


def structured(text: Column, parents: Column, siblings: Column, children: Column, most: int, shares: tuple[float, ...] = SHARES) -> Column:
    """An element's text with its parents', siblings' and children's (arrays in order of nearness), in about ``most`` tokens."""

    def whole(now: Column) -> Column:
        return _let(budgets(now, most, shares), lambda rooms: parts(now, rooms))

    def headed(title: str) -> Callable[[Column], Column]:
        return lambda body: F.when(body != "", F.concat(F.lit(title), body))

    def parts(now: Column, rooms: Column) -> Column:
        found = [F.concat(F.lit("=== Main Content ===\n"), _both_ends(text, now, F.get(rooms, F.lit(0))))]
        for i, (name, texts) in enumerate(zip(("Parent", "Sibling", "Child"), (parents, siblings, children)), 1):
            found.append(_let(fitting(texts, F.get(rooms, F.lit(i))), headed(f"=== {name} Context ===\n")))
        return F.concat_ws("\n\n", *found)

    return _let(vectors.token_estimate(text), whole)


def _escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def xml_element(role: Column, element_type: Column, element_id: Column, text: Column, distance: Column, level: Column | None = None, entities: int = 5) -> Column:
    """<element ...> for the role main, else <context ...>, with role, type, id (30 characters), strength, entities and level."""
    name = F.when(role == "main", "element").otherwise("context")
    short = F.when(F.length(element_id) > 30, F.concat(F.left(element_id, F.lit(27)), F.lit("..."))).otherwise(element_id)
    found = F.array_join(extract.key_entities(text, entities), ",")
    attribute = lambda key, value: F.concat(F.lit(f'{key}="'), value, F.lit('"'))
    attributes = [
        attribute("role", role),
        attribute("type", element_type),
        F.when(element_id != "", attribute("id", _escaped(short))),
        F.when(role != "main", attribute("strength", strength(role, distance, element_type).cast("string"))),
        F.when(found != "", attribute("entities", _escaped(found))),
    ]
    if level is not None:
        attributes.append(attribute("level", level.cast("string")))
    return F.concat(F.lit("<"), name, F.lit(" "), F.concat_ws(" ", *attributes), F.lit(">"), _escaped(F.trim(F.coalesce(text, F.lit("")))), F.lit("</"), name, F.lit(">"))


def xml_document(items: Column, doc_type: Column, doc_id: Column) -> Column:
    """Context elements (an array of texts) between the tags of their document."""
    opening = F.concat(F.lit('<document type="'), _escaped(doc_type), F.lit('" id="'), _escaped(doc_id), F.lit('">'))
    return F.concat_ws("\n", opening, F.array_join(items, "\n"), F.lit("</document>"))


def adapted_shares(depth: Column, children: Column) -> Column:
    """Shares of a context by a document's shape: deep ones favour parents, wide ones children, flat ones siblings."""
    deep, wide, flat = (0.35, 0.40, 0.15, 0.10), (0.35, 0.15, 0.20, 0.30), (0.40, 0.10, 0.40, 0.10)
    listed = lambda v: F.array(*[F.lit(x) for x in v])
    return F.when(depth >= 4, listed(deep)).when(children >= 10, listed(wide)).when(depth <= 1, listed(flat)).otherwise(listed(SHARES))
