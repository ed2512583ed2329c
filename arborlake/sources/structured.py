"""Structured documents as element rows: JSON, CSV, XML, HTML, Markdown, row documents, office files.

Formats that need a tokenizer use one small parser of the standard library per document
inside mapInArrow; types, relations and front matter are native.  All parsers give the
same node columns (NODE), which ``element_tree`` turns into elements with a root each.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Element types of HTML tags; other tags keep their name.
HTML_TYPES = {
    "p": "paragraph",
    "ul": "list",
    "ol": "list",
    "li": "list_item",
    "table": "table",
    "tr": "table_row",
    "td": "table_cell",
    "th": "table_header",
    "img": "image",
    "pre": "code_block",
    "code": "code_block",
    "blockquote": "blockquote",
} | {f"h{i}": "header" for i in range(1, 7)}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "source", "wbr"}
BATCH_ROWS = 10_000
# Words that make a column a key.
IDENTITY_WORDS = ["id", "key", "code", "num", "number"]
#: position counts from 0 in document order; parent is a position, null for the topmost.
NODE = "position int, parent int, element_type string, name string, text string, location string, level int, attributes map<string,string>"


def _parsed(documents: DataFrame, parse: Callable[[object], Iterator[tuple]], fields: str, key: str, content: str) -> DataFrame:
    """One row per tuple that parse yields for a document; a document that cannot be parsed gives one ``error`` column."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    slim = documents.select(F.col(key).alias("doc_id"), F.col(content).alias("content"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {fields}, error string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    width = len(arrow) - 2

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body is None:
                    continue
                try:
                    for r in parse(body):
                        rows.append((doc, *r, None))
                        if len(rows) >= BATCH_ROWS:
                            yield packed(rows)
                            rows = []
                except Exception as e:  # whatever a parser raises over one document concerns that document only
                    rows.append((doc, *[None] * width, f"{type(e).__name__}: {e}"[:200]))
            if rows:
                yield packed(rows)

    return slim.mapInArrow(run, schema)


def element_tree(nodes: DataFrame) -> DataFrame:
    """(element_id, doc_id, parent_id, element_type, position, level, text, attributes) of parsed nodes, with a root per document.

    The root is ``root_<doc_id>`` at position 0; a node's id is ``<doc_id>#<position>``.
    Documents that could not be parsed have their root only, with the error as attribute.
    """
    id_of = lambda c: F.concat_ws("#", F.col("doc_id").cast("string"), c.cast("string"))
    root = F.concat(F.lit("root_"), F.col("doc_id").cast("string"))
    own = nodes.where("error IS NULL").select(
        id_of(F.col("position")).alias("element_id"),
        "doc_id",
        F.when(F.col("parent").isNull(), root).otherwise(id_of(F.col("parent"))).alias("parent_id"),
        "element_type",
        (F.col("position") + 1).alias("position"),
        "level",
        "text",
        "attributes",
    )
    roots = nodes.groupBy("doc_id").agg(F.min("error").alias("error")).select(
        root.alias("element_id"),
        "doc_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("root").alias("element_type"),
        F.lit(0).alias("position"),
        F.lit(None).cast("int").alias("level"),
        F.lit("").alias("text"),
        F.when(F.col("error").isNotNull(), F.create_map(F.lit("error"), F.col("error"))).alias("attributes"),
    )
    return roots.unionByName(own)


class _Nodes(list):
    """Rows of one document in order; a node's position is its place."""

    def add(self, parent: int | None, kind: str, name: str | None = None, text: str | None = "", location: str | None = None, level: int | None = None, **attributes) -> int:
        own = {k: str(v) for k, v in attributes.items() if v is not None}
        self.append((len(self), parent, kind, name, text, location, level, own or None))
        return len(self) - 1


# JSON


def _json_rows(depth: int | None, flatten_arrays: bool) -> Callable[[object], Iterator[tuple]]:
    def parse(body):
        text = body.decode("utf-8") if isinstance(body, bytes) else body
        # objects as lists of pairs, numbers as they are written
        top = json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs), parse_int=str, parse_float=str, parse_constant=str)
        position, stack = 0, [("$", "", None, 0, top)]
        while stack:
            path, name, parent, level, value = stack.pop()
            if depth is not None and level >= depth:
                continue
            if isinstance(value, tuple):
                kind, below = "json_object", [(f"{path}.{k}", k, v) for k, v in value[1]]
            elif isinstance(value, list):
                kind, below = "json_array", [(f"{path}[{i}]", "", v) for i, v in enumerate(value)]
            else:
                kind, below = "json_field", []
            own = None if below or kind != "json_field" or value is None else {True: "true", False: "false"}.get(value, value) if isinstance(value, bool) else value
            if kind == "json_array" and flatten_arrays and parent is not None:
                stack += [(p, name, parent, level, v) for p, _, v in reversed(below)]
                continue
            marks = {}
            if kind == "json_field" and re.search(r"(?i)(?:^|_)(?:id|key|code|uuid)$", name):
                marks["identity"] = "true"
            if isinstance(own, str) and re.match(r"\d{4}-\d{2}-\d{2}(?:[T ]|$)", own):
                marks["temporal"] = "true"
            yield position, parent, kind, name, own, path, level, marks or None
            stack += [(p, n, position, level + 1, v) for p, n, v in reversed(below)]
            position += 1

    return parse


def json_nodes(documents: DataFrame, key: str = "doc_id", content: str = "content", depth: int | None = None, flatten_arrays: bool = False) -> DataFrame:
    """(doc_id, node columns, error): all nodes of each JSON text, every level unless ``depth`` limits them.

    Numbers keep their notation.  flatten_arrays: items hang below the array's parent.
    Attributes mark fields that are identities by name and values that begin like dates.
    """
    return _parsed(documents, _json_rows(depth, flatten_arrays), NODE, key, content)


def json_elements(documents: DataFrame, key: str = "doc_id", content: str = "content", depth: int | None = None) -> DataFrame:
    """(doc_id, path, element_type, name, value): all nodes of each JSON text; texts that are no JSON give no rows."""
    found = json_nodes(documents, key, content, depth).where("error IS NULL")
    return found.select("doc_id", F.col("location").alias("path"), "element_type", "name", F.col("text").alias("value"))


def json_type(text: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; null if it is none."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )


def json_preview(text: Column, length: int = 100) -> Column:
    """A scalar as it is, an object or array as compact JSON, cut to ``length`` characters with an ellipsis."""
    value = F.try_parse_json(text)
    plain = F.when(json_type(text).isin("object", "array"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    return F.when(F.length(plain) > length, F.concat(F.left(plain, F.lit(length - 3)), F.lit("..."))).otherwise(plain)


# CSV


# Delimiters and quotes that a CSV text may have; of equally good ones the first.
DELIMITERS, QUOTES = [",", ";", "\t", "|"], ['"', "'"]
_NUMBER = r"^\s*[+-]?\d+(?:[.,]\d+)*\s*$"


def csv_dialect(text: Column, lines: int = 20, head: int = 1 << 16) -> Column:
    """(delimiter, quote, header) of a CSV text, judged by its first ``lines`` non-empty lines.

    A quote is the one that stands more often at the ends of fields.  Quoted stretches are
    set aside; of the delimiters, that one is taken with the most lines that have the same
    number of fields, if that is two or more, then that with more fields.  The first line
    is a header unless it has a number in a column that has numbers in at least half of
    the other lines.  Only ``head`` characters are looked at; that concerns the dialect,
    not what is read.
    """
    start = F.regexp_replace(F.left(F.coalesce(text, F.lit("")), F.lit(head)), r"^[﻿\r\n]+", "")
    # transform over an array of one binds a value that is read several times
    once = lambda value, f: F.transform(F.array(value), f)[0]

    def quoted(start: Column) -> Column:
        ends = lambda q: F.size(F.split(start, rf"(?m)(?:^|[,;\t|] ?){q}|{q}(?:$|[,;\t|])"))
        return F.when(ends("'") > ends('"'), F.lit("'")).otherwise(F.lit('"'))

    def listed(start: Column, quote: Column) -> Column:
        # possessive, so that long stretches need no stack; one that the head cuts off ends with it
        bare = lambda q: F.regexp_replace(start, rf"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+(?:{q}|$)", "q")
        cleaned = F.when(quote == "'", bare("'")).otherwise(bare('"'))
        return F.slice(F.filter(F.split(cleaned, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), 1, lines)

    def fields(line: Column, mark: str) -> Column:
        return F.split(line, f"[{mark}]")

    def scored(rows: Column, mark: str, nth: int) -> Column:
        counts = F.transform(rows, lambda x: F.size(fields(x, mark)))
        alike = lambda c: F.size(F.filter(counts, lambda o: o == c))
        best = F.array_max(F.transform(counts, lambda c: F.struct(alike(c).alias("lines"), c.alias("fields"))))
        good = F.coalesce(best["fields"] > 1, F.lit(False))
        seen = lambda c: F.when(good, c).otherwise(0)
        return F.struct(seen(best["lines"]).alias("lines"), seen(best["fields"]).alias("fields"), F.lit(-nth).alias("nth"), F.lit(mark).alias("mark"))

    def headed(rows: Column, mark: str) -> Column:
        number = lambda line, j: F.coalesce(F.get(fields(line, mark), j).rlike(_NUMBER), F.lit(False))
        rest = F.slice(rows, 2, lines)
        same = lambda j: number(rows[0], j) & (2 * F.size(F.filter(rest, lambda r: number(r, j))) >= F.size(rest))
        return F.when(F.size(rows) < 2, True).otherwise(~F.exists(F.sequence(F.lit(0), F.size(fields(F.get(rows, F.lit(0)), mark)) - 1), same))

    def judged(rows: Column, quote: Column) -> Column:
        def told(best: Column) -> Column:
            held = F.when(F.size(rows) < 2, True)
            for m in DELIMITERS:
                held = held.when(best == m, headed(rows, m))
            return F.struct(best.alias("delimiter"), quote.alias("quote"), held.alias("header"))

        return once(F.array_max(F.array(*[scored(rows, m, i) for i, m in enumerate(DELIMITERS)]))["mark"], told)

    return once(start, lambda s: once(quoted(s), lambda q: once(listed(s, q), lambda rows: judged(rows, q))))


def _csv_rows(most: int | None) -> Callable[[object], Iterator[tuple]]:
    """A parser of texts that begin with their delimiter, quote and H where the first line is a header."""

    def parse(body):
        csv.field_size_limit(1 << 31)
        whole = body.decode("utf-8", "replace") if isinstance(body, bytes) else body
        mark, quote, headed, text = whole[0], whole[1], whole[2] == "H", whole[3:].lstrip("﻿").lstrip("\r\n")
        if not text.strip():
            return
        rows = csv.reader(io.StringIO(text), delimiter=mark, quotechar=quote, skipinitialspace=True)
        header = next(rows) if headed else []
        for i, row in enumerate(rows):
            if most is not None and i >= most:
                return
            for j, value in enumerate(row):
                yield i, j, header[j] if j < len(header) else f"column_{j + 1}", value

    return parse


def csv_cells(documents: DataFrame, key: str = "doc_id", content: str = "content", most: int | None = None) -> DataFrame:
    """(doc_id, row, col, header, value, error): cells below the header line, or of all lines if there is none, by ``csv_dialect``.

    All rows are read unless ``most`` limits those of a document.  Columns without a
    header are named column_1 and so on.
    """
    binary = documents.schema[content].dataType.simpleString() == "binary"
    # in a one-byte character set every content is a text, and what marks a dialect is ASCII
    dialect = csv_dialect(F.decode(F.col(content), "ISO-8859-1") if binary else F.col(content))
    mark = F.transform(F.array(dialect), lambda d: F.concat(d["delimiter"], d["quote"], F.when(d["header"], "H").otherwise("-")))[0]
    told = F.concat(F.encode(mark, "UTF-8") if binary else mark, F.col(content))
    return _parsed(documents.select(F.col(key).alias("__key"), told.alias("__content")), _csv_rows(most), "row int, col int, header string, value string", "__key", "__content")


def csv_tree(cells: DataFrame) -> DataFrame:
    """Elements of csv cells: a table per document, a header row and its cells, a row per line and its cells.

    Columns as of ``element_tree``; attributes of cells hold row and column, from 0, the header being row 0.
    """
    text = lambda *parts: F.concat_ws("#", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    good = cells.where("error IS NULL")
    doc, no_map = F.col("doc_id"), F.lit(None).cast("map<string,string>")
    none = F.lit(None).cast("int")
    heads = good.select("doc_id", F.lit(-1).alias("row"), "col", "header", F.col("header").alias("value")).distinct()
    width = heads.groupBy("doc_id").agg(F.max("col").alias("last"))
    all_cells = heads.unionByName(good.select("doc_id", "row", "col", "header", "value")).join(width, "doc_id")
    step = F.col("last") + 2
    at_row = (F.col("row") + 1) * step + 2
    cell = all_cells.select(
        text(doc, "cell", F.col("row") + 1, F.col("col")).alias("element_id"),
        "doc_id",
        text(doc, "row", F.col("row") + 1).alias("parent_id"),
        F.when(F.col("row") < 0, "table_header").otherwise("table_cell").alias("element_type"),
        (at_row + F.col("col") + 1).cast("int").alias("position"),
        none.alias("level"),
        F.col("value").alias("text"),
        F.create_map(F.lit("row"), (F.col("row") + 1).cast("string"), F.lit("col"), F.col("col").cast("string"), F.lit("header"), F.col("header")).alias("attributes"),
    )
    row = all_cells.groupBy("doc_id", "row", "last").agg(F.count(F.lit(1)).alias("n")).select(
        text(doc, "row", F.col("row") + 1).alias("element_id"),
        "doc_id",
        text(doc, "table").alias("parent_id"),
        F.when(F.col("row") < 0, "table_header_row").otherwise("table_row").alias("element_type"),
        at_row.cast("int").alias("position"),
        none.alias("level"),
        F.lit("").alias("text"),
        no_map.alias("attributes"),
    )

    def single(kind: str, name: Column, parent: Column, position: int) -> DataFrame:
        return width.select(name.alias("element_id"), "doc_id", parent.alias("parent_id"), F.lit(kind).alias("element_type"), F.lit(position).alias("position"), none.alias("level"), F.lit("").alias("text"), no_map.alias("attributes"))

    root = F.concat(F.lit("root_"), doc.cast("string"))
    return single("root", root, F.lit(None).cast("string"), 0).unionByName(single("table", text(doc, "table"), root, 1)).unionByName(row).unionByName(cell)


def is_identity_column(header: Column) -> Column:
    """Whether a column's name says that it identifies rows: one of its words is id, key, code, num or number."""
    return F.arrays_overlap(F.split(F.lower(header), r"[^a-z0-9]+"), F.array(*map(F.lit, IDENTITY_WORDS)))


def csv_types(cells: DataFrame) -> DataFrame:
    """(doc_id, col, header, type): integer, float, boolean, date or string, if all non-empty values are; string if none are."""
    v = F.col("value")
    full = cells.where("error IS NULL AND trim(value) <> ''")
    every = lambda c: F.bool_and(c)
    tests = full.groupBy("doc_id", "col", "header").agg(
        every(v.rlike(r"^\s*[+-]?\d+\s*$")).alias("i"),
        every(v.try_cast("double").isNotNull()).alias("f"),
        every(F.lower(F.trim(v)).isin("true", "false", "yes", "no")).alias("b"),
        every(v.rlike(r"^\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})")).alias("d"),
    )
    kind = F.when(F.col("i"), "integer").when(F.col("f"), "float").when(F.col("b"), "boolean").when(F.col("d"), "date").otherwise("string")
    return tests.select("doc_id", "col", "header", kind.alias("type"))


def csv_relations(cells: DataFrame) -> DataFrame:
    """(doc_id, source, target, relationship_type, confidence): key columns and columns that share another term of their name."""
    heads = cells.where("error IS NULL").select("doc_id", "header").distinct()
    words = F.filter(F.split(F.lower("header"), r"[^a-z0-9]+"), lambda w: w != "")
    terms = heads.select("doc_id", "header", F.explode(F.array_distinct(words)).alias("term"))
    keys = heads.where(is_identity_column(F.col("header")))
    key_terms = terms.join(keys, ["doc_id", "header"], "left_semi").where(~F.col("term").isin(IDENTITY_WORDS))
    plain = terms.join(keys, ["doc_id", "header"], "left_anti")
    pairs = key_terms.alias("k").join(plain.alias("p"), ["doc_id", "term"]).select(
        "doc_id", F.col("k.header").alias("source"), F.col("p.header").alias("target"), F.col("p.header").rlike("(?i)date|time|year").alias("temporal")
    ).distinct()
    both = pairs.union(pairs.select("doc_id", F.col("target").alias("source"), F.col("source").alias("target"), "temporal"))
    return both.select(
        "doc_id",
        "source",
        "target",
        F.when(F.col("temporal"), "temporal_relationship").otherwise("related_to").alias("relationship_type"),
        F.when(F.col("temporal"), 0.85).otherwise(0.7).alias("confidence"),
    )


# HTML and XML


# Fixed values of the HTML standard: what a start tag ends without an end tag, and what keeps it from looking further out.
_ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_ENDS |= {
    t: ({"p"}, {"td", "th", "li", "dd", "button", "table"})
    for t in (
        "p", "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
        "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul",
    )
}
_DEEPEST = 256  # levels that a location names; what lies deeper has the location of its ancestor there


class _Tree(HTMLParser):
    """Elements of an HTML page in document order, without scripts and styles; tags that need no end tag are closed as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.names: list[str] = []
        self.held: Counter[str] = Counter()  # how often each name is open
        self.counts: list[dict] = [{}]
        self.tables: list[list[int]] = []  # row and column of each open table
        self.silent = 0

    def _implied(self, tag) -> None:
        ended, stops = _ENDS.get(tag, ((), ()))
        if not any(self.held[n] for n in ended):
            return
        last = None
        for at in range(len(self.names) - 1, -1, -1):
            if self.names[at] in stops:
                break
            if self.names[at] in ended:
                last = at
        while last is not None and len(self.names) > last:
            self._pop()

    def _pop(self) -> str:
        name = self.names.pop()
        self.held[name] -= 1
        self.open.pop()
        self.counts.pop()
        if name == "table":
            self.tables.pop()
        return name

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        self._implied(tag)
        nth = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        parent = self.open[-1] if self.open else None
        above = self.rows[parent][5] if parent is not None else ""
        own = {k: v or "" for k, v in attrs}
        text = [own["alt"]] if tag == "img" and own.get("alt") else []
        level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else None
        if tag == "li":
            level = self.held["ul"] + self.held["ol"]
            own["index"] = str(nth - 1)
        elif tag == "table":
            self.tables.append([-1, 0])
        elif tag == "tr" and self.tables:
            self.tables[-1][0] += 1
            self.tables[-1][1] = 0
            own["row"] = str(self.tables[-1][0])
        elif tag in ("td", "th") and self.tables:
            own["row"], own["col"] = map(str, self.tables[-1])
            span = own.get("colspan", "1")
            self.tables[-1][1] += int(span) if span.isdigit() else 1
        kind = HTML_TYPES.get(tag, tag)
        location = f"{above}/{tag}[{nth}]" if len(self.open) < _DEEPEST else above
        self.rows.append([len(self.rows), parent, kind, tag, text, location, level, own])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.names.append(tag)
            self.held[tag] += 1
            self.counts.append({})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if self.held[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and not self.silent and data.strip():
            self.rows[self.open[-1]][4].append(" ".join(data.split()))


def _html_rows(body):
    tree = _Tree()
    tree.feed(body.decode("utf-8", "replace") if isinstance(body, bytes) else body)
    tree.close()
    for row in tree.rows:
        if row[3] not in ("script", "style", "meta", "link", "br"):
            yield (*row[:4], " ".join(row[4]), *row[5:7], row[7] or None)


def html_elements(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, node columns, error): elements of pages with the text they hold themselves.

    level: of headers their rank, of list items the nesting of lists.  attributes: those of
    the tag, and row and col (from 0) of table rows and cells, index of list items.
    """
    return _parsed(documents, _html_rows, NODE, key, content)


def _xml_rows(body):
    root = ElementTree.fromstring(body)
    stack = [(root, None, f"/{_local(root.tag)}", 0)]
    position = 0
    while stack:
        node, parent, path, level = stack.pop()
        if isinstance(node, str):
            yield position, parent, "xml_text", None, node, path, level, None
            position += 1
            continue
        children = [c for c in node if isinstance(c.tag, str)]
        names = [c.tag for c in children]
        kind = "xml_list" if len(names) > 1 and len(set(names)) == 1 else "xml_object" if len(set(names)) > 1 else "xml_element"
        own = {_local(k): v for k, v in node.attrib.items()}
        yield position, parent, kind, _local(node.tag), " ".join((node.text or "").split()), path, level, own or None
        below, seen = [], {}
        for c in children:
            nth = seen[c.tag] = seen.get(c.tag, 0) + 1
            index = f"[{nth}]" if names.count(c.tag) > 1 else ""
            below.append((c, position, f"{path}/{_local(c.tag)}{index}", level + 1))
            if c.tail and c.tail.strip():
                below.append((" ".join(c.tail.split()), position, f"{path}/text()", level + 1))
        stack += reversed(below)
        position += 1


def xml_elements(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, node columns, error): elements in document order, namespaces cut off names and attributes.

    location is an XPath, with an index where siblings share a name; text that follows a
    child is an xml_text node of its own.
    """
    return _parsed(documents, _xml_rows, NODE, key, content)


def xml_links(nodes: DataFrame) -> DataFrame:
    """(doc_id, position, name, target): attributes href, src, url and link of parsed XML nodes."""
    rows = nodes.where("attributes IS NOT NULL").select("doc_id", "position", F.explode("attributes").alias("name", "target"))
    return rows.where(F.lower("name").isin("href", "src", "url", "link"))


# What words in an element's name say about it as a container, and prefixes before a capital.
CONTAINER_WORDS = {
    "array": "array",
    "list": "array",
    "collection": "array",
    "items": "array",
    "records": "array",
    "entries": "array",
    "map": "object",
    "dictionary": "object",
    "object": "object",
    "container": "object",
    "wrapper": "object",
    "package": "object",
    "set": "array",
    "group": "object",
    "data": "object",
    "bundle": "object",
    "batch": "array",
    "series": "array",
    "catalog": "object",
    "index": "object",
    "directory": "object",
    "table": "object",
    "results": "array",
}
CONTAINER_PREFIXES = {"all": "array", "each": "object", "every": "object", "many": "array", "multi": "array"}


def container_by_name(name: Column) -> Column:
    """array or object if the name speaks of a container, else null: plural, container word, word within, prefix."""
    low = F.lower(name)
    plural = low.endswith("s") & ~F.right(low, F.lit(2)).isin("ss", "us", "is")
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTAINER_WORDS.items() for x in pair]), low)
    inside = F.coalesce(*[F.when(low.contains(w), kind) for w, kind in CONTAINER_WORDS.items()])
    prefix = F.coalesce(*[F.when(name.rlike(rf"^(?i:{p})[A-Z]"), kind) for p, kind in CONTAINER_PREFIXES.items()])
    return F.coalesce(exact, F.when(plural, "array"), inside, prefix)


def container_kinds(nodes: DataFrame) -> DataFrame:
    """(doc_id, position, kind) of parsed XML nodes: array, object or element (no container by its name).

    With several children the structure decides: of one name, or over four fifths of one,
    make an array; names that differ in more than half of the children an object.
    """
    child = nodes.where("parent IS NOT NULL AND element_type <> 'xml_text'").groupBy("doc_id", F.col("parent").alias("position"), "name").agg(F.count(F.lit(1)).alias("n"))
    below = child.groupBy("doc_id", "position").agg(F.sum("n").alias("children"), F.count(F.lit(1)).alias("names"), F.max("n").alias("most"))
    own = container_by_name(F.col("name"))
    several = F.col("children") > 1
    kind = (
        F.when(own.isNull(), "element")
        .when(several & ((F.col("names") == 1) | (F.col("most") > 0.8 * F.col("children"))), "array")
        .when(several & (F.col("names") > 0.5 * F.col("children")), "object")
        .otherwise(own)
    )
    rows = nodes.where("error IS NULL AND element_type <> 'xml_text'").join(below, ["doc_id", "position"], "left")
    return rows.select("doc_id", "position", kind.alias("kind"))


# Markdown


def front_matter(text: Column) -> Column:
    """The lines between two lines of dashes at the start; empty if there are none."""
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)


def markdown_links(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, text, target) of inline links and <url> autolinks."""
    inline = F.transform(
        F.regexp_extract_all(F.col(content), F.lit(r"\[[^\]]+\]\([^)\s]+\)"), F.lit(0)),
        lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("text"), F.regexp_extract(x, r"\(([^)\s]+)\)$", 1).alias("target")),
    )
    auto = F.transform(
        F.regexp_extract_all(F.col(content), F.lit(r"<(https?://[^>\s]+)>"), F.lit(1)), lambda x: F.struct(x.alias("text"), x.alias("target"))
    )
    return documents.select(F.col(key).alias("doc_id"), F.inline(F.concat(inline, auto)))


def markdown_elements(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, position, element_type, level, text): headers, list items, quotes, table rows, code and paragraph lines.

    Lines between two fences are code; a running count of fences tells which.
    """
    body = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"(?s)\A---\n.*?\n---\n?", "")
    lines = documents.select(F.col(key).alias("doc_id"), F.posexplode(F.split(body, "\n")).alias("position", "line"))
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(r"^\s*```")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(w)).where(~fence & (F.trim("line") != ""))
    line = F.col("line")
    kind = (
        F.when(F.col("fences") % 2 == 1, "code_block")
        .when(line.rlike(r"^#{1,6}\s"), "header")
        .when(line.rlike(r"^\s*([-*+]|\d+\.)\s"), "list_item")
        .when(line.rlike(r"^\s*>"), "blockquote")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table_row")
        .otherwise("paragraph")
    )
    typed = marked.withColumn("element_type", kind)
    text = (
        F.when(kind == "header", F.regexp_replace(line, r"^#{1,6}\s+", ""))
        .when(kind == "list_item", F.regexp_replace(line, r"^\s*([-*+]|\d+\.)\s+", ""))
        .when(kind == "blockquote", F.regexp_replace(line, r"^\s*>\s?", ""))
        .otherwise(line)
    )
    level = F.when(kind == "header", F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)))
    return typed.select("doc_id", "position", "element_type", level.alias("level"), text.alias("text"))


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)")
_HEADER = re.compile(r"^ {0,3}(#{1,6})(?=\s|$)(.*)$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_BELOW = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _markdown_rows(body):
    text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body
    lines = re.sub(r"(?s)\A---\n.*?\n---(?:\n|\Z)", "", text.replace("\r\n", "\n")).split("\n")
    nodes, sections, i = _Nodes(), [], 0  # sections: (level, position) of the open headers

    def add(kind, text="", **more):
        return nodes.add(sections[-1][1] if sections else None, kind, text=text, **more)

    def header(level, text):
        while sections and sections[-1][0] >= level:
            sections.pop()
        sections.append((level, add("header", text, level=level)))

    while i < len(lines):
        line = lines[i]
        if not line.strip() or _RULE.match(line):
            i += 1
        elif fence := _FENCE.match(line):
            mark, held = fence[1], []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(mark):
                held.append(lines[i])
                i += 1
            i += 1
            add("code_block", "\n".join(held), language=fence[2] or None)
        elif head := _HEADER.match(line):
            title = head[2].strip()
            bare = title.rstrip("#")  # marks at the end belong to the title unless white space parts them
            header(len(head[1]), title if bare and not bare[-1].isspace() else bare.rstrip())
            i += 1
        elif line.lstrip().startswith(">"):
            held = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                held.append(lines[i].lstrip()[1:].strip())
                i += 1
            add("blockquote", " ".join(h for h in held if h))
        elif "|" in line and i + 1 < len(lines) and _BELOW.match(lines[i + 1]) and "-" in lines[i + 1]:
            table, row = add("table"), 0
            while i < len(lines) and "|" in lines[i]:
                if not (row == 1 and _BELOW.match(lines[i])):
                    nth = max(0, row - 1) if row else 0
                    at = nodes.add(table, "table_row", row=nth)
                    for col, cell in enumerate(_cells(lines[i])):
                        nodes.add(at, "table_cell" if row else "table_header", text=cell, row=nth, col=col)
                row += 1
                i += 1
        elif _ITEM.match(line):
            open_lists = []  # (indent, list position, item position)
            while i < len(lines):
                item = _ITEM.match(lines[i])
                if item and not _RULE.match(lines[i]):
                    indent = len(item[1].expandtabs(4))
                    while open_lists and open_lists[-1][0] > indent:
                        open_lists.pop()
                    if not open_lists or open_lists[-1][0] < indent:
                        ordered = str(item[2][0].isdigit()).lower()
                        at = nodes.add(open_lists[-1][2], "list", ordered=ordered) if open_lists else add("list", ordered=ordered)
                        open_lists.append((indent, at, at))
                    level, at = len(open_lists), open_lists[-1][1]
                    open_lists[-1] = (indent, at, nodes.add(at, "list_item", text=item[3].strip(), level=level))
                elif lines[i].strip() and lines[i][:1] in " \t" and open_lists:
                    at = open_lists[-1][2]
                    nodes[at] = (*nodes[at][:4], f"{nodes[at][4]} {lines[i].strip()}", *nodes[at][5:])
                elif lines[i].strip() or i + 1 >= len(lines) or not _ITEM.match(lines[i + 1]):
                    break
                i += 1
        else:
            held = []
            while i < len(lines) and lines[i].strip() and not (held and (_FENCE.match(lines[i]) or _HEADER.match(lines[i]) or _ITEM.match(lines[i]) or lines[i].lstrip().startswith(">"))):
                if held and re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                    break
                held.append(lines[i].strip())
                i += 1
            if i < len(lines) and held and (under := re.match(r"^ {0,3}(=+|-+)\s*$", lines[i])):
                header(1 if under[1][0] == "=" else 2, " ".join(held))
                i += 1
            else:
                add("paragraph", " ".join(held))
    yield from nodes


def markdown_nodes(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, node columns, error) of Markdown texts: headers, merged paragraphs, lists, quotes, code, tables.

    A header's parent is the nearest header above with a lower level (a section stack),
    other blocks belong to the open header; lists nest by indentation, tables have rows
    and cells with row and col from 0.  Front matter is left out.
    """
    return _parsed(documents, _markdown_rows, NODE, key, content)


def markdown_references(documents: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, text, target) of reference links ``[text][label]`` and ``[label][]`` whose label the text defines."""
    found = lambda form, group: F.regexp_extract_all(F.col(content), F.lit(form), F.lit(group))
    definition = r"(?m)^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)"
    defined = documents.select(F.col(key).alias("doc_id"), F.explode(F.arrays_zip(found(definition, 1).alias("label"), found(definition, 2).alias("target"))).alias("d"))
    defined = defined.groupBy("doc_id", F.lower("d.label").alias("label")).agg(F.first("d.target").alias("target"))
    used = r"\[([^\]]+)\]\[([^\]]*)\]"
    uses = documents.select(F.col(key).alias("doc_id"), F.explode(F.arrays_zip(found(used, 1).alias("text"), found(used, 2).alias("label"))).alias("u"))
    uses = uses.select("doc_id", F.col("u.text").alias("text"), F.lower(F.when(F.col("u.label") == "", F.col("u.text")).otherwise(F.col("u.label"))).alias("label"))
    return uses.join(defined, ["doc_id", "label"]).select("doc_id", "text", "target")


# Rows of a table as one document


def row_document(rows: DataFrame, document: str, order: str, section: str, text: str, speaker: str | None = None) -> DataFrame:
    """(doc_id, position, section_run, element_type, text, speaker): a header where the section changes, a paragraph per row."""
    from ..operators.tree import runs

    numbered = runs(rows, document, order, section)
    own = F.col(speaker) if speaker else F.lit(None).cast("string")
    body = numbered.select(
        F.col(document).alias("doc_id"), (F.col(order) * 2 + 1).alias("position"), F.col("run").alias("section_run"), F.lit("paragraph").alias("element_type"), F.col(text).alias("text"), own.alias("speaker")
    )
    heads = numbered.groupBy(F.col(document).alias("doc_id"), F.col("run").alias("section_run")).agg(
        (F.min(order) * 2).alias("position"), F.min(section).alias("text")
    )
    return body.unionByName(heads.withColumns({"element_type": F.lit("header"), "speaker": F.lit(None).cast("string")}))


# Office files


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _numbered(names: list[str], form: str) -> list[str]:
    """Parts of a package whose name fits, by the number in it."""
    return sorted((n for n in names if re.fullmatch(form, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])


def _said(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _value(node, tag: str, default: str = "") -> str:
    """The first attribute value of the first ``tag`` at or below node."""
    return next((v for x in node.iter() if _local(x.tag) == tag for v in x.attrib.values()), default)


def _office_table(nodes: _Nodes, parent: int | None, table, location: str) -> None:
    at, row = nodes.add(parent, "table", location=location), 0
    for line in table:
        if _local(line.tag) != "tr":
            continue
        own = nodes.add(at, "table_row", location=location, row=row)
        for col, cell in enumerate(c for c in line if _local(c.tag) == "tc"):
            text = "\n".join(filter(None, (_said(p) for p in cell.iter() if _local(p.tag) == "p")))
            nodes.add(own, "table_cell" if row else "table_header", text=text, location=location, row=row, col=col, colspan=_value(cell, "gridSpan") or None)
        row += 1


def _docx(z: zipfile.ZipFile, names: list[str], nodes: _Nodes) -> None:
    def paragraph(p, kind, location, sections):
        style, text = _value(p, "pStyle"), _said(p)
        if not text.strip():
            return
        parent = sections[-1][1] if sections else None
        heading = re.fullmatch(r"(?:Heading|Title)\s*(\d?)", style)
        if heading and kind == "paragraph":
            level = int(heading[1] or 1)
            while sections and sections[-1][0] >= level:
                sections.pop()
            sections.append((level, nodes.add(sections[-1][1] if sections else None, "header", style, text, location, level)))
        else:
            listed = any(_local(x.tag) == "numPr" for x in p.iter())
            nodes.add(parent, "list_item" if listed and kind == "paragraph" else kind, style, text, location)

    sections: list[tuple[int, int]] = []
    for name in ["word/document.xml", *_numbered(names, r"word/(?:header|footer)\d*\.xml"), *_numbered(names, r"word/(?:comments|footnotes|endnotes)\.xml")]:
        if name not in names:
            continue
        kind = {"document": "paragraph", "header": "page_header", "footer": "page_footer", "comments": "comment", "footnotes": "footnote", "endnotes": "footnote"}[re.match(r"word/([a-z]+)", name)[1]]
        root = ElementTree.fromstring(z.read(name))
        if kind == "comment":
            for c in root:
                own = {_local(k): v for k, v in c.attrib.items()}
                nodes.add(None, kind, own.get("id"), _said(c), name, author=own.get("author"), date=own.get("date"))
            continue
        stack = list(reversed(root))
        while stack:
            x = stack.pop()
            if _local(x.tag) == "p":
                paragraph(x, kind, name, sections if kind == "paragraph" else [])
            elif _local(x.tag) == "tbl":
                _office_table(nodes, sections[-1][1] if sections and kind == "paragraph" else None, x, name)
            else:
                stack += reversed(x)


def _pptx(z: zipfile.ZipFile, names: list[str], nodes: _Nodes) -> None:
    for name in _numbered(names, r"ppt/slides/slide\d+\.xml"):
        slide = nodes.add(None, "slide", location=name)
        related = name.replace("slides/", "slides/_rels/") + ".rels"
        parts = [v for x in ElementTree.fromstring(z.read(related)) for k, v in x.attrib.items() if k == "Target"] if related in names else []
        stack = list(reversed(ElementTree.fromstring(z.read(name))))
        while stack:
            x = stack.pop()
            kind = _local(x.tag)
            title = next((v for y in x.iter() if _local(y.tag) == "cNvPr" for k, v in y.attrib.items() if k == "name"), None)
            if kind == "sp":
                text = "\n".join(filter(None, (_said(p) for p in x.iter() if _local(p.tag) == "p")))
                head = any(_local(y.tag) == "ph" and y.get("type") in ("title", "ctrTitle") for y in x.iter())
                if text.strip():
                    nodes.add(slide, "header" if head else "text_box", title, text, name, 1 if head else None)
            elif kind == "pic":
                nodes.add(slide, "image", title, next((y.get("descr", "") for y in x.iter() if _local(y.tag) == "cNvPr"), ""), name)
            elif kind == "tbl":
                _office_table(nodes, slide, x, name)
            else:
                stack += reversed(x)
        for part in parts:
            path = "ppt/" + part.removeprefix("../")
            if path not in names:
                continue
            if "notesSlide" in path:
                note = "\n".join(filter(None, (_said(p) for p in ElementTree.fromstring(z.read(path)).iter() if _local(p.tag) == "p")))
                nodes.add(slide, "slide_notes", text=note, location=path)
            elif "comments/" in path:
                for c in ElementTree.fromstring(z.read(path)):
                    words = " ".join(x.text or "" for x in c.iter() if _local(x.tag) in ("text", "t"))
                    nodes.add(slide, "comment", text=words.strip(), location=path, author=c.get("authorId"), date=c.get("dt"))
            elif "charts/" in path:
                chart = ElementTree.fromstring(z.read(path))
                values = [x.text or "" for x in chart.iter() if _local(x.tag) == "v"]
                kind = next((_local(x.tag) for x in chart.iter() if _local(x.tag).endswith("Chart")), "chart")
                nodes.add(slide, "chart", kind, " ".join([_said(chart), *values]).strip(), path)


def _corner(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a cell name."""
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _name(row: int, col: int) -> str:
    letters = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def data_range(grid: dict[tuple[int, int], str], bold: set[tuple[int, int]], filters: list[str]) -> str | None:
    """The range of a sheet's data table, two rows and columns at least, or None.

    A filter's range if there is one.  Else the block around the first filled cell, if its
    first row is a header: over half of it bold or filled, or words only above at least one
    column of numbers in the next rows (20 rows and columns are looked at).
    """
    for ref in filters:
        (r1, c1), (r2, c2) = map(_corner, ref.split(":")) if ":" in ref else ((0, 0), (0, 0))
        if r2 > r1 and c2 > c1:
            return ref.replace("$", "")
    if not grid:
        return None
    top, left = min(grid)
    right, bottom = left, top
    while (top, right + 1) in grid:
        right += 1
    while any((bottom + 1, c) in grid for c in range(left, right + 1)):
        bottom += 1
    if right == left or bottom == top:
        return None
    head = [(top, c) for c in range(left, min(right, left + 19) + 1)]
    number = re.compile(r"[-+]?[\d.,]+%?$")
    words = all(not number.match(grid[x]) for x in head)
    numbers = any(
        any((r, c) in grid for r in range(top + 1, min(bottom, top + 19) + 1)) and all(number.match(grid[r, c]) for r in range(top + 1, min(bottom, top + 19) + 1) if (r, c) in grid)
        for _, c in head
    )
    if 2 * sum(x in bold for x in head) > len(head) or (words and numbers):
        return f"{_name(top, left)}:{_name(bottom, right)}"
    return None


def _xlsx(z: zipfile.ZipFile, names: list[str], nodes: _Nodes) -> None:
    shared, bold_styles = [], set()
    if "xl/sharedStrings.xml" in names:
        shared = [_said(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    if "xl/styles.xml" in names:
        styles = {_local(x.tag): x for x in ElementTree.fromstring(z.read("xl/styles.xml"))}
        fonts = [any(_local(y.tag) == "b" for y in f) for f in styles.get("fonts", [])]
        for i, f in enumerate(styles.get("cellXfs", [])):
            if int(f.get("fillId", 0)) > 1 or (fonts and fonts[int(f.get("fontId", 0))]):
                bold_styles.add(str(i))
    titles, targets = {}, {}
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            targets[x.get("Id")] = "xl/" + x.get("Target", "").removeprefix("/xl/")
        for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(x.tag) == "sheet":
                titles[targets.get(next((v for k, v in x.attrib.items() if _local(k) == "id"), ""))] = x.get("name")
    book = nodes.add(None, "workbook")
    for name in _numbered(names, r"xl/worksheets/sheet\d+\.xml"):
        root = ElementTree.fromstring(z.read(name))
        sheet = nodes.add(book, "sheet", titles.get(name), location=name)
        grid, bold, filters = {}, set(), []
        line, last, col = None, -1, -1
        for x in root.iter():
            kind = _local(x.tag)
            if kind == "row":
                last, col = int(x.get("r", last + 2)) - 1, -1
                line = nodes.add(sheet, "table_row", location=name, row=last)
            elif kind == "c":
                at = _corner(x.get("r")) if x.get("r") else (max(last, 0), col + 1)
                if line is None or at[0] != last:  # a cell outside its row
                    line, last = nodes.add(sheet, "table_row", location=name, row=at[0]), at[0]
                col = at[1]
                raw = next((y.text or "" for y in x.iter() if _local(y.tag) == "v"), None)
                text = _said(x) if raw is None else shared[int(raw)] if x.get("t") == "s" else raw
                formula = next((y.text for y in x if _local(y.tag) == "f"), None)
                if text == "" and formula is None:
                    continue
                nodes.add(line, "table_cell", _name(*at), text, name, row=at[0], col=at[1], formula=formula)
                grid[at] = text
                if x.get("s") in bold_styles:
                    bold.add(at)
            elif kind == "mergeCell":
                nodes.add(sheet, "merged_cells", x.get("ref"), location=name)
            elif kind == "autoFilter" and x.get("ref"):
                filters.append(x.get("ref"))
        related = name.replace("worksheets/", "worksheets/_rels/") + ".rels"
        for x in ElementTree.fromstring(z.read(related)) if related in names else []:
            path = "xl/" + x.get("Target", "").removeprefix("../").removeprefix("/xl/")
            if path not in names:
                continue
            part = ElementTree.fromstring(z.read(path))
            if "comments" in path:
                for c in part.iter():
                    if _local(c.tag) == "comment":
                        nodes.add(sheet, "comment", c.get("ref"), _said(c), path)
            elif "tables/" in path and part.get("ref"):
                filters.append(part.get("ref"))
        if found := data_range(grid, bold, filters):
            nodes.add(sheet, "data_table", found, location=name)


def _office_rows(body):
    nodes = _Nodes()
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = z.namelist()
        for folder, read in (("word/", _docx), ("ppt/", _pptx), ("xl/", _xlsx)):
            if any(n.startswith(folder) for n in names):
                read(z, names, nodes)
    yield from nodes


def office_elements(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, node columns, error) of docx, pptx and xlsx files.

    docx: headers by style, paragraphs, list items, tables, page headers and footers,
    comments and notes.  pptx: slides with titles, boxes, pictures, tables, notes, comments
    and charts.  xlsx: sheets with rows, cells, merged ranges, comments and the range of a
    data table.
    """
    return _parsed(files, _office_rows, NODE, key, content)
