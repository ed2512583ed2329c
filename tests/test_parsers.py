"""Parsers on small documents, and what one bad document must not do to the others."""

import io
import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from arborlake.operators import tree
from arborlake.sources import connectors, structured

MARKDOWN = """---
title: x
---
# Top

Two lines
of one paragraph.

## Part

- one
  goes on
- two
  1. inner
  2. other

> quoted
> still

| a | b |
|---|:-:|
| 1 | x |
| 2 | y |

Under
-----

```python
# no header
```

# Next
text
"""


def table(spark, *bodies, kind="string"):
    return spark.createDataFrame(list(enumerate(bodies)), f"doc_id long, content {kind}")


def rows_of(parse, body):
    return [dict(zip(("position", "parent", "kind", "name", "text", "location", "level", "attributes"), r)) for r in parse(body)]


def test_markdown_sections_lists_and_tables():
    rows = rows_of(structured._markdown_rows, MARKDOWN)
    assert [r["position"] for r in rows] == list(range(len(rows)))
    heads = {r["text"]: r for r in rows if r["kind"] == "header"}
    assert {t: h["level"] for t, h in heads.items()} == {"Top": 1, "Part": 2, "Under": 2, "Next": 1}
    assert heads["Part"]["parent"] == heads["Under"]["parent"] == heads["Top"]["position"] and heads["Next"]["parent"] is None
    by = lambda kind: [r for r in rows if r["kind"] == kind]
    assert [r["text"] for r in by("paragraph")] == ["Two lines of one paragraph.", "text"]
    assert by("paragraph")[1]["parent"] == heads["Next"]["position"]
    assert [(r["text"], r["level"]) for r in by("list_item")] == [("one goes on", 1), ("two", 1), ("inner", 2), ("other", 2)]
    inner = by("list")[1]
    assert inner["attributes"] == {"ordered": "true"} and rows[inner["parent"]]["text"] == "two"
    assert by("blockquote")[0]["text"] == "quoted still"
    assert [(r["text"], r["attributes"]["row"], r["attributes"]["col"]) for r in by("table_header") + by("table_cell")] == [
        ("a", "0", "0"), ("b", "0", "1"), ("1", "1", "0"), ("x", "1", "1"), ("2", "2", "0"), ("y", "2", "1")
    ]
    assert by("code_block")[0]["text"] == "# no header" and by("code_block")[0]["attributes"] == {"language": "python"}
    assert rows_of(structured._markdown_rows, "") == [] and rows_of(structured._markdown_rows, "---\n```") == [
        {"position": 0, "parent": None, "kind": "code_block", "name": None, "text": "", "location": None, "level": None, "attributes": None}
    ]


def test_html_levels_lists_and_cells():
    page = "<h2 id=t>T</h2><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th colspan=2>h</th><th>i</th></tr><tr><td>1<td>2</td></tr></table><img alt=A src=s>"
    rows = rows_of(structured._html_rows, page)
    by = lambda kind: [r for r in rows if r["kind"] == kind]
    assert by("header")[0]["level"] == 2 and by("header")[0]["attributes"] == {"id": "t"}
    assert [(r["text"], r["level"]) for r in by("list_item")] == [("a", 1), ("b", 2)]
    assert [(r["attributes"]["row"], r["attributes"]["col"]) for r in by("table_header") + by("table_cell")] == [("0", "0"), ("0", "2"), ("1", "0"), ("1", "1")]
    assert by("image")[0]["text"] == "A"
    long = "<p>" + "<b>x</b> word " * 50_000 + "</p>"
    assert len(rows_of(structured._html_rows, long)[0]["text"]) == 5 * 50_000 - 1


def test_xml_attributes_indexes_and_tails():
    rows = rows_of(structured._xml_rows, '<a xmlns:n="u"><n:b n:k="1">x</n:b><n:b/>tail<!-- c --></a>')
    assert [(r["kind"], r["name"], r["location"], r["text"], r["attributes"]) for r in rows] == [
        ("xml_list", "a", "/a", "", None),
        ("xml_element", "b", "/a/b[1]", "x", {"k": "1"}),
        ("xml_element", "b", "/a/b[2]", "", None),
        ("xml_text", None, "/a/text()", "tail", None),
    ]


def test_json_nodes():
    body = '{"user_id": 7, "when": "2024-01-02T03:04", "x": [1.50, {"y": null}, []], "b": true, "x": "twice"}'
    rows = rows_of(structured._json_rows(None, False), body)
    assert [(r["location"], r["kind"], r["text"]) for r in rows] == [
        ("$", "json_object", None), ("$.user_id", "json_field", "7"), ("$.when", "json_field", "2024-01-02T03:04"), ("$.x", "json_array", None),
        ("$.x[0]", "json_field", "1.50"), ("$.x[1]", "json_object", None), ("$.x[1].y", "json_field", None), ("$.x[2]", "json_array", None),
        ("$.b", "json_field", "true"), ("$.x", "json_field", "twice"),
    ]
    assert rows[1]["attributes"] == {"identity": "true"} and rows[2]["attributes"] == {"temporal": "true"}
    flat = rows_of(structured._json_rows(None, True), '{"a": [1, 2]}')
    assert [(r["location"], r["parent"]) for r in flat] == [("$", None), ("$.a[0]", 0), ("$.a[1]", 0)]
    deep = json.loads("1")
    for _ in range(400):
        deep = [deep]
    assert len(rows_of(structured._json_rows(None, False), json.dumps(deep))) == 401
    assert len(rows_of(structured._json_rows(2, False), body)) == 6


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def docx():
    w = 'xmlns:w="urn:w"'
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    grid = f"<w:tbl><w:tr><w:tc>{p('h')}</w:tc><w:tc>{p('i')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc><w:tc>{p('2')}</w:tc></w:tr></w:tbl>"
    body = f"<w:document {w}><w:body>{p('T', 'Heading1')}{p('plain')}{p('S', 'Heading2')}{grid}</w:body></w:document>"
    return package(**{
        "word__document.xml": body,
        "word__header1.xml": f"<w:hdr {w}>{p('on top')}</w:hdr>",
        "word__comments.xml": f'<w:comments {w}><w:comment w:id="0" w:author="me">{p("why")}</w:comment></w:comments>',
    })


def pptx():
    sp = lambda text, kind="": f'<p:sp><p:nvSpPr><p:cNvPr name="n"/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    ns = 'xmlns:p="urn:p" xmlns:a="urn:a"'
    return package(**{
        "ppt__slides__slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{sp('Title', '<p:ph type=%stitle%s/>' % (chr(34), chr(34)))}{sp('Body')}</p:spTree></p:cSld></p:sld>",
        "ppt__slides___rels__slide1.xml.rels": '<R><Relationship Target="../notesSlides/notesSlide1.xml"/></R>',
        "ppt__notesSlides__notesSlide1.xml": f"<p:notes {ns}>{sp('say it')}</p:notes>",
    })


def xlsx():
    cell = lambda ref, v, t="": f'<c r="{ref}"{t}><v>{v}</v></c>'
    s = ' t="s"'
    sheet = (
        f'<worksheet><sheetData><row r="1">{cell("A1", 0, s)}{cell("B1", 1, s)}</row><row r="2">{cell("A2", 2, s)}{cell("B2", 5)}</row><row r="3">{cell("A3", 2, s)}{cell("B3", 7)}</row></sheetData>'
        '<mergeCells><mergeCell ref="D1:E1"/></mergeCells></worksheet>'
    )
    return package(**{
        "xl__workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="First" r:id="i1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<R><Relationship Id="i1" Target="worksheets/sheet1.xml"/></R>',
        "xl__sharedStrings.xml": "<sst><si><t>name</t></si><si><t>size</t></si><si><t>x</t></si></sst>",
        "xl__worksheets__sheet1.xml": sheet,
    })


def test_office_packages(spark):
    rows = structured.office_elements(table(spark, docx(), pptx(), xlsx(), b"no package", kind="binary")).orderBy("doc_id", "position").collect()
    of = lambda d: [(r["element_type"], r["text"]) for r in rows if r["doc_id"] == d]
    assert of(0) == [
        ("header", "T"), ("paragraph", "plain"), ("header", "S"), ("table", ""), ("table_row", ""), ("table_header", "h"), ("table_header", "i"),
        ("table_row", ""), ("table_cell", "1"), ("table_cell", "2"), ("page_header", "on top"), ("comment", "why"),
    ]
    first = [r for r in rows if r["doc_id"] == 0]
    assert first[1]["parent"] == 0 and first[2]["parent"] == 0 and first[3]["parent"] == 2 and first[11]["attributes"]["author"] == "me"
    assert of(1) == [("slide", ""), ("header", "Title"), ("text_box", "Body"), ("slide_notes", "say it")]
    assert of(2)[:2] == [("workbook", ""), ("sheet", "")] and [t for k, t in of(2) if k == "table_cell"] == ["name", "size", "x", "5", "x", "7"]
    named = {r["element_type"]: r["name"] for r in rows if r["doc_id"] == 2}
    assert named["sheet"] == "First" and named["merged_cells"] == "D1:E1" and named["data_table"] == "A1:B3"
    assert of(3) == [(None, None)] and "BadZipFile" in rows[-1]["error"]


def test_data_ranges():
    grid = {(r, c): "w" for r in range(3) for c in range(2)}
    assert structured.data_range(grid, set(), []) is None
    assert structured.data_range(grid, {(0, 0), (0, 1)}, []) == "A1:B3"
    assert structured.data_range(grid, set(), ["$C$2:$AB$9"]) == "C2:AB9"
    assert structured.data_range({(0, 0): "a", (1, 0): "1"}, set(), []) is None
    assert structured._corner("AB9") == (8, 27) and structured._name(8, 27) == "AB9"


def test_one_bad_document_costs_one_row(spark):
    """Markup that makes the parser give up, bad XML and a hostile CSV field leave the other documents alone."""
    html = structured.html_elements(table(spark, "<p>a</p>", "<![foo bar]><p>b</p>", "<p>c</p>", None, "")).collect()
    assert sorted(r["text"] for r in html if r["error"] is None) in (["a", "c"], ["a", "b", "c"])
    xml = structured.xml_elements(table(spark, "<a/>", "<a>", "<b/>")).collect()
    assert sorted(r["name"] for r in xml if r["error"] is None) == ["a", "b"] and sum(r["error"] is not None for r in xml) == 1
    cells = structured.csv_cells(table(spark, "a,b\n" + "x" * 300_000 + ",2\n")).collect()
    assert [len(r["value"]) for r in sorted(cells, key=lambda r: r["col"])] == [300_000, 1]
    assert structured.json_elements(table(spark, "{", "[1]")).where("doc_id = 0").count() == 0


def test_csv_reads_every_row(spark):
    body = "id,name\n" + "\n".join(f"{i},n{i}" for i in range(1500))
    cells = structured.csv_cells(table(spark, body))
    assert cells.count() == 3000 and cells.agg(F.max("row")).first()[0] == 1499
    assert structured.csv_cells(table(spark, body), most=10).count() == 20
    e = structured.csv_tree(cells)
    assert e.where("element_type = 'table_row'").count() == 1500
    assert e.select("element_id").distinct().count() == e.count() and e.select("position").distinct().count() == e.count()


def test_parsers_feed_the_tree_operators(spark):
    nodes = structured.markdown_nodes(table(spark, MARKDOWN, "# Only"))
    e = structured.element_tree(nodes)
    assert e.where("element_type = 'root'").count() == 2
    paths = {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(e).collect()}
    assert all(p[-1].startswith("root_") for k, p in paths.items() if not k.startswith("root_"))
    text = {r["doc_id"]: r["markdown"] for r in tree.as_markdown(e).collect()}
    assert "| a | b |\n| --- | --- |\n| 1 | x |\n| 2 | y |" in text[0] and text[1] == "# Only"
    again = structured.element_tree(structured.markdown_nodes(spark.createDataFrame([(0, text[0])], "doc_id long, content string")))
    kinds = lambda d: sorted((r["element_type"], r["text"]) for r in d.where("doc_id = 0").collect() if r["element_type"] in ("header", "table_cell", "code_block", "paragraph"))
    assert [k for k in kinds(again) if k[0] != "header"] == [k for k in kinds(e) if k[0] != "header"]
    html = {r["doc_id"]: r["html"] for r in tree.as_html(e).collect()}
    assert "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr>" in html[0] and "<ul><li>one goes on</li><li>two<ul><li>inner</li><li>other</li></ul></li></ul>" in html[0]
    whole = tree.complete(spark.createDataFrame([(0, "s"), (1, "t"), (9, "none")], "doc_id long, source string"), e, tree.containment(e)).collect()
    by = {r["doc_id"]: r for r in whole}
    assert by[9]["elements"] == [] and by[9]["text"] == "" and by[1]["text"] == "Only" and len(by[0]["elements"]) == e.where("doc_id = 0").count()


def test_deep_trees_keep_their_roots(spark):
    chain = [(f"e{i}", 1, f"e{i - 1}" if i else None, "paragraph", i, None, "x") for i in range(41)]
    e = spark.createDataFrame(chain, "element_id string, doc_id long, parent_id string, element_type string, position int, level int, text string")
    paths = {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(e).collect()}
    assert len(paths["e40"]) == 40 and paths["e40"][-1] == "e0"


def test_json_references_are_parsed(spark):
    body = json.dumps({"_id": 1, "note": '"fake_id": 3', "owner": {"$oid": "o1"}, "list": [{"x_id": "a"}, {"$oid": "o2"}], "y_id": None})
    found = connectors.references(table(spark, body, "no json")).collect()
    assert sorted((r["field"], r["target"]) for r in found) == [("list", "o2"), ("owner", "o1"), ("x_id", "a")]


def test_markdown_reference_links(spark):
    body = "see [the docs][d] and [Home][]\n\n[d]: http://d.org 'x'\n[home]: <http://h.org>\n"
    found = structured.markdown_references(table(spark, body)).collect()
    assert sorted((r["text"], r["target"]) for r in found) == [("Home", "http://h.org"), ("the docs", "http://d.org")]


def test_csv_identity_columns(spark):
    heads = ["customer_id", "Key", "code name", "identity", "n"]
    got = spark.createDataFrame([(h,) for h in heads], "h string").select(structured.is_identity_column(F.col("h")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, True, True, False, False]


def test_random_markdown_never_fails():
    rng = random.Random(1)
    for _ in range(300):
        body = "".join(rng.choice(["# ", "- ", "  ", "\n", "|", "---", "```", "> ", "a", "1. ", "=", "~~~", "\t"]) for _ in range(60))
        rows = rows_of(structured._markdown_rows, body)
        assert all(r["parent"] is None or r["parent"] < r["position"] for r in rows)


@pytest.mark.parametrize("body", ["", " ", "---\n---", None])
def test_empty_documents_have_a_root_or_nothing(spark, body):
    assert structured.element_tree(structured.markdown_nodes(table(spark, body, "x"))).where("element_type = 'root'").count() >= 1


@pytest.mark.parametrize(
    "text, wanted",
    [
        ('"a,b,c,d,e";x\n"f,g";y', (";", '"', True)),
        ("1;2;x\n3;4;y\n5;6;z", (";", '"', False)),
        ("name|age\nann|3\nbob|4", ("|", '"', True)),
        ("a\tb\n'it, is'\t'x;y'\n'o, k'\tz", ("\t", "'", True)),
        ("2019,2020\n1.5,2\n3,4", (",", '"', False)),
        ("﻿\r\na;b\r\n1;2,5\r\n", (";", '"', True)),
        ('x,"two\nlines; more",y\nz,"w",v', (",", '"', True)),
        ("only", (",", '"', True)),
        ("", (",", '"', True)),
        (None, (",", '"', True)),
        ('a,b\n1,"' + "long; " * 40_000, (",", '"', True)),
    ],
)
def test_csv_dialect(spark, text, wanted):
    d = spark.createDataFrame([(text,)], "t string").select(structured.csv_dialect(F.col("t")).alias("d")).first()["d"]
    assert tuple(d) == wanted


def test_csv_without_header_and_with_quoted_delimiters(spark):
    cells = structured.csv_cells(table(spark, "1;2\n3;4")).collect()
    assert sorted((r["row"], r["col"], r["header"], r["value"]) for r in cells) == [
        (0, 0, "column_1", "1"), (0, 1, "column_2", "2"), (1, 0, "column_1", "3"), (1, 1, "column_2", "4")
    ]
    binary = spark.createDataFrame([(0, bytearray(b'h;"a,b"\n\xff;"c,d,e,f"'))], "doc_id long, content binary")
    assert sorted((r["header"], r["value"]) for r in structured.csv_cells(binary).collect()) == [("a,b", "c,d,e,f"), ("h", "�")]


def test_html_tags_without_end_tags():
    rows = rows_of(structured._html_rows, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z</div><select><option>o<option>q</select>")
    by = {r["text"]: r for r in rows if r["text"]}
    path = lambda r: [] if r is None else [*path(rows[r["parent"]] if r["parent"] is not None else None), r["name"]]
    assert [by[t]["attributes"]["index"] for t in "abcd"] == ["0", "1", "0", "2"] and path(by["d"]) == ["ul", "li"] and path(by["c"]) == ["ul", "li", "ul", "li"]
    assert [(by[t]["attributes"]["row"], by[t]["attributes"]["col"]) for t in "123"] == [("0", "0"), ("0", "1"), ("1", "0")] and path(by["3"]) == ["table", "tr", "td"]
    assert path(by["y"]) == ["p"] and path(by["z"]) == ["div"] and path(by["q"]) == ["select", "option"]
    nested = rows_of(structured._html_rows, "<table><tr><td><table><tr><td>in</table><td>out</table>")
    assert [r["location"] for r in nested if r["text"]] == ["/table[1]/tr[1]/td[1]/table[1]/tr[1]/td[1]", "/table[1]/tr[1]/td[2]"]


def test_hostile_pages_and_lines_take_linear_time():
    began = time.time()
    flat = rows_of(structured._html_rows, "<p>x" * 40_000)
    assert len(flat) == 40_000 and flat[-1]["parent"] is None and flat[-1]["location"] == "/p[40000]"
    deep = rows_of(structured._html_rows, "<div>" * 40_000 + "x")
    assert deep[-1]["location"] == "/div[1]" * 256 and deep[-1]["parent"] == 39_998
    rows_of(structured._html_rows, "<b>" * 20_000 + "</b>" * 20_000 + "<li>" * 5_000)
    spaces = rows_of(structured._markdown_rows, "# a" + " " * 100_000 + "b\n\n" + " " * 100_000 + "x")
    assert [r["kind"] for r in spaces][0] == "header"
    assert time.time() - began < 20


@pytest.mark.parametrize("line, wanted", [("# a #", "a"), ("## b##", "b##"), ("# c # #", "c #"), ("#", ""), ("# #", ""), ("###  d  ", "d"), ("#e", None), ("# f\\t##  ", "f")])
def test_markdown_headers(line, wanted):
    rows = [r for r in rows_of(structured._markdown_rows, line.replace("\\t", "\t")) if r["kind"] == "header"]
    assert [r["text"] for r in rows] == ([] if wanted is None else [wanted])
