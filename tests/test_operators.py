import io
import zipfile
from datetime import datetime

import random

import pytest
from pyspark.sql import functions as F

from arborlake.functions import context
from arborlake.operators import edges, storage, tree
from arborlake.sources import readers, structured, text
from arborlake.streaming import queue

ELEMENTS = "element_id string, doc_id long, parent_id string, element_type string, position int, level int, text string"


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        ("r", 1, None, "root", 0, None, ""),
        ("h1", 1, "r", "header", 1, 1, "Intro"),
        ("p1", 1, "h1", "paragraph", 2, None, "first"),
        ("h2", 1, "h1", "header", 3, 2, "Detail"),
        ("p2", 1, "h2", "paragraph", 4, None, "second <b>"),
        ("h3", 1, "r", "header", 5, 1, "End"),
        ("p3", 1, "h3", "paragraph", 6, None, "third"),
    ]
    return spark.createDataFrame(rows, ELEMENTS)


def test_siblings(sample):
    found = {tuple(r) for r in tree.siblings(sample).collect()}
    assert found == {("h1", "next_sibling", "h3"), ("h3", "previous_sibling", "h1"), ("p1", "next_sibling", "h2"), ("h2", "previous_sibling", "p1")}


def test_sections(sample):
    assert {r["element_id"]: r["section_id"] for r in tree.sections(sample).collect()} == {
        "r": None, "h1": None, "p1": "h1", "h2": "h1", "p2": "h2", "h3": None, "p3": "h3",
    }


def test_ancestry_and_cycles(spark, sample):
    paths = {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(sample).collect()}
    assert paths["p2"] == ["h2", "h1", "r"] and paths["r"] == []
    loop = spark.createDataFrame([("a", 1, "b", "x", 0, None, ""), ("b", 1, "a", "x", 1, None, "")], ELEMENTS)
    assert {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(loop).collect()} == {"a": ["b"], "b": ["a"]}


def test_reconstruction(sample):
    assert tree.as_markdown(sample).first()["markdown"] == "# Intro\n\nfirst\n\n## Detail\n\nsecond <b>\n\n# End\n\nthird"
    assert "<h2>Detail</h2>\n<p>second &lt;b&gt;</p>" in tree.as_html(sample).first()["html"]
    assert tree.full_text(sample).first()["text"].startswith("Intro\n\nfirst")


def test_deep_ancestry(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(36)], "element_id string, parent_id string")
    paths = {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(chain).collect()}
    assert paths == {str(i): [str(j) for j in range(i - 1, -1, -1)] for i in range(36)}


def test_outline(spark, sample):
    hits = spark.createDataFrame([("p2", 0.9), ("h2", 0.5)], "element_id string, score double")
    assert {r["element_id"]: r["score"] for r in tree.outline(hits, sample).collect()} == {"p2": 0.9, "h2": 0.5, "h1": None, "r": None}


def test_links(spark, sample):
    links = spark.createDataFrame([("p1", 1, "#p3", "go"), ("p2", 1, "x", " End "), ("p3", 1, "https://example.org", "out")], "element_id string, doc_id long, target string, text string")
    found = {tuple(r) for r in edges.explicit_links(links, sample).collect()}
    assert found == {
        ("p1", "link", "#p3"), ("p2", "link", "x"), ("p3", "link", "https://example.org"), ("p3", "referenced_by", "p1"), ("h3", "referenced_by", "p2"),
    }


def test_entity_pairs(spark):
    rows = [("a", "x", "P", [1, 2]), ("b", "y", "p", [2]), ("c", "y", "q", [9]), ("d", "y", "p", [7])]
    table = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, elements array<int>")
    assert {tuple(r) for r in edges.entity_pairs(table, "x", "y", same=["name"]).collect()} == {("a", "b"), ("a", "d")}
    assert {tuple(r) for r in edges.entity_pairs(table, "x", "y", same=["name"], overlap="elements").collect()} == {("a", "b")}


def test_storage(spark, sample, tmp_path):
    new = sample.where("element_id = 'p1'").withColumn("text", F.lit("changed"))
    after = storage.upsert(sample, new, ["element_id"])
    assert after.count() == 7 and after.where("text = 'changed'").count() == 1
    gone = storage.delete_documents({"elements": sample, "edges": tree.siblings(sample)}, spark.createDataFrame([(1,)], "doc_id long"), "edges")
    assert all(t.count() == 0 for t in gone.values())
    storage.write(sample, str(tmp_path / "e"), partition_by=["element_type"])
    assert spark.read.parquet(str(tmp_path / "e")).count() == 7
    v, e = storage.graph_tables(sample, tree.siblings(sample))
    assert v.columns == ["id", "label", "doc_id"] and e.columns == ["src", "dst", "type"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "sub" / "b.json").write_text("{}")
    rows = readers.files(spark, str(tmp_path)).collect()
    assert {r["doc_type"] for r in rows} == {"markdown", "json"}
    assert readers.files(spark, str(tmp_path), include=r"sub/").count() == 1


def test_partition_values(spark):
    row = spark.createDataFrame([("s3://x/cik=12/year=2024/f.parquet",)], "p string").select(readers.partition_values(F.col("p")).alias("m")).first()
    assert row["m"] == {"cik": "12", "year": "2024"}


def test_sql_documents(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("docs_view")
    out = readers.sql_documents(spark, "SELECT * FROM docs_view WHERE lang = 'en'", "q", ["source", "doc_id"], "text", ["lang"])
    assert out.first()["doc_id"].startswith("q/source=src")


def test_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in readers.reachable(seeds, links, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


CSV = "﻿\n\nname;age;when\nAnn;0;01/02/2024\n\"B; b\";41;03/04/2024\n"


def test_csv(spark):
    docs = spark.createDataFrame([(1, CSV), (2, ""), (3, None)], "doc_id long, content string")
    cells = structured.csv_cells(docs)
    assert [r["value"] for r in cells.where("header = 'name'").orderBy("row").collect()] == ["Ann", "B; b"]
    assert {r["header"]: r["type"] for r in structured.csv_types(cells).collect()} == {"name": "string", "age": "integer", "when": "date"}


def test_csv_long(spark):
    lines = [f"{i},{i}" for i in range(25_000)] + ["x,25000"]
    docs = spark.createDataFrame([(1, "a,b\n" + "\n".join(lines))], "doc_id long, content string")
    cells = structured.csv_cells(docs)
    assert [r["value"] for r in cells.where("header = 'b'").orderBy("row").collect()] == [str(i) for i in range(25_001)]
    assert {r["header"]: r["type"] for r in structured.csv_types(cells).collect()} == {"a": "string", "b": "integer"}
    assert structured.csv_cells(docs, most=1000).count() == 2000


def test_json(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": true}]}, "d": null}'), (2, "no json"), (3, None)], "doc_id long, content string")
    found = {r["path"]: (r["element_type"], r["value"]) for r in structured.json_elements(docs).collect()}
    assert found["$.a.b[1].c"] == ("json_field", "true") and found["$.a.b"][0] == "json_array" and found["$.a.b[0]"] == ("json_field", "1")
    assert "$.d" in found


def test_html_and_xml(spark):
    page = "<html><body><h1>Hi</h1><script>x<y</script><ul><li>one<li>two</ul><img alt='pic'><p>a &amp; b</p></body></html>"
    docs = spark.createDataFrame([(1, page)], "doc_id long, content string")
    rows = structured.html_elements(docs).orderBy("position").collect()
    assert [(r["element_type"], r["text"]) for r in rows if r["text"]] == [("header", "Hi"), ("list_item", "one"), ("list_item", "two"), ("image", "pic"), ("paragraph", "a & b")]
    bad = spark.createDataFrame([(1, "<a><b>x</b><b>y</b></a>"), (2, "<a>")], "doc_id long, content string")
    rows = structured.xml_elements(bad).collect()
    assert [r["element_type"] for r in rows if r["doc_id"] == 1] == ["xml_list", "xml_element", "xml_element"]
    assert [r["error"] is not None for r in rows if r["doc_id"] == 2] == [True]


def test_markdown(spark):
    body = "---\na: 1\n---\n# T\ntext [x](y.md) <https://e.org>\n- i\n> q\n| a | b |\n```\n# no\n```\n"
    docs = spark.createDataFrame([(1, body)], "doc_id long, content string")
    kinds = [r["element_type"] for r in structured.markdown_elements(docs).orderBy("position").collect()]
    assert kinds == ["header", "paragraph", "list_item", "blockquote", "table_row", "code_block"]
    assert {r["target"] for r in structured.markdown_links(docs).collect()} == {"y.md", "https://e.org"}


def test_office(spark):
    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in parts.items():
                z.writestr(name, content)
        return out.getvalue()

    w = 'xmlns:w="http://w"'
    docx = packed({"word/document.xml": f'<w:d {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:t>b</w:t></w:r></w:p></w:d>'})
    xlsx = packed({"xl/sharedStrings.xml": "<s><si><t>hello</t></si></s>", "xl/worksheets/sheet1.xml": '<w><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></w>'})
    files = spark.createDataFrame([(1, docx), (2, xlsx), (3, b"junk")], "doc_id long, content binary")
    rows = structured.office_elements(files).collect()
    assert [(r["element_type"], r["text"]) for r in rows if r["doc_id"] == 1] == [("header", "Top"), ("paragraph", "ab")]
    sheet = [r for r in rows if r["doc_id"] == 2]
    assert [r["element_type"] for r in sheet] == ["workbook", "sheet", "table_row", "table_cell", "table_cell"]
    assert [(r["name"], r["text"]) for r in sheet if r["element_type"] == "table_cell"] == [("A1", "hello"), ("B1", "5")]
    assert [r["error"] is None for r in rows if r["doc_id"] == 3] == [False]
    kinds = files.select("doc_id", text.binary_type(F.col("content")).alias("k")).collect()
    assert {r["doc_id"]: r["k"] for r in kinds} == {1: "docx", 2: "xlsx", 3: "binary"}


def test_strength(spark):
    row = spark.range(1).select(context.strength(F.lit("parent"), F.lit(2), F.lit("header")).alias("s")).first()
    assert row["s"] == pytest.approx(0.79)


def test_greedy_passes_over_what_does_not_fit(spark):
    """An item that does not fit is passed over, a critical one (priority 1) is cut to what is left."""
    for first, want in ((2, ["a", "c"]), (1, ["a", "b"])):
        items = spark.createDataFrame([(first, 1, "a", 50), (first, 2, "b", 90), (3, 1, "c", 40)], "priority int, distance int, id string, tokens long")
        chosen = items.agg(context.greedy(F.collect_list(F.struct("priority", "distance", "id", "tokens")), 100).alias("c")).first()["c"]
        assert chosen == want


def test_queue(spark):
    assert queue.run_id({"b": 1, "a": 2}) == queue.run_id({"a": 2, "b": 1}) and len(queue.run_id({})) == 16
    now = datetime(2024, 1, 1, 12)
    rows = [(1, "pending", None, now, 0), (2, "retry", datetime(2024, 1, 1, 11), now, 5), (3, "retry", datetime(2024, 1, 1, 13), now, 9), (4, "processing", None, datetime(2024, 1, 1, 11), 1), (5, "processing", None, now, 1)]
    table = spark.createDataFrame(rows, "queue_id long, status string, next_attempt_at timestamp_ntz, created_at timestamp_ntz, priority int")
    assert [r["queue_id"] for r in queue.claimable(table, F.lit(now).cast("timestamp_ntz")).collect()] == [2, 4, 1]


def test_failure_state(spark, tmp_path):
    rows = [(1, False, 1), (1, False, 2), (2, False, 1), (2, True, 2), (3, False, 1), (3, False, 2), (3, False, 3), (3, False, 4)]
    spark.createDataFrame(rows, "source_id long, ok boolean, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id long, ok boolean, at long").parquet(str(tmp_path / "in"))
    out = []

    def collect(batch, _):
        out.extend(batch.collect())

    q = queue.failure_state(stream).writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["source_id"]: (r["failures"], r["status"], r["delay"]) for r in out} == {1: (2, "retry", 120), 2: (0, "ok", 0), 3: (4, "failed", 0)}


def _element(spark, rows):
    return spark.createDataFrame(rows, "element_id string, doc_id long, parent_id string, element_type string, position int, level int, text string")


def test_lists_nest_and_tables_are_whole(spark):
    rows = [
        ("l", 1, None, "list", 0, None, ""), ("x", 1, "l", "list_item", 1, None, "x"), ("m", 1, "x", "list", 2, None, ""), ("y", 1, "m", "list_item", 3, None, "y<"),
        ("w", 1, "y", "list_item", 4, None, "w"), ("z", 1, "l", "list_item", 5, None, "z"), ("k", 1, None, "list", 6, None, ""), ("o", 1, "k", "list_item", 7, None, "o"),
        ("p", 1, None, "paragraph", 8, None, "p | --- | q"),
        ("t", 1, None, "table", 9, None, ""), ("r1", 1, "t", "table_row", 10, None, ""), ("c1", 1, "r1", "table_cell", 11, None, "1"), ("c2", 1, "r1", "table_cell", 12, None, "2|"),
        ("r2", 1, "t", "table_row", 13, None, ""), ("c3", 1, "r2", "table_cell", 14, None, "3"),
        ("t2", 1, None, "table", 15, None, ""), ("r3", 1, "t2", "table_row", 16, None, ""), ("c4", 1, "r3", "table_header", 17, None, "h"),
        ("e", 2, None, "paragraph", 0, None, " "),
    ]
    e = _element(spark, rows)
    assert [tuple(r) for r in tree.as_html(e).collect()] == [
        (1, "<ul><li>x<ul><li>y&lt;<ul><li>w</li></ul></li></ul></li><li>z</li></ul>\n<ul><li>o</li></ul>\n<p>p | --- | q</p>\n"
            "<table><tbody><tr><td>1</td><td>2|</td></tr><tr><td>3</td></tr></tbody></table>\n<table><thead><tr><th>h</th></tr></thead></table>")
    ]
    assert tree.as_markdown(e).first()["markdown"] == (
        "- x\n  - y<\n    - w\n- z\n\n- o\n\np | --- | q\n\n| 1 | 2\\| |\n| --- | --- |\n| 3 |\n\n| h |\n| --- |"
    )


def test_markdown_of_many_paragraphs_is_linear(spark):
    import time

    e = spark.range(20_000).select(
        F.concat(F.lit("e"), "id").alias("element_id"), F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit("paragraph").alias("element_type"), F.col("id").alias("position"), F.lit(None).cast("int").alias("level"), F.repeat(F.lit("x"), 300).alias("text"),
    )
    tree.as_markdown(e.limit(10)).collect()
    began = time.time()
    assert len(tree.as_markdown(e).first()["markdown"]) == 20_000 * 302 - 2
    assert time.time() - began < 10


def test_labels_turn_ancestry_into_ranges(spark):
    rng = random.Random(8)
    rows, parents = [], {}
    for doc in range(3):
        stack = []
        for i in range(120):
            own = f"d{doc}e{i}"
            del stack[rng.randint(0, len(stack)):]
            parents[own] = stack[-1] if stack else rng.choice([None, own, f"gone{doc}"])
            rows.append((own, doc, parents[own], "p", i, None, "x"))
            stack.append(own)
    rows += [(f"c{i}", 9, f"c{i - 1}" if i else None, "p", i, None, "x") for i in range(300)]
    parents |= {f"c{i}": f"c{i - 1}" if i else None for i in range(300)}

    def path(x):
        out = []
        while parents.get(x) not in (None, x):
            x = parents[x]
            out.append(x)
        return out

    e = _element(spark, rows).repartition(4)
    found = {r["element_id"]: r for r in tree.labels(e).collect()}
    assert len(found) == len(rows) and {k: r["ancestor_ids"] for k, r in found.items()} == {k: path(k) for k in found}
    assert all(r["depth"] == len(r["ancestor_ids"]) and r["placed"] != (r["parent_id"] or "").startswith("gone") for r in found.values())
    below = {(a, b): path(b).index(a) + 1 for b in found for a in path(b) if a in found}
    tops = spark.createDataFrame([("d0e0",), ("d1e5",), ("c7",)], "element_id string")
    got = {(r["ancestor_id"], r["element_id"]): r["steps"] for r in tree.descendants(tree.labels(e), tops).collect()}
    assert got == {k: v for k, v in below.items() if k[0] in ("d0e0", "d1e5", "c7")}
    plan = tree.labels(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(e).collect()} == {k: path(k) for k in found}


def test_ancestry_of_elements_out_of_order(spark):
    rows = [("a", 1, None, "p", 0, None, ""), ("b", 1, "a", "p", 1, None, ""), ("c", 1, "a", "p", 2, None, ""), ("d", 1, "b", "p", 3, None, ""), ("e", 2, "d", "p", 0, None, "")]
    paths = {r["element_id"]: r["ancestor_ids"] for r in tree.ancestry(_element(spark, rows)).collect()}
    assert paths == {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "a"], "e": ["d", "b", "a"]}


def test_entity_pairs_are_not_shuffled(spark):
    rows = [("a", "x", [1, 2]), ("c", "x", [2]), ("b", "y", [1, 2]), ("d", "y", [2]), ("b", "y", [2]), ("a", "y", [1]), ("e", "y", None)]
    table = spark.createDataFrame(rows, "entity_id string, entity_type string, elements array<int>")
    found = [tuple(r) for r in edges.entity_pairs(table, "x", "y", overlap="elements").collect()]
    assert sorted(found) == [("a", "b"), ("a", "d"), ("c", "b"), ("c", "d")]
    single = edges.entity_pairs(table, "x", "y", overlap="elements")._jdf.queryExecution().optimizedPlan().toString()
    assert single.startswith("Union")
