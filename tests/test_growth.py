"""Work that must not grow faster than the input: plans and shapes of operators over larger tables."""

from arborlake.operators import tree


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_laid_out_with_one_shuffle(spark):
    rows = [
        (1, 0, "h", None, "header", 1, "T"),
        (1, 1, "u", "h", "list", None, ""),
        (1, 2, "a", "u", "list_item", None, "one"),
        (1, 3, "b", "a", "list_item", None, "two"),
        (1, 4, "c", "u", "list_item", None, "three"),
        (1, 5, "t", "h", "table", None, ""),
        (1, 6, "r", "t", "table_row", None, ""),
        (1, 7, "x", "r", "table_header", None, "k|"),
        (1, 8, "y", "r", "table_header", None, None),
        (1, 9, "s", "t", "table_row", None, ""),
        (1, 10, "z", "s", "table_cell", None, "v"),
        (None, 0, "p", None, "list_item", None, "kept"),
    ]
    e = spark.createDataFrame(rows, "doc_id long, position int, element_id string, parent_id string, element_type string, level int, text string")
    for laid in (tree.as_html(e), tree.as_markdown(e)):
        plan = _plan(laid)
        assert plan.count("Exchange") == 1 and "Join" not in plan, plan
    html = {r["doc_id"]: r["html"] for r in tree.as_html(e).collect()}
    assert html[1] == (
        "<h1>T</h1>\n<ul><li>one<ul><li>two</li></ul></li><li>three</li></ul>\n"
        "<table><thead><tr><th>k|</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>"
    )
    assert html[None] == "<ul><li>kept</li></ul>"
    text = {r["doc_id"]: r["markdown"] for r in tree.as_markdown(e).collect()}
    assert text[1] == "# T\n\n- one\n  - two\n- three\n\n| k\\| |\n| --- | --- |\n| v |"


def test_small_dictionary_is_looked_up_without_a_shuffle(spark):
    from arborlake.operators import dictionary

    terms = spark.createDataFrame([("New York", "city"), ("new york", "state"), ("York", "city"), ("york city hall", "place"), ("!", "none"), ("ΟΔΟΣ", "road")], "term string, entity_type string")
    rows = [(1, "To NEW-York City!"), (1, "york, York City Hall"), (2, None), (3, " ?! "), (None, "οδος İYork york")]
    e = spark.createDataFrame(rows, "element_pk long, text string")
    found = dictionary.matches(e, terms)
    assert "Exchange" not in _plan(found) and "Window" not in _plan(found)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(
        [
            (1, "city", "new york", 1, 2, "NEW York"),
            (1, "state", "new york", 1, 2, "NEW York"),
            (1, "city", "york", 0, 1, "york"),
            (1, "place", "york city hall", 1, 3, "York City Hall"),
            (None, "road", "οδος", 0, 1, "οδος"),
            (None, "city", "york", 2, 1, "york"),
        ],
        key=repr,
    )
    inner = {tuple(r)[1:5] for r in dictionary.matches(e.limit(1), terms, longest=False).collect()}
    assert inner == {("city", "new york", 1, 2), ("state", "new york", 1, 2), ("city", "york", 2, 1)}


def test_embeddings_of_a_table_take_no_shuffle(spark):
    from pyspark.sql import functions as F

    from arborlake.functions import vectors

    rows = [((1, "a"), "one Two, two-ÉTÉ ΟΔΟΣ'ΟΔΟΣ"), ((1, "a"), "two"), ((2, None), None), (None, "--"), ((3, "c"), "x " * 5000)]
    e = spark.createDataFrame(rows, "k struct<i:long,s:string>, t string")
    found = vectors.hashing_embeddings(e, "k", "t", 8)
    assert "Exchange" not in _plan(found)
    one = e.select("k", vectors.hashing_embedding(F.col("t"), 8).alias("embedding"))
    got, want = ([(r["k"], [round(x, 12) for x in r["embedding"]]) for r in df.collect()] for df in (found, one))
    assert got == want and len(got) == 5


def _forest(rng, docs):
    """Rows in document order: trees with elements without text, unknown parents and elements that are their own parents."""
    rows = []
    for doc in docs:
        stack = []
        for i in range(rng.randrange(1, 40)):
            own = f"d{doc}e{i}"
            del stack[rng.randint(0, len(stack)) :]
            parent = stack[-1] if stack else rng.choice([None, own, f"gone{doc}"])
            kind = rng.choice(["root", "p", "p", "p", None])
            rows.append((own, doc, parent, kind, i, rng.choice([f"text {own}", f"text {own}", " ", "", None])))
            stack.append(own)
    return rows


def test_contexts_take_one_shuffle(spark):
    import random

    rng = random.Random(6)
    kinds = "element_id string, doc_id long, parent_id string, element_type string, position int, text string"
    rows = _forest(rng, [*range(30), None])
    in_order = spark.createDataFrame(rows, kinds).repartition(3)
    found = tree.contexts(in_order, 2, 1, 2)
    plan = _plan(found)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
    for before, after, children in ((2, 1, 2), (0, 0, 1), (1, 2, 0), (3, 0, 9)):
        got, want = (
            sorted(map(tuple, f(in_order, before, after, children).select("element_id", "text", "parents", "siblings", "children").collect()))
            for f in (tree.contexts, tree._contexts_joined)
        )
        assert got == want and len(got) > 100
    moved = spark.createDataFrame([*rows, ("x1", 50, "x2", "p", 0, "late"), ("x2", 50, None, "p", 1, "up"), ("x3", 51, "x1", "p", 0, "far")], kinds)
    by_id = {r["element_id"]: r for r in tree.contexts(moved).collect()}
    assert by_id["x1"]["parents"] == ["up"] and by_id["x2"]["children"] == ["late"] and by_id["x3"]["parents"] == ["late", "up"]


def test_contexts_count_each_text_once(spark):
    from pyspark.sql import functions as F

    from arborlake.functions import context

    e = spark.createDataFrame([("a b", ["c"], None, [None, "d"])], "text string, p array<string>, s array<string>, c array<string>")
    whole = e.select(context.structured(F.col("text"), F.col("p"), F.col("s"), F.col("c"), 200).alias("x"))
    counts = whole._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert counts <= 8, counts
    assert whole.first()["x"] == "=== Main Content ===\na b\n\n=== Parent Context ===\nc"


def test_postings_do_not_shuffle_tokens(spark):
    from pyspark.sql import functions as F

    from arborlake.operators import fulltext

    rows = [(1, "One two, one-TWO ΟΔΟΣ"), (1, "two three four five six"), (1, "seven two"), (2, None), (3, " -- "), (None, "x"), (None, "x"), (4, "İstanbul 𐐀x ½ a_b")]
    rows += [(10 + i, f"w{i % 7} " * 3 + f"v{i}") for i in range(300)]
    e = spark.createDataFrame(rows, "element_pk long, text string").repartition(3)
    index = fulltext.postings(e)
    plan = _plan(index)
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1, plan
    listed = e.select("element_pk", fulltext.tokens(F.col("text")).alias("tokens")).select("element_pk", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    want = listed.groupBy("token", "element_pk", "length").agg(F.count(F.lit(1)).alias("tf"))
    assert index.schema.simpleString() == want.schema.simpleString()
    got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (index, want))
    assert got == want and ("two", 1, 5, 3) in got and ("x", None, 1, 2) in got


def test_entity_pairs_of_many_bins(spark, monkeypatch):
    import random

    from arborlake.operators import edges

    for name, most in (("_SOURCES", 5), ("_TARGETS", 3), ("_RUN", 2)):
        monkeypatch.setattr(edges, name, most)
    draw = random.Random(3)
    rows = [(f"{t}{i % 60}", t, draw.choice("ABCd"), draw.sample(range(6), draw.randint(0, 3))) for i in range(90) for t in "xy"]
    rows += [("z", "x", "a", [1]), ("z", "y", "a", [1]), (None, "x", "a", [1]), ("n", "y", None, [1])]
    table = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, elements array<int>")

    def wanted(agree):
        return sorted({(a[0], b[0]) for a in rows for b in rows if a[1] == "x" and b[1] == "y" and a[0] and a[0] != b[0] and a[2] and b[2] and agree(a, b)})

    found = lambda **by: sorted(map(tuple, edges.entity_pairs(table, "x", "y", **by).collect()))
    assert found(same=["name"]) == wanted(lambda a, b: a[2].lower() == b[2].lower())
    assert found(same=["name"], overlap="elements") == wanted(lambda a, b: a[2].lower() == b[2].lower() and set(a[3]) & set(b[3]))


def test_entity_pairs_take_less_than_a_byte_in_a_file(spark, tmp_path):
    from arborlake.operators import edges

    ids = spark.range(20_000).selectExpr("concat('s', id * 7919) AS entity_id", "'x' AS entity_type", "concat('k', id % 50) AS name")
    ids = ids.union(spark.range(2500).selectExpr("concat('t', id * 7919)", "'y'", "concat('k', xxhash64(id) % 25 + 25)"))
    edges.entity_pairs(ids, "x", "y", same=["name"]).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 600_000
