"""Ontologies, contexts, search order and upserts against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import context, extract, normalize, temporal, vectors
from arborlake.operators import edges, fulltext, ontology, search, storage, tree


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def tokens(text):
    return max(len(text) // 4, len(text.split()) * 4 // 3)


def first_tokens(text, most):
    now, words = tokens(text), text.split()
    return text if now <= most else " ".join(words[: len(words) * most // now])


def both_ends(text, most):
    now, words = tokens(text), text.split()
    if now <= most:
        return text
    if most <= 4:
        return first_tokens(text, most)
    head = (most - 4) * 2 // 3
    tail = (most - 4 - head) * len(words) // now
    return first_tokens(text, head) + "\n[...truncated...]\n" + (" ".join(words[-tail:]) if tail > 0 else "")


def fitting(texts, budget):
    chosen, used = [], 0
    for t in texts:
        n = tokens(t)
        if used + n <= budget:
            chosen.append(t)
            used += n
        else:
            if budget - used > 50:
                chosen.append(first_tokens(t, budget - used) + " [...]")
            break
    return "\n---\n".join(chosen)


def structured(text, parents, siblings, children, most):
    own, *rest = [int(most * s) for s in (0.40, 0.25, 0.20, 0.15)]
    unused = max(0, own - tokens(text))
    rest = [r + e for r, e in zip(rest, (unused // 3, unused // 3, unused - 2 * (unused // 3)))]
    parts = ["=== Main Content ===\n" + both_ends(text, own)]
    for name, texts, room in zip(("Parent", "Sibling", "Child"), (parents, siblings, children), rest):
        if body := fitting(texts, room):
            parts.append(f"=== {name} Context ===\n{body}")
    return "\n\n".join(parts)


def test_structured_contexts(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["alpha", "be", "gamma", "x", "delta"]) for _ in range(n))
    rows = [(i, words(rng.randrange(1, 400)), *[[words(rng.randrange(1, 150)) for _ in range(rng.randrange(4))] for _ in range(3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "i int, text string, p array<string>, s array<string>, c array<string>")
    got = table.select("i", context.structured(F.col("text"), F.col("p"), F.col("s"), F.col("c"), 300).alias("x")).collect()
    for r in got:
        assert r["x"] == structured(*rows[r["i"]][1:], 300)


def test_greedy_passes_over_and_cuts_the_critical(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        items = [(rng.randrange(1, 6), rng.randrange(5), f"e{j}", rng.randrange(1, 90)) for j in range(rng.randrange(8))]
        rows.append((i, items))
    table = spark.createDataFrame(rows, "i int, items array<struct<priority:int,distance:int,id:string,tokens:long>>")
    for r in table.select("i", context.greedy(F.col("items"), 120).alias("x")).collect():
        used, want = 0, []
        for priority, _, name, n in sorted(rows[r["i"]][1]):
            if used + n <= 120:
                used, want = used + n, [*want, name]
            elif priority == 1 and used < 120:
                used, want = 120, [*want, name]
        assert r["x"] == want


def test_semantic_pairs_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(i, int(i % 3), i, (base[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "element_pk long, doc_id int, position int, embedding array<double>")
    unit = np.array([r[3] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = set()
    for d in range(3):
        near = [(-float(unit[a] @ unit[b]), a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == d == b % 3 and unit[a] @ unit[b] >= 0.6]
        want |= {(a, b) for _, a, b in sorted(near)[: 2 * 20]}
    for block in (2048, 4):
        got = edges.semantic_pairs(table, 0.6, per_element=2, block=block).collect()
        assert {(r["source_id"], r["target_reference"]) for r in got} == want


def test_hashing_embeddings_agree(spark):
    texts = ["", None, "one", "Two words, two", "déjà vu " * 40]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    by_row = {r["k"]: r["e"] for r in table.select("k", vectors.hashing_embedding(F.col("t"), 16).alias("e")).collect()}
    by_table = {r["k"]: r["embedding"] for r in vectors.hashing_embeddings(table, "k", "t", 16).collect()}
    assert by_row.keys() == by_table.keys()
    for k, e in by_row.items():
        assert by_table[k] == pytest.approx(e)


def test_cosine_of_odd_vectors(spark):
    cases = [([1.0, 2.0], [2.0, 4.0], 1.0), ([1.0, 0.0, 5.0], [1.0, 1.0], 2**-0.5), ([0.0], [1.0], 0.0), ([], [1.0], 0.0), ([1.0, None], [1.0, 1.0], 2**-0.5)]
    table = spark.createDataFrame(cases, "a array<double>, b array<double>, x double")
    for r in table.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), "x").collect():
        assert r["c"] == pytest.approx(r["x"])


def elements(spark, rows):
    return spark.createDataFrame(rows, "element_id string, doc_id long, parent_id string, position int, element_type string, text string")


def test_semantic_rules_and_domains(spark):
    spec = {
        "name": "d",
        "terms": [{"id": "money", "label": "Money"}, {"id": "water", "label": "Water"}],
        "element_mappings": [
            {"term_id": "money", "rules": [{"type": "semantic", "semantic_phrase": "profit and loss", "confidence_threshold": 0.5}, {"type": "keywords", "keywords": ["cash"], "confidence": 0.4}]},
            {"term_id": "water", "rules": [{"type": "regex", "pattern": "riv.r"}]},
        ],
        "relationship_rules": [{"kind": "flows", "source": "money", "target": "water", "within": "other", "combine": "weighted", "weights": [1, 3], "minimum": 0.1}],
    }
    o = ontology.from_dict(spec)
    e = elements(spark, [("a", 1, "p", 1, "paragraph", "profit and loss"), ("b", 1, "p", 2, "paragraph", "cash flow"), ("c", 2, "q", 1, "paragraph", "a river"), ("d", 1, "p", 3, "paragraph", "a river")])
    found = {(r["element_id"], r["term"]): r["confidence"] for r in ontology.map_terms(e, o).collect()}
    assert found.keys() == {("a", "money"), ("b", "money"), ("c", "water"), ("d", "water")}
    assert found["a", "money"] == pytest.approx(1) and found["b", "money"] == 0.4
    with pytest.raises(ValueError):
        ontology.relate(e, ontology.map_terms(e, o), o.relationships[0])
    mappings, entities, near = ontology.domain_graph(e, o)
    assert {(r["source_id"], r["target_reference"], round(r["confidence"], 3)) for r in near.collect()} == {("a", "c", 1.0), ("b", "c", 0.85)}
    assert {r["entity_id"] for r in entities.collect()} == {"money:profit_and_loss", "money:cash_flow", "water:a_river"}
    with pytest.raises(ValueError):
        ontology.Rule("magic", ("x",))
    domains = ontology.Domains([o])
    assert domains.find_term("water") == ("d", "Water") and domains.map_terms(e).count() == 4
    domains.deactivate("d")
    assert domains.find_term("water") is None and domains.map_terms(e) is None and domains.active() == []
    domains.activate("d")
    assert domains.active() == [o]
    with pytest.raises(KeyError):
        domains.activate("none")
    yaml = pytest.importorskip("yaml")
    assert ontology.from_yaml(yaml.safe_dump(spec)) == o


COMBINED = {
    "average": lambda x, y: (x + y) / 2,
    "minimum": min,
    "maximum": max,
    "product": lambda x, y: x * y,
    "weighted": lambda x, y: (x * 0.5 + y * 0.5) / 1.0,
}


@pytest.mark.parametrize("direction", ["forward", "backward", "any"])
@pytest.mark.parametrize("combine", list(COMBINED))
def test_best_pairs_of_a_document(spark, combine, direction):
    rng = random.Random(f"{combine}{direction}")
    rows = [(f"e{i:03d}", rng.randrange(3), "p", rng.randrange(30), "paragraph", "x") for i in range(90)]
    e = elements(spark, rows)
    mapped = [(r[0], t, rng.choice([0.2, 0.5, 0.7, 0.9])) for r in rows for t in rng.choice(["s", "t", "st"])]
    mappings = spark.createDataFrame(mapped, "element_id string, term string, confidence double")
    place, score = {r[0]: (r[1], r[3]) for r in rows}, COMBINED[combine]
    for most in (1, 7, 60):
        rule = ontology.RelationshipRule("r", "s", "t", "document", direction, combine, 0.3)
        got = {(r["source_id"], r["target_reference"], round(r["confidence"], 9)) for r in ontology.relate(e, mappings, rule, most=most).collect()}
        want = set()
        for d in range(3):
            pairs = []
            for a, t, x in mapped:
                for c, u, y in mapped:
                    if (t, u) == ("s", "t") and a != c and place[a][0] == place[c][0] == d and score(x, y) >= 0.3:
                        if direction == "any" or (place[a][1] < place[c][1]) == (direction == "forward") and place[a][1] != place[c][1]:
                            pairs.append((-score(x, y), -x, -y, a, c))
            want |= {(a, c, round(-f, 9)) for f, _, _, a, c in sorted(pairs)[:most]}
        assert got == want


def test_best_pairs_of_a_long_document(spark):
    n = 50_000
    ids = spark.range(n).select(F.format_string("e%06d", "id").alias("element_id"), F.lit(1).alias("doc_id"), F.lit("p").alias("parent_id"), F.col("id").alias("position"), F.lit("x").alias("text"))
    mappings = ids.select("element_id", F.explode(F.array(F.lit("s"), F.lit("t"))).alias("term"), (F.pmod(F.xxhash64("element_id", "term"), F.lit(1000)) / 1000).alias("confidence"))
    for direction in ("any", "forward"):
        rule = ontology.RelationshipRule("r", "s", "t", "document", direction, "product")
        best = ontology.relate(ids, mappings, rule, most=100).collect()  # of 2.5 thousand million pairs
        assert len(best) == 100 and min(r["confidence"] for r in best) > 0.99
    with pytest.raises(ValueError, match="below zero"):
        ontology.relate(ids, mappings, ontology.RelationshipRule("r", "s", "t", combine="product", source_threshold=-1.0), most=3)


@pytest.mark.parametrize("combine", list(COMBINED))
def test_relate_across_keeps_the_best(spark, combine):
    combined = COMBINED[combine]
    rng = random.Random(6)
    rows = [(f"e{i:03d}", rng.randrange(4), "p", i, "paragraph", "x") for i in range(80)]
    e = elements(spark, rows)
    scores = {r[0]: (rng.choice("st"), rng.choice([0.2, 0.5, 0.7, 0.9])) for r in rows}
    mappings = spark.createDataFrame([(k, t, c) for k, (t, c) in scores.items()], "element_id string, term string, confidence double")
    rule = ontology.RelationshipRule("r", "s", "t", "other", combine=combine, minimum=0.5)
    got = {(r["source_id"], r["target_reference"]) for r in ontology.relate_across(e, mappings, rule, top=3).collect()}
    doc, want = {r[0]: r[1] for r in rows}, set()
    for a, (t, x) in scores.items():
        if t == "s":
            far = sorted((-combined(x, y), -y, b) for b, (u, y) in scores.items() if u == "t" and doc[b] != doc[a] and combined(x, y) >= 0.5)
            want |= {(a, b) for _, _, b in far[:3]}
    assert got == want


def test_page_is_ordered(spark):
    n = 400
    e = spark.createDataFrame([(i, i % 7, "paragraph", "t", "{}") for i in range(n)], "element_pk long, doc_id long, element_type string, text string, metadata string")
    v = spark.createDataFrame([(i, [1.0, float(i % 50)], ["x"], 1.0) for i in range(n)], "element_pk long, embedding array<double>, topics array<string>, confidence double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = search.Store(e, v).run(search.Builder().embedding([0.0, 1.0], threshold=0.0).options(limit=60).build()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert page == sorted(page, key=lambda r: (-r["final_score"], r["element_pk"])) and len(page) == 60


def test_upsert_takes_the_latest(spark):
    now = spark.createDataFrame([(1, "old"), (2, "kept")], "k int, v string")
    new = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (3, "n", 0)], "k int, v string, at int")
    assert sorted(map(tuple, storage.upsert(now, new, ["k"], latest_by="at").collect())) == [(1, "a"), (2, "kept"), (3, "n")]


def test_query_words_are_split_like_the_index(spark):
    e = spark.createDataFrame([(1, "The U.S. budget"), (2, "us budget"), (3, "s u")], "element_pk long, text string")
    index, totals = fulltext.postings(e), fulltext.index_statistics(e)
    for terms, want in ((["U.S."], {1, 3}), (["us budget"], {2}), (["BUDGET"], {1, 2})):
        scored = {r["element_pk"]: r["text_score"] for r in fulltext.bm25(index, totals, terms).collect()}
        scanned = {r["element_pk"]: r["text_score"] for r in fulltext.bm25_scan(e, terms).collect()}
        assert scored.keys() == want and scanned == pytest.approx(scored)
    marked = one(spark, fulltext.highlight(F.col("x"), ["a+b", "c"], "<$", ">"), x="a+b aab c.c")
    assert marked == "<$a+b> aab <$c>.<$c>"


def test_search_terms():
    q = search.Builder().text("net profit").topics("fin%").metadata(like={"k": "%net%"}).begin("NOT").text("gone").end().build()
    assert search.search_terms(q) == ["net", "profit", "fin"]


def test_places_and_contexts_of_values(spark):
    text = "Paid $5 then $5 million, 7% and 3x " + "z" * 80 + " €2"
    table = spark.createDataFrame([(1, text), (2, ""), (3, None)], "element_pk long, text string")
    rows = extract.values(table).collect()
    for r in rows:
        assert text[r["start"] : r["start"] + len(r["raw"])] == r["raw"]
        assert r["context"] == text[max(0, r["start"] - 50) : r["start"] + len(r["raw"]) + 50]
    listed = extract.by_position(extract.values(table)).first()["values"]
    assert [x["raw"] for x in listed] == ["$5", "$5 million", "7%", "3x", "€2"]


def test_listed_terms_and_titles(spark):
    assert one(spark, normalize.person(F.col("x")), x="Miss Jane Doe, PhD") == "jane doe"
    assert one(spark, extract.court_level(F.col("x")), x="Circuit Court of Appeals") == "APPELLATE"
    assert one(spark, extract.is_chronic(F.col("x")), x="Down Syndrome") is True
    found = extract.entities(spark.createDataFrame([(1, "18 U.S.C. § 5 and 17 C.F.R. 240.10")], "element_pk long, text string"), ["statute"])
    assert sorted(r["normalized"] for r in found.collect()) == ["17 CFR § 240.10", "18 USC § 5"]


def test_clock_times(spark):
    cases = {"12am": 0, "12:30 pm": 750, "13:45": 825, "9 a.m.": 540, "noon": 720, "25:00": None, "7:61": None, "x": None}
    for text, want in cases.items():
        assert one(spark, temporal.clock_minutes(F.col("x")), x=text) == want, text


def test_shared_ancestors_and_children(spark):
    rows = [("r", None), ("a", "r"), ("b", "r"), ("a1", "a"), ("b1", "b"), ("a2", "a")]
    e = spark.createDataFrame([(i, 1, p, n, "paragraph", "t") for n, (i, p) in enumerate(rows)], "element_id string, doc_id long, parent_id string, position int, element_type string, text string")
    pairs = spark.createDataFrame([("a1", "b1"), ("a1", "a2"), ("a", "b")], "a string, b string")
    assert sorted(map(tuple, tree.share_ancestor(e, pairs, 0).collect())) == [("a", "b"), ("a1", "a2")]
    assert sorted(map(tuple, tree.share_ancestor(e, pairs, 1).collect())) == [("a1", "a2"), ("a1", "b1")]
    assert {r["element_id"]: r["children"] for r in tree.first_children(e, 1).collect()} == {"r": ["a"], "a": ["a1"], "b": ["b1"]}


def test_semantic_rule_at_its_threshold(spark):
    near = [("at", 0.4 - 4e-16), ("below", 0.4 - 1e-9), ("above", 0.41)]
    e = spark.createDataFrame([(k, "t", [x, (1 - x * x) ** 0.5]) for k, x in near], "element_id string, text string, embedding array<double>")
    rule = ontology.Rule("semantic", ("phrase",), threshold=0.4)
    found = ontology.map_terms(e, ontology.Ontology("d", {"t": "T"}, {"t": (rule,)}), lambda _: vectors.literal([1.0, 0.0])).collect()
    assert {r["element_id"] for r in found} == {"at", "above"}
