"""Positions, covers, phrases and fragments against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import positions

VOCABULARY = ["a", "b", "c", "x", "y", "Ä"]


def brute_covers(tokens, weights, terms):
    out = []
    for i in range(len(tokens)):
        for j in range(i, len(tokens)):
            held = set(tokens[i : j + 1])
            if set(terms) <= held and not set(terms) <= set(tokens[i + 1 : j + 1]) and not set(terms) <= set(tokens[i:j]):
                at = [k for k in range(i, j + 1) if tokens[k] in terms]
                out.append((i, j, len(at), len(at) / sum(1 / weights[k] for k in at) / (1 + j - i + 1 - len(at))))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, n)))
    listed = [(f"e{i}", said(5), said(25)) for i in range(80)] + [("null", None, None), ("gap", "A", "!b?; --c"), ("empty", "", "")]
    return listed, spark.createDataFrame(listed, "id string, title string, body string").repartition(3)


def laid(row):
    parts = [(row[1] or "", 1.0), (row[2] or "", 0.25)]
    pairs = [(w.strip("!?;-").lower(), weight) for text, weight in parts for w in text.split() if w.strip("!?;-")]
    return [t for t, _ in pairs], [w for _, w in pairs]


@pytest.mark.parametrize("terms", [["a"], ["A", "b"], ["c", "ä", "b"], ["a", "absent"], []])
def test_covers(spark, rows, terms):
    listed, df = rows
    index = positions.positional(df, {"title": 1.0, "body": 0.25}, key="id")
    found = sorted((r["element_pk"], r["begin"], r["end"], r["hits"], round(r["density"], 9)) for r in positions.covers(index, terms).collect())
    asked = [t.lower() for t in terms]
    wanted = [(r[0], i, j, n, round(d, 9)) for r in listed if asked for i, j, n, d in brute_covers(*laid(r), asked)]
    assert found == sorted(wanted)
    near = {r["element_pk"]: (r["begin"], r["end"]) for r in positions.near(index, terms, 3).collect()}
    assert near == {k: min((j - i, i, j) for e, i, j, *_ in wanted if e == k)[1:] for k in {w[0] for w in wanted if w[2] - w[1] < 3}}


@pytest.mark.parametrize("text", ["a b", "a b a", "x x", "Ä, x!", "b c absent", ""])
def test_phrase(spark, rows, text):
    listed, df = rows
    index = positions.positional(df, {"title": 1.0, "body": 0.25}, key="id")
    asked = positions.terms_in_order(text)
    wanted = {}
    for r in listed:
        tokens, _ = laid(r)
        at = [i for i in range(len(tokens)) if asked and tokens[i : i + len(asked)] == asked]
        if at:
            wanted[r[0]] = at
    assert {r["element_pk"]: r["begins"] for r in positions.phrase(index, text).collect()} == wanted


def test_written_index_reads_the_buckets_of_its_terms(spark, rows, tmp_path):
    _, df = rows
    index = positions.positional(df, {"title": 1.0, "body": 0.25}, key="id")
    positions.write_index(index, str(tmp_path / "index"), buckets=8)
    held = positions.read_index(spark.read.parquet(str(tmp_path / "index")), ["a", "B"], buckets=8)
    assert sorted(map(tuple, held.select("token", "element_pk").collect())) == sorted(map(tuple, index.where("token IN ('a', 'b')").select("token", "element_pk").collect()))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan
    scored = positions.cover_density(held, ["a", "b"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the places of the asked terms, by element
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, positions.cover_density(index, ["a", "b"]).collect()))


def shown(spark, text, terms, **options):
    return spark.createDataFrame([(text,)], "t string").select(positions.fragments(F.col("t"), terms, **options)).first()[0]


def test_fragments(spark):
    assert shown(spark, None, ["a"]) == shown(spark, "", ["a"]) == shown(spark, "?! --", ["a"]) == ""
    assert shown(spark, "one two, three four", ["absent"], least=2) == "one two"
    assert shown(spark, "one two, three four", [], least=3) == "one two, three"
    assert shown(spark, "(One) two, Three!", ["one", "three"], least=1, most=3) == "<b>One</b>) two, <b>Three</b>"
    text = "a 1 2 3 4 5 6 b a 7 8 9 10 11 12 b 13 14"
    assert shown(spark, text, ["a", "b"], most=3, least=1, count=1) == "<b>b</b> <b>a</b>"
    assert shown(spark, text, ["a", "b"], most=3, least=1, count=3) == "<b>a</b> ... <b>b</b> <b>a</b> ... <b>b</b>"
    assert shown(spark, text, ["a", "b"], most=3, least=4, count=1, before="[", after="]") == "6 [b] [a] 7"
    assert shown(spark, text, ["14"], least=5, count=1) == "12 b 13 <b>14</b>".replace("12", "11 12")


def test_fragments_of_a_long_text_stay_short(spark):
    long = "cat " + "word " * 60_000 + "cat dog " + "word " * 60_000
    assert shown(spark, long, ["cat", "dog"], least=4, count=1) == "word <b>cat</b> <b>dog</b> word"
    dense = shown(spark, "cat " * 30_000, ["cat"], count=2)
    assert dense.count("<b>cat</b>") == 100
