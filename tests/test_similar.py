"""Similarity joins against all pairs."""

import numpy as np
import pytest

from arborlake.operators import edges, similar

SCHEMA = "element_pk string, doc_id string, embedding array<double>, id int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, d, v, 1, "x") for i, d, v in rows], SCHEMA)


def drawn(n, centres, dim=24, near=0.35, seed=1):
    """Clusters of vectors, each with a few relatives in other documents."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(0, centres, n)] + near * rng.normal(size=(n, dim)) * np.sqrt(rng.random((n, 1)) * 6)
    return [(f"e{i:05d}", f"d{i % 97}", x.tolist()) for i, x in enumerate(v)]


def brute(sources, targets, threshold, top):
    def usable(rows):
        return [(i, d, np.array(v, float)) for i, d, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == len(targets[0][2])]

    s, t = usable(sources), sorted(usable(targets), key=lambda r: r[0])
    unit = lambda rows: np.array([v / np.linalg.norm(v) for _, _, v in rows])
    scores, out = np.round(unit(s) @ unit(t).T, 14), set()
    docs = np.array([d if d is not None else f"none{k}" for k, (_, d, _) in enumerate(t)])
    for k, (i, d, _) in enumerate(s):
        own = np.where(docs == d, -2, scores[k]) if d is not None else scores[k]
        best = np.argsort(-own, kind="stable")[:top]
        out |= {(i, t[j][0]) for j in best if own[j] >= threshold}
    return out


def found(df):
    return {(r["source_id"], r["target_reference"]) for r in df.collect()}


@pytest.mark.parametrize("threshold, top, block, lists", [(0.8, 5, 4096, None), (0.6, 20, 64, 30), (-1.0, 3, 32, 7)])
def test_exact_join(spark, threshold, top, block, lists):
    rows = drawn(600, 12)
    rows += [("null", "d1", None), ("zero", "d1", [0.0] * 24), ("nan", "d1", [float("nan")] * 24), ("short", "d1", [1.0]), ("hole", "d1", [None] * 24)]
    rows += [(f"same{i:03d}", f"d{i % 3}", rows[0][2]) for i in range(150)]  # a list of a fifth of all
    rows += [("lone", None, rows[1][2]), ("twin", None, rows[1][2])]
    df = table(spark, rows).repartition(5)
    got = similar.join(df, df, threshold=threshold, top=top, block=block, lists=lists)
    assert found(got) == brute(rows, rows, threshold, top)
    assert all(r["similarity"] <= 1 for r in got.collect())


@pytest.mark.parametrize("n, centres, threshold", [(2000, 40, 0.9), (8000, 120, 0.85)])
def test_recall_and_work_of_few_lists(spark, n, centres, threshold):
    rows = drawn(n, centres, seed=n)
    asked = rows[::7]
    df, sources = table(spark, rows), table(spark, asked)
    index = similar.build(df, lists=80)
    index = similar.fitted(index, sources, threshold=threshold, top=10, recall=0.97)
    wanted = brute(asked, rows, threshold, 10)
    got = found(similar.search(index, sources, threshold=threshold, top=10))
    assert len(wanted) > len(asked)
    assert len(got & wanted) >= 0.9 * len(wanted)
    unit = np.array([v for _, _, v in asked])
    row, at = index.lists(unit / np.linalg.norm(unit, axis=1, keepdims=True), threshold)
    scored = index.sizes[at].sum() / len(asked)  # targets compared with a source
    assert scored < 0.35 * n, (scored, n)


def test_angles_pass_by_lists_without_loss(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 16)) * 3
    rows = [(f"e{i}", f"d{i}", (middle[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(900)]
    index = similar.build(table(spark, rows), lists=30)
    unit = np.array([v for _, _, v in rows])
    row, at = index.lists(unit / np.linalg.norm(unit, axis=1, keepdims=True), 0.95)
    assert index.sizes[at].sum() < 0.3 * len(rows) ** 2
    df = table(spark, rows)
    assert found(similar.search(index, df, threshold=0.95, top=8)) == brute(rows, rows, 0.95, 8)


def test_empty_and_other_ids(spark):
    none = table(spark, [])
    some = table(spark, [("a", "x", [1.0, 0.0]), ("b", "y", [1.0, 0.1])])
    assert similar.join(some, none, threshold=0.5, top=3).collect() == []
    assert similar.join(none, some, threshold=0.5, top=3).collect() == []
    assert similar.join(none, some, threshold=0.5, top=3, recall=0.9).collect() == []
    held = some.selectExpr("element_pk", "doc_id", "embedding", "'header' AS element_type")
    assert {(r["source_id"], r["target_reference"]) for r in edges.section_edges(held, 0.5).collect()} == {("a", "b"), ("b", "a")}


def test_sources_meet_packs_of_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i:04d}", f"d{i % 41}", v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    df = table(spark, rows)
    index = similar.build(df, lists=60, block=400)
    unit = np.array([v for _, _, v in rows])
    row, _ = index.lists(unit / np.linalg.norm(unit, axis=1, keepdims=True), 0.5)
    assert len(row) > 30 * len(rows)  # hardly a list can be passed by
    first, parts = index.packs()
    assert int((first + parts).max()) <= 12  # what a source is sent to at most
    assert found(similar.search(index, df, threshold=0.5, top=4)) == brute(rows, rows, 0.5, 4)
    first, parts = similar.replace(index, sizes=np.array([5, 2000, 5, 0, 990])).packs()
    assert first.tolist() == [0, 1, 6, 6, 7] and parts.tolist() == [1, 5, 1, 1, 3]
