"""The corpus pipeline on the smallest tables, stage by stage."""

import os
import random

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from arborlake.llm import quality  # noqa: E402
from tests.llm.test_llm import brute_normal  # noqa: E402


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def table(spark, texts, ids):
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute_similar(texts, ids):
    """The smallest id of each group linked by a five-word Jaccard similarity of 0.8 or more, all pairs compared."""
    sets, by_shingle = [], {}
    for at, t in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1]:
            by_shingle.setdefault(s, []).append(at)
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in {b for s in sets[a] for b in by_shingle[s] if b < a}:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted(min(i for i, g in zip(ids, group) if g == x) for x in set(group))


def test_stages(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(documents.columns)
    good = kept["quality classifier"]
    model = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(documents, model).where("predicted = 1")
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in scored.collect())
    first = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(brute_normal(r["text"]), r["doc_id"])
    exact = kept["exact dedup"]
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())
    ids = [r["doc_id"] for r in exact]
    near = kept["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in near) == brute_similar([r["text"] for r in exact], ids)
    mixed = kept["source mixing"]
    texts = {r["doc_id"]: r["text"] for r in near}
    assert all(texts[r["doc_id"]] == r["text"] for r in mixed)
    pieces = kept["packing"]
    starts = sum(r["start"] == 0 for r in pieces)
    assert starts == len(mixed)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_near_copies_leave(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for size in [200] * 20 + [9, 12, 15, 20, 30, 45, 60, 90, 120, 600]:
        base = [rng.choice(words) for _ in range(size)]
        texts.append(base)
        for changed in (1, 3, 4, 5, 8):
            copy = list(base)
            for i in rng.sample(range(size), changed * size // 200 or 1):
                copy[i] = rng.choice(words)
            texts.append(copy)
        block = size // 10
        texts += [base[block:], base[:-1], base[:block] + [rng.choice(words) for _ in range(block)] + base[2 * block :]]
    texts += [["a", "b"], ["A", "b"], ["c"], []]
    texts = [" ".join(t) for t in texts]
    ids = rng.sample(range(1000), len(texts))
    wanted = brute_similar(texts, ids)
    assert len(wanted) < len(texts) - 100
    got = stage("SimHash near-dedup")(spark, table(spark, texts, ids), str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == wanted


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated keys, null sources, extra columns, empty tables: no stage fails."""
    odd = [None, "", " ", "one two three four five six seven"] * 2
    ids = [None, None, 1, 2, 2, 3, 4, 5]
    rows = [(i, t, None, None, None, "x", 1) for i, t in zip(ids, odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, c long")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        found = function(spark, docs, str(tmp_path)).collect()
        if name == "quality classifier":  # one class of labels only: nothing is learned, texts with words stay
            assert sorted(r["doc_id"] for r in found) == [2, 5]
        if name == "exact dedup":
            assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "2"]
        if name == "SimHash near-dedup":
            assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "2", "3", "4", "None", "None"]
        if name != "packing":
            assert found == [] or sorted(found[0].asDict()) == sorted(corpus_pipeline.COLUMNS)
