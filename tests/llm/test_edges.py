"""Rows that repeat, keys that are null, clashing columns and hostile texts; the classifier's training against a plain loop."""

import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import line_dedup, packing, quality, sharding, token_count

P = pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
DOCS = "doc_id long, text string, key string, size long, n_tokens int, start int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], DOCS)


ROWS = [(1, "one two three"), (1, "one two three"), (1, "other words"), (None, "no key"), (None, None), (2, "")]


def test_token_counts_of_repeated_null_and_no_rows(spark):
    path = P.path("byte_bpe_50k.json")
    found = token_count.count_tokens(docs(spark, ROWS), path).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"]) for r in found) == sorted((repr(i), len(t or "")) for i, t in ROWS)
    assert token_count.count_tokens(docs(spark, []), path).collect() == []


def test_shards_of_null_keys(spark):
    found = sharding.shard_map(docs(spark, ROWS), limit=10, bits_per_round=3).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"]) for r in found) == sorted((repr(i), len(t or "")) for i, t in ROWS)
    assert len({r["shard"] for r in found if r["doc_id"] is None}) == 1


def test_packing_of_repeated_and_null_keys(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = packing.pack(docs(spark, ROWS).repartition(2), path).collect()
    wanted = [(repr(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ROWS]
    assert sorted((repr(r["doc_id"]), r["doc_tokens"]) for r in found if r["start"] == 0) == sorted(wanted)
    assert sum(r["length"] for r in found) == sum(n for _, n in wanted)
    assert packing.pack(docs(spark, []), path).collect() == []


def lines_left(spark, rows, **options):
    schema = "page_id long, url string, html string, host string, lines string, host_pages int, key int"
    pages = spark.createDataFrame([(i, u, h, "clash", "clash", 1, 2) for i, u, h in rows], schema)
    found = line_dedup.drop_boilerplate(pages, host=line_dedup.host_of(F.col("url")), text=F.col("html"), **options).collect()
    return {r["page_id"]: (r["text"], r["n_dropped"]) for r in found}


def test_a_line_at_exactly_the_ratio_stays(spark):
    rows = [(i, "https://a.org/", ("often\n" if i < 6 else "") + ("more\n" if i < 7 else "") + f"own {i}") for i in range(20)]
    found = lines_left(spark, rows, ratio=0.3)
    assert found[0] == ("often\nown 0", 1) and found[6] == ("own 6", 1) and found[19] == ("own 19", 0)
    assert lines_left(spark, rows, ratio=0.35)[0] == ("often\nmore\nown 0", 0)  # seven of twenty is exactly that share


def test_lines_of_megabytes(spark):
    long = "x" * 3_000_000
    rows = [(i, "https://a.org/", f"{long}\nown {i}") for i in range(4)] + [(9, "https://b.org/", long)]
    found = lines_left(spark, rows)
    assert all(found[i] == (f"own {i}", 1) for i in range(4)) and found[9] == (long, 0)


def test_quality_training_is_the_plain_loop(spark):
    """Weights of the fitted model against stochastic gradient descent written out in plain Python."""
    texts = ["good clean words here", "bad bad noise", "clean words again", "noise and bad noise", "", "words"]
    labels = [1, 0, 1, 0, 1, 1]
    options = {"buckets": 128, "dims": 4, "epochs": 3, "rate": 0.2, "favour": 2.0, "shortest": 3, "longest": 4}
    rated = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, quality int")
    model = quality.fit(docs(spark, list(enumerate(texts))), rated, **options)

    order = sorted(range(6), key=lambda i: (zlib.crc32(str(i).encode()), labels[i], texts[i].encode()))
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / 4, 1 / 4, (128, 4)).astype(np.float32).tolist()
    layer, bias = [[0.0, 0.0] for _ in range(4)], [0.0, 0.0]
    bags = []
    for i in order:
        ids, share = quality.features(texts[i].encode(), 128, 3, 4)
        bags.append((ids.tolist(), share.tolist(), labels[i]))
    done = 0
    for _ in range(3):
        for n in rng.permutation(6):
            ids, share, y = bags[n]
            if not ids:
                continue
            step = 0.2 * (1 - done / 18)
            done += 1
            hidden = [sum(s * vectors[b][d] for b, s in zip(ids, share)) for d in range(4)]
            logits = [sum(h * layer[d][c] for d, h in enumerate(hidden)) + bias[c] for c in range(2)]
            odds = [math.exp(z - max(logits)) for z in logits]
            error = [(o / sum(odds) - (c == y)) * (2.0 if y else 1.0) for c, o in enumerate(odds)]
            back = [sum(layer[d][c] * error[c] for c in range(2)) for d in range(4)]
            norm = sum(s * s for s in share)
            for d in range(4):
                for c in range(2):
                    layer[d][c] -= step * hidden[d] * error[c]
            for c in range(2):
                bias[c] -= step * 0.1 * error[c]
            for b, s in zip(ids, share):
                for d in range(4):
                    vectors[b][d] -= step / norm * s * back[d]
    wanted = [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(4)) for v in vectors]
    assert np.allclose(model.weight, wanted, atol=1e-4) and math.isclose(model.bias, bias[1] - bias[0], abs_tol=1e-4)
    assert max(map(abs, wanted)) > 0.05
