"""Vector codes and whitening against brute force in exact integers and in numpy."""

import hashlib
import math
import random
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from arborlake.llm import queries, vector_codes, whitening
from arborlake.llm.vector_codes import KdTree

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, x int, code string, `of` int, n long, part int"


def table(spark, rows):
    """Vectors with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, lab, 1, "c", 2, 3, 4) for i, v, lab in rows], SCHEMA)


def odd_rows(rng, n=60, dim=8):
    rows = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(3, rows[3][1], None), (7, rows[9][1], 1), (None, rows[4][1], 5), (None, rows[5][1], None), rows[0]]
    rows += [(900, None, 1), (901, [], 1), (902, [NAN] * dim, 1), (903, [INF] + [0.0] * (dim - 1), 1), (904, [None] * dim, 1), (905, [1.0], 1)]
    rows += [(1000 + i, rows[1][1], 9) for i in range(200)]  # a hot vector, a hot label
    rng.shuffle(rows)
    return rows


def taking_part(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])]


# 11


@pytest.mark.parametrize("kind", [np.int64, object])
def test_kd_tree_finds_the_lowest_of_the_nearest(kind):
    rng = np.random.default_rng(3)
    for size, width in ((1, 3), (5, 1), (40, 2), (256, 4), (256, 16)):
        entries = rng.integers(-3, 4, (size, width)).astype(kind)  # a grid: many equal entries and equal distances
        rows = rng.integers(-4, 5, (300, width)).astype(kind)
        if kind is object:
            entries, rows = entries * 10**30, rows * 10**30
        index, far = KdTree(entries).nearest(rows)
        all_far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == [min(range(size), key=lambda e: (f[e], e)) for f in all_far.tolist()]
        assert far.tolist() == [min(f) for f in all_far.tolist()]


def test_kd_tree_passes_by_what_is_far():
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.normal(100_000 * c, 10, (32, 4)) for c in range(8)]).astype(np.int64)
    tree, looked = KdTree(entries), 0
    compare = tree._compare

    def counted(leaf, who, *rest):
        nonlocal looked
        looked += len(who)
        compare(leaf, who, *rest)

    tree._compare = counted
    rows = rng.normal(300_000, 10, (1000, 4)).astype(np.int64)
    tree.nearest(rows)
    assert looked < len(tree.leaves) * len(rows) / 2


def brute_codes(rows, factor, parts, entries, rounds):
    floor = lambda v: [max(-(2**58), min(2**58, math.floor(factor * c))) for c in v]
    rows = [(i, floor(v), lab) for i, v, lab in rows]
    dim = len(rows[0][1])
    ends = vector_codes.cuts(dim, parts)
    cut = lambda v, p: v[ends[p] : ends[p + 1]]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    nearest = lambda v, book: min((far(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for _, v, _ in rows:
                taken.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for i, of in taken.items():
                books[p][i] = [sum(c) // len(of) for c in zip(*of)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, lab in rows:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(f for f, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{at:02x}" for _, at in found), error, lab))
    return sorted((repr(i), code, error, sums[lab], sha) for i, code, error, lab in out)


def codes(df, **options):
    found = vector_codes.compress(df, **options).collect()
    return sorted((repr(r["vec_id"]), r["code"], int(r["error"]), int(r["label_error"]), r["codebooks_sha256"]) for r in found)


@pytest.mark.parametrize("entries, parts, scale", [(16, 4, 1.0), (256, 4, 1.0), (5, 3, 1.0), (16, 2, 1e12), (4, 8, 1e300)])
def test_vector_codes(spark, entries, parts, scale):
    rows = [(i, v and [c and c * scale for c in v], lab) for i, v, lab in odd_rows(random.Random(5))]
    wanted = brute_codes(taking_part(rows, 8), 1024, parts, entries, 4)
    if scale > 1e100:  # errors have more than 38 digits unless vectors meet in one entry
        found = vector_codes.compress(table(spark, rows), entries=entries, parts=parts).collect()
        assert sorted((repr(r["vec_id"]), r["code"]) for r in found) == [w[:2] for w in wanted]
        assert {r["codebooks_sha256"] for r in found} == {wanted[0][4]}
        return
    assert codes(table(spark, rows).repartition(5), entries=entries, parts=parts) == wanted


def test_vector_codes_without_rows(spark):
    for rows in ([], [(1, None, 1), (2, [], None), (3, [NAN], 2)]):
        found = vector_codes.compress(table(spark, rows))
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert found.collect() == []
    with pytest.raises(ValueError, match="no 4 parts"):
        vector_codes.compress(table(spark, [(1, [1.0, 2.0], 1)]))
    with pytest.raises(ValueError, match="hex"):
        vector_codes.compress(table(spark, []), entries=257)


def test_vector_codes_query_and_sql(spark, sf_dir):
    found = queries.op11_vector_codes(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    wanted = con.execute(queries.oracle_sql()["op11_vector_codes"]).fetchall()
    assert found.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert dict(found.dtypes)["error"] == dict(found.dtypes)["label_error"] == "bigint"


# 13


def brute_whitening(rows, factor=256, k=4):
    x = [[max(-(2**58), min(2**58, math.floor(factor * c))) for c in v] for _, v, _ in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(c) for c in v] for v in fit]) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    with np.errstate(invalid="ignore"):
        white = (np.array([[float(c) for c in v] for v in x]) - np.array([s / n for s in sums])) @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviation, white, values / np.trace(cov)


def check_whitening(found, rows, k=4):
    n, deviation, white, explained = brute_whitening(rows, k=k)
    assert len(found) == len(rows) * k
    by = {}
    for r in found:
        by.setdefault((repr(r["vec_id"]), int(r["deviation"])), {})[r["component"]] = r
    signs = None
    for i, (row, d) in enumerate(zip(rows, deviation)):
        mine = by[repr(row[0]), d]
        w = np.array([mine[c]["whitened"] for c in range(1, k + 1)])
        if signs is None and (np.abs(w) > 0.1).all():
            signs = np.sign(w) * np.sign(white[i])
            rest = range(i)
            for j in rest:
                other = by[repr(rows[j][0]), deviation[j]]
                assert np.allclose([other[c]["whitened"] for c in range(1, k + 1)], signs * white[j], atol=1e-8)
        if signs is not None:
            assert np.allclose(w, signs * white[i], atol=1e-8)
        assert all(mine[c]["n"] == n and math.isclose(mine[c]["explained"], explained[c - 1], rel_tol=1e-9) for c in mine)
        assert all(mine[c]["identity_error"] < 1e-9 for c in mine)
    assert signs is not None


def test_merging_loses_nothing():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(500, 12)) * 300 + 5000).astype(np.int64)
    for blocks in ([500], [1, 499], [3] * 166 + [2], [100] * 5):
        ends = np.cumsum([0] + blocks)
        parts = [whitening.summarise(x[a:b]) for a, b in zip(ends, ends[1:])]
        random.Random(1).shuffle(parts)
        while len(parts) > 1:
            parts.append(parts.pop(0).merge(parts.pop(0)))
        (total,) = parts
        assert total.n == 500 and total.sums.tolist() == x.sum(axis=0).tolist()
        assert total.factor.shape == (12, 12)
        centred = x - x.mean(axis=0)
        assert np.allclose(total.factor.T @ total.factor, centred.T @ centred, rtol=1e-10, atol=1e-5)


def test_whitening_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], None) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op13_whitening(spark, sf_dir)
    assert dict(found.dtypes) == dict(
        vec_id="bigint", component="int", n="bigint", deviation="bigint", whitened="double", explained="double", identity_error="double"
    )
    check_whitening(found.collect(), rows)


def test_whitening_of_odd_rows(spark):
    rows = odd_rows(random.Random(7))
    df = table(spark, rows).repartition(37)  # more partitions than a group of merges
    check_whitening(whitening.transform(df, whitening.fit(df)).collect(), taking_part(rows, 8))


def test_deviations_are_exact(spark):
    rows = [(i, [(-1) ** i * 2.0**40 * i, 0.25 * i, 1.0], 1) for i in range(1, 9)]
    df = table(spark, rows)
    found = whitening.transform(df, whitening.fit(df)).collect()
    _, deviation, _, _ = brute_whitening(rows, k=3)
    assert {r["vec_id"]: r["deviation"] for r in found} == {r[0]: Decimal(d) for r, d in zip(rows, deviation)}
    far = table(spark, [(1, [1e300, 0.0], 1), (2, [-1e300, 1.0], 1)])  # components count as 2 ** 58
    assert {int(r["deviation"]) for r in whitening.transform(far, whitening.fit(far)).collect()} == {(2**59) ** 2 + 256**2}


def test_whitening_without_spread(spark):
    one = table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, None, 1)])
    found = whitening.transform(one, whitening.fit(one)).collect()
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in sorted(found)] == [(1, 1, 1, 0), (2, 1, 1, 0)]
    assert all(r["whitened"] is r["explained"] is r["identity_error"] is None for r in found)
    line = table(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)])
    found = whitening.transform(line, whitening.fit(line)).collect()
    assert {(r["component"], r["whitened"] is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert all(math.isclose(r["explained"], 1.0 if r["component"] == 1 else 0.0) for r in found)
    for rows in ([], [(1, None, 1), (2, [], 1)]):
        none = table(spark, rows)
        assert whitening.fit(none) is None
        assert whitening.transform(none, None).collect() == []
