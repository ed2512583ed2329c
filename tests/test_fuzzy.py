"""The edit-distance join, connected components and merged entities against brute force."""

import random

import pytest

from arborlake.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def ratio(a, b):
    return 1 - distance(a, b) / max(len(a), len(b))


def texts(rng, n, most):
    out = []
    for _ in range(n):
        t = list("".join(rng.choice("abé🎉") for _ in range(rng.randint(1, most))))
        out.append("".join(t))
        for _ in range(rng.randint(0, 3)):  # relatives
            at = rng.randrange(len(t) + 1)
            t[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            out.append("".join(t) or "a")
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 1.0])
def test_alike_loses_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = [(rng.choice(["k", "l", None]), t) for t in texts(rng, 70, 22)] + [("k", None), ("k", ""), ("l", ""), ("k", "")]
    df = spark.createDataFrame([(k, v, "c") for k, v in rows], "kind string, value string, segment string")
    found = {(r["kind"], r["a"], r["b"]): r["ratio"] for r in fuzzy.alike(df, threshold).collect()}
    wanted = {}
    for k in ("k", "l", None):
        of = sorted({v for kind, v in rows if kind == k and v}, key=lambda v: (len(v), v.encode()))
        wanted |= {(k, a, b): ratio(a, b) for i, a in enumerate(of) for b in of[i + 1 :] if ratio(a, b) >= threshold - 1e-12}
    assert found.keys() == wanted.keys()
    assert all(abs(found[p] - wanted[p]) < 1e-9 for p in found)
    assert threshold == 1.0 or len(found) > 20


def test_alike_does_not_form_all_pairs(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(10, 14))) for _ in range(3000)})
    df = spark.createDataFrame([("k", w) for w in words], "kind string, value string")
    met = fuzzy.candidates(df, 0.85)
    assert met.count() < 0.01 * len(words) ** 2
    plan = fuzzy.alike(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="0.6"):
        fuzzy.alike(df, 0.5)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (9000, 9000)]
    links += links[:20]
    owner = {}

    def root(x):
        while owner.setdefault(x, x) != x:
            x = owner[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            owner[b] = a
    found = fuzzy.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in owner}
    assert len(found) == len(owner)
    assert fuzzy.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_merged(spark):
    rows = [("person", "jonathan smith")] * 2 + [("person", "jonathan smyth"), ("person", "jonathon smith"), ("org", "jonathan smith"), (None, "x"), (None, "x")]
    rows += [("person", None), ("person", None), ("person", ""), ("person", "someone else")]
    found = fuzzy.merged(spark.createDataFrame(rows, "entity_type string, normalized string"), threshold=0.9)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(
        map(repr, [
            ("person", "jonathan smith", "jonathan smith", 3, 4),
            ("org", "jonathan smith", "jonathan smith", 1, 1),
            (None, "x", "x", 1, 2),
            ("person", None, None, 1, 2),
            ("person", "", "", 1, 1),
            ("person", "someone else", "someone else", 1, 1),
        ])
    )


@pytest.mark.parametrize("longest", [True, False])
@pytest.mark.parametrize("sent", [True, False])
def test_dictionary(spark, monkeypatch, longest, sent):
    from arborlake.operators import dictionary

    if not sent:
        monkeypatch.setattr(dictionary, "_SENT_TERMS", -1)
    rng = random.Random(4)
    words = ["a", "b", "Ä", "c'd", "x1"]
    said = lambda n: [rng.choice(words) for _ in range(rng.randint(0, n))]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(said(14))) for i in range(60)] + [(None, "a b"), (70, None), (71, "")]
    terms = [(" ".join(said(3)), rng.choice(["p", "q"])) for _ in range(25)] + [("?", "p"), (None, "p"), ("A  b", "p"), ("a-B", "p")]
    df = spark.createDataFrame(texts, "element_pk long, text string")
    entries = spark.createDataFrame(terms, "term string, entity_type string")
    split = lambda t: [w for w in (t or "").lower().replace("'", " ").replace(",", " ").replace("-", " ").replace("?", " ").split()]
    listed = {(tuple(split(t)), kind) for t, kind in terms if split(t)}
    wanted = set()
    for key, text in texts:
        said_words = split(text)
        hits = [(i, len(t), " ".join(t), k) for t, k in listed for i in range(len(said_words) - len(t) + 1) if tuple(said_words[i : i + len(t)]) == t]
        for i, n, t, k in hits:
            if not longest or not any(m > n and j <= i and j + m >= i + n for j, m, _, _ in hits):
                wanted.add((key, k, t, i, n))
    found = dictionary.matches(df, entries, longest=longest).collect()
    assert {(r["element_pk"], r["entity_type"], r["term"], r["begin"], r["n_words"]) for r in found} == wanted
    assert len(found) == len(wanted) and all(r["raw"].lower() == r["term"] for r in found)
    assert dictionary.matches(df, entries.limit(0)).collect() == []


def test_alike_common_syllables_bring_nothing_together(spark):
    rng = random.Random(5)
    words = sorted({"that" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(1500)})
    df = spark.createDataFrame([("k", w) for w in words + [words[0][:-1] + "z", words[0] + "yz"]], "kind string, value string")
    assert fuzzy.candidates(df, 0.85).count() < 20 * len(words)
    assert {(r["a"], r["b"]) for r in fuzzy.alike(df).collect()} >= {(words[0], words[0][:-1] + "z"), (words[0], words[0] + "yz")}


def test_scored_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["abc", "abd", "xyz", "abcde", None]), rng.choice(["g", "h", None])) for i in range(60)]
    found = fuzzy.scored_pairs(spark.createDataFrame(rows, "k long, v string, g string"), "k", "v", ["g"]).collect()
    alike = lambda x, y: None if x is None or y is None else ratio(x, y)
    wanted = {(a, b): alike(x, y) for a, x, g in rows for b, y, h in rows if a < b and g is not None and g == h}
    assert {(r["a"], r["b"]): r["ratio"] for r in found} == wanted and len(found) == len(wanted)
