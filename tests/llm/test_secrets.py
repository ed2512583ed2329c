"""Secret scans against plain regular expressions and Markov models from dictionaries."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from arborlake.llm import queries, secret_scan
from arborlake.llm.secret_scan import CLASSES, CUBE, ORDINARY

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
WORDS = "the quick brown fox jumps over lazy dogs while reading long papers about rivers and mountains in spring".split()


def base(text):
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(found)


def told(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, b, k in spans)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pieces = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "apikey", "passſword", "toKen", ":", "=", " = ", ": \"", "'", '"', " ", "\n", "\t",
              "AKIA", "AKIAAKIA", "Z" * 9, "0123456789abcdef", "deadbeef", "abc", "é", "🎉", "x" * 12, "/+", "._-=", "\0"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_base_spans_are_the_patterns_matches():
    texts = random_texts(5000)
    assert sum(len(base(t)) for t in texts) > 3000
    for t in texts:
        data = t.encode()
        spans = [s[:3] for s in secret_scan.base_spans(data)]
        assert secret_scan.in_code_points(data, spans) == base(t)


@pytest.mark.parametrize("least", [1, 5, 16, 24])
def test_free_parts_are_what_spans_leave_of_runs(least):
    for t in random_texts(1500, seed=2):
        data = t.encode()
        spans = secret_scan.base_spans(data)
        left = bytearray(data)
        for a, b, _, _ in spans:
            left[a:b] = b" " * (b - a)
        runs = [m.span() for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{%d,}" % least, data)]
        assert secret_scan.long_runs(data, least) == runs
        parts = [(a, m) for a, b in runs for m in re.finditer(rb"[^ ]{%d,}" % least, bytes(left[a:b]))]
        assert list(secret_scan.free_parts(runs, spans, least)) == [(a + m.start(), a + m.end()) for a, m in parts]


def brute_counts(texts, least=16):
    """(class, two before, one before, character) from the labelled characters, one by one."""
    counts, strings = {}, [0] * CLASSES
    for t in texts:
        data = t.encode()
        spans = secret_scan.base_spans(data)
        kinds = [ORDINARY] * len(data)
        for m in re.finditer(rb"[A-Za-z0-9]{%d,}" % least, data):
            kinds[m.start() : m.end()] = [-1] * len(m[0])
        for _, end, kind, value in reversed(spans):
            kinds[value:end] = [kind] * (end - value)
            strings[kind] += 1
        letter = lambda i: chr(data[i]) if i >= 0 and chr(data[i]) in string.ascii_letters + string.digits else ""
        for i, kind in enumerate(kinds):
            if kind < 0 or not letter(i):
                continue
            one = letter(i - 1) if i and kinds[i - 1] == kind else ""
            two = letter(i - 2) if one and i > 1 and kinds[i - 2] == kind else ""
            counts[kind, two, one, letter(i)] = counts.get((kind, two, one, letter(i)), 0) + 1
    return counts, strings


def code(c):
    return secret_scan.LETTERS.index(c.encode()) + 1 if c else 0


def test_counts_whatever_the_chunks(monkeypatch):
    texts = random_texts(60, seed=3) + [" ".join(WORDS), "x" * 100]
    wanted, strings = brute_counts(texts)
    size = secret_scan.SIZE
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(secret_scan, "CHUNK", chunk)
        counts, found = np.zeros((CLASSES, CUBE), np.int64), np.zeros(CLASSES, np.int64)
        for t in texts:
            secret_scan.count_text(t.encode(), counts, found, 16)
        assert int(counts.sum()) == sum(wanted.values())
        assert all(counts[k, (code(a) * size + code(b)) * size + code(c)] == n for (k, a, b, c), n in wanted.items())
        assert found[:ORDINARY].tolist() == strings[:ORDINARY]


def test_ratio_from_dictionaries():
    texts = random_texts(300, seed=4) + [" ".join(WORDS)] * 3
    counts, strings = np.zeros((CLASSES, CUBE), np.int64), np.zeros(CLASSES, np.int64)
    for t in texts:
        secret_scan.count_text(t.encode(), counts, strings, 16)
    model = secret_scan.train(counts, strings)
    seen, _ = brute_counts(texts)
    seen = {k: n - (k[0] == ORDINARY) for k, n in seen.items()}
    letters = string.ascii_letters + string.digits

    def total(kind, two=None, one=None, c=None):
        return sum(n for (k, a, b, d), n in seen.items() if k == kind and two in (None, a) and one in (None, b) and c in (None, d))

    def p(kind, two, one, c):
        p0 = (total(kind, c=c) + 1) / (total(kind) + 62)
        p1 = (total(kind, one=one, c=c) + 4 * p0) / (total(kind, one=one) + 4)
        return (total(kind, two, one, c) + 4 * p1) / (total(kind, two, one) + 4)

    for run in ("quick-brown/fox", "Zz9+4e5f6a7b8c9d", "aaaaabbbb"):
        logs, n, same = [0.0] * CLASSES, 0, 0
        for i, c in enumerate(run):
            if c in letters:
                one = run[i - 1] if i and run[i - 1] in letters else ""
                two = run[i - 2] if one and i > 1 and run[i - 2] in letters else ""
                n, same = n + 1, same + (one == c)
                for k in range(CLASSES):
                    logs[k] += math.log(p(k, two, one, c))
        shares = [*strings[:ORDINARY].tolist(), 1]
        rand = sum(s / sum(shares) * math.exp(v) for s, v in zip(shares, [*logs[:ORDINARY], -n * math.log(62)]))
        plain = math.exp(logs[ORDINARY]) + 0.95**same * (0.05 / 62) ** (n - same)
        assert math.isclose(model.ratio(run.encode()), math.log(rand) - math.log(plain), rel_tol=1e-4, abs_tol=1e-3)


def secret(rng, n=32):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def corpus(rng):
    long = ["mountains-and-rivers-in-spring", "https://quick.brown/fox/jumps", "readinglongpapersaboutdogs", "-" * 60, "x" * 40_000]
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) + f" {rng.choice(long)} token = \"{rng.randbytes(20).hex()}\"" for _ in range(120)]
    hidden = {i: secret(rng) for i in range(0, 120, 10)}
    for i, s in hidden.items():
        texts[i] = f"é {texts[i]} {s}, then"
    return texts, hidden


def test_hidden_secrets_are_found_and_words_are_not(spark):
    texts, hidden = corpus(random.Random(5))
    copies = [texts[0]] * 30  # a group of copies does not make its secret ordinary
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + copies)], "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: r for r in secret_scan.scan(df, secret_scan.fit(df)).collect()}
    assert len(found) == len(texts) + 30
    for i, t in enumerate(texts + copies):
        s = hidden.get(i if i < 120 else 0)
        markov = [(t.index(s), t.index(s) + len(s), 3)] if s else []
        assert found[i]["spans"] == told(sorted(base(t) + markov)), t[-120:]
        assert found[i]["n_markov"] == len(markov)
        assert found[i]["base_sha256"] == hashlib.sha256(told(base(t)).encode()).hexdigest()


def test_odd_texts(spark):
    texts = [None, "", " ", "\x1c", "🎉 token: \"0123456789abcdefÀ", "a" * 70_000, "word " * 20_000, "password = " * 3000, "é" * 100, "AKIA" * 9, "0" * 16]
    rows = [(i if i else None, t, i, "c", 1) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hex int, spans string, at int")
    found = sorted(tuple(r)[1:5] for r in secret_scan.scan(df, secret_scan.fit(df)).collect())
    wanted = []
    for _, t, *_ in rows:
        spans = base(t or "")
        kinds = [k for _, _, k in spans]
        wanted.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told(spans).encode()).hexdigest()))
    assert found == sorted(wanted)
    none = df.limit(0)
    assert secret_scan.scan(none, secret_scan.fit(none)).collect() == []


def test_query(spark, sf_dir):
    found = queries.op12_secret_scan(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(told(spans).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if not s.startswith("markov")] == told(spans).split(",")
