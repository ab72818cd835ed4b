import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from faultline.llm import wordruns

WORD = re.compile("[^ \t-\r]+")


def brute_runs(words, min_periods=4, min_words=6):
    """Every maximal stretch with its smallest period, by definition."""
    n, found = len(words), {}
    for q in range(1, n // min_periods + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= 2 * q:
                found.setdefault((s, e + q - s), q)  # the smallest period comes first
            s = e + 1
    return sorted((s, m, q) for (s, m), q in found.items() if m >= max(min_words, min_periods * q))


def plant(doc_id, words):
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute(doc_id, text):
    words = plant(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rnd, n):
    out = []
    while len(out) < n:
        root = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
        out += root * rnd.randint(1, 9) + root[: rnd.randint(0, len(root))]
    return out[:n]


def test_runs_equal_the_definition():
    rnd = random.Random(5)
    for trial in range(400):
        texts = [random_words(rnd, rnd.randint(0, 120)) if trial % 2 else [rnd.choice("ab") for _ in range(rnd.randint(0, 40))] for _ in range(3)]
        names = np.array([ord(w) for t in texts for w in t], np.int64)
        rows = np.repeat(np.arange(3), [len(t) for t in texts])
        first = np.cumsum([0, *map(len, texts)])
        got = list(zip(*(x.tolist() for x in wordruns.find_runs(names, rows)), strict=True))
        want = [(r, s + first[r], m, q) for r, t in enumerate(texts) for s, m, q in sorted(brute_runs(t), key=lambda x: (x[0], x[2]))]
        assert got == want


def test_a_run_that_many_levels_name():
    names = np.zeros(50_000, np.int64)
    assert [x.tolist() for x in wordruns.find_runs(names, names)] == [[0], [0], [50_000], [1]]
    root = np.random.RandomState(1).permutation(5_000)
    names = np.tile(root, 5)
    assert [x.tolist() for x in wordruns.find_runs(names, np.zeros(25_000, np.int64))] == [[0], [0], [25_000], [5_000]]
    with pytest.raises(ValueError):
        wordruns.find_runs(names, names, min_periods=2)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    rows = [None, "", " \t\r\n\v\f ", "a", "a a a a a", "a a a a a a", "é　é　é é é é é é é é", "x\x85y z " * 9, "No no No no No no No no", "a\tb\na  b\r\na b a b end"]
    rows += [" ".join(random_words(rnd, rnd.randint(1, 150))) for _ in range(120)]
    rows += [" ".join(random_words(rnd, 30_000)), "w " * 3000]
    pairs = list(enumerate(rows))
    return pairs + [(12, rows[12]), (12, rows[12]), (None, "a b " * 5), (None, None), (-(2**63), "q " * 40)]


def test_digests(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, runs int, w string").repartition(3)
    got = wordruns.run_digests(wordruns.collapse_runs(wordruns.planted(docs)))
    long = [r for r in got.collect() if r.doc_id == 130]
    want = sorted((brute(i, t) for i, t in texts if i != 130), key=str)
    assert sorted((tuple(r) for r in got.collect() if r.doc_id != 130), key=str) == want
    assert len(long) == 1 and long[0].n_runs > 100


def test_columns_are_kept_and_nothing_is_fine(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts[:20]], "doc_id long, text string, runs int, period string")
    out = wordruns.collapse_runs(docs)
    assert out.columns == ["doc_id", "period", "n_words", "runs", "collapsed"]
    assert {r.doc_id: r.collapsed for r in out.collect()}[9] == "a b end"
    assert wordruns.run_digests(wordruns.collapse_runs(wordruns.planted(docs.limit(0)))).isEmpty()
