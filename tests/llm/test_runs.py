"""Lyndon arrays and runs against their definitions; the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import queries, runs

SF_SMALL = "/root/testdata/sf0.001"


def slow_lyndon(w):
    return [
        max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n)))
        for i in range(len(w))
    ]


def slow_runs(w, least):
    """Maximal stretches of every period; only those whose smallest period it is."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q):
                s = w[i : i + n]
                if not any(s[r:] == s[:-r] for r in range(1, q)):
                    found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_array():
    rng = random.Random(1)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randrange(25))]
        assert runs.lyndon_array(w) == slow_lyndon(w)


@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs(least):
    rng = random.Random(least)
    for _ in range(400):
        w = []
        while len(w) < rng.randrange(1, 120):
            w += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 5)
        assert list(map(tuple, runs.runs_of(np.array(w), least).T.tolist())) == slow_runs(w, least)


def test_extensions():
    rng = random.Random(5)
    w = np.array([rng.randrange(2) for _ in range(70)])
    e = runs.Extensions(w)
    first, second = map(np.array, zip(*[(i, j) for i in range(70) for j in range(i + 1, 70)], strict=True))
    ahead, back = e.forward(first, second), e.backward(first, second)
    for i, j, f, b in zip(first, second, ahead, back, strict=True):
        assert f == next((k for k in range(70 - j) if w[i + k] != w[j + k]), 70 - j)
        assert b == next((k for k in range(i) if w[i - 1 - k] != w[j - 1 - k]), i)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words, 12)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, sha(lines), sha(kept))


def _answers(spark, frame, tmp_path):
    path = str(tmp_path / "docs")
    frame.write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, queries.op11_word_runs(spark, path).collect()), key=lambda r: tuple(map(str, r)))


def test_query_on_edge_rows(spark, tmp_path):
    lines = "one two three four five six seven\n" * 9
    rows = [
        (1, None), (2, ""), (3, " \t "), (4, "a " * 11), (5, "a " * 12), (6, "a b " * 6), (6, "a b " * 6), (None, "a b " * 9),
        (7, lines), (8, "x " + lines + " y " + lines), (9, "ä\x0bö\x1cü  " * 8), (10, "a " * 30 + "b " * 30 + "a " * 30),
    ]
    rows += [(i, " ".join(f"w{k * k % 41}" for k in range(i))) for i in range(11, 90)]  # tails of many lengths
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("runs", "w", "n", "g", "a", "p", "h", "best", "start", "collapsed"):
        frame = frame.withColumn(name, F.lit(1))
    assert _answers(spark, frame, tmp_path) == sorted((expected(*r) for r in rows), key=lambda r: tuple(map(str, r)))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(11, 90)) > 3


def test_empty_table(spark, no_docs, tmp_path):
    assert _answers(spark, no_docs, tmp_path) == []


def test_one_very_long_text(spark):
    words = [f"w{k * k % 9973}" for k in range(60_000)]
    frame = spark.createDataFrame([(1, " ".join(words * 3)), (2, "z " * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in runs.word_runs(frame).collect()}
    # squares repeat after 9973 numbers, the whole after 60,000
    assert {(0, 60_000, 9973), (0, 180_000, 60_000)} <= {tuple(r) for r in found[1].runs}
    assert [tuple(r) for r in found[2].runs] == [(0, 200_000, 1)] and found[2].collapsed == "z"


def test_whole_table(spark, docs, doc_rows):
    key = lambda r: tuple(map(str, r))
    short = [r for r in doc_rows if len((r.text or "").split()) <= 400]
    found = [tuple(r) for r in queries.op11_word_runs(spark, SF_SMALL).collect()]
    assert len(found) == len(doc_rows)
    ids = {r.doc_id for r in short}
    assert sorted((r for r in found if r[0] in ids), key=key) == sorted((expected(r.doc_id, r.text) for r in short), key=key)
