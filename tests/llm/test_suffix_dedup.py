"""Removal against a dictionary of every 50-byte string; sorting against Python's sort."""

import hashlib
import random

import numpy as np
import pytest

from scriptorium.llm import suffix_dedup


def slow(rows, length=50):
    first = {}
    data = [((i is None, i or 0), i, (t or "").encode()) for i, t in rows]
    for order, _, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(order, first.get(s, order))
    out = []
    for order, i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(frame, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    found = [tuple(r) for r in suffix_dedup.deduplicate(frame).collect()]
    assert sorted(found, key=key) == sorted(slow(rows), key=key)


def test_documents(docs, doc_rows):
    check(docs, [(r.doc_id, r.text) for r in doc_rows])


def test_edges(edge_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert suffix_dedup.deduplicate(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_mosaics(spark, seed, monkeypatch):
    """Documents made of shared passages, repeats, zero bytes and periodic stretches."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab \0é") for _ in range(rng.choice((20, 49, 50, 51, 80, 200)))) for _ in range(12)]
    parts += ["x" * 60, "xy" * 70, "abcdefg" * 20, "\0" * 55]
    rows = []
    for k in range(60):
        text = "".join(rng.choice(parts) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randrange(8)))
        rows.append((rng.choice((None, k, k // 3)), text))
    rows += rows[:5]
    monkeypatch.setattr(suffix_dedup, "PORTION", 50)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_sorting():
    rng = np.random.default_rng(2)
    for letters, n, width in ((2, 500, 20), (3, 300, 50), (1, 40, 34), (256, 200, 10), (2, 1, 9)):
        strings = rng.integers(0, letters, (n, width)).astype(np.uint8)
        strings[n // 2 :] = strings[: n - n // 2]
        order = suffix_dedup.deep_shallow(strings, shallow=8)
        assert sorted(order.tolist()) == list(range(n))
        ranked = [strings[k].tobytes() for k in order]
        assert ranked == sorted(ranked)
        assert [strings[k].tobytes() for k in suffix_dedup.blind_order(strings)] == ranked


def test_kept_bytes(spark):
    shared = "shared passage of more than fifty bytes, repeated as it is"
    frame = spark.createDataFrame([(1, shared), (2, "before " + shared + " after")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.deduplicate(frame, with_text=True).collect()}
    assert kept == {1: shared.encode(), 2: b"before  after"}


def test_rows_without_ids_meet_only_their_own_text(spark, monkeypatch):
    """No join pairs the texts of rows that share a null doc_id, and each gets its own marks only."""
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcdef ") for _ in range(70)) for _ in range(4)]
    rows = [(k, f"{k} {p} {k}") for k, p in enumerate(shared)]
    rows += [(None, f"{k} {shared[k % 4]} {rng.random()} {'z' * (k % 3)}") for k in range(40)]
    rows += rows[-3:] * 3 + [(7, "x" + shared[0]), (7, "y" + shared[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = suffix_dedup.map_batches

    def counted(df, function, schema):
        seen.append((df, df.columns))
        return real(df, function, schema)

    monkeypatch.setattr(suffix_dedup, "map_batches", counted)
    check(frame, rows)
    searched, asked, _, cut = [df for df, _ in seen]
    distinct = len({(i, t) for i, t in rows})
    assert searched.select("ord", "th").distinct().count() == distinct and searched.count() == len(rows)
    assert max(len(r.marks or ()) for r in cut.select("marks").collect()) <= 4
    assert max(len(r.grams) for r in asked.select("grams").collect()) <= 40
