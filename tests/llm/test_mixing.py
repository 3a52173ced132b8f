"""Targets against water filling by rounds, the mix against its guarantees."""

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes, weights=(3, 1, 2)):
    """{source: target}: cap, share the excess by weight, repeat."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    target, full = {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        mass = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / mass for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def check(frame, block):
    rows = frame.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    targets = slow_targets(sizes)
    found = mixing.words_taken(frame, block=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    by_row = [(r.doc_id, size(r.text), sizes[r.source], round(targets[r.source], 6)) for r in rows]
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in found), key=key) == sorted(by_row, key=key)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    source_of = {(r.doc_id, size(r.text)): r.source for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        taken[source_of[r.doc_id, r.size]] += r.taken
    return {s: (targets[s], t) for s, t in taken.items()}, sorted(map(tuple, found), key=key)


def test_documents(docs):
    taken, rows = check(docs, mixing.BLOCK)
    assert all(abs(t - target) <= mixing.BLOCK for target, t in taken.values())
    assert rows == check(docs.repartition(5), mixing.BLOCK)[1]


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_edges(edge_docs, block):
    check(edge_docs, block)


def test_empty(no_docs):
    assert mixing.words_taken(no_docs).collect() == []
    assert mixing.mix(no_docs).collect() == []


def test_hot_source_and_tiny_ones(spark):
    rows = [(i, "w " * 50, "hot") for i in range(2000)] + [(5000 + i, "one", f"s{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, _ = check(frame, 16)
    assert all(abs(t - target) <= max(1, 0.01 * target) for target, t in taken.values())


def test_permutation_is_exact(spark):
    sources = spark.createDataFrame([(0, 1, 2, 0), (1, 2, 4, 2), (2, 97, 150, 6), (3, 1000, 1000, 156)], "sid long, blocks long, quota long, first long")
    slots = mixing.slots(sources, 1156, shard=64).collect()
    for sid, blocks, quota in ((0, 1, 2), (1, 2, 4), (2, 97, 150), (3, 1000, 1000)):
        own = [r for r in slots if r.sid == sid]
        assert sorted(r.slot for r in own) == list(range(quota))
        for p in range(2):
            read = [r.block for r in own if getattr(r, "pass") == p]
            assert len(read) == len(set(read)) == max(0, min(blocks, quota - p * blocks))
            assert all(0 <= b < blocks for b in read)
    last = [r.block for r in sorted((r for r in slots if r.sid == 3), key=lambda r: r.slot)]
    rises = sum(a < b for a, b in zip(last, last[1:], strict=False))
    assert 400 < rises < 600  # no order left


def test_mix_rows(docs, edge_docs):
    for frame in (docs, edge_docs):
        taken = {}
        for r in mixing.words_taken(frame).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        mixed = mixing.mix(frame)
        assert mixed.columns == frame.columns
        words = {}
        for r in mixed.select("doc_id", "text", "n_chars").collect():
            words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
            assert r.n_chars == len(r.text)
        assert words == {i: t for i, t in taken.items() if t}
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = mixing.mix(docs).where(F.col("n_chars") > 0).collect()
    assert any(r.text == texts[r.doc_id] for r in whole)
