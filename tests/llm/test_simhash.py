"""Fingerprints and components against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import simhash


def slow_fingerprint(text, width=3):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    words = [w for w in folded.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{fingerprint: smallest member} over all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def check(frame, rows):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    groups = slow_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    expected = [(i, f"{p:016x}", least.get(groups[p])) for i, p in prints]
    found = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in (r[0], r[2])) + (r[1],)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_documents(docs, doc_rows):
    check(docs, [(r.doc_id, r.text) for r in doc_rows])


def test_edges(edge_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_links_of_dense_lists_in_cells(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    while len(prints) < 700:  # many fingerprints a few bits around one
        p = centre
        for _ in range(rng.randrange(6)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    chain = 0
    for _ in range(60):
        chain ^= 7 << rng.randrange(60)
        prints.add(chain)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for block in (32, 1024):
        found = simhash.components(simhash.links(frame, block=block))
        groups = {}
        for r in found.collect():
            groups.setdefault(r.component, set()).add(int(np.int64(r.node).view(np.uint64)))
        expected = {}
        for p, root in slow_components(prints).items():
            expected.setdefault(root, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_triples_cover_every_five_positions():
    from itertools import combinations

    for five in combinations(range(8), 5):
        assert any(set(t) <= set(five) for t in simhash.TRIPLES)


def test_different_texts_of_one_doc_id(spark):
    first, second = "one text about rivers and the towns along them", "quite another text, on glass and how it breaks"
    rows = [(1, first), (3, first), (3, second), (3, second), (5, second), (4, first + "!"), (6, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {t: slow_fingerprint(t) for _, t in rows}
    groups = slow_components(prints.values())
    least = {}
    for i, t in rows:
        least[groups[prints[t]]] = min((i, t or ""), least.get(groups[prints[t]], (i, t or "")), key=lambda r: r[0])
    kept = [(r.doc_id, r.text or "") for r in simhash.keep_one_per_component(frame).collect()]
    assert sorted(kept) == sorted(least.values())
    assert (3, second) in kept and (3, first) not in kept


def test_one_of_each_component_stays(spark, edge_docs):
    kept = simhash.keep_one_per_component(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect())
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge_docs).collect()}
    assert ids == sorted(i for i, c in component.items() if i is not None and i == c)
    assert kept.where(F.col("doc_id").isNull()).count() == 2


def test_one_row_of_each_component_with_null_ids(spark, edge_docs):
    import corpus_pipeline

    first, second = "one text about rivers and the towns along them", "quite another text, on glass and how it breaks"
    rows = [(None, first), (None, first), (None, first + "!"), (4, second), (None, second), (4, second), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = slow_components([slow_fingerprint(t) for _, t in rows])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()]
    assert sorted(groups[slow_fingerprint(t)] for _, t in kept) == sorted(set(groups.values()))
    assert [i for i, t in kept if t == second] == [4]
    stage = corpus_pipeline.near_duplicate_stage(spark, edge_docs, "")
    members = [slow_fingerprint(r.text) for r in edge_docs.collect()]
    groups = slow_components(members)
    assert stage.columns == edge_docs.columns
    assert sorted(groups[slow_fingerprint(r.text)] for r in stage.collect()) == sorted(set(groups.values()))
