"""Top k against a full matrix product."""

import numpy as np
import pytest

from scriptorium.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k):
    def whole(r):
        return r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])

    held = [(r[0], np.floor(256 * np.array(r[1], dtype=np.float32).astype(np.float64)).astype(np.int64)) for r in rows if whole(r)]
    out = set()
    asking = {}
    for i, v in held:
        if asked(i):
            asking[i] = min(asking.get(i, tuple(v.tolist())), tuple(v.tolist()))
    for q, a in asking.items():
        scores = []
        for i, v in held:
            if i != q:
                n = min(len(a), len(v))
                scores.append((-int(np.array(a[:n]) @ v[:n]), i))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def check(spark, rows, asked, k, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    ids = [i for i, _ in rows if i is not None and asked(i)]
    queries = frame.where(frame.vec_id.isin(ids))
    found = [tuple(r) for r in topk.top_k(frame, queries, k, **options).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, asked, k)


@pytest.mark.parametrize("options", [{}, {"block": 40}, {"block": 100, "step": 1}])
def test_random_vectors_with_copies(spark, options):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.15, (300, 16)).astype(np.float32)
    vectors[100:180] = vectors[7]  # ties at the top
    vectors[250:] = -vectors[8]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    check(spark, rows, lambda i: i % 7 == 0, 5, **options)


def test_edges(spark):
    rows = [
        (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []),
        (7, [0.1, 0.2, 300.0]), (None, [0.1, 0.2]), (8, [-3.0, 2.0]), (1, [0.5, -0.25]), (9, [0.0, 0.0]),
    ]
    check(spark, rows, lambda i: True, 5)
    check(spark, rows[:1], lambda i: True, 5)


def test_an_id_with_several_vectors_asks_with_the_least(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 30, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (120, 8)).astype(np.float32))]
    check(spark, rows + rows[:40], lambda i: i % 5 == 0, 7)


def test_few_blocks_are_searched_by_many_tasks(spark):
    assert topk.grid(0, 10, 8) == (0, 1) and topk.grid(10, 0, 8) == (1, 0)
    assert topk.grid(100, 3, 8) == (1, 1)
    assert topk.grid(51_000, 1020, 6) == (4, 6)
    assert topk.grid(10**9, 2 * 10**7, 4000) == (61_036, 4883)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(0, 0.2, (600, 4)).astype(np.float32))]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    found = topk.top_k(frame, frame, block=200)
    blocks, chunks = topk.grid(600, 600, spark.sparkContext.defaultParallelism, 200)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert chunks > 1 and "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 2  # the groups', the ranking's
    check(spark, rows, lambda i: True, 5, block=200)


def test_empty(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert topk.top_k(frame, frame).collect() == []


def test_processing_stops_before_the_end_only_with_proof():
    rng = np.random.default_rng(5)
    matrix = np.zeros((2000, 32), dtype=np.int64)
    for row in matrix:  # sparse vectors: high impacts decide early
        row[rng.integers(0, 32, 3)] = rng.integers(1, 120, 3)
    index = topk.BlockIndex(np.arange(2000), matrix, 16)
    query = matrix[17]
    at, scores = index.search(17, query, 5)
    every = matrix @ query
    every[17] = -(10**9)
    best = np.lexsort((np.arange(2000), -every))[:5]
    assert at.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
