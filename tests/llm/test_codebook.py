"""Codes and codebooks against plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import codebook, queries

SF_SMALL = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, label int"


def expected(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows."""
    held = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not held:
        return []
    w = -(-max(len(v) for _, v, _ in held) // 8)
    held = [(i, v + [0] * (8 * w - len(v)), g) for i, v, g in held]
    order = lambda i: (i is None, i or 0)
    first = [min(v for j, v, _ in held if j == i) for i in sorted({i for i, _, _ in held}, key=order)[:16]]
    books = [[v[p * w : p * w + w] for v in first] for p in range(8)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        new = [list(b) for b in books]
        for p in range(8):
            groups = {}
            for _, v, _ in held:
                x = v[p * w : p * w + w]
                groups.setdefault(nearest(p, x)[1], []).append(x)
            for e, xs in groups.items():
                new[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, v, g in held:
        found = [nearest(p, v[p * w : p * w + w]) for p in range(8)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), g))
    totals = {}
    for _, _, error, g in coded:
        totals[g] = totals.get(g, 0) + error
    return [(i, code, error, totals[g], digest) for i, code, error, g in coded]


def _same(found, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.drop("label").collect()), key=key) == sorted(expected(rows), key=key)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    _same(queries.op13_value_dictionaries(spark, SF_SMALL), rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.25, -0.5, 0.125, 1.0, -1.0, 0.0, 0.75, -0.001]
    rows = [
        (5, v, 1), (5, v, 1), (5, [x / 2 for x in v], 2), (None, [-x for x in v], None), (None, v, None), (1, None, 1), (2, [0.1, None], 1),
        (3, [nan] * 8, 1), (4, [1.0, -inf], 1), (6, [], 3), (7, [2.0, -3.5], None), (8, v + v, 1), (9, [30000.0] * 3, 4),
    ]
    rows += [(100 + k, [math.sin(k * j) * 0.5 for j in range(1, 17)], k % 3) for k in range(60)]
    rows += [(200, [0.5] * 16, 9)] * 70
    frame = spark.createDataFrame(rows, SHAPE).repartition(5)
    for name in ("v", "code", "error", "sum_label", "part", "places"):
        frame = frame.withColumn(name, F.lit("x"))
    _same(codebook.compress(frame), rows)


def test_few_rows_and_empty_table(spark):
    for rows in ([], [(1, None, 1)], [(1, [0.5] * 8, None)], [(1, [], 1), (2, [], 1)], [(3, [0.5], 1), (2, [-0.5, 1.0], 2)]):
        found = codebook.compress(spark.createDataFrame(rows, SHAPE))
        assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
        _same(found, rows)


def test_chunks_do_not_change_the_result(spark):
    frame = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    whole = sorted(codebook.compress(frame).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert sorted(codebook.compress(frame.repartition(3)).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_components_that_are_too_large(spark):
    with pytest.raises(Exception, match="component too large"):
        codebook.compress(spark.createDataFrame([(1, [1e9], 1)], SHAPE)).collect()
