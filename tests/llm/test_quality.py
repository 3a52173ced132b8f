"""Held-out accuracy, whole texts, defined cases."""

import zlib

import numpy as np
SF_MID = "/root/testdata/sf0.01"

from scriptorium.llm import quality


def slow_logit(text, network):
    """The forward pass by definition, over the whole document at once."""
    data = (text or "").encode("utf-8") or b"\0"
    bytes_at = [np.frombuffer((data + b"\0" * j)[j:], dtype=np.uint8) for j in range(quality.WIDTH)]
    response = sum(network.filters[j].astype(np.float64)[at] for j, at in enumerate(bytes_at))
    starts = range(0, max(1, len(data) - quality.CELL), quality.CELL)  # a chunk is two cells long and starts at every cell
    chunks = np.array([response[a : a + 2 * quality.CELL].max(axis=0) for a in starts])
    hidden = np.maximum(chunks + network.bias, 0)
    return hidden.mean(axis=0) @ network.mean + hidden.max(axis=0) @ network.top + network.last[0]


def slow_scores(docs, labels):
    """[(doc_id, text, score)]: one plain pass over each document by the trained network."""
    network = quality.train(*quality.labelled_sample(docs, labels))
    rows = docs.select("doc_id", "text").collect()
    return [(r.doc_id, r.text, 1 / (1 + np.exp(-slow_logit(r.text, network)))) for r in rows]


def test_scores_by_definition(spark, docs, edge_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    few = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for frame, known in ((docs, labels), (edge_docs, few)):
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        expected = sorted(((i, s) for i, _, s in slow_scores(frame, known)), key=key)
        found = sorted(((r.doc_id, r.score) for r in quality.score(frame, known).collect()), key=key)
        assert [i for i, _ in found] == [i for i, _ in expected]
        assert np.allclose([s for _, s in found], [s for _, s in expected], atol=1e-4)


def test_sample_does_not_depend_on_the_layout(spark):
    rows = [(i % 20, f"text {i} of {i % 20}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 3 % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    samples = [quality.labelled_sample(docs.repartition(n), labels.repartition(n)) for n in (1, 3, 8)]
    assert samples[0] == samples[1] == samples[2] and len(set(samples[0][0])) == len(samples[0][0]) > 5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    found = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    truth = [(r.quality, found[r.doc_id].predicted) for r in labels.collect() if found[r.doc_id].held_out]
    for label in (0, 1):
        hits = [p == label for q, p in truth if q == label]
        assert np.mean(hits) >= 0.85


def test_edges(spark, edge_docs):
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    kept = quality.keep_good(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_without_labels(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(edge_docs, labels).collect()} == {0.5}
    assert quality.score(no_docs, labels).collect() == []


def test_pieces_give_the_same_as_one_pass():
    network = quality.Network(3)
    tables = network.pair_tables()
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh ,.\n"), quality.PIECE * 2 + 1000))
    data = quality.padded(text)
    response = quality.responses(data, tables)
    cells = np.maximum.reduceat(response, np.arange(0, len(response), quality.CELL))
    hidden = np.maximum(np.maximum(cells[:-1], cells[1:]) + network.bias, 0)
    whole = hidden.mean(0) @ network.mean + hidden.max(0) @ network.top + network.last[0]
    assert np.isclose(quality.logit(text, network, tables), whole)
    # the last byte counts
    assert quality.logit(text + "\x7f" * 6, network, tables) != quality.logit(text, network, tables)


def test_gradient():
    network = quality.Network(1)
    network.top[:] = 0.1
    text, step = "hello world, " * 60, 1e-2
    grads = [np.zeros_like(w) for w in network.weights()]
    quality._backward(text, 1, 1.0, network, network.pair_tables(), grads)

    def loss():
        return float(np.log1p(np.exp(-quality.logit(text, network, network.pair_tables()))))

    for w, g in zip(network.weights(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert np.isclose((up - down) / (2 * step), g[at], rtol=0.1, atol=1e-3)
