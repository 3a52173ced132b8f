"""Sketched top terms against full counts."""

import random

import pytest

from scriptorium.operators import lexical


def _same(spark, rows, k, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, year int").repartition(3)
    for groups in (["lang"], ["lang", "year"], []):
        expected = sorted(map(tuple, lexical.top_terms(lexical.term_counts(docs, "text", groups), k, groups).collect()), key=str)
        found = lexical.heavy_terms(docs, k, "text", groups, **options)
        assert sorted(map(tuple, found.select(*groups, "term", "n", "term_rank").collect()), key=str) == expected


@pytest.mark.parametrize(("buckets", "fullest"), [(1 << 16, 4), (64, 1), (2, 1), (1, 1), (1000, 1)])
def test_same_as_counting_everything(spark, buckets, fullest):
    rng = random.Random(buckets)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=n))
    rows = [(draw(60), rng.choice(["a", "b", None]), 2000 + i % 2) for i in range(40)]
    rows += [(" ".join(words), "flat", 2000), (None, "a", 2000), ("", "none", 2001), ("one Two two", "few", 2000)]
    _same(spark, rows, 7, buckets=buckets, fullest=fullest)


def test_the_sketch_alone_would_be_wrong(spark, monkeypatch):
    # many rare terms fill buckets more than the frequent ones do: the recount of open buckets is needed
    rows = [(" ".join(f"r{i}" for i in range(4000)), "a", 2000), ("top " * 9 + "next " * 5 + "third " * 4, "a", 2000)]
    passes = []
    count = lexical._count_in
    monkeypatch.setattr(lexical, "_count_in", lambda *args: passes.append(args[2]) or count(*args))
    _same(spark, rows, 3, buckets=100, fullest=1)
    assert len(passes) == 6 and passes[1] > passes[0]  # two exact passes for each grouping


def test_ties_at_the_end(spark):
    _same(spark, [("b a c d e " * 3 + "f f f f", "x", 1), ("z", "y", 1)], 3, buckets=1 << 16, fullest=1)


def test_one_pass_where_the_bound_holds(spark, monkeypatch):
    passes = []
    count = lexical._count_in
    monkeypatch.setattr(lexical, "_count_in", lambda *args: passes.append(args[2]) or count(*args))
    docs = spark.createDataFrame([("a " * 50 + "b " * 40 + " ".join(f"r{i}" for i in range(200)), "x")], "text string, lang string")
    assert [r.term for r in lexical.heavy_terms(docs, 2, "text", ["lang"]).orderBy("term_rank").collect()] == ["a", "b"]
    assert passes == [8]
