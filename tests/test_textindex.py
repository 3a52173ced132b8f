"""Index searches against scans."""

import random
import re

import pytest
from pyspark.sql import functions as F
from settings import SF_SMALL

from scriptorium.operators import lexical, search, textindex
from scriptorium.plans import catalog
from scriptorium.plans import fixtures as fx
from scriptorium.session import scratch_dir
from scriptorium.sources import generations


def _key(r):
    return tuple(map(str, r))


@pytest.fixture(scope="module")
def papers_index(spark):
    root = scratch_dir(spark, "t-index")
    p = fx.papers(spark, SF_SMALL)
    for k in range(2):
        textindex.add_records(p.where(F.col("seq") % 2 == k).repartition(3), root, ["title", "abstract"])
    return root


@pytest.mark.parametrize(
    "text", ["the", "license", "the license", "THE", "of", "a", "", "zzzqqq", "und der", "token =", "$$$", "e%", "è", "all rights reserved", "the zzzqqq"]
)
def test_same_papers_as_the_scan(spark, papers_index, text):
    p = fx.papers(spark, SF_SMALL)
    for limits in ({}, {"min_year": 2004, "max_year": 2015, "max_per_year": 2, "sources": ["crossref", "scopus", "pubmed"]}):
        found = textindex.search_papers(spark, papers_index, text, **limits)
        expected = search.search_papers(p, text, **limits)
        assert found.columns == expected.columns
        assert sorted(map(tuple, found.collect()), key=_key) == sorted(map(tuple, expected.collect()), key=_key)


def test_a_search_reads_the_postings_of_its_terms(spark, papers_index):
    found = textindex.search_papers(spark, papers_index, "license")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "lows" in line]
    assert len(scans) == 2 and all(re.search(r"PushedFilters: \[[^]]*In\(gram", s) for s in scans)
    few = textindex.candidates(spark, papers_index, {0: [["rights reserved"]]}).count()
    assert 0 < few < fx.papers(spark, SF_SMALL).count()


def test_blocks_and_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 4)
    rows = [(i, "abcd" if i % 2 else "bcdx", None if i % 3 else "Abc") for i in range(50)]
    frame = spark.createDataFrame(rows, "seq long, title string, abstract string").repartition(3)
    root = str(tmp_path / "index")
    textindex.add_records(frame, root, ["title", "abstract"])
    lists = spark.read.parquet(f"{generations.live(spark, root)[0].path}/postings").collect()
    assert all(r.lows == sorted(set(r.lows)) and 0 <= min(r.lows) and max(r.lows) < 4 for r in lists)
    found = {r.seq for r in textindex.candidates(spark, root, {0: [["abc"]]}).collect()}
    assert found == {i for i in range(50) if i % 2 or not i % 3}
    asked = {r.seq: sorted(r.asked) for r in textindex.candidates(spark, root, {0: [["abc", "cdx"]], 5: [["abcd"], ["x abc"]], 7: [["x"]]}).collect()}
    for i in range(50):
        hay = ("abcd" if i % 2 else "bcdx") + " " + ("" if i % 3 else "abc")
        assert asked[i] == [0] * ("abc" in hay and "cdx" in hay) + [5] * ("abcd" in hay or "x abc" in hay) + [7]
    with pytest.raises(ValueError, match="other fields"):
        textindex.add_records(frame, root, ["title"])


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("license", [["license"]]), (" la | le ", [[" la "], [" le "]]), ("api[_ ]?key|secret", [["api", "key"], ["secret"]]),
        ("colou?r", [["colo", "r"]]), ("ab+c", [["ab", "c"]]), ("ab*c", [["a", "c"]]), ("a{2}bc", [["bc"]]), (r"a\.b\d+c", [["a.b", "c"]]),
        ("(abc|def)ghi", [["ghi"]]), ("[abc]", [[]]), ("", [[]]), ("^abc$", [["abc"]]), ("(?i)abc", [[]]), (r"\bword\b", [["word"]]),
        ("a|", [["a"], []]), ("[]a]bc", [["bc"]]), ("[^]a]bc", [["bc"]]), (r"[a\]]bc", [["bc"]]), ("((a)b)c", [["c"]]), (r"\p{L}abc", [["abc"]]),
        ("abc++d", [["abc", "d"]]), ("abc*?d", [["ab", "d"]]), ("[a-z&&[^b]]cde", [["cde"]]), (r"\Qa.b\E", [[]]), ("ab{0,3}cde", [["a", "cde"]]),
    ],
)
def test_literals_of_patterns(pattern, literals):
    assert textindex.literals_of(pattern) == literals


def test_term_frequency_of_two_hundred_patterns(spark, tmp_path):
    docs = fx.documents_with_year(spark, SF_SMALL).select("doc_id", "year", "text")
    odd = spark.createDataFrame([(9001, 1990, None), (9002, None, "the und"), (9003, 1991, "The Ünd straße 1.5 a.b")], "doc_id long, year int, text string")
    docs = docs.unionByName(odd.select("doc_id", F.col("year").cast(docs.schema["year"].dataType).alias("year"), "text"))
    root = str(tmp_path / "index")
    textindex.add_records(docs, root, ["text"])
    rng = random.Random(4)
    words = sorted({w for r in docs.where("text IS NOT NULL").limit(60).collect() for w in re.findall(r"\w{2,}", r.text.lower())})
    kinds = [
        lambda: rng.choice(words), lambda: f"{rng.choice(words)}|{rng.choice(words)}", lambda: rf"\b{rng.choice(words)}\b",
        lambda: f"{rng.choice(words)}[a-z]*{rng.choice(words)[:2]}", lambda: f"({rng.choice(words)}|x){rng.choice(words)[:3]}?",
        lambda: f"{rng.choice(words)[:2]}", lambda: f"{rng.choice(words)}+ ?{rng.choice(words)[:1]}", lambda: f"[{rng.choice(words)}]{{3}}",
        lambda: rng.choice(words).title(),
    ]
    patterns = {"", ".", "a|", "license|", "(?i)THE", r"\.", "1.5", r"1\.5"}
    while len(patterns) < 200:
        patterns.add(rng.choice(kinds)())
    patterns = sorted(patterns)
    found = sorted(map(tuple, textindex.term_frequency(spark, root, patterns).collect()), key=_key)
    assert found == sorted(map(tuple, lexical.term_frequency(docs, patterns, column="text").collect()), key=_key)
    assert any(r[4] for r in found)


def test_registered_queries_use_the_index(spark):
    assert {"search_papers_indexed", "term_frequency_indexed"} <= set(catalog.queries())
