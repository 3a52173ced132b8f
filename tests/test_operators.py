"""Hand-made cases (FIXTURES.md §3) and skew / partitioning invariance."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import dates, text
from scriptorium.functions.countries import country_to_iso
from scriptorium.operators import lexical, merge, search, segments
from scriptorium.operators import library as libops
from scriptorium.operators import screening as scr


def test_merge_first_non_null_and_source_union(spark):
    df = spark.createDataFrame(
        [("a", "", "s1", 0, 1), ("a", "x", "s2|s3", 0, 2), (None, "y", "s1", 0, 3)],
        "doi string, title string, source string, priority int, seq int",
    )
    out = merge.join_multi(merge.merge_duplicates(df)).collect()
    assert [tuple(r) for r in out] == [("a", "x", "s1|s2|s3")]


def test_merge_invariant_under_partitioning(spark):
    rows = [(f"d{i % 17}", None if i % 3 else f"t{i}", f"s{i % 4}", i % 3, i) for i in range(400)]
    df = spark.createDataFrame(rows, "doi string, title string, source string, priority int, seq int")
    ref = sorted(map(tuple, merge.join_multi(merge.merge_duplicates(df)).collect()))
    for n in (1, 4, 16):
        shuffled = df.repartition(n).orderBy(F.rand(n))
        assert sorted(map(tuple, merge.join_multi(merge.merge_duplicates(shuffled)).collect())) == ref


def test_append_old_values_win(spark):
    old = spark.createDataFrame([("a", "old", "scopus", 0, 5)], "doi string, title string, source string, priority int, seq int")
    new = spark.createDataFrame([("a", "new", "pubmed", 0, 1)], "doi string, title string, source string, priority int, seq int")
    out = merge.join_multi(merge.append_results(merge.merge_duplicates(old), new)).collect()
    assert [tuple(r) for r in out] == [("a", "old", "pubmed|scopus")]


def _freq(spark, word):
    df = spark.createDataFrame([(2000, "Foo bar"), (2000, None), (2001, "baz"), (2001, "FOO")], "year int, abstract string")
    return {r.year: r.freq for r in lexical.term_frequency(df, [word]).collect()}


def test_frequency_ignores_null_text(spark):
    assert _freq(spark, "foo") == {2000: 1.0, 2001: 0.5}


def test_frequency_capital_pattern_never_matches(spark):
    assert _freq(spark, "FOO") == {2000: 0.0, 2001: 0.0}


def test_smoothing_five_and_four_years(spark):
    tf = spark.createDataFrame([(0, 2000 + i, v) for i, v in enumerate([0.0, 0.0, 1.0, 0.0, 0.0])], "word_pos int, year int, freq double")
    got = [round(r.smoothed, 6) for r in lexical.smooth(tf).orderBy("year").collect()]
    assert got == [0.0, 0.342857, 0.485714, 0.342857, 0.0]
    short = tf.where("year < 2004")
    assert all(r.smoothed is None for r in lexical.smooth(short).collect())


def test_chronology_order(spark):
    rows = []
    for y in (2000, 2010):
        rows += [(y, "w1 text" if y == 2000 else "w2 text")]
    df = spark.createDataFrame(rows, "year int, abstract string")
    s = lexical.freq_series(df, ["w1", "w2", "w3"])
    order = [r.word for r in s.select("word", "chrono_rank").distinct().orderBy("chrono_rank").collect()]
    assert order == ["w3", "w1", "w2"]


def test_duplicate_words_rejected():
    with pytest.raises(ValueError):
        lexical.word_table(["a", "a"])


def test_table_headings(spark):
    df = spark.createDataFrame([([["Method", "acc", "AUC"], ["ours", "0.8", "0.7"]],)], "cells array<array<string>>")
    assert df.select(segments.table_headings(F.col("cells"))).first()[0] == "Method ; ours | acc ; AUC"


def test_last_words(spark):
    long = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([("a b\tc  d",), (long,)], "t string")
    got = [r[0] for r in df.select(scr.last_words(F.col("t"), 300)).collect()]
    assert got[0] == "a bc d"
    assert got[1].split(" ") == [f"w{i}" for i in range(100, 400)]
    assert [r[0] for r in df.select(scr.last_words(F.col("t"))).collect()] == ["a bc d", long]


def test_match_choice(spark):
    df = spark.createDataFrame([("Other, maybe color fundus",), ("Foo. ",)], "r string")
    got = [r[0] for r in df.select(scr.match_choice(F.col("r"), ["color fundus"])).collect()]
    assert got == ["color fundus", "foo"]


def test_countries(spark):
    names = ["Hong Kong", "South Korea", "Ciudad de México, DF", "Atlantis", "china"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.select(country_to_iso(F.col("c"))).collect()] == ["CHN", "KOR", "MEX", "", ""]


def test_years(spark):
    df = spark.createDataFrame([("2019-05",), ("May 2019",), ("n.d.",)], "d string")
    a = [r[0] for r in df.select(dates.year_anchored(F.col("d"))).collect()]
    b = [r[0] for r in df.select(dates.year_anywhere(F.col("d"))).collect()]
    assert a == [2019, None, None] and b == [2019, 2019, None]


def test_roman(spark):
    df = spark.range(1, 40).select(F.col("id").cast("int").alias("n"))
    rows = df.select("n", text.int_to_roman(F.col("n")).alias("r")).select("n", "r", text.roman_to_int(F.col("r")).alias("back")).collect()
    assert all(r.n == r.back for r in rows)
    assert {r.n: r.r for r in rows}[14] == "XIV"


def test_prefer_content(spark):
    df = spark.createDataFrame(
        [("1", "application/pdf"), ("1", "text/html"), ("2", "text/html"), ("2", "text/html")], "zoteroID string, content_type string"
    )
    loose = sorted(map(tuple, libops.prefer_content(df, "pdf").collect()))
    strict = sorted(map(tuple, libops.prefer_content(df, "pdf", strict=True).collect()))
    assert loose == [("1", "application/pdf"), ("2", "text/html"), ("2", "text/html")]
    assert strict == [("1", "application/pdf")]


def test_cap_per_group_exact_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [(2000 if rnd.random() < 0.4 else rnd.randint(2001, 2010), i, rnd.random()) for i in range(5000)]
    df = spark.createDataFrame(rows, "year int, seq long, v double")
    pdf = pd.DataFrame(rows, columns=["year", "seq", "v"]).sort_values(["v", "seq"]).groupby("year").head(30)
    want = sorted(map(tuple, pdf.itertuples(index=False)))
    for buckets in (1, 8):
        got = sorted(map(tuple, search.cap_per_group(df, 30, ["year"], ["v", "seq"], salt_buckets=buckets).collect()))
        assert got == want
    assert search.cap_per_group(df, 0, ["year"], ["v", "seq"]).count() == len(rows)
    with pytest.raises(ValueError):
        search.cap_per_group(df, -1, ["year"], ["v", "seq"])


def test_search_rejects_bad_range():
    with pytest.raises(ValueError):
        search.check_year_range(2010, 2000)


def test_year_periods_labels(spark):
    b = spark.createDataFrame([("a", 2000, 2001), ("b", 2005, None), ("c", None, 2003)], "k string, min_year int, max_year int")
    got = sorted((r.k, r.label) for r in search.year_periods(b).collect())
    assert got == [("a", "2000"), ("a", "2001"), ("b", "2005-"), ("c", "-2003")]


def test_existing_paths_with_file_listing(spark, tmp_path):
    from scriptorium.operators import library as lib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "a" / "y.html").write_text("<html/>")
    listing = lib.list_files(spark, str(tmp_path))
    df = spark.createDataFrame(
        [("k1", str(tmp_path / "a" / "x.pdf")), ("k2", str(tmp_path / "a" / "missing.pdf")), ("k3", None)],
        "zoteroID string, path string",
    )
    assert [r.zoteroID for r in lib.existing_paths(df, listing).collect()] == ["k1"]


def test_the_random_work_list_does_not_depend_on_the_partitions(spark):
    papers = spark.createDataFrame([(f"d{i}",) for i in range(300)], "doi string")
    none = papers.limit(0)
    orders = [[r.doi for r in search.missing_dois(papers.repartition(n), none, seed=7).collect()] for n in (1, 5)]
    other = [r.doi for r in search.missing_dois(papers, none, seed=8).collect()]
    assert orders[0] == orders[1] != other and sorted(orders[0]) == sorted(other) != orders[0]
