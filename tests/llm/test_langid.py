"""Held-out accuracy, the vectors against plain counting, rejection, defined cases."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import langid, queries

SF_MID = "/root/testdata/sf0.01"
WORDS = {
    "aa": "kala muna tiro selo kina mura pelo nita",
    "bb": "xerth wuqq zarch vexth qurr wozz yarth xuzz",
    "cc": "ñandú çiça şöğü ørsk ålgæ žužka čočka łąka",
}


def made(n=40):
    rows, rng = [], random.Random(3)
    for k, (lang, words) in enumerate(WORDS.items()):
        words = words.split()
        rows += [(100 * k + i, " ".join(rng.choices(words, k=rng.randrange(2, 25))), lang) for i in range(n)]
    return rows


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    found = queries.op12_nearest_centroid(spark, SF_MID).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert len(found) == len(langs) and all(r.held_out == held(r.doc_id) for r in found)
    unseen = [r for r in found if r.held_out]
    assert len(unseen) > 100 and np.mean([r.lang_pred == langs[r.doc_id] for r in unseen]) >= 0.99
    assert all(0 <= r.score <= 1 for r in found)


def test_counts_against_plain_counting():
    text = "Ab, ab! Ça\nb12ΑΒ  x"
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(letters.split()) + " "
    grams = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n] != " ")
    expected = np.zeros(langid.BUCKETS, dtype=int)
    for gram, n in grams.items():
        symbols = np.array([ord(c) for c in gram], dtype=np.uint32)
        expected[langid._hashed(symbols, len(gram))[0]] += n
    for piece in (1, 2, 3, 7, 1 << 20):  # cut anywhere
        assert (langid.counts_of(text, piece) == expected).all()
    assert langid.counts_of("12 3 !") is None and langid.counts_of("") is None


def test_nothing_held_out_is_learned(spark):
    rows = made()
    spoilt = [(i, "zzz qqq " * 9 if held(i) else t, "cc" if held(i) else lang) for i, t, lang in rows]
    shape = "doc_id long, text string, lang string"
    a, b = (langid.fit(spark.createDataFrame(r, shape)) for r in (rows, spoilt))
    assert (a.idf == b.idf).all() and (a.centroids == b.centroids).all()
    # the layout, other columns and copies of one text do not change the sample
    again = spark.createDataFrame(rows[::-1], shape).repartition(7).withColumn("th", F.lit("x")).withColumn("rank", F.lit(0))
    c = langid.fit(again)
    assert (a.idf == c.idf).all() and np.allclose(a.centroids, c.centroids)


def test_copies_do_not_fill_the_sample(spark):
    rows = made() + [(1000 + i, "kala kala kala", "aa") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learning = langid.learning_rows(frame)
    sample = langid.learning_sample(learning, per_lang=10).collect()
    assert Counter(r.lang for r in sample) == {"aa": 10, "bb": 10, "cc": 10}
    assert len({(r.lang, r.text) for r in sample}) == 30


def test_rejection_and_defined_cases(spark):
    rows = made() + [
        (901, None, "aa"), (902, "", "aa"), (903, "12 !? 34", None), (904, "漢字仮名交じり文", None), (None, "kala muna tiro selo kina mura kala", "bb"),
        (905, "kala muna tiro selo kina mura kala", None), (905, "kala muna tiro selo kina mura kala", None), (906, "xerth wuqq " * 50_000, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("held_out", "score", "distance", "th", "rank", "centroid"):
        frame = frame.withColumn(name, F.lit("x"))
    model = langid.fit(frame)
    found = langid.identify(frame, model).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i in (901, 902, 903):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].distance) == ("und", 0.0, None)
    assert by_id[904].rejected and by_id[904].lang_pred == "und" and by_id[904].nearest_lang in WORDS
    assert [r.lang_pred for r in found if r.doc_id == 905] == ["aa", "aa"]
    assert by_id[906].lang_pred == "bb" and by_id[None].lang_pred == "aa" and by_id[None].held_out is False
    kept = {r.doc_id: r for r in langid.identify(frame, model, und_if_rejected=False).collect()}
    assert kept[904].lang_pred == by_id[904].nearest_lang and kept[904].rejected and kept[902].lang_pred == "und"


def test_nothing_to_learn_and_empty_table(spark, no_docs):
    frame = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(frame).collect()] == [("und", 0.0)] * 2
    empty = langid.identify(no_docs)
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
