"""The set-similarity join and the best match against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import matching

WORDS = [f"w{i}" for i in range(14)]


def _sets(spark, sets):
    return spark.createDataFrame([(str(i), sorted(s)) for i, s in enumerate(sets)], "id string, words array<string>")


@pytest.mark.parametrize("threshold", [1, 333, 500, 600, 800, 1000])
def test_similar_sets_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    # the first words are frequent, and every set has one of them
    draw = lambda: frozenset([*rng.choices(WORDS, weights=range(14, 0, -1), k=rng.randrange(1, 9)), *["w0"] * (rng.random() < 0.7)])
    left, right = (sorted({draw() for _ in range(90)}, key=sorted) for _ in range(2))
    found = {(int(r.left_id), int(r.right_id)): r.similarity for r in matching.similar_sets(_sets(spark, left), _sets(spark, right), threshold).collect()}
    expected = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            similarity = 1000 * len(a & b) // len(a | b)
            if similarity >= threshold:
                expected[i, j] = similarity
    assert found == expected and expected


def test_candidates_are_joined_on_rare_words_only(spark):
    left = _sets(spark, [{"common", "other", f"rare{i}"} for i in range(300)])
    a = matching._prefixes(left, left.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_sets")), 600)
    assert a.where("word = 'common'").count() + a.where("word = 'other'").count() == 300  # one of the two, not both
    assert matching.similar_sets(left, left, 800).count() == 300


def test_pairs_that_only_share_a_few_words_are_ruled_out_where_they_meet(spark):
    rng = random.Random(3)
    left, right = (sorted({frozenset(rng.sample(range(60), 14)) for _ in range(150)}, key=sorted) for _ in range(2))
    right += [s - {min(s)} for s in left[:20]]
    a, b = (_sets(spark, [{f"v{i}" for i in s} for s in side]) for side in (left, right))
    pairs = {(int(r.left_id), int(r.right_id)) for r in matching.candidate_pairs(a, b, 600).collect()}
    alike = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if 1000 * len(x & y) >= 600 * len(x | y)}
    assert alike <= pairs and len(alike) >= 20
    assert len(pairs) < 2 * len(alike)  # 13,073 by their rare words, sizes and places alone


RECORD = "doi string, title string, first_author string, publication string, year int"
WORK = "title string, author string, publication string, year int, DOI string"


def test_the_best_work_is_ranked(spark):
    works = [
        ("Deep Learning of Retinal Vessels", "Ada Byron", "Eye", 2019, "10/c"),
        ("Deep learning of retinal vessels: a survey", "Ada Byron", "Eye", 2020, "10/b"),
        ("Deep Learning of Retinal Vessels", "Bo Chen", "Ear", 2019, "10/a"),
        ("Deep Learning of Retinal Vessels", "Bo Chen", "Ear", 2019, "10/0"),
        ("Something else entirely", "Ada Byron", "Eye", 2019, "10/d"),
        (None, "Ada Byron", "Eye", 2019, "10/e"),
        ("Deep Learning of Retinal Vessels", None, None, None, None),
    ]
    records = [
        (None, "deep learning of retinal vesels", "Byron, Ada", "eye", 2019),  # misspelt
        (None, "Deep learning of retinal vessels: a survey", "Ada Byron", "Eye", 2020),
        (None, "Deep learning of retinal vessels — part two", "B. Chen", None, 2018),
        (None, "Deep learning of retinal vessels", None, None, None),  # a tie goes to the smallest DOI
        (None, "Deep", "Ada Byron", "Eye", 2019),
        (None, None, "Ada Byron", "Eye", 2019),
        (None, "?!", "Ada Byron", "Eye", 2019),
        ("10/kept", "Deep learning of retinal vessels", "Ada Byron", "Eye", 2019),
    ]
    frame = spark.createDataFrame([*records, records[0]], RECORD)
    found = matching.fill_best_doi(frame, spark.createDataFrame(works, WORK)).collect()
    told = {(r.title, r.first_author, r.year): (r.doi, r.match_score) for r in found}
    assert len(found) == 9
    dois = [told[t, a, y][0] for _, t, a, _, y in records]
    assert dois[:7] == ["10/c", "10/b", "10/0", "10/0", None, None, None]
    assert told["Deep learning of retinal vessels", "Ada Byron", 2019] == ("10/kept", None)
    assert told[records[1][1], "Ada Byron", 2020] == ("10/b", 10_000)


def test_no_works_and_no_records(spark):
    none, record = spark.createDataFrame([], WORK), spark.createDataFrame([(None, "a b", "c", "d", 2000)], RECORD)
    assert [r.doi for r in matching.fill_best_doi(record, none).collect()] == [None]
    assert matching.fill_best_doi(spark.createDataFrame([], RECORD), none).count() == 0
