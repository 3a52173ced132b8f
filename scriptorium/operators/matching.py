"""Best-match lookup of records in a table of works, by a set-similarity join.

Titles are compared as sets of words, each title in two variants: whole, and
without its subtitle.  Two titles are alike when two of their variants have a
Jaccard similarity of ``threshold`` thousandths or more.  Pairs are found by a
prefix-filtered join, not by comparing everything:

* equal sets are one set, so copies of a title are joined once;
* the words of a set are ordered by rarity, and two sets that are alike share
  a word among the first n - ceil(threshold n) + 1 of each, so only these few
  rare words are joined on;
* sizes and positions of the shared word rule many candidates out where they
  meet, and so does a small map of each set's words: words that only one of two
  sets has are at least as many as the bits that differ in their maps;
* what is left is checked exactly.

No pair that reaches the threshold is lost.  Among the works alike, the best
one is ranked by title, author, publication and year in whole thousandths, so
that ties are ties everywhere; they go to the smallest DOI.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.lexical import TERM_PATTERN

THRESHOLD = 600
# Shares of title, author, publication and year in the score.
WEIGHTS = (6, 2, 1, 1)
# Longs of the map of a set's words: 64 bits each, a bit for each word by its hash.
MAP_LONGS = 4
# Where a subtitle begins (fixed value).
SUBTITLE = "[:–—].*$"


def word_set(c: Column) -> Column:
    """The different lower-case words of a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))))


def title_variants(c: Column) -> Column:
    """Word sets of the whole title and of the title without subtitle; none for a title without words."""
    return F.array_distinct(F.filter(F.array(word_set(c), word_set(F.regexp_replace(c, f"(?s){SUBTITLE}", ""))), lambda s: F.size(s) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets in whole thousandths, rounded down; 0 for empty sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, F.floor(F.lit(1000) * both / either)).otherwise(F.lit(0)).cast("int")


def _prefixes(sets: DataFrame, rarity: DataFrame, threshold: int) -> DataFrame:
    words = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("word")).join(rarity, "word")
    of_set = Window.partitionBy("id")
    place = F.row_number().over(of_set.orderBy("n_sets", "word"))
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 1000) + 1
    hashed = words.withColumn("bit", F.pmod(F.xxhash64("word"), F.lit(64 * MAP_LONGS)).cast("int"))
    one = F.expr("shiftleft(1L, bit % 64)")
    maps = {f"map{k}": F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, one).otherwise(F.lit(0))).over(of_set) for k in range(MAP_LONGS)}
    placed = hashed.withColumns({**maps, "place": place}).where(F.col("place") <= kept)
    return placed.select("word", "id", "n", "place", *maps)


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``left_id, right_id`` of the pairs that are to be checked, all that reach the threshold among them."""
    words = left.select(F.explode("words").alias("word")).unionAll(right.select(F.explode("words").alias("word")))
    rarity = words.groupBy("word").agg(F.count(F.lit(1)).alias("n_sets"))
    a, b = (_prefixes(s, rarity, threshold).alias(name) for s, name in ((left, "a"), (right, "b")))
    sizes = (F.lit(1000) * F.col("a.n") >= threshold * F.col("b.n")) & (F.lit(1000) * F.col("b.n") >= threshold * F.col("a.n"))
    # at the first word that two sets share, no more words than the rest of either can be shared
    most = F.lit(1) + F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    reach = most * (1000 + threshold) >= threshold * (F.col("a.n") + F.col("b.n"))
    # of the words of both, at most those can be shared that the differing bits of their maps leave
    differ = sum((F.bit_count(F.col(f"a.map{k}").bitwiseXOR(F.col(f"b.map{k}"))) for k in range(MAP_LONGS)), F.lit(0))
    shared = (F.col("a.n") + F.col("b.n") - differ) * (1000 + threshold) >= 2 * threshold * (F.col("a.n") + F.col("b.n"))
    return a.join(b, "word").where(sizes & reach & shared).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()


def similar_sets(left: DataFrame, right: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of word sets (``id``, ``words`` on each side) with a similarity of ``threshold`` or more.

    Returns ``left_id, right_id, similarity``.  Ids must stand for different,
    non-empty sets within a side.
    """
    if not 0 < threshold <= 1000:
        raise ValueError("the threshold is given in thousandths, from 1 to 1000")
    checked = (
        candidate_pairs(left, right, threshold).join(left.select(F.col("id").alias("left_id"), F.col("words").alias("_a")), "left_id")
        .join(right.select(F.col("id").alias("right_id"), F.col("words").alias("_b")), "right_id")
    )
    similarity = jaccard(F.col("_a"), F.col("_b"))
    return checked.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _described(df: DataFrame, title: str, author: str, publication: str, year: str) -> list[Column]:
    return [
        F.col(title).cast("string").alias("_title"), F.col(author).cast("string").alias("_author"),
        F.col(publication).cast("string").alias("_publication"), F.col(year).cast("string").try_cast("int").alias("_year"),
    ]


DESCRIPTION = ["_title", "_author", "_publication", "_year"]


def _sets(described: DataFrame, *carried: str) -> DataFrame:
    """A row for each title variant: its id and words, what the rest is compared by, and ``carried``."""
    words = described.withColumn("words", F.explode(title_variants(F.col("_title"))))
    return words.select(
        F.md5(F.concat_ws(" ", "words")).alias("id"), "words", word_set(F.col("_author")).alias("author"),
        word_set(F.col("_publication")).alias("publication"), F.col("_year").alias("year"), *carried,
    )


def year_likeness(a: Column, b: Column) -> Column:
    """1000 for the same year, 500 for neighbouring ones, else (or where one is missing) 0."""
    return F.when(a == b, 1000).when(F.abs(a - b) == 1, 500).otherwise(0)


def best_matches(described: DataFrame, works: DataFrame, threshold: int = THRESHOLD, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``key, match_doi, match_score`` for each described record with a work alike.

    ``described``: ``key`` and ``DESCRIPTION``, one row per key; ``works``:
    ``DESCRIPTION`` and ``_doi``.  Works that agree in everything but the DOI
    are one work with the smallest DOI.
    """
    known = works.where(F.col("_doi").isNotNull() & F.col("_title").isNotNull()).groupBy(*DESCRIPTION).agg(F.min("_doi").alias("doi"))
    asked, held = _sets(described, "key"), _sets(known, "doi")
    unique = [s.groupBy("id").agg(F.any_value("words").alias("words")) for s in (asked, held)]
    pairs = similar_sets(*unique, threshold)
    a, b = asked.drop("words").alias("a"), held.drop("words").alias("b")
    joined = pairs.join(a, F.col("left_id") == F.col("a.id")).join(b, F.col("right_id") == F.col("b.id"))
    parts = (
        F.col("similarity"), jaccard(F.col("a.author"), F.col("b.author")), jaccard(F.col("a.publication"), F.col("b.publication")),
        year_likeness(F.col("a.year"), F.col("b.year")),
    )
    score = sum((part * w for part, w in zip(parts[1:], weights[1:], strict=True)), parts[0] * weights[0])
    best = joined.groupBy("a.key").agg(F.min(F.struct((-score).alias("s"), F.col("b.doi").alias("doi"))).alias("best"))
    return best.select("key", F.col("best.doi").alias("match_doi"), (-F.col("best.s")).cast("int").alias("match_score"))


def fill_best_doi(df: DataFrame, works: DataFrame, threshold: int = THRESHOLD, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give rows without DOI the DOI of the best matching work, NULL if none is alike.

    ``df``: doi, title, first_author, publication, year; ``works``: title,
    author, publication, year, DOI.  Adds ``match_score`` (NULL for rows that
    had a DOI or found none).  Records that agree in all four are looked up
    once; rows with a DOI or without title stay out of the join.
    """
    cols = df.columns
    key = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in DESCRIPTION]))
    told = df.select("*", *_described(df, "title", "first_author", "publication", "year")).withColumn("_key", key)
    asks = F.col("doi").isNull() & F.col("_title").isNotNull()
    described = told.where(asks).select(F.col("_key").alias("key"), *DESCRIPTION).groupBy("key").agg(*[F.any_value(c).alias(c) for c in DESCRIPTION])
    table = works.select(*_described(works, "title", "author", "publication", "year"), F.col("DOI").alias("_doi"))
    found = best_matches(described, table, threshold, weights)
    asking = told.where(asks).join(found, F.col("_key") == F.col("key"), "left").withColumn("doi", F.col("match_doi"))
    rest = told.where(~asks).withColumn("match_score", F.lit(None).cast("int"))
    return rest.select(*cols, "match_score").unionByName(asking.select(*cols, "match_score"))
