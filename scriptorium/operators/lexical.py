"""Lexical analysis: yearly term frequency, chronology order, smoothing, term counts.

All words are evaluated in ONE aggregate over the corpus (one scan, partial
aggregation per map task, one small shuffle keyed by year).  Everything after
that works on the words x years result, whose size is bounded by the word list
the caller passes in, never by the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_root

# Savitzky-Golay weights for window 5, polynomial order 3
# (least-squares cubic through five points).  Interior rows use the centre
# row of the fit; the first two and last two rows evaluate the cubic fitted
# to the first / last five rows at their own position.
SG_INTERIOR = ((-3, 12, 17, 12, -3), 35.0)
SG_FIRST = ((69, 4, -6, 4, -1), 70.0)
SG_SECOND = ((2, 27, 12, -8, 2), 35.0)
SG_WINDOW = 5

CHRONO_EPS = 1e-3


def word_table(words: Sequence[str] = (), labelled: Mapping[str, str] | None = None) -> list[tuple[int, str, str]]:
    """(position, pattern, label) for positional words then labelled words.

    Labels replace ``_`` by a space and are stripped; patterns are used as given.
    Duplicate patterns are rejected (they would silently collapse into one series).
    """
    labelled = dict(labelled or {})
    patterns = list(words) + list(labelled.values())
    labels = [str(w).replace("_", " ").strip() for w in list(words) + list(labelled.keys())]
    if len(set(patterns)) != len(patterns):
        raise ValueError(f"duplicate words in {patterns!r}")
    if not patterns:
        raise ValueError("at least one word is required")
    return [(i, p, lab) for i, (p, lab) in enumerate(zip(patterns, labels, strict=True))]


def term_frequency(
    df: DataFrame,
    words: Sequence[str] = (),
    column: str = "abstract",
    year_col: str = "year",
    labelled: Mapping[str, str] | None = None,
) -> DataFrame:
    """Share of documents per year whose lower-cased ``column`` matches each regex.

    Returns ``word_pos, word, label, year, freq``.  Null texts do not count
    (neither in numerator nor denominator); rows without a year drop out.
    Patterns written with capitals never match, since only the text is lowered.
    """
    table = word_table(words, labelled)
    base = df.select(F.col(year_col).cast("int").alias("year"), F.lower(F.col(column)).alias("_lc")).where(
        F.col("year").isNotNull()
    )
    wide = base.groupBy("year").agg(
        *[F.avg(F.col("_lc").rlike(p).cast("double")).alias(f"f{i}") for i, p, _ in table]
    )
    long = wide.unpivot("year", [f"f{i}" for i, _, _ in table], "slot", "freq")
    pos = F.substring("slot", 2, 9).cast("int")
    pats = F.array(*[F.lit(p) for _, p, _ in table])
    labs = F.array(*[F.lit(lab) for _, _, lab in table])
    return long.select(
        pos.alias("word_pos"),
        F.element_at(pats, pos + 1).alias("word"),
        F.element_at(labs, pos + 1).alias("label"),
        "year",
        "freq",
    )


def term_hits(
    df: DataFrame,
    words: Sequence[str] = (),
    column: str = "abstract",
    year_col: str = "year",
    labelled: Mapping[str, str] | None = None,
) -> DataFrame:
    """What ``term_frequency`` divides, in a form that adds up: per year the number of texts
    (``n_docs``) and, by word position, how many of them match (``hits``)."""
    table = word_table(words, labelled)
    base = df.select(F.col(year_col).cast("int").alias("year"), F.lower(F.col(column)).alias("_lc")).where(F.col("year").isNotNull())
    found = base.groupBy("year").agg(F.count("_lc").alias("n_docs"), *[F.count_if(F.col("_lc").rlike(p)).alias(f"f{i}") for i, p, _ in table])
    return found.select("year", "n_docs", F.array(*[f"f{i}" for i, _, _ in table]).alias("hits"))


def add_hits(hits: DataFrame) -> DataFrame:
    """The sum per year of any number of ``term_hits`` results of the same words, stacked."""
    rows = hits.select("year", "n_docs", F.posexplode("hits").alias("slot", "n"))
    per_word = rows.groupBy("year", "slot").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    return per_word.groupBy("year").agg(
        F.max("n_docs").alias("n_docs"), F.transform(F.array_sort(F.collect_list(F.struct("slot", "n"))), lambda s: s["n"]).alias("hits")
    )


def frequency_of_hits(hits: DataFrame, words: Sequence[str] = (), labelled: Mapping[str, str] | None = None) -> DataFrame:
    """``term_frequency`` of all texts counted in ``hits`` (one row per year, see ``add_hits``)."""
    table = word_table(words, labelled)
    long = hits.select("year", "n_docs", F.posexplode("hits").alias("word_pos", "n"))
    return long.select(
        "word_pos",
        F.element_at(F.array(*[F.lit(p) for _, p, _ in table]), F.col("word_pos") + 1).alias("word"),
        F.element_at(F.array(*[F.lit(lab) for _, _, lab in table]), F.col("word_pos") + 1).alias("label"),
        "year",
        F.when(F.col("n_docs") > 0, F.col("n") / F.col("n_docs")).alias("freq"),
    )


def chronology(tf: DataFrame) -> DataFrame:
    """Add ``chrono_score``: centre-of-mass year of each word's cubed, max-normalised series.

    ``c = (f / (max f + 1e-3))^3``; ``p = c / (sum c + 1e-3)``; ``score = sum p * year``.
    A word that never occurs scores 0.
    """
    # ordered by year with a whole-partition frame: the same window spec (and
    # sort) as the smoothing, so both run in one pass per word
    w = Window.partitionBy("word_pos").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.pow(F.col("freq") / (F.max("freq").over(w) + F.lit(CHRONO_EPS)), 3)
    with_c = tf.withColumn("_c", c)
    with_p = with_c.withColumn("_p", F.col("_c") / (F.sum("_c").over(w) + F.lit(CHRONO_EPS)))
    return with_p.withColumn("chrono_score", F.coalesce(F.sum(F.col("_p") * F.col("year")).over(w), F.lit(0.0))).drop(
        "_c", "_p"
    )


def chrono_rank(tf: DataFrame, keep_order: bool = False) -> DataFrame:
    """Add ``chrono_rank`` (1-based): words ascending by chronology score, ties by position.

    The ranking window runs over one row per word (bounded by the caller's word
    list), then the rank is joined back.
    """
    if keep_order:
        return tf.withColumn("chrono_rank", (F.col("word_pos") + 1).cast("int"))
    per_word = tf.groupBy("word_pos").agg(F.max("chrono_score").alias("_score"))
    ranked = per_word.select(
        "word_pos", F.row_number().over(Window.orderBy("_score", "word_pos")).alias("chrono_rank")
    )
    return tf.join(ranked, "word_pos")


def _weighted(cols: Sequence[Column], weights: Sequence[int], denom: float) -> Column:
    acc = None
    for c, wt in zip(cols, weights, strict=True):
        term = c * F.lit(float(wt))
        acc = term if acc is None else acc + term
    return acc / F.lit(denom)


def clip01(x: Column) -> Column:
    """Clip to [0, 1], keeping null as null (``greatest``/``least`` skip nulls)."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def smooth(tf: DataFrame, value_col: str = "freq", out_col: str = "smoothed", clip: bool = True) -> DataFrame:
    """Savitzky-Golay (window 5, order 3) over each word's rows ordered by year.

    Neighbours are rows, not calendar years.  Series shorter than the window give null.
    """
    w = Window.partitionBy("word_pos").orderBy("year")
    f = F.col(value_col)
    lag = {k: F.lag(value_col, k).over(w) for k in range(1, 5)}
    lead = {k: F.lead(value_col, k).over(w) for k in range(1, 5)}
    i = F.row_number().over(w)
    n = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = _weighted([f, lead[1], lead[2], lead[3], lead[4]], *SG_FIRST)
    second = _weighted([lag[1], f, lead[1], lead[2], lead[3]], *SG_SECOND)
    last = _weighted([f, lag[1], lag[2], lag[3], lag[4]], *SG_FIRST)
    before_last = _weighted([lead[1], f, lag[1], lag[2], lag[3]], *SG_SECOND)
    interior = _weighted([lag[2], lag[1], f, lead[1], lead[2]], *SG_INTERIOR)
    raw = (
        F.when(n < SG_WINDOW, F.lit(None).cast("double"))
        .when(i == 1, first)
        .when(i == 2, second)
        .when(i == n, last)
        .when(i == n - 1, before_last)
        .otherwise(interior)
    )
    return tf.withColumn(out_col, clip01(raw) if clip else raw)


def freq_series(
    df: DataFrame,
    words: Sequence[str] = (),
    column: str = "abstract",
    year_col: str = "year",
    labelled: Mapping[str, str] | None = None,
    keep_order: bool = False,
) -> DataFrame:
    """The data behind the yearly occurrence graph: frequency, smoothed curve, order.

    Columns: ``word_pos, word, label, year, freq, smoothed, chrono_score, chrono_rank``.
    """
    return series_of(term_frequency(df, words, column=column, year_col=year_col, labelled=labelled), keep_order)


def series_of(tf: DataFrame, keep_order: bool = False) -> DataFrame:
    """A frequency table with its smoothed curves and the order of the words."""
    return chrono_rank(smooth(chronology(tf)), keep_order=keep_order)


def freq_max(tf: DataFrame) -> DataFrame:
    """Overall maximum frequency (one row), used to scale the graph."""
    return tf.agg(F.max("freq").alias("freq_max"))


# Fixed value: a term is a maximal run of letters, digits or underscore.
TERM_PATTERN = r"[\p{L}\p{N}_]+"


def term_counts(df: DataFrame, column: str = "text", group_cols: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each lower-cased term (optionally per group).

    The explode stays inside the scan stage and ``groupBy`` combines map-side, so
    a hot group or term never ships more than one partial row per map task.
    """
    terms = df.select(*group_cols, F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(TERM_PATTERN), 0)).alias("term"))
    return terms.groupBy(*group_cols, "term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(counts: DataFrame, k: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """The k most frequent terms (per group), ties broken by term; adds ``term_rank``.

    ``row_number() <= k`` lets Spark insert a partial per-group limit before the
    shuffle (window group limit), so each map task sends at most k rows per group.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.desc("n"), F.asc("term")) if group_cols else Window.orderBy(
        F.desc("n"), F.asc("term")
    )
    if not group_cols:
        return counts.orderBy(F.desc("n"), F.asc("term")).limit(k).withColumn(
            "term_rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term")))
        )
    return counts.withColumn("term_rank", F.row_number().over(w)).where(F.col("term_rank") <= k)


def _terms(df: DataFrame, column: str, group_cols: Sequence[str], buckets: int) -> DataFrame:
    terms = df.select(*group_cols, F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(TERM_PATTERN), 0)).alias("term"))
    return terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


# Buckets of the sketch per group, the fullest ones (per term wanted) that are counted
# exactly at first, and the most that a filter is broadcast for.
SKETCH_BUCKETS = 1 << 16
FULLEST = 4
MOST_BROADCAST = 1 << 20


def _count_in(terms: DataFrame, chosen: DataFrame, n_chosen: int, group_cols: Sequence[str]) -> DataFrame:
    """Exact counts of the terms in the chosen buckets (of all terms where these are too many to be sent round)."""
    if n_chosen <= MOST_BROADCAST:
        same = [F.col(f"terms.{c}").eqNullSafe(F.col(f"chosen.{c}")) for c in (*group_cols, "bucket")]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        terms = terms.alias("terms").join(F.broadcast(chosen.alias("chosen")), condition, "left_semi")
    return terms.groupBy(*group_cols, "term").agg(F.count(F.lit(1)).alias("n"))


def heavy_terms(
    df: DataFrame, k: int, column: str = "text", group_cols: Sequence[str] = (), buckets: int = SKETCH_BUCKETS, fullest: int = FULLEST
) -> DataFrame:
    """``top_terms`` of ``term_counts`` without shuffling the vocabulary; same rows, exact.

    A sketch per group counts terms by hash bucket; sketches add up, so a map
    task sends one row per bucket at most.  A bucket's count bounds each of its
    terms from above.  The terms of the fullest ``fullest * k`` buckets are
    counted exactly; where another bucket holds as much as the k-th of them, or
    a group has found fewer than k, the terms of all buckets that hold at least
    as much are counted, which proves the result: a term of any other bucket is
    rarer than the k-th found.
    """
    if not 0 < k or not 0 < buckets:
        raise ValueError("k and the number of buckets must be positive")
    terms = _terms(df, column, group_cols, buckets)
    checkpoint_root(df.sparkSession)
    sketch = terms.groupBy(*group_cols, "bucket").agg(F.count(F.lit(1)).alias("held")).checkpoint()
    place = F.row_number().over(Window.partitionBy(*group_cols).orderBy(F.desc("held"), "bucket"))
    first = sketch.withColumn("_place", place).where(F.col("_place") <= fullest * k).checkpoint()
    found = _count_in(terms, first, first.count(), group_cols).checkpoint()
    ranked = top_terms(found, k, group_cols)
    kth = ranked.where(F.col("term_rank") == k).select(*[F.col(c).alias(f"_{c}") for c in group_cols], F.col("n").alias("least"))
    same = F.lit(True)
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    open_buckets = sketch.join(kth, same, "left").where(F.col("held") >= F.coalesce("least", F.lit(0)))
    open_buckets = open_buckets.select(*group_cols, "bucket").checkpoint()
    condition = F.lit(True)
    for c in (*group_cols, "bucket"):
        condition = condition & F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}"))
    if open_buckets.alias("o").join(first.alias("f"), condition, "left_anti").isEmpty():
        return ranked
    return top_terms(_count_in(terms, open_buckets, open_buckets.count(), group_cols), k, group_cols)


def token_frequency(
    df: DataFrame, words: Sequence[str], column: str = "abstract", year_col: str = "year"
) -> DataFrame:
    """Share of documents per year containing each word as a whole lower-cased token.

    The form for long word lists (thousands of words): instead of one regex
    pass per word, a document gives one row for each listed word among its
    distinct tokens and one with an empty word, which no token is; counting
    (year, word) with map-side combine then gives hits and totals in one scan.
    Pairs that never occur are absent (sparse output).  Returns ``year, word,
    n_docs, freq``.
    """
    wl = sorted({w.lower() for w in words})
    if not wl:
        raise ValueError("at least one word is required")
    base = df.select(F.col(year_col).cast("int").alias("year"), F.lower(F.col(column)).alias("_lc")).where(
        F.col("year").isNotNull() & F.col("_lc").isNotNull()
    )
    tokens = F.array_distinct(F.regexp_extract_all("_lc", F.lit(TERM_PATTERN), 0))
    hits = F.array_append(F.filter(tokens, lambda t: t.isin(wl)), "")
    counts = base.select("year", F.explode(hits).alias("word")).groupBy("year", "word").agg(F.count(F.lit(1)).alias("n_docs"))
    docs = F.max(F.when(F.col("word") == "", F.col("n_docs"))).over(Window.partitionBy("year"))
    return counts.withColumn("freq", F.col("n_docs") / docs).where(F.col("word") != "")
