"""Search over landed records: engines, text, year range, periods, cap per period.

The live HTTP clients are not rebuilt; a "search" selects from records already
landed as a table, with the same parameters and limits as a scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.merge import append_results, merge_duplicates, union_sources, valid_records

# Engine names, and the engines used when none is given
# (the code's default, two of the three).
ENGINE_NAMES = ("crossref", "pubmed", "scopus", "external")
DEFAULT_ENGINES = ("scopus", "pubmed")

# Salt buckets of the first phase of ``cap_per_group``: a hot group is ranked
# in this many pieces, and the second phase sees at most SALT * n rows of it.
CAP_SALT_BUCKETS = 64


def parse_engines(engines: str | Sequence[str] | None) -> list[str]:
    if engines is None:
        return list(DEFAULT_ENGINES)
    if isinstance(engines, str):
        engines = [engines]
    out = []
    for e in engines:
        e = str(getattr(e, "value", e))
        if e not in ENGINE_NAMES:
            raise ValueError(f"unknown search engine {e!r}; expected one of {ENGINE_NAMES}")
        out.append(e)
    return out


def check_year_range(min_year: int | None, max_year: int | None) -> tuple[int | None, int | None]:
    lo = int(min_year) if min_year is not None else None
    hi = int(max_year) if max_year is not None else None
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("min_year should be less than or equal to max_year")
    return lo, hi


def period_label(year: Column, min_year: int | None, max_year: int | None) -> Column:
    """Label of the period a record falls into.

    Both bounds: one period per year, labelled by the year.  One bound: a single
    open period ``-Y`` or ``Y-``.  No bound: one period with a NULL label.
    """
    lo, hi = check_year_range(min_year, max_year)
    if lo is not None and hi is not None:
        return year.cast("string")
    if hi is not None:
        return F.lit(f"-{hi}")
    if lo is not None:
        return F.lit(f"{lo}-")
    return F.lit(None).cast("string")


def year_periods(bounds: DataFrame, min_col: str = "min_year", max_col: str = "max_year") -> DataFrame:
    """One row per period for each (min, max) row: per year when both bounds exist.

    Adds ``since``, ``until`` and ``label``.  The explode is bounded by the
    width of the year range of each row.
    """
    lo, hi = F.col(min_col), F.col(max_col)
    both = lo.isNotNull() & hi.isNotNull()
    per_year = F.when(both, F.sequence(lo, hi)).otherwise(F.array(F.lit(None).cast("int")))
    exploded = bounds.withColumn("_y", F.explode(per_year))
    return exploded.select(
        *bounds.columns,
        F.when(both, F.col("_y")).otherwise(lo).alias("since"),
        F.when(both, F.col("_y")).otherwise(hi).alias("until"),
        F.when(both, F.col("_y").cast("string"))
        .when(hi.isNotNull(), F.concat(F.lit("-"), hi.cast("string")))
        .when(lo.isNotNull(), F.concat(lo.cast("string"), F.lit("-")))
        .alias("label"),
    )


def cap_per_group(
    df: DataFrame,
    n: int,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    salt_buckets: int = CAP_SALT_BUCKETS,
) -> DataFrame:
    """At most ``n`` rows per group, the first ones in ``order_cols`` order. Exact.

    The salt is the input's partition, so a task's rows of a group share one
    piece and the group limit that Spark puts before the exchange leaves ``n``
    of them: what is shuffled does not grow with a group.  The first phase ranks
    those pieces, the second the at most ``salt_buckets * n`` survivors of each
    group.  Limits above ``spark.sql.optimizer.windowGroupLimitThreshold`` have
    no limit before the exchange; a hot group is still ranked in pieces.
    Whatever piece a row falls into, the result is the same.  ``order_cols``
    must make the order total.  ``n`` of None or 0 means no cap; a negative one
    is an error.
    """
    if n is not None and n < 0:
        raise ValueError("a cap cannot be negative")
    if not n:
        return df
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    salt = F.pmod(F.spark_partition_id(), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    phase1 = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n)
    return phase1.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= n).drop("_salt", "_rn")


def cap_per_year(
    df: DataFrame, n: int | None, year_col: str = "year", order_cols: Sequence[str] = ("priority", "seq"),
    by: Sequence[str] = (),
) -> DataFrame:
    """At most ``n`` records per year (and per ``by`` columns, e.g. the engine)."""
    if n is None:
        return df
    return cap_per_group(df, n, [*by, year_col], order_cols)


def text_match(cols: Sequence[str], text: str) -> Column:
    """Every whitespace-separated term of ``text`` occurs (case-free) in the given fields."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    cond = F.lit(True)
    for term in text.lower().split():
        cond = cond & (F.instr(hay, term) > 0)
    return cond


def search_papers(
    records: DataFrame,
    text: str,
    min_year: int | None = None,
    max_year: int | None = None,
    max_per_year: int | None = None,
    sources: str | Sequence[str] | None = None,
    fields: Sequence[str] = ("title", "abstract"),
    order_cols: Sequence[str] = ("priority", "seq"),
) -> DataFrame:
    """Records of the chosen engines matching all terms inside the year range.

    Only valid records (doi, title, first author) count; the cap applies per
    engine and period (per year when both bounds are given, else one period).
    Adds ``period`` and ``query``.
    """
    lo, hi = check_year_range(min_year, max_year)
    engines = parse_engines(sources)
    cond = F.col("source").isin(engines) & text_match(fields, text)
    if lo is not None:
        cond = cond & (F.col("year") >= lo)
    if hi is not None:
        cond = cond & (F.col("year") <= hi)
    hits = valid_records(records.where(cond)).withColumn("period", period_label(F.col("year"), lo, hi))
    if max_per_year:
        hits = cap_per_group(hits.withColumn("_p", F.coalesce("period", F.lit(""))), max_per_year, ["source", "_p"], order_cols).drop("_p")
    return hits.withColumn("query", F.lit(text))


def search_scan(
    frames: Mapping[str, DataFrame],
    query: str,
    known: DataFrame | None = None,
    known_key: str = "pmid",
    earlier: DataFrame | None = None,
) -> DataFrame:
    """One scan in one call: engines stacked in the given order, records of the last engine whose
    ``known_key`` is known already left out, duplicates merged, the query noted, and all that merged
    into the records of earlier scans."""
    names = list(frames)
    found = [frames[n] for n in names]
    if known is not None:
        found[-1] = exclude_keys(found[-1], known, known_key)
    stacked = union_sources(found).withColumn("query", F.lit(query))
    if earlier is None:
        return merge_duplicates(stacked)
    return append_results(earlier.withColumn("query", F.lit(None).cast("string")) if "query" not in earlier.columns else earlier, stacked)


def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key another source already gave (anti join)."""
    return df.join(keys.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def filter_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in a list (semi join; the list may be any size)."""
    return df.join(keys.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def missing_dois(papers: DataFrame, known: DataFrame, key: str = "doi", seed: int | None = None) -> DataFrame:
    """Work list: distinct DOIs not yet present; optionally in a seeded random order
    (by a hash of DOI and seed, so it does not depend on the partitions)."""
    todo = exclude_keys(papers.select(key).where(F.col(key).isNotNull()).distinct(), known, key)
    if seed is not None:
        todo = todo.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return todo
