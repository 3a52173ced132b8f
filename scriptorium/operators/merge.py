"""Union of record sources and merge of duplicate records by DOI.

A merge is one aggregate keyed by DOI: every column takes its first
non-null value in arrival order (``min_by`` over an explicit order key, never
``first``), and the multi-value ``source`` column becomes the union of its
``|``-separated sets.  Both aggregates combine map-side, so a DOI held by a
third of all rows still sends one partial row per map task to the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The canonical record columns (output order) and the
# multi-value fields, stored as arrays inside and joined by "|" at the edges.
RECORD_COLUMNS = (
    "doi",
    "title",
    "first_author",
    "authors",
    "publication",
    "publication_type",
    "year",
    "date",
    "affiliation",
    "affiliation_country",
    "keywords",
    "abstract",
    "pmid",
    "scopus_id",
    "citations_count",
    "issn",
    "source",
    "query",
)
MULTI_SEPARATOR = "|"
MULTI_SPLIT = "[|]"
DEFAULT_SOURCE = "external"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``""`` -> NULL on string columns (so an early blank never shadows a later value)."""
    cols = set(cols if cols is not None else string_columns(df))
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in cols else F.col(c) for c in df.columns])


def null_to_blank(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL -> ``""`` on string columns; used only at the output edge."""
    cols = list(cols if cols is not None else string_columns(df))
    return df.fillna("", subset=cols) if cols else df


def tag_source(df: DataFrame, source: str | None = None, query: str | None = None) -> DataFrame:
    """Constant ``source`` (default ``external``) and ``query`` (default ``""``) columns."""
    return df.withColumn("source", F.lit(source or DEFAULT_SOURCE)).withColumn("query", F.lit(query or ""))


def cast_year(df: DataFrame, col: str = "year") -> DataFrame:
    """Year to int; text that is not a number gives NULL instead of failing."""
    return df.withColumn(col, F.col(col).cast("string").try_cast("int"))


def valid_records(df: DataFrame, required: Sequence[str] = ("doi", "title", "first_author")) -> DataFrame:
    """Keep records having every required field (non-null, non-blank)."""
    cond = None
    for c in required:
        ok = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        cond = ok if cond is None else cond & ok
    return df.where(cond)


def union_sources(frames: Sequence[DataFrame], priority_col: str = "priority") -> DataFrame:
    """Stack sources in the given (arrival) order; column sets may differ.

    Each frame gets its list position as arrival priority unless it already
    carries one, so the merge can tell which source came first.
    """
    out = None
    for i, df in enumerate(frames):
        if priority_col not in df.columns:
            df = df.withColumn(priority_col, F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source to union")
    return out


def union_sets(col: Column) -> Column:
    """Set union of ``|``-separated values gathered in a group (sorted, distinct).

    ``collect_set`` on the raw strings deduplicates map-side; the number of
    distinct source strings is bounded by the number of engines.
    """
    parts = F.transform(F.collect_set(col), lambda s: F.split(s, MULTI_SPLIT))
    return F.array_sort(F.array_distinct(F.flatten(parts)))


def merge_duplicates(
    df: DataFrame,
    key: str = "doi",
    order_cols: Sequence[str] = ("priority", "seq"),
    set_cols: Sequence[str] = ("source",),
    keep_order_cols: bool = False,
) -> DataFrame:
    """Group by DOI; first non-null value per column in arrival order.

    Blanks count as missing.  Rows without a DOI vanish (as in a group-by).
    ``set_cols`` become sorted arrays of distinct values; join them with
    ``array_join(c, '|')`` at a CSV edge.  A frame without the key is returned
    unchanged.  The output is not sorted; see ``order_results``.
    """
    if key not in df.columns:
        return df
    order_cols = [c for c in order_cols if c in df.columns]
    if not order_cols:
        raise ValueError("merge needs an explicit arrival order column (Spark rows have no order)")
    df = blank_to_null(df)
    ord_key = F.struct(*[F.col(c) for c in order_cols])
    set_cols = [c for c in set_cols if c in df.columns]
    value_cols = [c for c in df.columns if c != key and c not in set_cols and c not in order_cols]
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ord_key)).alias(c) for c in value_cols]
    aggs += [union_sets(F.col(c)).alias(c) for c in set_cols]
    if keep_order_cols:
        aggs += [F.min(ord_key).alias("_first")]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    if keep_order_cols:
        out = out.select(key, *value_cols, *set_cols, *[F.col("_first")[c].alias(c) for c in order_cols])
    return out


def append_results(
    old: DataFrame | None,
    new: DataFrame,
    key: str = "doi",
    order_cols: Sequence[str] = ("priority", "seq"),
    set_cols: Sequence[str] = ("source",),
) -> DataFrame:
    """Merge new records into accumulated ones; old values win.

    The very first load is stored as it is (no dedup).  Later loads are merged
    with the accumulated rows placed first in arrival order.  Callers write the
    result to a new location, never over the one being read.
    """
    if old is None:
        return new
    # merged rows carry set columns as arrays: bring them back to joined strings first
    for c in set_cols:
        if c in old.columns and not isinstance(old.schema[c].dataType, StringType):
            old = old.withColumn(c, F.array_join(c, MULTI_SEPARATOR))
    stacked = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    merged = merge_duplicates(stacked, key, ("_batch", *order_cols), set_cols, keep_order_cols=False)
    return merged.drop("_batch")


def order_results(df: DataFrame, key: str = "doi") -> DataFrame:
    """Records ordered by DOI; meant for the sink only."""
    return df.orderBy(key)


def join_multi(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Array columns -> ``|``-joined strings (CSV edge)."""
    from pyspark.sql.types import ArrayType

    cols = set(cols if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)])
    return df.select(*[F.array_join(F.col(c), MULTI_SEPARATOR).alias(c) if c in cols else F.col(c) for c in df.columns])


def distinct_titles(df: DataFrame, title_col: str = "title", order_cols: Sequence[str] = ("priority", "seq")) -> DataFrame:
    """Keep the first row per title in arrival order.

    ``row_number() = 1`` gets a partial limit of one row per title and map task
    before the shuffle, so a hot title costs one row per task.
    """
    first = F.row_number().over(Window.partitionBy(title_col).orderBy(*order_cols))
    return df.withColumn("_rn", first).where(F.col("_rn") == 1).drop("_rn")
