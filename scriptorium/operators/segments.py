"""Text segments of papers: section texts by class, table captions and headings,
figure captions.

Section texts are reduced per paper where they already live (the section
pipeline leaves them hash-partitioned by paper), and the small per-paper
table and figure aggregates are joined to them, so the text is never shuffled
a second time.  Papers without children still get a row (empty segments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.sections import KEY, SECTION_TYPES

# Names of the non-section segments.
TABLE_CAPTIONS = "table_captions"
TABLE_HEADINGS = "table_headings"
FIGURE_CAPTIONS = "figure_captions"
SEGMENT_TYPES = (*SECTION_TYPES, TABLE_CAPTIONS, TABLE_HEADINGS, FIGURE_CAPTIONS)


def segment_column(name: str) -> str:
    """Column name of a segment (``related work`` -> ``related_work``)."""
    return name.replace(" ", "_")


def is_numeric_cell(h: Column) -> Column:
    """Digits only once dots are removed (``0.8`` is numeric, ``.`` is not)."""
    return F.regexp_replace(h, r"[.]", "").rlike(r"^\p{N}+$")


def _heading_cell(h: Column) -> Column:
    return h.isNotNull() & (h != "") & ~is_numeric_cell(h)


def table_headings(cells: Column) -> Column:
    """``col ; col | row ; row`` from the first column and the first row of a table.

    Empty and numeric cells are skipped; when both parts exist the corner cell
    is dropped from the row part.  A table without cells gives ``""``.
    """
    first_col = F.transform(cells, lambda r: F.try_element_at(r, F.lit(1)))
    first_row = F.coalesce(F.try_element_at(cells, F.lit(1)), F.array().cast("array<string>"))
    col = F.filter(first_col, _heading_cell)
    row = F.filter(first_row, _heading_cell)
    col_part = F.array_join(col, " ; ")
    both = F.concat(col_part, F.lit(" | "), F.array_join(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), " ; "))
    return (
        F.when(F.size(col) > 0, F.when(F.size(row) > 0, both).otherwise(col_part))
        .otherwise(F.array_join(row, " ; "))
    )


def table_heading_lists(cells: Column) -> Column:
    """(column headings, row headings) as a struct of two arrays (empty when absent)."""
    first_col = F.transform(cells, lambda r: F.try_element_at(r, F.lit(1)))
    first_row = F.coalesce(F.try_element_at(cells, F.lit(1)), F.array().cast("array<string>"))
    keep = lambda h: h.isNotNull() & ~is_numeric_cell(h)
    return F.struct(F.filter(first_col, keep).alias("col_headings"), F.filter(first_row, keep).alias("row_headings"))


def _ordered_join(items: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), sep)


def _collect(cond: Column, pos: str, text: Column) -> Column:
    return F.collect_list(F.when(cond, F.struct(F.col(pos).cast("int").alias("p"), text.alias("v"))))


def text_segments(papers: DataFrame, sections: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """One row per paper: the 5 section classes, table captions/headings, figure captions.

    ``papers`` needs ``item_key``; ``sections`` ``item_key, sec_idx, text, type``;
    ``tables`` ``item_key, pos, caption, cells``; ``figures`` ``item_key, pos, caption``.

    Sections (the bulk of the text) are reduced per paper where they are: when
    they come from ``classify_sections`` they are already hash-partitioned by
    paper, so this aggregate adds no shuffle.  The small per-paper table and
    figure aggregates and the paper keys are joined to it, so only they move.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    typ = F.coalesce(F.col("type"), F.lit(""))
    sec = sections.groupBy(KEY).agg(
        *[tx.strip(_ordered_join(_collect(typ == k, "sec_idx", t))).alias(segment_column(k)) for k in SECTION_TYPES]
    )
    heads = table_headings(F.col("cells"))
    tab = tables.groupBy(KEY).agg(
        _ordered_join(_collect(F.lit(True), "pos", F.coalesce(F.col("caption"), F.lit("")))).alias(TABLE_CAPTIONS),
        _ordered_join(_collect(heads != "", "pos", heads)).alias(TABLE_HEADINGS),
    )
    fig = figures.groupBy(KEY).agg(
        _ordered_join(_collect(F.lit(True), "pos", F.coalesce(F.col("caption"), F.lit("")))).alias(FIGURE_CAPTIONS)
    )
    out = sec.join(papers.select(KEY).distinct(), KEY, "right").join(tab, KEY, "left").join(fig, KEY, "left")
    return out.select(KEY, *[F.coalesce(F.col(segment_column(k)), F.lit("")).alias(segment_column(k)) for k in SEGMENT_TYPES])


def segments_long(segments: DataFrame) -> DataFrame:
    """Wide segments -> ``item_key, type, text`` (the on-disk ``segments`` list)."""
    cols = [segment_column(t) for t in SEGMENT_TYPES]
    long = segments.select(KEY, *cols).unpivot(KEY, cols, "_col", "text")
    names = F.create_map(*[x for t in SEGMENT_TYPES for x in (F.lit(segment_column(t)), F.lit(t))])
    return long.select(KEY, F.element_at(names, F.col("_col")).alias("type"), "text")
