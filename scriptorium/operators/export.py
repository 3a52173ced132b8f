"""Incremental parse-and-export of library papers into the XML corpus.

PDF attachments of the library (preferring PDF, existing files only,
optionally a DOI list) whose key is not yet in the output are joined with
their TEI text, shredded, classified, reduced to text segments and written to
the corpus.  Already exported keys are skipped with an anti join (or replaced,
with ``overwrite``); papers without TEI, or with TEI that cannot be parsed, are
reported as failed, stay out of the corpus, and are tried again by the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import library as libops
from scriptorium.operators import sections as secops
from scriptorium.operators import segments as segops
from scriptorium.session import checkpoint_root
from scriptorium.sources import corpus, tei
from scriptorium.sources.library import Library


def export_candidates(
    lib: Library, root: str, listing: DataFrame, filter_dois: DataFrame | None = None, library: str | None = "",
    collection: str | None = None,
) -> DataFrame:
    """PDF attachments with an existing file: ``zoteroID, title, doi, path``."""
    df = libops.list_local_path(lib, root, prefer="pdf", check_exists=True, listing=listing, library=library, collection=collection)
    df = df.where(F.col("content_type") == "pdf")
    if filter_dois is not None:
        df = df.join(filter_dois.select("doi").where(F.col("doi").isNotNull()).distinct(), "doi", "left_semi")
    return df


def first_per_item(cand: DataFrame) -> DataFrame:
    """The first PDF (smallest path) of each item; its further PDFs are reported as ``other_file``.

    A map-side-combined ``min_by`` aggregate, so an item with very many
    attachments costs one partial row per map task.
    """
    picked = cand.groupBy("zoteroID").agg(F.min_by(F.struct("title", "doi", "path"), F.col("path")).alias("_r"))
    return picked.select("zoteroID", "_r.title", "_r.doi", "_r.path")


STATUSES = ("exported", "failed", "skipped", "other_file")


def export_parsed(
    spark: SparkSession,
    lib: Library,
    tei_by_path: DataFrame,
    out_path: str,
    root: str,
    listing: DataFrame,
    filter_dois: DataFrame | None = None,
    overwrite: bool = False,
    library: str | None = "",
    collection: str | None = None,
) -> DataFrame:
    """Export papers; returns the report ``status, n`` with one row per status:

    exported; failed (no TEI, or TEI that does not parse); skipped (already in
    the corpus); other_file (an item's PDFs beyond its first).
    ``tei_by_path``: ``path, content``, one row per PDF (empty content gives an
    empty paper).  With ``overwrite`` papers already present are exported again
    and replaced.
    """
    checkpoint_root(spark)
    cand = export_candidates(lib, root, listing, filter_dois, library, collection).checkpoint()
    firsts = first_per_item(cand)
    done = corpus.exported_keys(spark, out_path)
    todo = firsts
    if done is not None and not overwrite:
        todo = firsts.join(done.select(F.col("item_key").alias("zoteroID")), "zoteroID", "left_anti")
    todo = todo.checkpoint()
    content = todo.join(tei_by_path.select("path", "content"), "path").select(F.col("zoteroID").alias("item_key"), "content")
    shredded = tei.shred_tei(content.where(F.col("content").isNotNull())).where(F.col("error").isNull()).checkpoint()
    counts = {"exported": shredded.count()}
    n_todo, n_firsts = todo.count(), firsts.count()
    if counts["exported"]:
        classified = secops.classify_sections(tei.tei_sections(shredded))
        segs = segops.text_segments(shredded.select("item_key"), classified, tei.tei_tables(shredded), tei.tei_figures(shredded))
        meta = todo.select(F.col("zoteroID").alias("item_key"), "zoteroID", "doi", "title", "path")
        rows = corpus.paper_rows(meta, shredded, classified, segs)
        (corpus.add_papers if done is None or not overwrite else corpus.replace_papers)(rows, out_path)
    counts |= {"failed": n_todo - counts["exported"], "skipped": n_firsts - n_todo, "other_file": cand.count() - n_firsts}
    return spark.createDataFrame([(s, counts[s]) for s in STATUSES], "status string, n long")
