"""The XML corpus: one ``<paper>`` element per exported paper.

Written and read with Spark's XML data source (``rowTag = paper``).  Root
attributes carry DOI, title, path and the library key; the element holds the
whole paper: abstract, classified sections with their refs, references,
figures, tables with cells, formulas, and ``text_segments`` with one ``<segments
type=..>`` element per segment.  Explicit schemas everywhere: inference would
read a section number ``1.`` as the double 1.0.

A corpus that exports keep up to date grows by generations (``generations``):
each export is a sub-folder that becomes visible when it has been written.
Papers written over others stand in a generation that says so, and readers take
each of its keys from there.  Nothing is rewritten or deleted, so an export that
dies leaves the corpus as it was.  XML files that stand directly in the folder
(one per paper or many per file), or in the bucket folders of earlier versions,
are read as what came before the first generation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.segments import SEGMENT_TYPES, segment_column
from scriptorium.sources import generations

ROW_TAG = "paper"
ROOT_TAG = "papers"
ATTRS = ("DOI", "title", "path", "zoteroID")
REFS = ("publication_refs", "figure_refs", "table_refs")
SECTION_XML = "struct<_heading:string, _num:string, _type:string, text:string, " + ", ".join(f"{c}:array<string>" for c in REFS) + ">"
PARTS_XML = (
    f"title string, abstract string, sections struct<section:array<{SECTION_XML}>>, "
    "references struct<reference:array<string>>, "
    "figures struct<figure:array<struct<_label:string, _caption:string, _type:string, _figure_id:string>>>, "
    "tables struct<table:array<struct<_label:string, _caption:string, _figure_id:string, "
    "data:struct<row:array<struct<cell:array<string>>>>>>>, "
    "formulas struct<formula:array<string>>"
)
CORPUS_SCHEMA = (
    "_DOI string, _title string, _path string, _zoteroID string, "
    f"{PARTS_XML}, text_segments struct<segments:array<struct<_type:string, _VALUE:string>>>"
)
PAPER_XML_SCHEMA = f"_item_key string, {PARTS_XML}"
# Files outside of generations: directly in the folder, or in folders of a hash of the key.
LOOSE = {False: ("*.xml*", r"[^_.].*\.xml"), True: ("bucket=*/*.xml*", r"bucket=")}
GENERATION = "_generation"


def _texts(c: str):
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _sections_xml(sections, section_type) -> F.Column:
    return F.struct(
        F.transform(
            sections,
            lambda s: F.struct(
                s["heading"].alias("_heading"), s["num"].alias("_num"), section_type(s).alias("_type"), s["text"].alias("text"),
                *[s[c].alias(c) for c in REFS],
            ),
        ).alias("section")
    ).alias("sections")


def _other_parts_xml() -> list[F.Column]:
    """References, figures, tables with their cells, and formulas of shredded papers."""
    figures = F.transform(
        "figures", lambda f: F.struct(f["label"].alias("_label"), f["caption"].alias("_caption"), f["type"].alias("_type"), f["figure_id"].alias("_figure_id"))
    )
    tables = F.transform(
        "tables",
        lambda t: F.struct(
            t["label"].alias("_label"), t["caption"].alias("_caption"), t["figure_id"].alias("_figure_id"),
            F.struct(F.transform(t["cells"], lambda r: F.struct(r.alias("cell"))).alias("row")).alias("data"),
        ),
    )
    return [
        F.struct(_texts("references").alias("reference")).alias("references"),
        F.struct(figures.alias("figure")).alias("figures"),
        F.struct(tables.alias("table")).alias("tables"),
        F.struct(_texts("formulas").alias("formula")).alias("formulas"),
    ]


def paper_xml_rows(shredded: DataFrame) -> DataFrame:
    """Shredded papers (see ``tei.SHREDDED_SCHEMA``) as nested rows for ``<paper>`` XML."""
    return shredded.select(
        F.col("item_key").cast("string").alias("_item_key"), "title", "abstract",
        _sections_xml(F.col("sections"), lambda s: F.lit(None).cast("string")), *_other_parts_xml(),
    )


def papers_from_xml(rows: DataFrame) -> DataFrame:
    """``<paper>`` rows (corpus or single papers) back as shredded papers, sections with their type.

    XML does not tell an empty text from a missing one: both come back as "".
    """

    def text(c) -> F.Column:
        return F.coalesce(c, F.lit(""))

    def numbered(items: str, fields) -> F.Column:
        held = F.filter(F.coalesce(F.col(items), F.array()), lambda x: x.isNotNull())
        return F.transform(held, lambda x, pos: F.struct(pos.alias("pos"), *fields(x)))

    def strings(c) -> F.Column:
        return F.coalesce(c, F.array().cast("array<string>"))

    sections = numbered("sections.section", lambda s: [
        text(s["_heading"]).alias("heading"), text(s["_num"]).alias("num"), text(s["_type"]).alias("type"), text(s["text"]).alias("text"),
        *[strings(s[c]).alias(c) for c in REFS],
    ])
    figures = numbered("figures.figure", lambda f: [
        text(f["_label"]).alias("label"), text(f["_caption"]).alias("caption"), text(f["_type"]).alias("type"), text(f["_figure_id"]).alias("figure_id"),
    ])
    tables = numbered("tables.table", lambda t: [
        text(t["_label"]).alias("label"), text(t["_caption"]).alias("caption"), text(t["_figure_id"]).alias("figure_id"),
        F.transform(F.coalesce(t["data"]["row"], F.array()), lambda r: F.transform(strings(r["cell"]), text)).alias("cells"),
    ])
    key = "_item_key" if "_item_key" in rows.columns else "_zoteroID"
    return rows.select(
        F.col(key).alias("item_key"), text(F.col("title")).alias("title"), text(F.col("abstract")).alias("abstract"),
        sections.alias("sections"), tables.alias("tables"), figures.alias("figures"),
        F.transform(strings(F.col("references.reference")), text).alias("references"),
        F.transform(strings(F.col("formulas.formula")), text).alias("formulas"),
    )


def read_paper_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", ROW_TAG).schema(PAPER_XML_SCHEMA).load(path)


def paper_rows(meta: DataFrame, shredded: DataFrame, classified: DataFrame, segments: DataFrame) -> DataFrame:
    """Assemble corpus rows.

    ``meta``: item_key, zoteroID, doi, title, path (library side);
    ``shredded``: papers as ``tei.shred_tei`` gives them; ``classified``: merged
    sections; ``segments``: wide text segments (one column per segment type).
    """
    fields = ("sec_idx", "heading", "num", "type", "text", *REFS)
    secs = classified.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
    seg = F.array(*[F.struct(F.lit(t).alias("_type"), F.col(segment_column(t)).alias("_VALUE")) for t in SEGMENT_TYPES])
    parts = shredded.select("item_key", F.col("title").alias("_ptitle"), "abstract", *_other_parts_xml())
    j = meta.join(parts, "item_key").join(secs, "item_key", "left").join(segments, "item_key", "left")
    return j.select(
        F.col("doi").alias("_DOI"),
        F.col("title").alias("_title"),
        F.col("path").alias("_path"),
        F.col("zoteroID").alias("_zoteroID"),
        F.coalesce("_ptitle", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        _sections_xml(F.coalesce(F.col("_s"), F.array()), lambda s: s["type"]),
        "references", "figures", "tables", "formulas",
        F.struct(seg.alias("segments")).alias("text_segments"),
    )


def write_corpus(papers: DataFrame, path: str, mode: str = "append") -> None:
    """Write corpus rows (see ``CORPUS_SCHEMA``) as XML part files below ``path``.

    A paper holds its text as sections, segments and captions, so the files are compressed.
    """
    papers.write.format("xml").options(rowTag=ROW_TAG, rootTag=ROOT_TAG, compression="gzip").mode(mode).save(path)


def add_papers(papers: DataFrame, path: str) -> None:
    """Append papers whose keys the corpus does not have yet."""
    generations.add(papers.sparkSession, path, lambda folder: write_corpus(papers, folder))


def replace_papers(papers: DataFrame, path: str) -> None:
    """Write papers over those of the same key; other papers stay as they are."""
    generations.add(papers.sparkSession, path, lambda folder: write_corpus(papers, folder), {"replaces": True})


def _key() -> F.Column:
    return F.coalesce(F.col("_zoteroID"), F.regexp_replace(F.col("_file"), r"\.xml(\.gz)?$", ""))


def _read_xml(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    number = F.regexp_extract(F.col("_metadata.file_path"), f"/{generations.PREFIX}(\\d+)/[^/]*$", 1)
    return (
        spark.read.format("xml").option("rowTag", ROW_TAG).schema(schema).load(paths)
        .withColumns({"_file": F.col("_metadata.file_name"), GENERATION: F.coalesce(number.try_cast("int"), F.lit(0))})
    )


def _visible(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The corpus rows that count, with file name and generation; None where nothing has been written."""
    root = path.rstrip("/")
    if not generations.is_folder(spark, root):  # a file or a pattern
        return _read_xml(spark, [path], schema) if any(c in path for c in "*?[{") or root.endswith(".xml") else None
    standing = generations.entries(spark, root)
    paths = [f"{root}/{glob}" for folder, (glob, name) in LOOSE.items() if any(f == folder and re.match(name, n) for n, f in standing)]
    found = generations.live(spark, root)
    paths += [g.path for g in found]
    if not paths:
        return None
    rows = _read_xml(spark, paths, schema)
    replacing = [g.path for g in found if g.note.get("replaces")]
    if not replacing:
        return rows
    newest = _read_xml(spark, replacing, "_zoteroID string").groupBy(_key().alias("_newest_key")).agg(F.max(GENERATION).alias("_newest"))
    joined = rows.join(newest, _key() == F.col("_newest_key"), "left")
    return joined.where(F.col("_newest").isNull() | (F.col(GENERATION) >= F.col("_newest"))).drop("_newest_key", "_newest")


def read_corpus_raw(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a corpus folder as ``CORPUS_SCHEMA``, with the name of their file."""
    rows = _visible(spark, path, CORPUS_SCHEMA)
    if rows is None:
        raise FileNotFoundError(f"no corpus at {path}")
    return rows.drop(GENERATION)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per paper: key, root attributes, abstract, one column per segment type.

    The key is the ``zoteroID`` attribute, else the file stem.  A segment that
    is absent or empty reads as ``""``.
    """
    raw = read_corpus_raw(spark, path)
    seg_map = F.map_from_entries(
        F.transform(
            F.coalesce(F.col("text_segments.segments"), F.array()),
            lambda s: F.struct(s["_type"], F.coalesce(s["_VALUE"], F.lit(""))),
        )
    )
    cols = [
        _key().alias("item_key"),
        F.col("_DOI").alias("doi"),
        F.col("_title").alias("title"),
        F.col("_path").alias("path"),
        F.coalesce(F.col("abstract"), F.lit("")).alias("abstract"),
    ]
    cols += [F.coalesce(F.element_at(seg_map, F.lit(t)), F.lit("")).alias(segment_column(t)) for t in SEGMENT_TYPES]
    return raw.select(*cols)


def exported_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys already present below ``path`` (None when nothing was written yet).

    Only the key attribute is asked of the reader; texts are skipped over.
    """
    rows = _visible(spark, path, "_zoteroID string")
    return None if rows is None else rows.select(_key().alias("item_key"))
