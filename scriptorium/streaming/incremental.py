"""Structured Streaming forms of the incremental jobs.

* ``stream_corpus``: new corpus XML files only (file source + checkpoint),
  projected like the batch reader and appended to a Parquet table.
* ``stream_append_results``: every micro-batch of landed records becomes a
  generation of the accumulated results (old values win).  A batch writes its
  own records and nothing else; ``read_results`` merges the generations.  As
  they become many, the newest ones of similar size are merged into one, so
  each record is rewritten a logarithmic number of times.
* ``stream_term_counts``: per micro-batch the sums and counts behind the yearly
  term frequencies; ``read_term_frequency`` adds them up.

All are meant to run with ``trigger(availableNow=True)`` after new files land;
the checkpoint makes a rerun skip files already processed.  A generation notes
the (checkpoint, epoch) it holds, so a replayed epoch is left out, another
checkpoint goes on from the results as they are, and an epoch that died while
it was written is invisible and written anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType

from scriptorium.operators import lexical
from scriptorium.operators.merge import MULTI_SEPARATOR, MULTI_SPLIT, join_multi, merge_duplicates
from scriptorium.operators.segments import SEGMENT_TYPES, segment_column
from scriptorium.sources import corpus, generations
from scriptorium.sources.generations import Generation

ORDER = ("priority", "seq")
SETS = ("source",)
# So many generations of similar size are merged into one.
MERGE_AT = 8


def corpus_stream(spark: SparkSession, src_path: str) -> DataFrame:
    """Streaming read of corpus XML files with the batch reader's projection."""
    raw = (
        spark.readStream.format("xml").option("rowTag", corpus.ROW_TAG).schema(corpus.CORPUS_SCHEMA).load(src_path)
        .withColumn("_file", F.col("_metadata.file_name"))
    )
    seg_map = F.map_from_entries(
        F.transform(F.coalesce(F.col("text_segments.segments"), F.array()), lambda s: F.struct(s["_type"], F.coalesce(s["_VALUE"], F.lit(""))))
    )
    cols = [
        F.coalesce(F.col("_zoteroID"), F.regexp_replace(F.col("_file"), r"\.xml(\.gz)?$", "")).alias("item_key"),
        F.col("_DOI").alias("doi"),
        F.col("_title").alias("title"),
        F.col("_path").alias("path"),
        F.coalesce(F.col("abstract"), F.lit("")).alias("abstract"),
    ]
    cols += [F.coalesce(F.element_at(seg_map, F.lit(t)), F.lit("")).alias(segment_column(t)) for t in SEGMENT_TYPES]
    return raw.select(*cols)


def stream_corpus(spark: SparkSession, src_path: str, sink_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """New corpus files -> Parquet table at ``sink_path``."""
    table = corpus_stream(spark, src_path).writeStream.format("parquet").option("compression", "zstd")
    writer = table.option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink_path)


def _results(out_root: str) -> str:
    return f"{out_root.rstrip('/')}/results"


def _position(g: Generation) -> int:
    """Place in the order of arrival: merged generations stand where the first of theirs stood."""
    return g.note.get("position", g.number)


def _in_order(spark: SparkSession, root: str) -> list[Generation]:
    return sorted(generations.live(spark, root), key=_position)


def _last_epochs(found: Sequence[Generation]) -> dict[str, int]:
    """The last epoch of each checkpoint that the generations hold."""
    last: dict[str, int] = {}
    for g in found:
        for checkpoint, epoch in g.note.get("epochs", {}).items():
            last[checkpoint] = max(epoch, last.get(checkpoint, epoch))
    return last


def _add_epoch(batch: DataFrame, epoch: int, root: str, checkpoint: str, **note: Any) -> bool:
    """Write a micro-batch as a generation, once per (checkpoint, epoch); False where it is there already."""
    spark = batch.sparkSession
    if _last_epochs(generations.live(spark, root)).get(checkpoint, -1) >= epoch:
        return False

    def told(path: str) -> dict[str, Any]:
        return {"epochs": {checkpoint: epoch}, "rows": spark.read.parquet(path).count(), **note}

    generations.add(spark, root, lambda path: batch.write.mode("append").parquet(path), told)
    return True


def _similar(found: Sequence[Generation]) -> list[Generation]:
    """The newest generations, back to the first one that is larger than all after it together."""
    taken: list[Generation] = []
    rows = 0
    for g in reversed(found):
        if taken and g.note["rows"] > 2 * rows:
            break
        taken.insert(0, g)
        rows += g.note["rows"]
    return taken


def _replace(spark: SparkSession, root: str, taken: Sequence[Generation], merged: DataFrame, **note: Any) -> None:
    """Let ``merged`` stand in for the generations ``taken``; what earlier merges covered is deleted."""
    generations.drop_covered(spark, root)

    def told(path: str) -> dict[str, Any]:
        return {
            "epochs": _last_epochs(taken), "covers": [g.number for g in taken], "position": _position(taken[0]), "merged": True,
            "rows": spark.read.parquet(path).count(), **note,
        }

    generations.add(spark, root, lambda path: merged.write.mode("append").parquet(path), told)


def _stacked(spark: SparkSession, found: Sequence[Generation]) -> DataFrame:
    frames = [spark.read.parquet(g.path).withColumn("_arrival", F.lit(_position(g))) for g in found]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _merged(spark: SparkSession, found: Sequence[Generation], key: str, order_cols: Sequence[str]) -> DataFrame:
    return merge_duplicates(_stacked(spark, found), key, ("_arrival", *order_cols), SETS)


def read_results(spark: SparkSession, out_root: str, key: str = "doi", order_cols: Sequence[str] = ORDER) -> DataFrame:
    """The accumulated results: the first load as it is; after that one row per key, sets as arrays."""
    found = _in_order(spark, _results(out_root))
    if not found:
        raise FileNotFoundError(f"no results below {out_root}")
    if len(found) > 1:
        return _merged(spark, found, key, order_cols)
    rows = spark.read.parquet(found[0].path)
    if not found[0].note.get("merged"):
        return rows
    split = {c: F.when(F.col(c) != "", F.split(c, MULTI_SPLIT)).otherwise(F.array().cast("array<string>")) for c in SETS if c in rows.columns}
    return rows.withColumns(split)


def merge_epoch(
    batch: DataFrame, epoch: int, out_root: str, checkpoint: str, order_cols: Sequence[str] = ORDER, key: str = "doi",
    merge_at: int = MERGE_AT,
) -> None:
    """Add one micro-batch to the results below ``out_root``, once per (checkpoint, epoch).

    The batch becomes visible as a whole when it has been written.  Whenever
    ``merge_at`` generations of similar size have gathered, they are merged.
    """
    spark, root = batch.sparkSession, _results(out_root)
    batch = batch.withColumns({f.name: F.array_join(f.name, MULTI_SEPARATOR) for f in batch.schema if f.name in SETS and isinstance(f.dataType, ArrayType)})
    if _add_epoch(batch, epoch, root, checkpoint):
        taken = _similar(_in_order(spark, root))
        if len(taken) >= merge_at:
            _replace(spark, root, taken, join_multi(_merged(spark, taken, key, order_cols), SETS))


def compact_results(spark: SparkSession, out_root: str, key: str = "doi", order_cols: Sequence[str] = ORDER) -> None:
    """Merge all generations into one (a first load alone stays as it is)."""
    root = _results(out_root)
    found = _in_order(spark, root)
    if len(found) > 1:
        _replace(spark, root, found, join_multi(_merged(spark, found, key, order_cols), SETS))


def stream_append_results(
    spark: SparkSession, src_path: str, schema: str, out_root: str, checkpoint: str, fmt: str = "json", available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Landed records (``fmt`` files with ``schema``) added batch by batch to the results."""
    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(src_path)
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: merge_epoch(batch, epoch, out_root, checkpoint))
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def add_term_counts(
    batch: DataFrame, epoch: int, out_root: str, checkpoint: str, words: Sequence[str] = (), labelled: Mapping[str, str] | None = None,
    column: str = "abstract", year_col: str = "year", merge_at: int = MERGE_AT,
) -> None:
    """Add one micro-batch of papers to the term counts, once per (checkpoint, epoch): a row per year, whatever the batch's size."""
    spark = batch.sparkSession
    asked = {"words": list(words), "labelled": dict(labelled or {})}
    for g in generations.live(spark, out_root):
        if {k: g.note[k] for k in asked} != asked:
            raise ValueError(f"{out_root} holds counts of other words")
    hits = lexical.term_hits(batch, words, column, year_col, labelled)
    if _add_epoch(hits, epoch, out_root, checkpoint, **asked):
        found = _in_order(spark, out_root)
        if len(found) >= merge_at:
            _replace(spark, out_root, found, lexical.add_hits(_stacked(spark, found)), **asked)


def read_term_frequency(spark: SparkSession, out_root: str) -> DataFrame:
    """The yearly term frequencies of all papers counted so far (see ``lexical.term_frequency``)."""
    found = _in_order(spark, out_root)
    if not found:
        raise FileNotFoundError(f"no term counts below {out_root}")
    hits = lexical.add_hits(_stacked(spark, found).drop("_arrival"))
    return lexical.frequency_of_hits(hits, found[0].note["words"], found[0].note["labelled"])


def stream_term_counts(
    spark: SparkSession, papers: DataFrame, out_root: str, checkpoint: str, words: Sequence[str] = (),
    labelled: Mapping[str, str] | None = None, column: str = "abstract", year_col: str = "year", available_now: bool = True,
) -> StreamingQuery:
    """Term counts of a stream of papers, kept up to date batch by batch."""
    writer = papers.writeStream.foreachBatch(
        lambda batch, epoch: add_term_counts(batch, epoch, out_root, checkpoint, words, labelled, column, year_col)
    ).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
