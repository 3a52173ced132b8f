"""The queries of the operators and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import (
    bpe, codebook, imatch, langid, mixing, pii, quality, runs, secret_scan, simhash, sql, suffix_dedup, topk, warc,
)
from scriptorium.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150% of all words takes of each document."""
    return mixing.words_taken(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, weak candidates linked."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", secret_scan.spans_text()).drop("found")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-byte strings of earlier ones."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, by patterns and by bootstrapped contexts."""
    found = pii.extract(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", pii.spans_text()).drop("found")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return imatch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document (each tenth with a periodic tail) and the text without repeats."""
    found = runs.word_runs(runs.with_periodic_tails(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", runs.longest_run())
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.run_lines(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; texts beyond a centroid's radius are marked, not renamed."""
    return langid.identify(table(spark, sf_dir, "documents"), und_if_rejected=False)


def op13_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector by learned codebooks."""
    return codebook.compress(table(spark, sf_dir, "embeddings")).drop("label")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SQL_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page,
         row_number() OVER (PARTITION BY payload_digest, page_id) AS copy FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR (page_id = first_page AND copy = 1) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR (page_id = first_page AND copy = 1) THEN NULL ELSE first_page END AS refers_to
FROM f
"""

SQL_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_mix_sources, op2_bpe_codec, op3_warc_round_trip, op4_quality_cnn, op5_exact_top_k, op6_secret_scan,
        op7_suffix_dedup, op8_pii_bootstrap, op9_imatch, op10_simhash_components, op11_word_runs,
        op12_nearest_centroid, op13_value_dictionaries, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_round_trip": SQL_WARC, "op5_exact_top_k": SQL_TOP_K,
        "op11_word_runs": sql.RUNS, "op13_value_dictionaries": sql.CODES,
    }
