"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes lower-case letters with single spaces for everything between
them; its n-grams of one to three symbols are hashed into ``BUCKETS`` counts.
A vector is the square root of the counts times the inverse document
frequencies, normalised.  Document frequencies cover every learning row.

Each learned language has up to ``CENTROIDS`` centroids, found by spherical
k-means over at most ``SAMPLE_PER_LANG`` of its different learning texts (those
of the least text hash, so the sample does not depend on the layout, and copies
do not fill it).  The model holds languages x ``CENTROIDS`` x ``BUCKETS`` floats
(64 kB a centroid), so its size depends on the number of languages only.

A text gets the language of the centroid of greatest cosine.  Each language has
a radius: the greatest cosine distance of its sampled texts to the nearest of
its centroids.  A text farther from its nearest centroid than ``REACH`` times
that radius is rejected: the operator says ``und`` for it by default, or keeps
the nearest language and only marks the row (``und_if_rejected=False``, as the
query needs by its contract).  The score is the nearest language's share of a
softmax over the languages' best cosines, lessened by reach / distance for
rejected texts.

Long texts are counted in pieces, so memory is bounded by ``PIECE``, not by the
text (besides the text itself); no part of a text is left out.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and
no distance; rows with a null doc_id or lang are not learned from (a null
doc_id is not held out); ties go to the language first by code point; repeated
rows get a row each; without learning rows every text is ``und``; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches
from scriptorium.session import ship_package

FOLDS = 5
BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
CENTROIDS = 4
SAMPLE_PER_LANG = 600
RANK_PARTS = (4096, 256, 16, 4, 1)
ROUNDS = 12
LEAST_SHARE = 0.05
REACH = 1.2
SHARPNESS = 20.0
PIECE = 1 << 20  # characters counted at a time
TOGETHER = 64  # texts compared with the centroids at a time
UNKNOWN = "und"
SPACE = 32
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, nearest_lang string, distance double, rejected boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(SPACE))


def _hashed(symbols: np.ndarray, size: int) -> np.ndarray:
    count = len(symbols) - size + 1
    code = np.full(count, size, dtype=np.uint32)
    for j in range(size):
        code = (code ^ symbols[j : j + count]) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
    return code >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counts_of(text: str, piece: int = PIECE) -> np.ndarray | None:
    """Counts of the n-grams by bucket, or None for a text without letters."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    carried = np.array([SPACE], dtype=np.uint32)
    any_letter = False
    for at in range(0, len(text), piece):
        new = _symbols(text[at : at + piece])
        if at + piece >= len(text):
            new = np.append(new, np.uint32(SPACE))
        space = new == SPACE
        # one space for each stretch of them; the carried symbol stands before the new ones
        doubled = space & np.concatenate((carried[-1:] == SPACE, space[:-1]))
        any_letter = any_letter or not space.all()
        held = np.concatenate((carried, new[~doubled]))
        for size in GRAMS:
            part = held[max(0, len(carried) - size + 1) :]  # n-grams that end in a new symbol
            if len(part) >= size:
                codes = _hashed(part, size)
                if size == 1:
                    codes = codes[part != SPACE]
                counts += np.bincount(codes, minlength=BUCKETS)
        carried = held[-(max(GRAMS) - 1) :]
    return counts if any_letter else None


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.sqrt(counts).astype(np.float32) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of the rows that may be learned from."""
    known = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    return docs.where(known & ~held_out()).select(F.col("lang").cast("string").alias("lang"), "text")


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS + 1, dtype=np.int64)  # the last one counts the documents
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts = counts_of(text)
            if counts is not None:
                found[:-1] += counts > 0
                found[-1] += 1
    held = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held])], names=["bucket", "n"])


def inverse_frequencies(learning: DataFrame) -> np.ndarray:
    """log(1 + N / (1 + n)) per bucket, over all learning rows; at most BUCKETS + 1 numbers reach the driver."""
    counted = map_batches(learning.select("text"), _count_documents, "bucket int, n long")
    found = np.zeros(BUCKETS + 1, dtype=np.float64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[bucket] = n
    return np.log1p(found[-1] / (1 + found[:-1])).astype(np.float32)


def learning_sample(learning: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(lang, th, text): per language the different texts of least hash.

    Only hashes are ranked, first within small parts of a language, then within
    ever larger ones: a task ranks a 4096th of a language, or 16 x ``per_lang``
    hashes.  Texts are fetched for the chosen ones, one of each; these are
    languages x ``per_lang`` pairs at most, so they are broadcast and no text is
    moved that is not in the sample.
    """
    keyed = learning.withColumn("th", F.xxhash64("text"))
    chosen = keyed.select("lang", "th").distinct()
    for parts in RANK_PARTS:
        ranked = Window.partitionBy("lang", F.pmod("th", F.lit(parts))).orderBy("th")
        chosen = chosen.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= per_lang)
    chosen = F.broadcast(chosen.select("lang", "th"))
    return keyed.join(chosen, ["lang", "th"], "left_semi").groupBy("lang", "th").agg(F.min("text").alias("text"))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(centroids, radius) of normalised rows.

    Starts from the row nearest to the mean, then draws rows by their distance
    to those drawn (seeded).  A centroid of fewer than ``LEAST_SHARE`` of the
    rows goes: a few odd texts are no kind of their language.
    """

    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    rng = np.random.default_rng(11)
    start = [int(np.argmax(vectors @ unit(vectors.mean(0))))]
    far = np.maximum(0, 1 - vectors @ vectors[start[0]].astype(np.float64))
    while len(start) < k and far.max() > 1e-6:
        start.append(int(rng.choice(len(far), p=far / far.sum())))
        far = np.minimum(far, np.maximum(0, 1 - vectors @ vectors[start[-1]]))
    centroids = vectors[start].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = unit(vectors[own == c].mean(0))
    size = np.bincount(np.argmax(vectors @ centroids.T, axis=1), minlength=len(centroids))
    centroids = centroids[size >= min(LEAST_SHARE * len(vectors), size.max())]
    return centroids.astype(np.float32), float(max(0.0, 1 - (vectors @ centroids.T).max(axis=1).min()))


def _cluster(rows: pd.DataFrame, idf: np.ndarray, k: int) -> pd.DataFrame:
    counts = [c for c in map(counts_of, rows.sort_values("th").text) if c is not None]
    if not counts:
        return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
    centroids, radius = spherical_kmeans(_weighted(np.stack(counts), idf), k)
    return pd.DataFrame({"lang": rows.lang.iloc[0], "centroid": [c.tobytes() for c in centroids], "radius": radius})


class Model:
    def __init__(self, idf: np.ndarray, rows: list):
        rows = sorted(rows, key=lambda r: (r.lang, bytes(r.centroid)))
        self.idf = idf
        self.langs = sorted({r.lang for r in rows})
        self.lang_of = np.array([self.langs.index(r.lang) for r in rows], dtype=np.int64)
        self.reach = np.array([REACH * max(r.radius for r in rows if r.lang == lang) for lang in self.langs])
        self.centroids = np.array([np.frombuffer(r.centroid, dtype=np.float32) for r in rows]).reshape(-1, BUCKETS)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language numbers, scores, distances, rejected) of rows of counts."""
        cosines = (_weighted(counts, self.idf) @ self.centroids.T).astype(np.float64)
        # language by language, the nearest of its centroids
        best = np.stack([cosines[:, self.lang_of == k].max(1) for k in range(len(self.langs))], axis=1)
        lang = np.argmax(best, axis=1)
        rows = np.arange(len(lang))
        distance = np.clip(1 - best[rows, lang], 0, 1)
        rejected = distance > self.reach[lang] + 1e-6
        share = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        score = share[rows, lang] / share.sum(1)
        score *= np.where(rejected, self.reach[lang] / np.maximum(distance, 1e-12), 1.0)
        return lang, np.clip(score, 0, 1), distance, rejected


def fit(docs: DataFrame, centroids: int = CENTROIDS, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Document frequencies over all learning rows; one task per language clusters its bounded sample."""
    ship_package(docs.sparkSession)
    learning = learning_rows(docs)
    idf = inverse_frequencies(learning)
    clustered = learning_sample(learning, per_lang).groupBy("lang").applyInPandas(
        lambda rows: _cluster(rows, idf, centroids), "lang string, centroid binary, radius double"
    )
    return Model(idf, clustered.collect())


def _predict(batches: Iterator[pa.RecordBatch], model: Model, und_if_rejected: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        texts = batch.column(2)
        nearest: list[str | None] = [None] * n
        score, distance, rejected = [0.0] * n, [None] * n, [False] * n
        waiting: list[tuple[int, np.ndarray]] = []

        def settle(waiting=waiting, nearest=nearest, score=score, distance=distance, rejected=rejected):
            if waiting:
                found = model.predict(np.stack([c for _, c in waiting]))
                for (at, _), k, s, d, r in zip(waiting, *(f.tolist() for f in found), strict=True):
                    nearest[at], score[at], distance[at], rejected[at] = model.langs[k], s, d, r
                waiting.clear()

        for at in range(n):
            text = texts[at].as_py()
            counts = counts_of(text) if text and model.langs else None
            if counts is not None:
                waiting.append((at, counts))
                if len(waiting) == TOGETHER:
                    settle()
        settle()
        told = [UNKNOWN if x is None or (r and und_if_rejected) else x for x, r in zip(nearest, rejected, strict=True)]
        columns = [
            batch.column(0), batch.column(1), pa.array(told, pa.string()), pa.array(score, pa.float64()),
            pa.array(nearest, pa.string()), pa.array(distance, pa.float64()), pa.array(rejected, pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def identify(docs: DataFrame, model: Model | None = None, und_if_rejected: bool = True) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, nearest_lang, distance, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(source, lambda batches: _predict(batches, shared.value, und_if_rejected), RESULT)
