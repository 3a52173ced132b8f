"""Product-quantised vector codes, learned and assigned with per-dimension value dictionaries.

Vectors become integers and are cut into ``parts`` equal parts, each with a
codebook of ``entries``.  The rows are kept in chunks (one per Arrow batch).  A
chunk stores, for each dimension, the dictionary of the different integers that
occur there, and each component as its place in that dictionary.  To compare
the chunk with a codebook, the squared differences of every dictionary integer
to all entries are tabulated once per dimension; the distance of a part is then
a gather from the tables of its dimensions and an addition.  Dictionaries are
made once and serve all rounds.

A round is one Spark job: tasks assign their chunks and send one row per
(part, entry, position) with sum and count, Spark adds them up, and at most
entries x dimensions rows reach the driver, which divides.  Everything is
integer arithmetic, so the layout of the rows does not change the result.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; shorter vectors count as padded with zeros to the longest one,
rounded up to a multiple of the parts; the first entries come from the smallest
different vec_ids (a null vec_id counts as the greatest), of a repeated vec_id
the smallest vector; fewer rows give fewer entries; repeated rows are coded and
counted each; a null label is a label of its own; an empty table gives an empty
result; other columns are not looked at.  Components must be below 2^27 / scale
in size (32,768 at the default); larger ones are an error, as their sums would
not fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, staged

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 27


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(scale * x)."""
    whole = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    limit = f"CASE WHEN abs({scale} * double(x)) < {LARGEST} THEN int(floor({scale} * double(x))) ELSE raise_error('component too large') END"
    return vectors.where(F.expr(whole)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.expr(f"transform(embedding, x -> {limit})").alias("v")
    )


def _chunk(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    vectors = batch.column(2)
    n = batch.num_rows
    lengths = np.diff(vectors.offsets.to_numpy())
    matrix = np.zeros((n, width), dtype=np.int32)
    matrix[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy()
    places = np.zeros((width, n), dtype=np.int32)
    dictionaries = []
    for d in range(width):
        values, places[d] = np.unique(matrix[:, d], return_inverse=True)
        dictionaries.append(values)
    sizes = np.array([len(x) for x in dictionaries], dtype=np.int32)
    held = np.concatenate([np.zeros(0, dtype=np.int32), *dictionaries])
    narrow = np.uint16 if n <= 1 << 16 else np.int32
    whole = [pa.array([0, n], pa.int32())]
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(whole[0], batch.column(0)), pa.ListArray.from_arrays(whole[0], batch.column(1)),
            pa.array([sizes.tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary()),
            pa.array([places.astype(narrow).tobytes()], pa.binary()),
        ],
        names=["vec_ids", "labels", "sizes", "dictionaries", "places"],
    )


def chunked(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, v) rows as chunks: ids, labels, dictionaries per dimension, places in them."""
    label = dict(rows.dtypes)["label"]
    schema = f"vec_ids array<bigint>, labels array<{label}>, sizes binary, dictionaries binary, places binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _chunk(batch, width)

    return map_batches(rows, encode, schema)


class Chunk:
    """The dictionaries of a chunk and its rows as places in them."""

    def __init__(self, n: int, sizes: bytes, dictionaries: bytes, places: bytes):
        ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32))
        held = np.frombuffer(dictionaries, dtype=np.int32).astype(np.int64)
        self.dictionaries = np.split(held, ends[:-1]) if len(ends) else []
        kind = np.uint16 if n <= 1 << 16 else np.int32
        self.places = np.frombuffer(places, dtype=kind).reshape(len(ends), n)
        self.n = n

    def assign(self, part: int, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's part; ties go to the lower index."""
        width = codebook.shape[1]
        total = np.zeros((self.n, len(codebook)), dtype=np.int64)
        for d in range(width):
            at = part * width + d
            table = (self.dictionaries[at][:, None] - codebook[:, d]) ** 2
            total += table[self.places[at]]
        nearest = total.argmin(axis=1)
        return nearest, total[np.arange(self.n), nearest]

    def values(self, dimension: int) -> np.ndarray:
        return self.dictionaries[dimension][self.places[dimension]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, pa.RecordBatch, int]]:
    for batch in batches:
        for at in range(batch.num_rows):
            n = len(batch.column(0)[at])
            yield Chunk(n, *(batch.column(k)[at].as_py() for k in (2, 3, 4))), batch, at


def first_entries(chunks: DataFrame, width: int, count: int) -> list[list[int]]:
    """The vectors of the ``count`` smallest different vec_ids, nulls last; tasks send that many rows at most."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for chunk, batch, at in _chunks(batches):
            ids = batch.column(0)[at].as_py()
            order = sorted({(i is None, i or 0) for i in ids} | {(k is None, k or 0) for k in best})[:count]
            bound = set(order)
            best = {k: v for k, v in best.items() if (k is None, k or 0) in bound}
            for row, i in enumerate(ids):
                if (i is None, i or 0) in bound:
                    vector = [int(chunk.dictionaries[d][chunk.places[d, row]]) for d in range(width)]
                    best[i] = min(best.get(i, vector), vector)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.int32()))], names=["vec_id", "v"]
        )

    found = map_batches(chunks, candidates, "vec_id long, v array<int>")
    rows = found.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).limit(count)
    return [r.v for r in rows.collect()]


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, entries, width = books.shape
    totals = np.zeros((parts, entries, width + 1), dtype=np.int64)  # the last position counts the rows
    for chunk, _, _ in _chunks(batches):
        for p in range(parts):
            nearest, _ = chunk.assign(p, books[p])
            totals[p, :, -1] += np.bincount(nearest, minlength=entries)
            for d in range(width):
                # sums of a chunk are far below 2^53: exact as floats
                weights = chunk.values(p * width + d).astype(np.float64)
                totals[p, :, d] += np.bincount(nearest, weights, minlength=entries).astype(np.int64)
    places = np.indices(totals.shape).reshape(3, -1)
    columns = [pa.array(x, pa.int32()) for x in places] + [pa.array(totals.ravel())]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "total"])


def refined(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    sums = map_batches(chunks, lambda batches: _sums(batches, books), "part int, entry int, position int, total long")
    totals = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
    for part, entry, position, total in sums.groupBy("part", "entry", "position").agg(F.sum("total")).collect():
        totals[part, entry, position] = total
    count = totals[:, :, -1:]
    return np.where(count > 0, totals[:, :, :-1] // np.maximum(count, 1), books)


def learn(chunks: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks: an array of parts x entries x positions."""
    first = first_entries(chunks, width, entries)
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, width // parts).swapaxes(0, 1)
    for _ in range(rounds):
        books = refined(chunks, books)
    return books


def encode(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""
    label = chunks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch, at in _chunks(batches):
            codes, error = np.zeros((chunk.n, len(books)), dtype=np.uint8), np.zeros(chunk.n, dtype=np.int64)
            for p, book in enumerate(books):
                codes[:, p], distance = chunk.assign(p, book)
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[at].values, batch.column(1)[at].values, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return map_batches(chunks, run, f"vec_id long, label {label}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (over equal labels) and codebooks_sha256 of every kept row."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = staged(integers(vectors, scale), "integer-vectors")
    longest = rows.agg(F.max(F.size("v"))).head()[0]
    width = -(-(longest or 0) // parts) * parts
    chunks = staged(chunked(rows, width), "vector-chunks")
    books = learn(chunks, width, parts, entries, rounds)
    coded = staged(encode(chunks, books), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("sum_label")).agg(F.sum("error").alias("label_error"))
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("sum_label")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
