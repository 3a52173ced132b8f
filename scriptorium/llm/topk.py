"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x).  The index is cut into blocks of
about ``block`` vectors.  A block keeps, per dimension, its members in order of
their quantised impact (component divided by ``step``, rounded), cut into
posting segments of equal impact, besides the exact integers and the length of
what quantising leaves of each vector.

A query processes the segments of all dimensions by descending |weight x
impact|, adding weight x impact to one accumulator per vector.  What is left is
bounded from both sides: per dimension by the range of the impacts not yet
processed, and for the quantising remainder by the product of the two lengths
(Cauchy-Schwarz).  Processing stops only when these bounds prove that few
vectors can still be among the block's k best (or the segments are used up);
all vectors the bounds leave possible are then rescored exactly, ties included,
so nothing depends on where it stopped.

Queries are cut into chunks and each pair of an index block and a query chunk
is one group of bounded size, and a task of its own as long as there are few.
Blocks are as large as they may be, since a larger one proves more at once; where
that leaves fewer groups than ``GROUPS_PER_CORE`` for each core, the queries are
cut finer, down to ``LEAST_CHUNK``, beside which building an index again is
little work.  A block gives k rows per query at most, and the k best of all
blocks are ranked per query.

Defined cases: vectors that are null, hold null or non-finite components, or
have no id take no part; shorter vectors count as padded with zeros; rows that
share the query's id are its own and no candidates; a query's id is answered
once, for the least of its vectors (as arrays of integers) if it has several;
candidates are rows, so a repeated vec_id is listed as often as its rows rank; an
empty table gives an empty result.  Components must be below
2^31 / scale in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import staged
from scriptorium.session import ship_package

SCALE = 256
STEP = 8
BLOCK = 16_384
QUERY_CHUNK = 4096
LEAST_CHUNK = 64
GROUPS_PER_CORE = 4
GROUP_TASKS = 20_000  # beyond so many groups several share a task
FEW = 4  # times k: so few possible members are worth rescoring at once
LOOKS = 4  # times the bounds are looked at
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part, as integers."""
    whole = F.expr(
        "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    integers = F.expr(f"transform(embedding, x -> floor({scale} * double(x)))")
    return vectors.where(F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long"), integers.alias("v")
    )


class BlockIndex:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, step: int = STEP):
        self.ids, self.matrix, self.step = ids, matrix, step
        impacts = np.floor_divide(matrix + step // 2, step)
        self.rest = np.sqrt(((matrix - step * impacts).astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(impacts, axis=0, kind="stable")
        self.members: list[np.ndarray] = []  # of each segment
        dims, levels = [], []
        for d in range(matrix.shape[1]):
            ranked = impacts[order[:, d], d]
            cuts = np.flatnonzero(np.diff(ranked)) + 1
            self.members += np.split(order[:, d], cuts)
            found = ranked[np.concatenate(([0], cuts))]
            dims += [d] * len(found)
            levels += found.tolist()
        self.dims, self.levels = np.array(dims, dtype=np.int64), np.array(levels, dtype=np.int64)
        self.sizes = np.array([len(m) for m in self.members], dtype=np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of all that may be among the k best candidates, ranked; at most k."""
        candidates = self.ids != query_id
        wanted = min(k, int(candidates.sum()))
        if not wanted:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        worth = query[self.dims] * self.levels
        order = np.argsort(-np.abs(worth), kind="stable")
        total = np.zeros(len(self.ids))
        possible = candidates
        part = max(1, -(-len(order) // LOOKS))
        for at in range(0, len(order), part):
            now, rest = order[at : at + part], order[at + part :]
            now = now[worth[now] != 0]
            if len(now):
                # the sums are integers below 2^53 in size, so adding them as doubles is exact
                adds = np.repeat(worth[now].astype(np.float64), self.sizes[now])
                total += np.bincount(np.concatenate([self.members[s] for s in now]), adds, len(total))
            # a vector's impact in a dimension has been processed (nothing is left) or is among the rest
            least = np.zeros(self.matrix.shape[1], dtype=np.int64)
            most = least.copy()
            np.minimum.at(least, self.dims[rest], worth[rest])
            np.maximum.at(most, self.dims[rest], worth[rest])
            known = self.step * total
            # what quantising left, and room for the rounding of these floats
            slack = np.sqrt((query.astype(np.float64) ** 2).sum()) * self.rest + 1e-9 * np.abs(known) + 1
            low = known + self.step * float(least.sum()) - slack
            high = known + self.step * float(most.sum()) + slack
            bar = np.partition(low[candidates], -wanted)[-wanted]
            possible = candidates & (high >= bar)
            if possible.sum() <= FEW * k:
                break
        rows = np.flatnonzero(possible)
        scores = self.matrix[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:wanted]
        return rows[best], scores[best]


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def search_group(rows: pd.DataFrame, k: int, step: int) -> pd.DataFrame:
    """One index block (is_query false) against one chunk of queries."""
    asked, held = rows[rows.is_query], rows[~rows.is_query]
    found: list[tuple[int, int, int]] = []
    if len(asked) and len(held):
        width = int(max(map(len, rows.v)))
        index = BlockIndex(held.vec_id.to_numpy(), _padded(list(held.v), width), step)
        for query_id, query in zip(asked.vec_id.tolist(), _padded(list(asked.v), width), strict=True):
            at, scores = index.search(query_id, query, k)
            found += zip([query_id] * len(at), index.ids[at].tolist(), scores.tolist(), strict=True)
    return pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])


def grid(vectors: int, queries: int, cores: int, block: int = BLOCK) -> tuple[int, int]:
    """Numbers of index blocks and of query chunks."""
    blocks = -(-vectors // block)
    wanted = -(-GROUPS_PER_CORE * cores // max(1, blocks))
    return blocks, max(-(-queries // QUERY_CHUNK), min(wanted, -(-queries // LEAST_CHUNK)))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, block: int = BLOCK, step: int = STEP
) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have vec_id and embedding; ties go to the
    smaller vec_id.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    held = staged(quantised(vectors, scale), "vectors")
    asked = staged(quantised(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "vector-queries")
    blocks, chunks = grid(held.count(), asked.count(), spark.sparkContext.defaultParallelism, block)
    if not blocks or not chunks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tasks = min(blocks * chunks, GROUP_TASKS)
    dealt = []
    for frame, own, own_count, other, other_count in ((held, "b", blocks, "c", chunks), (asked, "c", chunks, "b", blocks)):
        placed = frame.select(
            F.lit(own == "c").alias("is_query"),
            "vec_id",
            "v",
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(own_count)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_count - 1).cast("long"))).alias(other),
        )
        task = ((F.col("b") * chunks + F.col("c")) % tasks).cast("int")
        dealt.append(placed.select(task.alias("task"), "b", "c", "is_query", "vec_id", "v"))
    # groups go to tasks by number: hashes of so few small numbers would put several into one and leave others empty
    groups = dealt[0].unionByName(dealt[1]).repartitionById(tasks, F.col("task")).groupBy("task", "b", "c")
    local = groups.applyInPandas(lambda rows: search_group(rows, k, step), RESULT)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

