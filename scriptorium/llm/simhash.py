"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Texts are lower-cased (A-Z only) and cut into shingles of words; a bit of the
64-bit fingerprint is 1 if it is set in over half of the shingles' hashes.
Fingerprints that differ in at most ``max_bits`` (3) bits share at least
8 - 3 = 5 of their 8 positional bytes.  Split the positions into two halves of
four: five shared positions leave three in one half, so each posting list of
the index holds the fingerprints that share a triple of positional bytes of
one half (eight lists per fingerprint).  Within a list the shared positional
bytes of each pair are tallied, pairs below the guaranteed minimum are dropped
and the rest is verified bit by bit.

Equal fingerprints collapse to one before the index, lists longer than
``block`` are cut into cells of block x block, and a cell emits only a spanning
forest of its verified links, so no list is gathered whole and no list is
expanded into all its pairs; the components are the same.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle of all words; null
doc_ids count in links but never as the smallest doc_id (a component of nulls
only has a null component_id); repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, staged, text_or_empty, with_row_id

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 1024
HALVES = ((0, 1, 2, 3), (4, 5, 6, 7))
TRIPLES = tuple(tuple(p for p in half if p != left) for half in HALVES for left in half)
_HASHES_AT_ONCE = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1)).tolist()
    ends = np.append(spaces, len(joined)).tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    n = len(words) - width + 1
    for at in range(0, n, _HASHES_AT_ONCE):
        to = min(n, at + _HASHES_AT_ONCE)
        spans = zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, hash of the text (th) and fingerprint (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "fp"])

    text = text_or_empty()
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))
    return map_batches(source, run, "doc_id long, th long, fp long")


def byte_at(position: int):
    return F.shiftrightunsigned(F.col("fp"), 8 * position).bitwiseAND(F.lit(255))


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): the fingerprint in the list of each of its byte triples."""
    keys = [
        F.shiftleft(F.lit(k).cast("long"), 24)
        + F.shiftleft(byte_at(a), 16)
        + F.shiftleft(byte_at(b), 8)
        + byte_at(c)
        for k, (a, b, c) in enumerate(TRIPLES)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def cell_links(left: np.ndarray, right: np.ndarray | None, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    members = left if right is None else np.concatenate([left, right])
    spread = members.view(np.uint8).reshape(-1, 8)
    shared = np.zeros((len(members), len(members)), dtype=np.uint8)
    for position in range(8):
        shared += spread[:, None, position] == spread[None, :, position]
    # tally first: only pairs with the guaranteed number of shared bytes are verified
    rows, columns = np.nonzero(shared >= 8 - max_bits)
    near = np.bitwise_count(members[rows] ^ members[columns]) <= max_bits
    linked = np.zeros_like(shared, dtype=bool)
    linked[rows[near], columns[near]] = True
    if right is not None:
        linked[: len(left), : len(left)] = False
        linked[len(left) :, len(left) :] = False
    edges, fresh = [], np.ones(len(members), dtype=bool)
    for root in range(len(members)):
        if not fresh[root]:
            continue
        fresh[root], reached = False, [root]
        while reached:
            at = reached.pop()
            found = np.flatnonzero(linked[at] & fresh)
            fresh[found] = False
            reached += found.tolist()
            edges += [(int(members[at]), int(members[k])) for k in found]
    return edges


def _cells(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, row, col, block, fp), sorted by cell -> links of each cell."""
    names = ["u", "v"]
    held: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        cell = np.concatenate(held)
        fps = np.ascontiguousarray(cell[:, 4]).view(np.uint64)
        row, col = cell[0, 1], cell[0, 2]
        if row == col:
            edges = cell_links(fps, None, max_bits)
        else:
            edges = cell_links(fps[cell[:, 3] == row], fps[cell[:, 3] == col], max_bits)
        pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64)
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        for piece in np.split(rows, cuts):
            if held and (held[0][0, :3] != piece[0, :3]).any():
                yield close()
                held = []
            held.append(piece)
    if held:
        yield close()


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all near ones."""
    if not 0 <= max_bits <= 3:
        raise ValueError("byte triples guarantee links of up to 3 differing bits")
    lists = postings(fps)
    sizes = lists.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"), F.count("*").alias("n"))
    placed = lists.join(sizes.where("n > 1"), "key").withColumn("block", F.expr("pmod(xxhash64(fp), blocks)"))
    # a member of block b belongs to the cells (b, j) and (i, b) of the upper triangle
    cells = F.expr(
        "transform(sequence(0L, blocks - 1), j -> struct(least(block, j) AS row, greatest(block, j) AS col))"
    )
    spread = placed.select("key", "block", "fp", F.explode(cells).alias("cell"))
    dealt = spread.select("key", "cell.row", "cell.col", "block", "fp").repartition("key", "row", "col")
    ordered = dealt.sortWithinPartitions("key", "row", "col", "fp")
    return map_batches(ordered, lambda it: _cells(it, max_bits), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of the edges is connected to.

    Alternates two rounds of star making (to larger neighbours, then to
    smaller ones) until the edges stay the same; each round is written to the
    shared folder.  All steps are joins and aggregates on one node, with
    map-side combination.
    """
    current, seen = staged(edges.where("u <> v").distinct(), "links"), None
    while True:
        seen_now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen_now == seen or not seen_now[0]:
            break
        seen = seen_now
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest)
        )
        current = staged(small.where("u <> v").distinct(), "stars")
    stars = current.union(current.select("v", "v"))  # a star's centre is of its own component
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def labelled(docs: DataFrame, shingle: int, max_bits: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): the fingerprint of each row, and the first row of each fingerprint's component.

    ``first`` holds the smallest doc_id of the component, null only where no
    row has one, and the smallest text hash among rows that share it.
    """
    rows = staged(fingerprints(docs, shingle), "fingerprints")
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    distinct = rows.groupBy("fp").agg(F.min(named).alias("first_row"))
    found = components(links(distinct.select("fp"), max_bits, block))
    owned = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "first_row", F.coalesce("component", "fp").alias("component")
    )
    smallest = owned.groupBy("component").agg(F.min("first_row").alias("first"))
    return rows, staged(owned.join(smallest, "component").select("fp", "first"), "components")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the smallest doc_id that a chain of links reaches, the
    row's own included.
    """
    rows, labels = labelled(docs, shingle, max_bits, block)
    return rows.join(labels, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def keep_one_per_component(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK
) -> DataFrame:
    """The first document of each component, with all of docs' columns.

    The first is the one of smallest doc_id; of different texts that share it
    one stays if they are near, and each of them where they are not.  Of rows
    equal in doc_id and text one stays.  Rows without a doc_id cannot be named
    as a component's member and stay.
    """
    _, labels = labelled(docs, shingle, max_bits, block)
    kept = labels.where("first.doc_id IS NOT NULL").select("first.doc_id", "first.th").distinct().toDF("kept_id", "kept_th")
    prefix = "th_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    hashed = docs.withColumn(prefix, F.xxhash64(text_or_empty()))
    named = hashed.join(
        kept, (hashed["doc_id"].cast("long") == kept["kept_id"]) & (hashed[prefix] == kept["kept_th"]), "left_semi"
    ).dropDuplicates(["doc_id", prefix])
    return named.drop(prefix).unionByName(docs.where(docs["doc_id"].isNull()))


def keep_one_row_per_component(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK
) -> DataFrame:
    """Exactly one row of each component, with all of docs' columns.

    The one of smallest doc_id (rows without one come last), then of smallest
    text hash, then the first as the rows were numbered.  Unlike
    ``keep_one_per_component``, rows without a doc_id are members like any other.
    """
    prefix = "row_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    th, number = f"{prefix}th", f"{prefix}number"
    numbered = with_row_id(docs.withColumn(th, F.xxhash64(text_or_empty())), number)
    numbered = staged(numbered, "numbered-documents")
    _, labels = labelled(numbered, shingle, max_bits, block)
    kept = labels.select("first.doc_id", "first.th").distinct().toDF(f"{prefix}id", f"{prefix}kept")
    # rows of one doc_id and text are of one component, so the least number of each pair is one row of it
    keys = numbered.groupBy(F.col("doc_id").cast("long").alias("doc_id"), th).agg(F.min(number).alias(number))
    same = keys["doc_id"].eqNullSafe(kept[f"{prefix}id"]) & (keys[th] == kept[f"{prefix}kept"])
    return numbered.join(keys.join(kept, same, "left_semi").select(number), number, "left_semi").drop(th, number)
