"""Removal of repeated byte strings with suffix sorting (deep-shallow).

A byte is removed if a string of ``length`` (50) bytes that covers it also
starts in a document with a smaller doc_id.  Sorting every suffix of the corpus
would move each byte fifty times; here only suffixes that can matter are
sorted:

1. Every window of ``length`` bytes names an anchor, the ``GRAM``-byte string
   in it with the least hash (leftmost among equals).  Equal windows name equal
   anchors at equal places.  Spark finds the anchors that occur in more than
   one document.
2. For those, the bytes around the anchor that a window can hold (its context)
   go to one place per anchor string: a row per document and context, with all
   places of it.  Of the documents of a batch that have the same context only
   the first one's goes there; the others are settled at once, so a passage that
   very many documents share sends a row per batch, not per document.
3. There the suffixes that start at the anchors, and the reversed strings that
   end there, are sorted by deep-shallow sorting: multikey quicksort on words
   of 8 bytes to a shallow depth, then blind tries order the groups that still
   agree.  Common prefix lengths of neighbours give, for every depth, the
   classes of equal strings; a window with o bytes before the anchor is a pair
   of a class of depth o backward and one of depth length - o forward, and is a
   repeat if the pair's smallest doc_id is smaller than its own.
4. The windows found are merged per document and cut out.

Contexts equal to an earlier document's are settled while they stream by; only
distinct contexts are sorted, in portions of whole anchors, so a task holds the
distinct contexts of one anchor string (84 bytes each).  Documents equal to an
earlier one are settled by their hash alone and give no contexts.  The sort is
multikey in words of 8 bytes (numpy's lexsort on the rows that still agree),
then blind tries.

Defined cases: null texts are empty; null doc_ids sort after all others and do
not remove each other's bytes, nor do rows that repeat a doc_id; texts shorter
than ``length`` lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, staged, text_or_empty

LENGTH = 50
GRAM = 16
LAST = 2**63 - 1  # the order of documents without an id
SHALLOW = 24
PORTION = 100_000
MARK = "ord long, tag long, start long, end long"
# ``around``: the bytes of the document before and after the place (as before x AROUND + after);
# ``places``: 32-bit numbers.  A row without context is settled: all that is around its places is repeated.
CONTEXT = "context binary, around int, ord long, tag long, places binary"
AROUND = 1 << 8
HASH_BITS = 48  # kept of an anchor's hash; equal ones are told apart by their bytes


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM (a power of two) bytes from each position."""
    h = data.astype(np.uint64)
    factor, n = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < GRAM:
            h = h[:-n] * factor + h[n:]
            factor, n = factor * factor, 2 * n
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` neighbouring values, by doubling."""
    n = 1
    while 2 * n <= width:
        values, n = best(values[:-n], values[n:]), 2 * n
    return best(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the places that hold the least hash of some window."""
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = gram_hashes(data)
    width = length - GRAM + 1
    low = sliding(h, width, np.minimum)
    # a place's hash is at least every minimum of the windows over it; an anchor's equals one of them
    edge = np.zeros(width - 1, dtype=np.uint64)
    found = np.flatnonzero(h == sliding(np.concatenate([edge, low, edge]), width, np.maximum))
    return found, (h[found] >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def blind_order(strings: np.ndarray) -> list[int]:
    """Order of the rows of a byte matrix by a blind trie.

    A branch knows only the depth at which its strings first differ.  A new
    string is led down by those bytes alone, compared once with the leaf it
    meets, and put in at the depth of the first difference.
    """
    width = strings.shape[1]
    rows = [r.tobytes() for r in strings]
    numbers = [int.from_bytes(r, "big") for r in rows]
    root: list = [None, [0]]  # [depth, children] of a branch, [None, rows] of a leaf
    for k in range(1, len(rows)):
        row, node = rows[k], root
        while node[0] is not None:
            node = node[1].get(row[node[0]]) or next(iter(node[1].values()))
        differs = numbers[k] ^ numbers[node[1][0]]
        if not differs:
            node[1].append(k)
            continue
        depth, other = width - (differs.bit_length() + 7) // 8, rows[node[1][0]]
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][row[node[0]]]
        if node[0] == depth:
            node[1][row[depth]] = [None, [k]]
        else:
            node[:] = [depth, {other[depth]: node[:], row[depth]: [None, [k]]}]
    order: list[int] = []
    stack = [root]
    while stack:
        depth, inside = stack.pop()
        if depth is None:
            order += inside
        else:
            stack += [inside[b] for b in sorted(inside, reverse=True)]
    return order


def deep_shallow(strings: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Sorted order of the rows of a byte matrix.

    Multikey: rows are sorted by a word of 8 bytes, and only rows that agree so
    far by the next one, to ``shallow`` bytes; deep: blind tries for the rest.
    """
    n, width = strings.shape
    wide = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    wide[:, :width] = strings
    words = wide.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)  # group: of the row at each place of the order
    for depth in range(min(words.shape[1], shallow // 8)):
        sizes = np.bincount(group, minlength=1)
        open_places = np.flatnonzero(sizes[group] > 1)
        if not len(open_places):
            return order
        rows = order[open_places]
        order[open_places] = rows[np.lexsort((words[rows, depth], group[open_places]))]
        key = words[order, depth]
        cut = np.concatenate(([False], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(cut)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, dtype=np.int64)
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
        if b - a > 1:
            order[a:b] = order[a:b][blind_order(strings[order[a:b]])]
    return order


def classes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row, common prefix length of each sorted row with the one before)."""
    order = deep_shallow(strings)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    differs = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    return rank, np.concatenate(([0], common))


def repeats(
    context: np.ndarray, before: np.ndarray, after: np.ndarray, order: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray]:
    """Per context the bytes before its anchor at which the first and the last repeated window start; -1 if none."""
    left = length - GRAM
    forward, fc = classes(context[:, left:])
    backward, bc = classes(np.ascontiguousarray(context[:, :left][:, ::-1]))
    n = len(context)
    most, least = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for o in range(left + 1):
        usable = np.flatnonzero((before >= o) & (after >= length - o))
        if len(usable) < 2:
            continue
        key = np.cumsum(fc < length - o)[forward[usable]] * (n + 1) + np.cumsum(bc < o)[backward[usable]]
        by_key = np.argsort(key, kind="stable")
        ranked = key[by_key]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        smallest = np.minimum.reduceat(order[usable][by_key], starts)
        own = np.repeat(smallest, np.diff(np.append(starts, len(ranked))))
        hit = usable[by_key][order[usable][by_key] > own]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return most, least


def unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows equal in ord and tag (so in text) to the row before: their anchors and marks would be the same."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column("ord").to_pylist(), batch.column("tag").to_pylist(), strict=True))
        fresh = [k != before for k, before in zip(keys, [last, *keys], strict=False)]
        last = keys[-1] if keys else last
        yield batch if all(fresh) else batch.filter(pa.array(fresh, pa.bool_()))


def _document_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents -> (gram, ord, part, spread), each anchor of a document once.

    An anchor that several documents of the batch have is known to be shared:
    its first and last document stand for them (spread 0, as for the rest), and
    the others are dealt out by document, not to one place per anchor.
    """
    for batch in unrepeated(batches):
        texts = batch.column("text")
        grams = [np.unique(anchors(np.frombuffer(t.as_buffer(), dtype=np.uint8), length)[1]) for t in texts]
        sizes = [len(g) for g in grams]
        if sum(sizes):
            gram = np.concatenate(grams)
            order, part = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("ord", "part"))
            ranked = np.lexsort((order, gram))
            g, o = gram[ranked], order[ranked]
            first = np.concatenate(([True], g[1:] != g[:-1]))
            inner = ~first & ~np.append(first[1:], True)  # neither the first nor the last document of the anchor
            low = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
            last = np.append(np.flatnonzero(first)[1:], len(g)) - 1
            several = o[last][np.cumsum(first) - 1] > o[low]
            spread = np.zeros(len(g), dtype=np.int64)
            spread[ranked] = np.where(inner & several, (o ^ part[ranked]) | 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, order, part, spread)], ["gram", "ord", "part", "spread"])


def _once(
    context: np.ndarray, around: np.ndarray, order: np.ndarray, tag: np.ndarray, place: np.ndarray
) -> pa.RecordBatch:
    """Places with their contexts as rows of ``CONTEXT``, one per document and context."""
    n, width = context.shape
    wide = np.zeros((n, -(-width // 8) + 1), dtype=np.uint64)
    wide[:, :-1].view(np.uint8)[:, :width] = context
    wide[:, -1] = around
    hashes = np.zeros(n, dtype=np.uint64)
    for column in wide.T:
        hashes = (hashes ^ column) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    ranked = np.lexsort((place, tag, order, hashes))
    wide, order, tag = wide[ranked], order[ranked], tag[ranked]
    # contexts of one hash that differ only make more groups
    new = np.concatenate(([True], (wide[1:] != wide[:-1]).any(axis=1)))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    row = new | np.concatenate(([True], (order[1:] != order[:-1]) | (tag[1:] != tag[:-1])))
    # rows as they stand in the texts: neighbouring contexts overlap, and so are stored small
    starts, sizes = np.flatnonzero(row), np.diff(np.append(np.flatnonzero(row), n))
    by_text = np.argsort(ranked[starts], kind="stable")
    starts, sizes = starts[by_text], sizes[by_text]
    settled = order[starts] > order[first[starts]]
    held = ranked[starts]
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = place[ranked][np.repeat(starts - at[:-1], sizes) + np.arange(n)].astype(np.int32)
    bytes_of = np.ascontiguousarray(context[held[~settled]])
    ends = np.concatenate(([0], np.cumsum(np.where(settled, 0, width)))).astype(np.int32)
    contexts = pa.BinaryArray.from_buffers(
        pa.binary(), len(held), [pa.array(~settled).buffers()[1], pa.py_buffer(ends.tobytes()), pa.py_buffer(bytes_of.tobytes())]
    )
    places = pa.BinaryArray.from_buffers(
        pa.binary(), len(held), [None, pa.py_buffer((4 * at).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
    )
    columns = [contexts, pa.array(around[held].astype(np.int32)), pa.array(order[starts]), pa.array(tag[starts]), places]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CONTEXT.split(", ")])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents with ``grams`` -> the contexts of the anchors among these."""
    left = length - GRAM
    for batch in unrepeated(batches):
        waiting: list[tuple[np.ndarray, ...]] = []
        for order, tag, text, grams in zip(*[batch.column(c) for c in ("ord", "tag", "text", "grams")], strict=True):
            data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            place, gram = anchors(data, length)
            place = place[np.isin(gram, grams.values.to_numpy())]
            framed = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
            for at in range(0, len(place), PORTION):
                p = place[at : at + PORTION]
                rows = np.lib.stride_tricks.sliding_window_view(framed, left + length)[p]
                own = (np.full(len(p), x.as_py(), dtype=np.int64) for x in (order, tag))
                waiting.append((rows, np.minimum(p, left) * AROUND + np.minimum(len(data) - p, length), *own, p))
                if sum(len(w[0]) for w in waiting) >= PORTION:
                    yield _once(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                    waiting = []
        if waiting:
            yield _once(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def _marks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, context and order -> repeated stretches (ord, tag, start, end)."""
    left, width = length - GRAM, 2 * length - GRAM
    names = [f.split()[0] for f in MARK.split(", ")]
    held: list[tuple[np.ndarray, np.ndarray, list]] = []  # distinct contexts of whole anchors, and of the last one
    carry: tuple | None = None  # (key, smallest order) of the last context seen

    def marks(rows: np.ndarray, places: list, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        """A mark around every place of the rows."""
        sizes = [len(p) for p in places]
        at = np.concatenate([np.zeros(0, dtype=np.int64), *places])
        order, tag, start, end = (np.repeat(x, sizes) for x in (rows[:, 2], rows[:, 3], start, end))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (order, tag, at + start, at + end)], names)

    def chosen(places: list, which: np.ndarray) -> list:
        return [places[k] for k in np.flatnonzero(which)]

    def anchor_starts(context: np.ndarray) -> np.ndarray:
        gram = context[:, left : left + GRAM]
        return np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]).any(axis=1))))

    def settle(rows: np.ndarray, context: np.ndarray, places: list) -> Iterator[pa.RecordBatch]:
        counts = np.diff(np.append(anchor_starts(context), len(rows)))
        several = np.repeat(counts > 1, counts)  # an anchor with one context left has nothing to be compared with
        rows, context, places = rows[several], context[several], chosen(places, several)
        if len(rows):
            most, least = repeats(context, rows[:, 0], rows[:, 1], rows[:, 2], length)
            hit = most >= 0
            yield marks(rows[hit], chosen(places, hit), -most[hit], length - least[hit])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        # before, after, ord, tag
        around, order, tag = (c.to_numpy().astype(np.int64) for c in batch.columns[1:4])
        rows = np.stack([around // AROUND, around % AROUND, order, tag], axis=1)
        places = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in batch.column(4)]
        told = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        if told.any():
            yield marks(rows[told], chosen(places, told), -rows[told, 0], rows[told, 1])
            rows, places = rows[~told], chosen(places, ~told)
            n = len(rows)
            if not n:
                continue
        texts = batch.column(0).filter(pa.array(~told))
        context = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[texts.offset * width :][: n * width].reshape(n, width)
        keys = rows[:, :2]
        same = np.zeros(n, dtype=bool)
        same[1:] = (keys[1:] == keys[:-1]).all(axis=1) & (context[1:] == context[:-1]).all(axis=1)
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        smallest = rows[first, 2]
        if carry and carry[0] == (*keys[0].tolist(), context[0].tobytes()):
            smallest = np.where(first == 0, carry[1], smallest)
        carry = ((*keys[-1].tolist(), context[-1].tobytes()), int(smallest[-1]))
        # the same context in an earlier document: all of it is a repeat
        later = rows[:, 2] > smallest
        if later.any():
            yield marks(rows[later], chosen(places, later), -rows[later, 0], rows[later, 1])
        held.append((rows[~later], context[~later].copy(), chosen(places, ~later)))
        if sum(len(r) for r, _, _ in held) >= PORTION:
            rows, context = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            places = [p for h in held for p in h[2]]
            last = int(anchor_starts(context)[-1])
            if last:
                yield from settle(rows[:last], context[:last], places[:last])
            held = [(rows[last:], context[last:], [p.copy() for p in places[last:]])]
    if held:
        rows, context = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        if len(rows):
            yield from settle(rows, context, [p for h in held for p in h[2]])


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents with their marks -> what is left of each."""
    for batch in batches:
        found = []
        for th, text, marks in zip(*[batch.column(c) for c in ("th", "text", "marks")], strict=True):
            data, tags = text.as_buffer().to_pybytes(), (0, th.as_py())
            spans: list[list[int]] = []
            for mark in sorted((m["start"], m["end"]) for m in marks.as_py() or () if m["tag"] in tags):
                if spans and mark[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], mark[1])
                else:
                    spans.append(list(mark))
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            found.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names[: len(columns) + 1])


def _part(text_hash: str) -> Column:
    """Divides the one order that all documents without an id share: their text's hash, 0 for other documents."""
    return F.when(F.col("ord") == LAST, F.col(text_hash)).otherwise(0).cast("long")


def deduplicate(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, ``with_text``)."""
    text = text_or_empty()
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64(text).alias("th"),
        F.encode(text, "UTF-8").alias("text"),
    ).withColumn("part", _part("th"))
    # documents equal to an earlier one; a tag tells apart different texts of one doc_id (0: there is one only)
    known = texts.select("ord", "th", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").cast("long").alias("n"))
    known = staged(known, "document-hashes")
    # written, so that the join below stands alone and Spark can split the copies of one text
    first = staged(known.groupBy("sha").agg(F.min("ord").alias("first")), "first-copies")
    known = known.join(first, "sha").withColumn("copy", (F.col("ord") > F.col("first")) & (F.col("n") >= length))
    known = known.groupBy("ord", "th").agg(F.max("n").alias("n"), F.bool_and("copy").alias("copy"))
    texts_of = Window.partitionBy("ord", _part("th"))  # documents without an id are not gathered, each has its tag
    several = (F.col("ord") == LAST) | (F.count("*").over(texts_of) > 1)
    known = known.withColumn("tag", F.when(several, F.col("th")).otherwise(0).cast("long"))
    known = staged(known, "document-copies")
    whole = known.where("copy").select("ord", "tag", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    needed = known.where("NOT copy").select("ord", _part("th").alias("part"), "tag")
    # The three joins below read all of ``texts`` by ord and part, so that Spark moves the texts once and reuses the exchange.
    key = ["ord", "part"]
    mine = (F.col("tag") == 0) | (F.col("tag") == F.col("th"))
    asked = texts.join(needed, key).where(mine).select("doc_id", "ord", "part", "th", "text", "tag")
    # anchors of more than one document, per document
    grams = map_batches(asked, lambda it: _document_anchors(it, length), "gram long, ord long, part long, spread long")
    everywhere = Window.partitionBy("gram", "spread")
    shared = grams.withColumns({"low": F.min("ord").over(everywhere), "high": F.max("ord").over(everywhere)})
    wanted = shared.where("low < high OR spread <> 0").groupBy(*key).agg(F.collect_list("gram").alias("grams"))
    # their contexts, sorted; the stretches found, per document
    wanted = needed.join(wanted, key)
    asked = texts.join(wanted, key).where(mine).select("doc_id", "ord", "part", "th", "text", "tag", "grams")
    contexts = map_batches(asked, lambda it: _contexts(it, length), CONTEXT)
    gram = F.substring("context", length - GRAM + 1, GRAM)
    # settled rows go anywhere
    place = F.when(F.col("context").isNull(), F.xxhash64("ord", "tag", "places")).otherwise(F.xxhash64(gram))
    ordered = contexts.repartition(place).sortWithinPartitions(gram, "context", "around", "ord")
    marks = map_batches(ordered, lambda it: _marks(it, length), MARK).unionByName(whole)
    marks = marks.withColumn("part", _part("tag"))
    per_document = marks.groupBy(*key).agg(F.collect_set(F.struct("tag", "start", "end")).alias("marks"))
    joined = texts.join(per_document, key, "left").select("doc_id", "ord", "part", "th", "text", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(joined, lambda it: _cut(it, with_text), schema + (", kept binary" if with_text else ""))
