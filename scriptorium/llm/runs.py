"""Periodic runs of words: Lyndon roots from a suffix sorter's first phase, extended into runs.

A run is a stretch of consecutive words with smallest period q and a length of
at least 2 q (and ``min_length``) that no neighbouring word extends.  Every run
holds a Lyndon word of length q, under the order of the words or under the
reverse order, that is the longest Lyndon word at its place.  So:

* ``lyndon_array`` is phase one of Baier's suffix sorting.  Suffixes stand in
  groups of equal Lyndon prefixes; the highest group is taken off again and
  again, and whatever stands before l copies of its prefix moves to a new group
  right above its own.  A group that is taken off has its final prefix, the
  longest Lyndon word at each of its places, so the phase yields the Lyndon
  array directly; it is run under both orders.
* each (place, root length) is extended to both sides by longest common
  extensions, looked up in ranks of all stretches of 1, 2, 4, ... words.

Both stages see only words covered by a stretch of half ``min_length`` words
that occurs twice in the document.  A run of length L >= max(min_length, 2q)
equals itself moved by q over L - q >= max(min_length / 2, q) words, so each of
its words is covered by such a stretch and no run is lost.  Stretches that are
not neighbours are kept apart by words that occur once.

The work is per document, in Arrow batches: linear but for sorting ranks, with
four bytes per covered word and doubling.

Defined cases: a null or empty text has no runs and an empty collapsed text;
rows that repeat give a row each; rows without a doc_id keep a null one; a text
that is one word over and over is one run; an empty table gives an empty
result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD, map_batches, text_or_empty

MIN_LENGTH = 12
RUN = "struct<start:long,length:long,period:long>"
RESULT = f"doc_id long, runs array<{RUN}>, collapsed string"
NONE = np.zeros((3, 0), dtype=np.int64)


def lyndon_array(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place."""
    n = len(symbols)
    found = [0] * n
    # blocks of the text that are left: neighbours by place, -1 and n outside
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    levels = sorted(set(symbols))
    number = {s: g for g, s in enumerate(levels)}
    group = [number[s] for s in symbols]
    members: list[list[int]] = [[] for _ in levels]
    for place, g in enumerate(group):
        members[g].append(place)
    above, below = list(range(1, len(levels) + 1)), list(range(-1, len(levels) - 1))
    if levels:
        above[-1] = -1
    top = len(levels) - 1
    while top >= 0:
        movers: dict[int, list[int]] = {}
        length = 0
        for place in members[top]:
            if group[place] != top:
                continue  # has moved up since
            if not length:
                length = right[place] - place
            found[place] = length
            before = left[place]
            if before >= 0 and group[before] == top:
                continue  # not the first of its copies
            after, copies = right[place], 1
            while after < n and group[after] == top:
                after = right[after]
                copies += 1
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                movers.setdefault(copies, []).append(before)
        for copies in sorted(movers, reverse=True):
            raised: dict[int, int] = {}
            for place in movers[copies]:
                old = group[place]
                new = raised.get(old)
                if new is None:
                    new = raised[old] = len(members)
                    members.append([])
                    above.append(above[old])
                    below.append(old)
                    below[above[old]] = new  # the top stands above every mover
                    above[old] = new
                members[new].append(place)
                group[place] = new
        members[top] = []
        top = below[top]
    return found


def _ranks(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int32)


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) * (int(second.max()) + 1) + second


def covered(ids: np.ndarray, width: int) -> np.ndarray:
    """Which words stand in a stretch of ``width`` words that occurs twice."""
    count = len(ids) - width + 1
    codes, done, bound = ids[:count].astype(np.int64), 1, int(ids.max()) + 1
    limit, size = bound, bound
    while done < width:
        if limit * size >= 1 << 62:
            codes = _ranks(codes).astype(np.int64)
            limit = count
        codes = codes * size + ids[done : done + count]
        limit *= size
        done += 1
    _, inverse, times = np.unique(codes, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[inverse] > 1)
    edges = np.bincount(twice, minlength=len(ids) + 1) - np.bincount(twice + width, minlength=len(ids) + 1)
    return np.cumsum(edges[:-1]) > 0


class Extensions:
    """Longest common extensions of pairs of places, to both sides."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.levels = [ids.astype(np.int32)]
        while 2 << (len(self.levels) - 1) <= self.n:
            size = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(_ranks(_paired(last[:-size], last[size:])))

    def forward(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many words from ``first`` and from ``second`` (the later ones) on agree."""
        total = np.zeros(len(first), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(second + total + (1 << k) <= self.n)
            same = self.levels[k][first[fits] + total[fits]] == self.levels[k][second[fits] + total[fits]]
            total[fits[same]] += 1 << k
        return total

    def backward(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many words before ``first`` (the earlier ones) and before ``second`` agree."""
        total = np.zeros(len(first), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            fits = np.flatnonzero(first - total - size >= 0)
            same = self.levels[k][first[fits] - total[fits] - size] == self.levels[k][second[fits] - total[fits] - size]
            total[fits[same]] += size
        return total


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """The runs of a sequence of word numbers: rows start, length, period, by start and period."""
    width = -(-min_length // 2)
    if len(ids) < max(min_length, 2):
        return NONE
    places = np.flatnonzero(covered(ids, width))
    if not len(places):
        return NONE
    # covered words in their order, a word of its own after each stretch
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    words = np.insert(ids[places].astype(np.int64), gaps, int(ids.max()) + 1 + np.arange(len(gaps)))
    places = np.insert(places, gaps, -1)
    words = _ranks(words)
    pairs = []
    for order in (words, int(words.max()) - words):
        lengths = np.array(lyndon_array(order.tolist()), dtype=np.int64)
        starts = np.arange(len(words))
        after = np.minimum(starts + lengths, len(words) - 1)
        # a run reaches beyond its root on one side at least
        left = (starts > 0) & (words[starts - 1] == words[starts + lengths - 1])
        right = (starts + lengths < len(words)) & (words[starts] == words[after])
        held = np.flatnonzero(left | right)
        pairs.append(starts[held] * (len(words) + 1) + lengths[held])
    first, period = np.divmod(np.unique(np.concatenate(pairs)), len(words) + 1)
    extensions = Extensions(words)
    start = first - extensions.backward(first, first + period)
    length = first + period + extensions.forward(first, first + period) - start
    long = length >= np.maximum(min_length, 2 * period)
    found = np.unique(np.stack([places[start[long]], period[long], length[long]]), axis=1)
    return found[[0, 2, 1]]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stand in no run, or only among the first period of words of runs."""
    start, length, period = runs
    edges = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edges[:n]) == 0


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))


def _find(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, texts = [], []
        for text in batch.column(1).to_pylist():
            words = text.encode("utf-8").split()  # ASCII white space
            found = runs_of(_numbered(words), min_length)
            if found.shape[1]:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), found))]
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.T.tolist()])
            texts.append(b" ".join(words).decode("utf-8"))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        columns = [batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])


def word_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, runs (by start, then period) and the text without the repeats of its runs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(texts, lambda batches: _find(batches, min_length), RESULT)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which every tenth, by crc32 of the doc_id, ends periodically.

    With h = crc32(doc_id), g = floor(h / 10) and n words: where h % 10 = 0 and
    n > 0, word i >= a becomes word a + (i - a) % p; a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).  Rows without a doc_id stay as they are.
    """
    edited = """array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE element_at(w, int(a + (i - a) % p + 1)) END), ' ')"""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    frame = frame.select("*", words.alias("w")).withColumn("n", F.size("w"))
    some = F.col("n") > 0
    g = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
    frame = frame.withColumn("g", F.when(some, g)).withColumn("a", F.when(some, F.expr("g % n")))
    frame = frame.withColumn("p", F.when(some, F.expr("1 + (n - a) div (3 + g % 8)")))
    return frame.select("doc_id", F.when(some, F.expr(edited)).otherwise(F.col("text")).alias("text"))


def run_lines(runs: str = "runs") -> Column:
    """Every run's ``start,length,period`` and a line feed."""
    lines = F.transform(F.col(runs), lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")


def longest_run(runs: str = "runs") -> Column:
    """The run of greatest length; ties go to the smallest start, then period (null where there is none)."""
    keyed = F.transform(F.col(runs), lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(keyed)
    return F.when(
        best.isNotNull(), F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"))
    )
