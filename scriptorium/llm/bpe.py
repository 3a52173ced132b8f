"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Spark counts the words of the whole corpus; the most frequent ones are merged
once and compiled into a minimal acyclic automaton (equal suffixes are shared)
whose paths number the words, and the number selects the word's ids.  The
automaton is one flat file: it is written to the shared folder, fetched once
per executor and memory-mapped by its workers.  Words it does not hold are
merged exactly, by rank.

Texts are taken some megabytes at a time.  What stands between white space is a
piece; the pieces of all these texts are looked up together, each different one
once, and Arrow puts the results back in the texts' order.  Nothing is kept
from one lot of texts to the next.

The vocabulary file must be a ``tokenizers`` BPE over byte characters with a
word-end suffix, NFC + lower-case normalisation, and a splitting pattern whose
matches are the words (``public_tokenizers`` ``word_bpe_49k.json``).

Null and empty texts have no tokens; the text of an empty id list is empty.
The tokenizer's own special tokens, where they stand in a text, become their
ids, as the tokenizers library does.  Repeated rows give repeated results, an
empty table an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, staged, text_or_empty
from scriptorium.session import scratch_dir

LEXICON_WORDS = 262_144
SHORT_WORD = 64
WORDS_AT_ONCE = 20_000
CHARACTERS_AT_ONCE = 4_000_000
NO_ID = -1
NO_RANK = 2**40
# Python's split() takes these for white space, Unicode's White_Space property does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
ENCODE_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    place = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in place)
    place.update({b: chr(256 + n) for n, b in enumerate(hidden)})
    return [place[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and splitting rule of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.large_string())  # by id
        self.numerals = pa.array([str(i) for i in range(len(self.tokens))], pa.large_string())
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[int, tuple[int, int]] = {}  # left id << 32 | right id -> (rank, merged id)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.ids[left] << 32 | self.ids[right], (rank, self.ids[left + right]))
        self.pairs = np.array(sorted(self.merges), dtype=np.int64)
        self.rank_of = np.array([self.merges[p][0] for p in self.pairs.tolist()], dtype=np.int64)
        self.merged_by = np.zeros(len(model["merges"]), dtype=np.int64)  # by rank
        for rank, merged in self.merges.values():
            self.merged_by[rank] = merged
        characters = byte_characters()
        self.inner = np.array([self.ids.get(c, NO_ID) for c in characters], dtype=np.int64)
        self.ending = np.array([self.ids.get(c + self.suffix, NO_ID) for c in characters], dtype=np.int64)
        splits = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        marks = "|".join(map(regex.escape, self.special))
        self.marks = regex.compile(f"({marks})")
        self.words_and_ends = regex.compile(rf"\n(?:{marks})|{pattern}|\x20")  # of pieces, a space after each

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: lowest rank first, leftmost first among equal ranks.

        Short words are merged together, one merge of every word at a time.
        """
        spelled = [w.encode("utf-8") for w in words]
        out: list[list[int]] = [[] for _ in words]
        by_width: dict[int, list[int]] = {}
        for k, s in enumerate(spelled):
            by_width.setdefault(max(8, 1 << (len(s) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            for at in range(0, len(members), WORDS_AT_ONCE):
                some = members[at : at + WORDS_AT_ONCE]
                ids, ends = self._characters([spelled[k] for k in some])
                if width <= SHORT_WORD:
                    merged = self._merge_rows(ids, np.diff(ends), width)
                else:
                    merged = [self._merge_by_queue(ids[a:b].tolist()) for a, b in pairwise(ends)]
                for k, own in zip(some, merged, strict=True):
                    out[k] = own
        return out

    def _characters(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words' characters, one word after the other, and where words start and end there."""
        data = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        ends = np.cumsum([0, *map(len, spelled)])
        ids = self.inner[data]
        ids[ends[1:] - 1] = self.ending[data[ends[1:] - 1]]
        held = ids != NO_ID
        return ids[held], np.append(0, np.cumsum(held))[ends]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.rank_of[at], NO_RANK)

    def _merge_rows(self, starts: np.ndarray, lengths: np.ndarray, width: int) -> list[list[int]]:
        ids = np.full((len(lengths), width + 1), NO_ID, dtype=np.int64)  # the last column stays empty
        ids[np.arange(width + 1) < lengths[:, None]] = starts
        ranks = np.full((len(lengths), width + 1), NO_RANK, dtype=np.int64)
        ranks[:, :width] = self._rank(ids[:, :-1], ids[:, 1:])
        done = ids.copy()
        rows, columns = np.arange(len(lengths)), np.arange(width)
        while len(rows):
            place = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            least = ranks[k, place]
            more = least < NO_RANK
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, ranks, place, least = rows[more], ids[more], ranks[more], place[more], least[more]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            ids[k, place] = self.merged_by[least]
            after = columns[None, :] + (columns[None, :] > place[:, None])
            ids[:, :width] = np.take_along_axis(ids, after, axis=1)
            # the merged pair's rank and those of its neighbours change, the others move up
            shifted = columns[None, :] + (columns[None, :] >= place[:, None])
            ranks[:, :width] = np.take_along_axis(ranks, shifted, axis=1)
            ranks[k, place] = self._rank(ids[k, place], ids[k, place + 1])
            inside = np.flatnonzero(place > 0)
            ranks[inside, place[inside] - 1] = self._rank(ids[inside, place[inside] - 1], ids[inside, place[inside]])
        held = done != NO_ID
        merged, ends = done[held].tolist(), np.cumsum([0, *held.sum(axis=1)]).tolist()
        return [merged[a:b] for a, b in pairwise(ends)]

    def _merge_by_queue(self, ids: list[int]) -> list[int]:
        """The same for one long word, in n log n steps."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []  # rank, place, pair

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (pair := ids[i] << 32 | ids[after[i]]) in merges:
                heapq.heappush(queue, (merges[pair][0], i, pair))

        for i in range(n):
            offer(i)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] == NO_ID or j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = merges[pair][1], NO_ID
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i != NO_ID]

    def pieces(self, text: str) -> str:
        """The text with its pieces one space apart: runs without white space, and special tokens after a line feed."""
        pieces: list[str] = []
        for k, part in enumerate(self.marks.split(text) if "<|" in text else [text]):
            if k % 2:
                pieces.append("\n" + part)
            else:
                # lower-casing is by character: the capital sigma has one form
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                pieces += self.words.findall(part) if SEPARATORS.search(part) else part.split()
        return " ".join(pieces)


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words, with their ids, as one flat file.

    Words are added in byte order; a state whose subtree is finished is
    replaced by an equal one seen before, so equal suffixes share states.  An
    edge carries the number of words that sort before its subtree within its
    state: the sum along a path is the word's number.
    """
    entries = sorted((w.encode("utf-8"), ids) for w, ids in words.items() if w)
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    spare: list[int] = []  # numbers of states that turned out equal to earlier ones
    path: list[tuple[int, int]] = []  # (parent, byte) of the unfinished states

    def finish(depth: int) -> None:
        while len(path) > depth:
            parent, byte = path.pop()
            child = edges[parent][byte]
            same = known.setdefault((final[child], tuple(edges[child].items())), child)
            if same != child:
                edges[parent][byte] = same
                edges[child], final[child] = {}, False
                spare.append(child)

    last = b""
    for word, _ in entries:
        common = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        finish(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            if spare:
                child = spare.pop()
            else:
                child = len(edges)
                edges.append({})
                final.append(False)
            edges[state][byte] = child
            path.append((state, byte))
            state = child
        final[state] = True
        last = word
    finish(0)

    live, stack = {0: 0}, [0]
    while stack:
        for child in edges[stack.pop()].values():
            if child not in live:
                live[child] = len(live)
                stack.append(child)
    counts: dict[int, int] = {}
    for state in live:
        stack = [state]
        while stack:
            top = stack[-1]
            todo = [c for c in edges[top].values() if c not in counts]
            if todo:
                stack += todo
            else:
                counts[top] = final[top] + sum(counts[c] for c in edges[top].values())
                stack.pop()
    rows = []
    for state, number in live.items():
        ahead = int(final[state])
        for byte, child in sorted(edges[state].items()):
            rows.append((number * 256 + byte, live[child], ahead))
            ahead += counts[child]
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    ends = np.zeros(len(live), dtype=np.int64)
    for state, number in live.items():
        ends[number] = final[state]
    offsets = np.cumsum([0, *(len(ids) for _, ids in entries)], dtype=np.int64)
    pool = np.array([i for _, ids in entries for i in ids], dtype=np.int64)
    parts = [np.ascontiguousarray(table[:, k]) for k in range(3)] + [ends, offsets, pool]
    return b"".join(p.tobytes() for p in [np.array([len(p) for p in parts], dtype=np.int64), *parts])


class Lexicon:
    """A compiled lexicon file, memory-mapped; looks up many words at once."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, dtype=np.int64, mode="r"))  # still mapped; plain arrays index faster
        sizes = data[:6].tolist()
        starts = np.cumsum([6, *sizes]).tolist()
        self.keys, self.targets, self.ahead, self.final, offsets, pool = (
            data[a : a + n] for a, n in zip(starts, sizes, strict=False)
        )
        self.ids = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(pool))  # by word number

    def look_up(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """Ids of each word, null for words that are not in the lexicon."""
        if not len(words) or not len(self.keys):
            return pa.nulls(len(words), self.ids.type)
        ends, flat = (np.frombuffer(b, kind) for b, kind in zip(words.buffers()[1:], (np.int64, np.uint8), strict=True))
        starts = ends[words.offset : words.offset + len(words)]
        lengths = ends[words.offset + 1 : words.offset + 1 + len(words)] - starts
        state = np.zeros(len(words), dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        alive = np.arange(len(words))
        depth = 0
        while len(alive := alive[lengths[alive] > depth]):
            key = state[alive] * 256 + flat[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            number[alive] += self.ahead[at]
            state[alive] = self.targets[at]
            depth += 1
        found = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) & (lengths > 0)
        return self.ids.take(pa.array(number, mask=~found))

    def find(self, words: list[str]) -> list[list[int] | None]:
        """The same as lists."""
        return self.look_up(pa.array(words, pa.large_string())).to_pylist()


def joined(offsets: np.ndarray, parts: pa.Array) -> pa.LargeStringArray:
    """The strings between every two offsets, joined by a space."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), parts), pa.scalar(" ", pa.large_string()))


class Coder:
    """Encodes and decodes texts in one worker process."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def word_ids(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """Ids of each word, from the lexicon, or else merged."""
        v = self.vocabulary
        known = self.lexicon.look_up(words)
        unseen = np.flatnonzero(known.is_null())
        spelled = words.take(pa.array(unseen)).to_pylist()
        merged = [[v.special[w[1:]]] if w[0] == "\n" else ids for w, ids in zip(spelled, v.merge(spelled), strict=True)]
        place = np.arange(len(words))
        place[unseen] = len(words) + np.arange(len(unseen))
        return pa.concat_arrays([known, pa.array(merged, known.type)]).take(pa.array(place))

    def piece_ids(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, pa.Array]:
        """Ids of all the pieces, one after the other, and where each piece starts and ends there."""
        together = joined(np.array([0, len(pieces)]), pieces)[0].as_py() + " "
        found = pa.array(self.vocabulary.words_and_ends.findall(together), pa.large_string())
        end = pc.equal(found, " ")
        ends = np.flatnonzero(end) - np.arange(len(pieces))  # in words
        coded = found.filter(pc.invert(end)).dictionary_encode()
        ids = self.word_ids(coded.dictionary).take(coded.indices)
        return ids.offsets.to_numpy()[np.append(0, ends)], ids.values

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, pa.LargeStringArray, pa.LargeStringArray]]:
        """Numbers of tokens, ids joined by a space and decoded texts, of some of the texts at a time."""
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= CHARACTERS_AT_ONCE):
                held += len(texts[to])
                to += 1
            yield self._encode_together(texts[at:to])
            at = to

    def _encode_together(self, texts: list[str]) -> tuple[np.ndarray, pa.LargeStringArray, pa.LargeStringArray]:
        v = self.vocabulary
        split = pc.split_pattern(pa.array(map(v.pieces, texts), pa.large_string()), " ")
        texts_at, of_texts = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
        pieces_at, ids = self.piece_ids(of_texts.dictionary)
        lengths = np.diff(pieces_at)[of_texts.indices.to_numpy()]
        spelled, decoded = (
            joined(texts_at, joined(pieces_at, names.take(ids)).take(of_texts.indices)) for names in (v.numerals, v.tokens)
        )
        return np.diff(np.cumsum(np.append(0, lengths))[texts_at]), spelled, decoded


def sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())


@lru_cache(maxsize=2)
def worker_coder(tokenizer: str, lexicon_file: str) -> Coder:
    return Coder(Vocabulary(tokenizer), Lexicon(SparkFiles.get(lexicon_file)))


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent letter runs of the whole corpus, ``words`` at most.

    Words are taken by count: the least count at which they are not too many is
    found on the counts' histogram, so only the words kept reach the driver.
    """
    runs = F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    counts = staged(docs.select(runs).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    histogram = counts.groupBy("n").agg(F.count("*").alias("words"))
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = histogram.withColumn("upto", upto).where(F.col("upto") <= words).agg(F.min("n")).first()[0]
    return [r.word for r in counts.where(F.col("n") >= least).select("word").collect()] if least else []


def publish_lexicon(spark: SparkSession, content: bytes) -> str:
    """Write the lexicon file to the shared folder and have executors fetch it; its name."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, "lexicon") + ".bin")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(content)
    out.close()
    sc.addFile(path.toString())
    return path.getName()


def encode(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS, keep_texts: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256; with
    ``keep_texts`` also the ids (array) and the decoded text themselves.
    Columns of ``docs`` other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer)
    words = frequent_words(docs, lexicon_words)
    name = publish_lexicon(spark, compile_lexicon(dict(zip(words, vocabulary.merge(words), strict=True))))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep_texts else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(tokenizer, name)
        for batch in batches:
            at = 0
            for n_tokens, ids, decoded in coder.encode(batch.column(1).to_pylist()):
                columns = [batch.column(0).slice(at, len(ids)), pa.array(n_tokens, pa.int64()), sha256(ids), sha256(decoded)]
                if keep_texts:
                    numbers = [[int(i) for i in t.split()] for t in ids.to_pylist()]
                    columns += [pa.array(numbers, pa.list_(pa.int32())), decoded.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(ids)

    schema = ENCODE_SCHEMA + (", ids array<int>, decoded string" if keep_texts else "")
    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, schema)
