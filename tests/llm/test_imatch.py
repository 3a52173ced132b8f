"""Edited texts and successors exactly, fingerprints by their properties and by hand."""

import hashlib
import math
import re

import pytest
import xxhash
from scriptorium.llm import imatch


def check(frame):
    rows = frame.select("doc_id", "text").collect()
    found = imatch.fingerprint_edits(frame).collect()
    assert len(found) == len(rows)
    texts = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows})
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    if len({t[:2] for t in texts}) == len(texts):  # the order is that of doc_id alone
        for k, (none, doc_id, text) in enumerate(texts):
            after = texts[(k + 1) % len(texts)][2]
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            for r in by_doc[None if none else doc_id]:
                assert r.n_chars == len(text)
                assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
                assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in rows:
        got = {x.fingerprint for x in by_doc[r.doc_id] if x.n_chars == len(r.text or "")}
        prints.setdefault(r.text or "", set()).update(got if len(got) == 1 else ())
    assert all(len(p) <= 1 for p in prints.values())
    return found


def test_documents(docs, doc_rows):
    found = check(docs)
    near = [r.near_edited for r in found if r.n_chars > 400]
    assert sum(near) / len(near) > 10 * sum(r.near_next for r in found) / len(found)


def test_edges(edge_docs):
    check(edge_docs)


def test_order_without_repeats(spark):
    rows = [(9, "nine " * 9), (None, "last one of all"), (1, None), (4, "abcdefgh"), (70, "x")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_single_and_empty(spark, no_docs):
    assert imatch.fingerprint_edits(no_docs).collect() == []
    row = imatch.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_band(spark):
    texts = [f"common word{i % 20} rare{i}" for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {}
    for t in texts:
        for w in set(re.findall(r"\w+", t)):
            counts[w] = counts.get(w, 0) + 1
    expected = {w for w, n in counts.items() if n >= 2 and 2.0 <= math.log(200 / n) <= 5.5}
    assert {r.term for r in imatch.lexicon(frame).collect()} == expected == {f"word{i}" for i in range(20)}


def test_order_and_repeats_of_terms_do_not_matter(spark):
    words = [f"term{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(reversed(words)).upper() + " term7 term7", " ".join(words[:100]) + " unknown"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = imatch.in_subsets(spark.createDataFrame([(w,) for w in words], "term string"))
    prints = {r.doc_id: r.fp for r in imatch.fingerprints(frame, ["doc_id"], [], {"text": "fp"}, known).collect()}
    assert prints[0] == prints[1] != prints[2]
    same = sum(a == b and a is not None for a, b in zip(prints[0], prints[2], strict=True))
    assert 0 < same < len(imatch.RATES)


def plain_fingerprints(texts):
    """(fingerprint, edited fingerprint, near_edited, near_next) of each text, by definition."""
    def words_of(t):
        return {w for w in re.findall(r"[^\W_]+", t.lower())}

    def chain(words, seed=42):
        for w in sorted(words, key=lambda w: w.encode()):
            seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
        return seed >> 32

    counts = {}
    for t in texts:
        for w in words_of(t):
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if n >= 2 and imatch.MIN_IDF <= math.log(len(texts) / n) <= imatch.MAX_IDF}

    def member(w, k, rate):
        h = xxhash.xxh64(k.to_bytes(4, "little"), seed=xxhash.xxh64(w.encode(), seed=42).intdigest()).intdigest()
        return (h - (1 << 64) if h >> 63 else h) % rate == 0

    def fingerprint(t):
        subsets = [{w for w in words_of(t) & lexicon if member(w, k, r)} for k, r in enumerate(imatch.RATES)]
        rest = chain(words_of(t)) if words_of(t) else xxhash.xxh64(t.encode(), seed=42).intdigest() >> 32
        return [chain(s) if s else None for s in subsets] + [None if any(subsets) else rest]

    def near(a, b):
        used = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in used) / len(used)

    def shown(f):
        return "".join("." * 8 if h is None else f"{h:08x}" for h in f)

    own = [fingerprint(t) for t in texts]
    for k, t in enumerate(texts):
        after = (k + 1) % len(texts)
        cut = len(t) // 4
        edited = fingerprint(t[: len(t) - cut] + texts[after][:cut])
        yield shown(own[k]), shown(edited), near(own[k], edited), near(own[k], own[after])


def test_fingerprints_by_definition(spark, doc_rows):
    """Whole results against plain Python: lexicon, subsets, hashes, likeness."""
    texts = [r[1] or "" for r in sorted({(r.doc_id, r.text) for r in doc_rows if r.doc_id is not None})][:150]
    texts += ["", "?!", texts[0], "one word"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in imatch.fingerprint_edits(frame).collect()}
    for k, (own, other, near_edited, near_next) in enumerate(plain_fingerprints(texts)):
        row = found[k]
        assert (row.fingerprint, row.edited_fingerprint) == (own, other)
        assert row.near_edited == pytest.approx(near_edited) and row.near_next == pytest.approx(near_next)
    assert sum("." * 8 * len(imatch.RATES) not in r.fingerprint for r in found.values()) > 100


def test_equal_rows_give_equal_rows(spark):
    n = imatch.COPIES + 5
    frame = spark.range(n).selectExpr("1L AS doc_id", "'the same text of one document' AS text")
    found = imatch.fingerprint_edits(frame).collect()
    assert len(found) == n and len(set(found)) == 1
