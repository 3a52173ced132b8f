"""Encoding and decoding against the tokenizers library."""

import hashlib
import sys

import public_tokenizers
from tokenizers import Tokenizer

from scriptorium.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(text):
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    spelled = " ".join(map(str, ids))
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(frame, lexicon_words):
    rows = frame.select("doc_id", "text").collect()
    found = bpe.encode(frame, PATH, lexicon_words=lexicon_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(((r.doc_id, *expected(r.text)) for r in rows), key=key)


def test_documents(docs):
    check(docs, bpe.LEXICON_WORDS)


def test_edges_and_small_lexicon(edge_docs):
    check(edge_docs, 10)


def test_empty(no_docs):
    assert bpe.encode(no_docs, PATH).collect() == []


def test_odd_texts(spark):
    texts = [
        "İstanbul ΑΣ ΑΣ. KKelvin ﬁ é  x y\x1cz\x85q", "a" * 3000, "\U0001f600‍\U0001f525!!!???", "''s 'll'd",
        "<|startoftext|>x<|endoftext|><|endoftext", "<|ENDOFTEXT|> <|endoftext|> q<|EndOfText|>", "１２３ ½ ⅷ 中文字 ไทย", "\x00\x01 �",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(frame, 5)


def test_real_outputs(spark):
    frame = spark.createDataFrame([(1, "Hello hello world")], "doc_id long, text string")
    row = bpe.encode(frame, PATH, keep_texts=True).first()
    assert row.ids == Tokenizer.from_file(PATH).encode("hello hello world", add_special_tokens=False).ids
    assert row.decoded == "hello</w> hello</w> world</w>"


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {"tap": [1, 2], "taps": [3], "top": [4], "tops": [5, 6, 7], "s": [8], "": [9], "straße": [10]}
    file = tmp_path / "lexicon.bin"
    file.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(file))
    asked = ["tap", "taps", "top", "tops", "s", "straße", "ta", "tapsx", "x", "", "topsy", "str"]
    assert lexicon.find(asked) == [[1, 2], [3], [4], [5, 6, 7], [8], [10], None, None, None, None, None, None]
    # tap/top share the states after their vowel; "", t, ta|to, tap|top, s-end and the path of straße remain
    assert len(lexicon.final) == 4 + 1 + len("traße".encode())


def coder(tmp_path, words):
    vocabulary = bpe.Vocabulary(PATH)
    file = tmp_path / f"{len(words)}.bin"
    file.write_bytes(bpe.compile_lexicon(dict(zip(words, vocabulary.merge(words), strict=True))))
    return bpe.Coder(vocabulary, bpe.Lexicon(str(file)))


def rows(parts):
    digest = lambda t: hashlib.sha256(t.as_py().encode()).hexdigest()
    return [(n, digest(i), digest(d)) for ns, ids, texts in parts for n, i, d in zip(ns, ids, texts, strict=True)]


def test_pieces_are_not_taken_one_by_one(tmp_path):
    words = [a + b for a in "abcdefghij" for b in ("nder", "ing", "tion", "ous", "ly", "ment", "e", "ist", "hood", "ness")]
    texts = [" ".join(f"{a}-{b}" for b in words) for a in words]  # 10,000 different pieces
    encoder = coder(tmp_path, words)
    calls = 0

    def count(frame, event, argument):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        parts = list(encoder.encode(texts))
    finally:
        sys.setprofile(None)
    assert calls < 5000
    assert rows(parts) == [expected(t) for t in texts]


def test_a_few_texts_at_a_time(tmp_path, monkeypatch):
    texts = [
        "", "the end", " \n ", "", "the<|endoftext|>the the.the", "<|endoftext|><|startoftext|>", "it's 'llama ''s\x1cnot", "a b" * 90,
        "x" * 70 + " " + "日本" * 30, "<|ENDOFTEXT|>", "the", "\ufeff\u200b", "",
    ]
    encoder = coder(tmp_path, ["the", "end"])
    for characters in (0, 1, 12, 10_000):
        monkeypatch.setattr(bpe, "CHARACTERS_AT_ONCE", characters)
        assert rows(encoder.encode(texts)) == [expected(t) for t in texts]
    assert coder(tmp_path, []).lexicon.find(["the", ""]) == [None, None]
    assert encoder.lexicon.find(["", ""]) == [None, None]
