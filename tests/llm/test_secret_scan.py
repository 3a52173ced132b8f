"""Base spans against the contract's patterns, linking against all pairs, redaction against the spans."""

import hashlib
import re

from scriptorium.llm import secret_scan

WEAK = "aB3dE6gH9jK2mN5pQ8sT1vW4"
KEY = "AKIA" + "Z" * 16
TEXTS = [
    f"{KEY} {WEAK}", f"{WEAK}", f"{KEY} " + "x " * 300 + WEAK, f"see https://host.example/a and {WEAK}", "https://host.example/a",
    f"https://h.example/x {KEY} password='hunter22'", "PassWord=abc123 SECRET : zzzzz token=ab api-key=123456 apikey=1234567 apı_key=999999",
    "api_key=\"abcdef\" passwd:' abc' tokentoken=abcdef.=/", "f" * 24 + " " + "0a" * 11 + " AKIA" + "0" * 15 + " AKIAAKIA" + "A" * 14,
    None, "", "ſecret=abcdefgh Key",
]


def slow_base(text):
    kinds = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    spans = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(spans)


def slow_parts(text):
    """(start, kind, end) of every part: base spans, random-looking tokens outside the others, addresses."""
    parts = [(a, k, b) for a, k, b, _ in slow_base(text)]
    schemes = "https?|s3|ftp|postgres|mysql|redis|amqp"
    parts += [(m.start(), 4, m.end()) for m in re.finditer(rf"(?<!\w)(?:{schemes})://[^\x20\t-\r\"'<>]+", text)]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        kinds = [re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")]
        if re.fullmatch("[A-Za-z0-9+/_-]{20,}={0,2}", m[0]) and all(kinds) and len(set(m[0])) >= 12:
            if not any(a < m.end() and m.start() < b for a, k, b in parts if k != 3):
                parts.append((m.start(), 3, m.end()))
    return sorted(parts)


def slow_spans(text, scope=400):
    """All pairs of parts, by the characters between them."""
    parts, found = slow_parts(text), []
    for a, kind, b in parts:
        near = {k for c, k, d in parts if max(c - b, a - d, 0) <= scope}
        secret = bool(near & {0, 2, 3})
        if kind < 3 or (kind == 3 and near & {1, 4}) or (kind == 4 and 1 in near and secret):
            found.append((a, kind, b))
    return found


def slow_masked(text):
    """Each group of overlapping spans as one mark."""
    groups = []
    for a, _, b in slow_spans(text):
        if groups and a < groups[-1][1]:
            groups[-1][1] = max(b, groups[-1][1])
        else:
            groups.append([a, b])
    for a, b in reversed(groups):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def slow_links(text):
    return secret_scan.joined(slow_spans(text))


def check(frame, rows):
    found = secret_scan.scan(frame).withColumn("spans", secret_scan.spans_text()).collect()
    expected = []
    for doc_id, text in rows:
        text = text or ""
        base = slow_base(text)
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base)
        spans = slow_links(text)
        expected.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), spans))
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[5])
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    return got


def test_documents(docs, doc_rows):
    check(docs, [(r.doc_id, r.text) for r in doc_rows])


def test_edges(edge_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert secret_scan.scan(no_docs).collect() == []


def test_linking(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    spans = {r[0]: r[5] for r in check(frame, list(enumerate(TEXTS)))}
    assert spans[0] == "access:0:20,weak:21:45"
    assert spans[1] == ""
    assert spans[2] == "access:0:20"  # out of scope
    assert spans[3].startswith("weak:")  # an address in scope; the address itself lacks an identifier
    assert spans[4] == ""
    assert "endpoint:0:19" in spans[5] and "assign:" in spans[5] and "access:" in spans[5]


def test_redaction(spark):
    frame = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long")
    for r in secret_scan.redact(frame).collect():
        original = TEXTS[r.doc_id]
        spans = slow_spans(original or "")
        assert r.text == (None if original is None else slow_masked(original))
        if not spans:
            assert r.text == original and r.n_chars == (None if original is None else len(original))
            continue
        assert r.n_chars == len(r.text)
        assert all(original[a:b] not in r.text for a, _, b in spans)
        assert "[SECRET]" in r.text


def test_long_weak_tokens(spark):
    token = (WEAK * 13)[:300]
    texts = [f"{KEY} {token} x", f"{KEY} {token}== x", f"{KEY} {token}=== x", f"{token} at s3://bucket/x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r[0]: r[5] for r in check(frame, list(enumerate(texts)))}
    assert spans[0] == "access:0:20,weak:21:321"
    assert spans[1] == "access:0:20,weak:21:323"
    assert spans[2] == "access:0:20"
    assert spans[3] == "weak:0:300"
    assert token not in "".join(r.text for r in secret_scan.redact(frame.where("doc_id <> 2")).collect())


def test_links_by_the_gap_between_parts(spark):
    url, filler, random = "https://h.example/" + "p" * 600, " -" * 195, __import__("random").Random(3)
    texts = [f"{url} {KEY} {WEAK}", f"token={'x' * 500} {url} {KEY}", f"{KEY} {'0a' * 20} https://h.example/x"]
    texts += [f"{KEY}{' ' * n}{WEAK}" for n in (400, 401)] + [f"{WEAK}{' ' * n}{KEY}" for n in (400, 401)]
    pieces = [url, KEY, WEAK, WEAK * 20, filler, filler, "secret=" + "y" * 450, "0a" * 300, "s3://b/k"]
    texts += [" ".join(random.choice(pieces) for _ in range(random.randrange(2, 12))) for _ in range(150)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r[0]: r[5] for r in check(frame, rows)}
    assert spans == {i: slow_links(t) for i, t in rows}
    assert "endpoint" in spans[0] and "weak" in spans[0] and "endpoint" in spans[1] and "endpoint" in spans[2]
    assert ["weak" in spans[i] for i in range(3, 7)] == [True, False, True, False]
