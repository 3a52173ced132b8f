"""Base spans against the contract's patterns; bootstrapping on a corpus made for it."""

import hashlib
import re

from scriptorium.llm import pii

ODD = [
    "a@b.c_x@d.e", "x@@y.z a.b@c-d.e.f.", "@ a@ @b.c a@b", "1.2.3.4.5 999.1.1.1 1.2.3 001.002.003.255 1.2.3.256", "1..2.3.4",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 4111111111111111 12345678901234567890", "0 0 0 0 0 0 0 0 0 0 0 0 0", "4111  1111 1111 1111",
    "+1 (988) 555-2485. +12 +1() +1 2 3 +49.30.1234567890123456", "++1 234 567 8901+2 345 678 9012", "١٢٣ +1 ٤٥٦ 7.7.7.7",
    "é@é.é x" * 50 + "z@q.rr", "7" * 5000, "a" * 5000 + "@", "9 " * 3000, "x@y." + "z." * 3000,
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_base(text):
    kinds = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    spans = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                k == 0
                or (k == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (k == 2 and 13 <= len(digits) <= 19 and luhn(digits))
                or (k == 3 and 9 <= len(digits) <= 15)
            )
            if ok:
                spans.append((k, m.start(), m.end()))
    return sorted(spans)


def slow_tokens(text):
    """(start, end, pattern, identifier, is_seed) of each word with a digit or an at-sign that begins no earlier than its seed."""
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\t-\r]+", text)]
    base, tokens = slow_base(text), []
    for n, (start, word) in enumerate(words):
        inner = word.lstrip(pii.LEAD)
        start += len(word) - len(inner)
        inner = inner.rstrip(pii.TRAIL)
        end = start + len(inner)
        if not re.search("[0-9@]", word) or not inner or any(a < start < b for _, a, b in base):
            continue
        before = (["^", "^"] + [w.lower() for _, w in words[:n]])[-2:]
        tokens.append((start, end, " ".join(before), inner.lower(), any(a < end and start < b for _, a, b in base)))
    return tokens


def slow_contexts(texts, rounds=3, min_seeds=3, confidence=0.8):
    """Per text: the tokens that bootstrapping discovers, by plain loops over the graph."""
    tokens = [slow_tokens(t) for t in texts]
    count, seed = {}, {}
    for _, _, pattern, identifier, is_seed in (t for row in tokens for t in row):
        edge = pattern, identifier
        count[edge] = count.get(edge, 0) + 1
        seed[edge] = max(seed.get(edge, 0.0), float(is_seed))
    score, belief = dict(seed), {}
    for _ in range(rounds):
        belief = {}
        for pattern in {p for p, _ in count}:
            edges = [e for e in count if e[0] == pattern]
            if sum(seed[e] > 0 or score[e] >= confidence for e in edges) >= min_seeds:
                belief[pattern] = sum(count[e] * score[e] for e in edges) / (sum(count[e] for e in edges) + 1)
        after = {}
        for identifier in {i for _, i in count}:
            edges = [e for e in count if e[1] == identifier]
            held = [e for e in edges if e[0] in belief]
            passed = sum(count[e] * belief[e[0]] for e in held) / sum(count[e] for e in held) if held else 0.0
            after[identifier] = max(passed, max(seed[e] for e in edges))
        score = {e: after[e[1]] for e in count}
    sure = {p for p, b in belief.items() if b >= confidence}
    return [[(4, a, b) for a, b, pattern, _, is_seed in row if pattern in sure and not is_seed] for row in tokens]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def check(frame, rows):
    found = pii.extract(frame).withColumn("spans", pii.spans_text()).collect()
    expected = []
    contexts = slow_contexts([text or "" for _, text in rows])
    for (doc_id, text), context in zip(rows, contexts, strict=True):
        base = slow_base(text or "")
        counts = [sum(s[0] == k for s in base) for k in range(4)]
        expected.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + sorted(context))))
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    return found


def test_documents(docs, doc_rows):
    check(docs, [(r.doc_id, r.text) for r in doc_rows])


def test_odd_texts(spark):
    rows = list(enumerate(ODD))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_edges(edge_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert pii.extract(no_docs).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    seeds = [f"filler words mail me at user{i}@host.example today" for i in range(30)]
    unseen = ["more text mail me at «user99(at)host», thanks", "nothing personal about 42 things", "we met at 10 today"]
    rows = list(enumerate(seeds + unseen))
    found = {r.doc_id: r.spans for r in check(spark.createDataFrame(rows, "doc_id long, text string"), rows)}
    text = unseen[0]
    assert found[30] == f"context:{text.index('«')}:{text.index(',')}"
    assert found[31] == "" and found[32] == ""


def test_scores_travel_through_identifiers(spark):
    # "badge number" never stands before a seed, but before identifiers that stand behind a confident pattern
    rows = [f"write to {i}x{i}@h.example now" for i in range(40)]
    tokens = pii.candidates(pii.occurrences(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))[1])
    confident = {r.pattern for r in pii.confident_patterns(tokens).collect()}
    assert confident == {"write to"}


def test_random_corpora_by_plain_loops(spark):
    random = __import__("random").Random(11)
    leads = ["write to", "mail me", "badge number", "room", "on day", "code is"]
    total = 0
    for share in (0.3, 0.6, 0.95):
        rows = []
        for n in range(120):
            words = []
            for _ in range(random.randrange(1, 9)):
                lead = random.choice(leads)
                value = f"u{n}{random.randrange(50)}@h{random.randrange(9)}.example" if random.random() < share and "o" in lead else f"{random.choice('XYZ')}{random.randrange(25)}"
                words += [lead, random.choice(["", "(", "«"]) + value + random.choice(["", ",", ")."])]
            rows.append((n, " ".join(words) if n % 17 else None))
        found = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
        total += sum("context" in r.spans for r in found)
    assert total > 20


def test_second_hop_patterns_become_confident(spark):
    # no seed ever follows "badge number", but identifiers that stand behind the seeds' pattern do
    seeds = [f"write to {i}x{i}@h.example now" for i in range(200)]
    first = [f"write to X{i} now" for i in range(20)]
    second = [f"badge number X{i}" for i in range(20)] + ["badge number Y7", "badge pin Y8"]
    rows = list(enumerate(seeds + first + second))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = pii.candidates(pii.occurrences(frame)[1])
    assert {r.pattern for r in pii.confident_patterns(tokens).collect()} == {"write to", "badge number"}
    found = {r.doc_id: r.spans for r in pii.extract(frame).withColumn("spans", pii.spans_text()).collect()}
    assert found[240] == "context:13:15" and found[241] == ""


def test_patterns_are_the_last_two_words(spark):
    long_word = "w" * 60
    texts = [
        "Room 12 code X9", "a 1 2 b 3", "1 2 3 \t4", "code" + " " * 80 + "is \n" + " " * 90 + "X8", f"{long_word} {long_word} 5 ",
        "call +1 (988) 555-2485 or pay 4111 1111 1111 1111 till 7", "ΟΔΟΣ  Σ 6",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, spans = pii.occurrences(frame)
    rows, spans = pii.staged(rows, "rows"), pii.staged(spans, "spans")
    found = pii.candidates(spans).join(rows, "row_id").orderBy("doc_id", "start").collect()
    got = [[(r.pattern, r.identifier, r.seed) for r in found if r.doc_id == i] for i in range(len(texts))]
    assert got[0] == [("^ room", "12", False), ("12 code", "x9", False)]
    assert got[1] == [("^ a", "1", False), ("a 1", "2", False), ("2 b", "3", False)]
    assert got[2] == [("^ ^", "1", False), ("^ 1", "2", False), ("1 2", "3", False), ("2 3", "4", False)]
    assert got[3] == [("code is", "x8", False)]
    assert got[4] == [(f"{long_word} {long_word}", "5", False)]
    assert got[5] == [("^ call", "+1", True), ("or pay", "4111", True), ("1111 till", "7", False)]
    assert got[6] == [("οδος σ", "6", False)]
