"""Secret scanning with multipart credential linking.

Base spans (assignments, access identifiers, long hex runs) are always
reported.  Weak candidates are parts that mean little alone: random-looking
tokens (kind ``weak``) and service addresses (kind ``endpoint``).  An interval
join decides: two parts are linked if at most ``scope`` code points lie between
them (none where they touch or overlap).  A token is reported where it is
linked to an access identifier or an address, an address where it is linked to
both an identifier and a secret part (token, assignment or hex run).  The join
is a running window over both edges of a document's parts: of the parts that
start before the end of one's scope, the furthest end decides, so no pairs are
emitted.

Spans are code points, end exclusive, of whole texts.  Null texts count as
empty; repeated rows give repeated results; doc_id is carried, never a key.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, staged, text_or_empty, with_row_id

SCOPE = 400
KINDS = ("assign", "access", "hex", "weak", "endpoint")
SECRET_PARTS = (0, 2, 3)
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ that are long enough
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|s3|ftp|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]+""")
MIN_SECRET, MIN_ACCESS = 6, 20
SCAN_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string,"
    " base array<struct<start:long,kind:int,end:long>>, parts array<struct<start:long,kind:int,end:long>>"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kinds are indexes of KINDS."""
    spans = []
    folded = text.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_SECRET]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def looks_random(token: str) -> bool:
    """Digits, capitals and small letters mixed, and few characters repeated."""
    return (
        any(c.isdigit() for c in token)
        and any(c.isupper() for c in token)
        and any(c.islower() for c in token)
        and len(set(token)) >= 12
    )


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates outside base spans; none where no complementary part can be near."""
    addresses = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not addresses and not any(kind == 1 for _, kind, _ in base):
        return []
    taken = sorted((s, e) for s, _, e in [*base, *addresses])
    tokens, k = [], 0
    for m in WEAK.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if (k == len(taken) or taken[k][0] >= m.end()) and looks_random(m[0]):
            tokens.append((m.start(), 3, m.end()))
    return sorted(tokens + addresses)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py()
            base = base_spans(text)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            weak = weak_parts(text, base)
            parts = base + weak if weak else []
            as_rows = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in (base, parts)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), *as_rows))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, span]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of (row_id, start, kind, end) whose complementary parts stand in scope."""
    # each part counts from its start on; a weak candidate asks where its scope ends, after the parts that start there
    own = F.struct(F.col("start").alias("at"), F.lit(False).alias("asks"))
    asking = F.struct((F.col("end") + scope).alias("at"), F.lit(True).alias("asks"))
    edges = F.when(F.col("kind") >= 3, F.array(own, asking)).otherwise(F.array(own))
    placed = parts.withColumn("edge", F.explode(edges)).select("row_id", "start", "kind", "end", "edge.*")
    so_far = Window.partitionBy("row_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)

    def seen(*kinds: int):
        furthest = F.max(F.when(~F.col("asks") & F.col("kind").isin(*kinds), F.col("end"))).over(so_far)
        return F.coalesce(furthest >= F.col("start") - scope, F.lit(False))

    marked = placed.withColumns({"access": seen(1), "address": seen(4), "hidden": seen(*SECRET_PARTS)})
    supported = F.when(F.col("kind") == 3, F.col("access") | F.col("address")).when(
        F.col("kind") == 4, F.col("access") & F.col("hidden")
    )
    return marked.where(F.col("asks") & supported).select("row_id", "start", "kind", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, counts, base_sha256 and ``found``, all reported spans by start and kind."""
    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = staged(with_row_id(map_batches(source, _scan, SCAN_SCHEMA), "row_id"), "secret-parts")
    parts = rows.select("row_id", F.explode("parts").alias("part")).select("row_id", "part.*")
    added = linked_parts(parts, scope).groupBy("row_id").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added")
    )
    found = F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    return rows.join(added, "row_id", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", found.alias("found")
    )


def spans_text():
    """``found`` as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform("found", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the texts replaced by ``mark`` (n_chars follows).

    Linking looks at one text only, so scanning and replacing share one pass:
    the parts of a text are linked in place.  Null texts stay null.
    """
    columns = docs.columns
    at_text = columns.index("text")
    at_chars = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(v.as_py(), scope, mark) for v in batch.column(at_text)]
            arrays = list(batch.columns)
            arrays[at_text] = pa.array([t for t, _ in texts], pa.string())
            if at_chars is not None:
                old = batch.column(at_chars).to_pylist()
                sizes = [len(t) if changed else n for (t, changed), n in zip(texts, old, strict=True)]
                arrays[at_chars] = pa.array(sizes, batch.schema.field(at_chars).type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return map_batches(docs, run, docs.schema)


def linked_spans(text: str, scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """All reported spans of one text: the rule of ``linked_parts`` on a single text."""
    base = base_spans(text)
    parts = sorted(base + weak_parts(text, base))
    groups = {"access": (1,), "address": (4,), "hidden": SECRET_PARTS}
    of = {what: [(s, e) for s, kind, e in parts if kind in kinds] for what, kinds in groups.items()}
    starts = {what: [s for s, _ in spans] for what, spans in of.items()}
    furthest = {what: list(itertools.accumulate((e for _, e in spans), max)) for what, spans in of.items()}

    def seen(what: str, start: int, end: int) -> bool:
        k = bisect.bisect_right(starts[what], end + scope)
        return k > 0 and furthest[what][k - 1] >= start - scope

    def kept(start: int, kind: int, end: int) -> bool:
        if kind == 3:
            return seen("access", start, end) or seen("address", start, end)
        return kind < 3 or (seen("access", start, end) and seen("hidden", start, end))

    return [p for p in parts if kept(*p)]


def masked(text: str | None, scope: int, mark: str) -> tuple[str | None, bool]:
    """(text with its spans replaced, whether any was)."""
    spans = linked_spans(text, scope) if text else []
    pieces, at = [], 0
    for start, _, end in spans:
        if start >= at:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return ("".join([*pieces, text[at:]]), True) if spans else (text, False)
