"""WARC archives as a chunked record table.

A payload is written as segments of at most ``chunk_bytes``: one row
(record id, chunk number, bytes) is one WARC record and one gzip member.  The
first segment is a ``response`` whose block is the HTTP head and the payload's
first bytes; the others are ``continuation`` records.  Fields that this reader
needs on every segment and the format has none for begin with ``X-``.  Members
are packed to about a mebibyte and Spark's own writer puts a bounded number of
packs into a file, so an archive has a bounded size whatever the payloads are,
every file system Spark knows works, and a lost executor's files are written
again.

Reading decompresses an archive in pieces and yields chunk rows.  A record
whose segments all lie in one archive is digested as they stream by; segments
of a record that crosses archives go by (record id, chunk number) to one task,
which carries the digest from row to row.  No step holds a whole record that
it has not been handed as one table cell.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the smallest page_id is the response and the others revisit it.  Defined cases:
null html is an empty payload; a null page_id sorts last, and a group of nulls
only has one response and revisits that refer to null; of rows that repeat the
smallest page_id one is the response; rows that repeat page_id and payload are
recorded with the smallest url; a page without url has its page_id as URI;
white space in a url becomes %20; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, staged
from scriptorium.session import scratch_dir

MIN_REVISIT = 100
CHUNK_BYTES = 64 * 1024
# compressed bytes of a pack of gzip members, and packs in an archive
PACK_BYTES = 1 << 20
PACKS_PER_FILE = 32
# copies of one page and payload that one row of the work list stands for
COPIES = 1024
BREAK = "\r\n"
_PIECE = 1 << 20
_FEED = 1 << 16
_ROWS_AT_ONCE = 512
# Fixed value: the format's name of revisits that are found by equal payload digests.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
CHUNK_SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, declared string,"
    " chunk_no long, chunks long, digest string, data binary"
)
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per page: id, url, payload, digest, size, copy number, record type and what it refers to.

    Decisions are made on keys.  Only the payloads of responses of at least
    ``min_revisit`` bytes are exchanged, each once; equal ones meet before the
    exchange.  Payloads of revisits are null.  Copies are counted, and the
    rows for them are made again in pieces of ``COPIES``.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload"), url.alias("url"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    large = F.col("size") >= min_revisit
    keys = rows.withColumn("short", F.when(~large, F.col("payload"))).groupBy("page_id", "digest", "size", "short")
    keys = staged(keys.agg(F.count("*").alias("copies"), F.min("url").alias("url")), "page-digests")
    first = keys.where(large).groupBy("digest").agg(
        F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url")
    )
    decided = keys.join(first, "digest", "left").withColumn("responds", large & F.col("page_id").eqNullSafe(F.col("first_page")))

    payloads = rows.where(large).groupBy("digest").agg(F.first("payload").alias("payload"))
    shape = ["page_id", "url", "digest", "size"]
    nothing = [F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url")]
    responses = decided.where("responds").join(payloads, "digest").select(
        *shape, F.lit(1).cast("long").alias("copy"), F.lit("response").alias("record_type"), *nothing, "payload"
    )
    rest = decided.withColumn("at", F.when(F.col("responds"), F.lit(2)).otherwise(F.lit(1)).cast("long"))
    rest = rest.where("at <= copies").withColumn("at", F.explode(F.expr(f"sequence(at, copies, {COPIES}L)")))
    rest = rest.repartition("digest", "page_id", "at")
    rest = rest.withColumn("copy", F.explode(F.expr(f"sequence(at, least(copies, at + {COPIES - 1}))")))
    rest = rest.select(
        *shape, "copy", F.when(large, "revisit").otherwise("response").alias("record_type"),
        F.when(large, F.col("first_page")).alias("refers_to"), F.when(large, F.col("first_url")).alias("refers_url"),
        F.col("short").alias("payload"),
    )
    return responses.unionByName(rest)


def record_id(page_id: Column, copy: Column, digest: Column) -> Column:
    """A URI made of the page, its copy number and its payload."""
    name = F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), copy.cast("string"), digest)
    h = F.sha2(name, 256)
    parts = [h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("8"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts, h.substr(21, 12)))


def segments(decided: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table to write: one row per segment, a record's segments in order."""
    count = F.when(
        F.col("record_type") == "response", F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes))
    ).otherwise(1)
    rows = decided.withColumn("chunks", count.cast("int")).withColumns(
        {
            "record_id": record_id(F.col("page_id"), F.col("copy"), F.col("digest")),
            "refers_id": F.when(
                F.col("record_type") == "revisit", record_id(F.col("refers_to"), F.lit(1), F.col("digest"))
            ),
        }
    )
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    data = F.when(
        F.col("record_type") == "response", F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")
    ).otherwise(F.expr("X''"))
    return rows.select(
        "record_id", "page_id", "url", "record_type", "refers_to", "refers_id", "refers_url", "size", "digest",
        "chunks", "chunk_no", data.alias("data"),
    )


def _packs(batches: Iterator[pa.RecordBatch], pack_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, several to a row; each row lacks its last byte, which the writer puts back.

    That byte is the highest of the member's length, 0 for any record below 16 MiB.
    """
    held = bytearray()

    def row() -> pa.RecordBatch:
        if held[-1]:
            raise ValueError("a segment is too long: chunk_bytes must stay below 16 MiB")
        return pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.binary())], ["pack"])

    for batch in batches:
        for value in batch.column(0):
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            held += member.compress(value.as_buffer()) + member.flush()
            if len(held) >= pack_bytes:
                yield row()
                held.clear()
    if held:
        yield row()


def write_archives(
    table: DataFrame, path: str, records_per_file: int | None = None, captured: Column | None = None
) -> None:
    """Write segment rows as gzip WARC archives below ``path``, a member per record.

    Archives end after ``PACKS_PER_FILE`` packs of about ``PACK_BYTES``, or
    after ``records_per_file`` records if given.  ``captured`` is the records'
    time (UTC, ISO 8601; the time of writing if not given).
    """
    if captured is None:
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        captured = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    opens, continued = F.col("chunk_no") == 0, F.col("chunk_no") > 0
    revisits = F.col("record_type") == "revisit"
    segmented = F.col("chunks") > 1
    own_id = F.when(opens, F.col("record_id")).otherwise(
        record_id(F.col("page_id"), F.concat_ws("/", "record_id", (F.col("chunk_no") + 1).cast("string")), F.col("digest"))
    )

    def uri(value: Column) -> Column:
        return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")

    def bracketed(value: Column) -> Column:
        return F.concat(F.lit("<"), value, F.lit(">"))

    def line(name: str, value: Column, where: Column | None = None) -> Column:
        given = value.isNotNull() if where is None else where & value.isNotNull()
        return F.when(given, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK))).otherwise("")

    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("size").cast("string"), F.lit(BREAK * 2),
    )
    block = F.concat(F.when(opens, F.encode(http, "UTF-8")).otherwise(F.expr("X''")), F.col("data"))
    header = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(continued, "continuation").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", bracketed(own_id)),
        line("WARC-Date", captured),
        line("WARC-Target-URI", F.coalesce(F.when(F.col("url") != "", uri(F.col("url"))), F.concat(F.lit("urn:page:"), page))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"), opens),
        line("WARC-Profile", F.lit(SAME_PAYLOAD), revisits),
        line("WARC-Refers-To", bracketed(F.col("refers_id")), revisits),
        line("WARC-Refers-To-Target-URI", uri(F.col("refers_url")), revisits & (F.col("refers_url") != "")),
        line("WARC-Refers-To-Date", captured, revisits),
        line("WARC-Segment-Number", F.col("chunk_no") + 1, segmented),
        line("WARC-Segment-Origin-ID", bracketed(F.col("record_id")), continued),
        line("WARC-Segment-Total-Length", F.col("size") + F.length(http), segmented & (F.col("chunk_no") + 1 == F.col("chunks"))),
        line("Content-Type", F.lit(HTTP), opens),
        line("Content-Length", F.length("block")),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("refers_to")),
        line("X-Record-Type", F.col("record_type"), continued),
        line("X-Payload-Length", F.col("size")),
        line("X-Payload-Digest", F.col("digest"), continued),
        line("X-Segment-Count", F.col("chunks"), segmented),
        F.lit(BREAK),
    )
    value = F.concat(F.encode(header, "UTF-8"), F.col("block"), F.encode(F.lit(BREAK * 2), "UTF-8"))
    records = table.withColumn("block", block).select(value.alias("value"))
    pack_bytes = 1 if records_per_file else PACK_BYTES
    packs = map_batches(records, lambda it: _packs(it, pack_bytes), "pack binary")
    (
        packs.select(F.col("pack").cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .option("compression", "none")
        .option("maxRecordsPerFile", records_per_file or PACKS_PER_FILE)
        .text(path)
    )


def _inflate(content: pa.Buffer) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members."""
    view = memoryview(content)
    stream = zlib.decompressobj(31)
    for at in range(0, len(view), _FEED):
        piece: bytes | memoryview = view[at : at + _FEED]
        while len(piece):
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(piece, _PIECE)
            piece = stream.unused_data if stream.eof else stream.unconsumed_tail
    yield stream.flush()


def parse_archive(content: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, segment bytes) of each record of an archive."""
    held = bytearray()
    header: dict[str, str] | None = None
    length = 0
    end = (BREAK * 2).encode()
    for piece in _inflate(content):
        held += piece
        while True:
            if header is None:
                at = held.find(end)
                if at < 0:
                    break
                lines = bytes(held[:at]).decode("utf-8").split(BREAK)
                header = dict(x.split(": ", 1) for x in lines[1:])
                length = int(header["Content-Length"])
                del held[: at + len(end)]
            if len(held) < length + len(end):
                break
            yield header, bytes(held[:length])
            del held[: length + len(end)]
            header = None
    if header is not None or held:
        raise ValueError("archive ends within a record")


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _segment(header: dict[str, str], block: bytes) -> tuple[str, int, int, bytes]:
    """(origin's record id, chunk number, chunks, payload bytes) of a record."""
    origin = header.get("WARC-Segment-Origin-ID", header["WARC-Record-ID"])[1:-1]
    number = int(header.get("WARC-Segment-Number", 1)) - 1
    if header.get("Content-Type") == HTTP:
        end = (BREAK * 2).encode()
        block = block[block.index(end) + len(end) :]
    return origin, number, int(header.get("X-Segment-Count", 1)), block


def _whole_records(content: pa.Buffer) -> set[str]:
    """Ids of the segmented records that have all their segments in this archive."""
    missing: dict[str, int] = {}
    for header, _ in parse_archive(content):
        if "X-Segment-Count" in header:
            origin, _, chunks, _ = _segment(header, b"\r\n\r\n")
            missing[origin] = missing.get(origin, chunks) - 1
    return {origin for origin, n in missing.items() if n == 0}


def _archive_rows(content: pa.Buffer, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of an archive.

    Without data it is inflated once, and again only where a record crosses
    archives: which records do is known when the first pass is over.
    """

    def row(header: dict[str, str], number: int, chunks: int, origin: str, digest: str | None, data: bytes | None) -> tuple:
        declared = header.get("X-Payload-Digest") or header["WARC-Payload-Digest"].removeprefix("sha256:")
        return (
            origin, _number(header.get("X-Page-ID")), header.get("X-Record-Type", header["WARC-Type"]),
            _number(header.get("X-Refers-To-Page-ID")), int(header["X-Payload-Length"]), declared, number, chunks,
            digest, data,
        )

    whole = _whole_records(content) if with_data else None
    begun: dict[str, list] = {}
    for header, block in parse_archive(content):
        origin, number, chunks, data = _segment(header, block)
        digest, seen = begun.setdefault(origin, [hashlib.sha256(), 0])
        if number == seen:
            digest.update(data)
            begun[origin][1] += 1
        ends = begun[origin][1] == chunks
        if whole is not None:
            held = chunks == 1 or origin in whole
            yield row(header, number, chunks, origin, digest.hexdigest() if held else None, data)
        elif ends:
            yield row(header, number, chunks, origin, digest.hexdigest(), None)
        if ends:
            del begun[origin]
    if whole is None and begun:
        for header, block in parse_archive(content):
            origin, number, chunks, data = _segment(header, block)
            if origin in begun:
                yield row(header, number, chunks, origin, None, data)


def _chunk_rows(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for row in _archive_rows(content.as_buffer(), with_data):
                rows.append(row)
                held += len(row[-1] or b"")
                if len(rows) >= _ROWS_AT_ONCE or held >= _PIECE:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives below ``path``.

    ``digest`` is the SHA-256 up to and including the chunk, where the record
    lies in one archive (else null).  Without data, a record of one archive
    gives its last row only; a record across archives always gives its bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_batches(files, lambda it: _chunk_rows(it, with_data), CHUNK_SCHEMA)


def _carry_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows sorted by record and chunk -> one row per record; the digest is carried along."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    digest, length = hashlib.sha256(), 0
    for batch in batches:
        rows = []
        columns = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            row = {n: c[k].as_py() for n, c in columns.items()}
            if row["record_type"] == "revisit":
                rows.append((row["page_id"], row["payload_bytes"], row["declared"], "revisit", row["refers_to"]))
                continue
            if row["chunk_no"] == 0:
                digest, length = hashlib.sha256(), 0
            if row["digest"] is None:
                digest.update(row["data"])
                length += len(row["data"])
            if row["chunk_no"] < row["chunks"] - 1:
                continue
            found = row["digest"] or digest.hexdigest()
            if found != row["declared"] or (row["digest"] is None and length != row["payload_bytes"]):
                raise ValueError(f"{row['record_id']}: payload does not have the declared digest")
            rows.append((row["page_id"], row["payload_bytes"], found, "response", None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives, its payload's digest computed from the bytes read."""
    chunks = read_chunks(spark, path, with_data=False)
    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return map_batches(ordered, _carry_digests, RECORD_SCHEMA)


def round_trip(
    pages: DataFrame,
    min_revisit: int = MIN_REVISIT,
    chunk_bytes: int = CHUNK_BYTES,
    records_per_file: int | None = None,
) -> DataFrame:
    """Write a record per page and read the archives back."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(segments(decide(pages, min_revisit), chunk_bytes), path, records_per_file)
    return read_records(spark, path)
