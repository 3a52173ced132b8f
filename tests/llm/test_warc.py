"""Archives against a plain reading of the contract."""

import hashlib
import re

import pytest

from scriptorium.llm import warc
from scriptorium.session import scratch_dir

PAGES = "page_id long, url string, html string"


def expected(rows):
    out, first = [], {}
    payloads = [(i, (h or "").encode()) for i, h in rows]
    for i, p in payloads:
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    done = set()
    for i, p in payloads:
        responds = len(p) < 100 or (first.get(p) == i and p not in done)
        if len(p) >= 100 and responds:
            done.add(p)
        refers = None if responds else first.get(p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if responds else "revisit", refers))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 1000, "records_per_file": 3}, {"chunk_bytes": 7, "records_per_file": 50}])
def test_round_trip(spark, limits):
    same, breaks = "é" * 80, "x\r\n\r\nWARC/1.1\r\n\r\n" * 40
    rows = [
        (5, same), (3, same), (3, same), (9, "short"), (8, "short"), (None, same), (2, None), (2, ""), (1, breaks),
        (7, breaks), (None, "lonely " * 30), (None, "lonely " * 30), (4, "€" * 5001), (6, "y" * 99), (10, "y" * 99),
    ]
    frame = spark.createDataFrame([(i, "u", h) for i, h in rows], PAGES).repartition(2)
    assert ordered(warc.round_trip(frame, **limits).collect()) == ordered(expected(rows))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_chunk_table_holds_every_byte_and_running_digests(spark):
    text = "abc€" * 3000
    frame = spark.createDataFrame([(1, "u", text)], PAGES)
    path = scratch_dir(spark, "t-warc")
    warc.write_archives(warc.segments(warc.decide(frame), 1000), path, 4)
    chunks = warc.read_chunks(spark, path).orderBy("chunk_no").collect()
    assert [c.chunk_no for c in chunks] == list(range(18)) and {c.chunks for c in chunks} == {18}
    assert b"".join(bytes(c.data) for c in chunks) == text.encode()
    # the record crosses archives: no single task has seen all of it
    assert all(c.digest is None for c in chunks)
    path = scratch_dir(spark, "t-warc")
    warc.write_archives(warc.segments(warc.decide(frame), 1000), path)
    whole, seen = warc.read_chunks(spark, path).orderBy("chunk_no").collect(), b""
    for c in whole:
        seen += bytes(c.data)
        assert c.digest == hashlib.sha256(seen).hexdigest()


def test_changed_payload_is_found(spark):
    frame = spark.createDataFrame([(1, "u", "a" * 500)], PAGES)
    path = scratch_dir(spark, "t-warc")
    from pyspark.sql import functions as F

    table = warc.segments(warc.decide(frame), 100)
    warc.write_archives(table.withColumn("data", F.expr("encode(replace(decode(data, 'UTF-8'), 'a', 'b'), 'UTF-8')")), path)
    with pytest.raises(Exception, match="declared digest"):
        warc.read_records(spark, path).collect()


def members(path):
    """The gzip members of all archives, each inflated alone."""
    import glob
    import zlib

    for name in sorted(glob.glob(path.removeprefix("file:") + "/part-*")):
        with open(name, "rb") as f:
            rest = f.read()
        while rest:
            stream = zlib.decompressobj(31)
            yield stream.decompress(rest) + stream.flush()
            assert stream.eof
            rest = stream.unused_data


@pytest.mark.parametrize("records_per_file", [None, 3])
def test_archives_are_of_the_format(spark, records_per_file):
    """One member per record, the format's mandatory fields, and fields only where it allows them."""
    same = "é" * 80
    rows = [
        (5, "http://a/5", same), (3, "http://a/3 x", same), (3, "http://a/3 a", same), (9, None, "short"),
        (None, "", "short"), (4, "http://a/4", "long " * 700), (6, "http://a/6", None),
    ]
    path = scratch_dir(spark, "t-warc")
    table = warc.segments(warc.decide(spark.createDataFrame(rows, PAGES)), 1000)
    warc.write_archives(table, path, records_per_file)
    found = []
    for member in members(path):
        head, block = member.split(b"\r\n\r\n", 1)
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert first == "WARC/1.1" and len(fields) == len(lines)
        assert block.endswith(b"\r\n\r\n") and len(block) == int(fields["Content-Length"]) + 4
        found.append((fields, block[:-4]))
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(f) for f, _ in found)
    uuid = r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>"
    assert all(re.fullmatch(uuid, f["WARC-Record-ID"]) for f, _ in found)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) for f, _ in found)
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(found)
    by_type = {}
    for f, block in found:
        by_type.setdefault(f["WARC-Type"], []).append((f, block))
    assert {t: len(x) for t, x in by_type.items()} == {"response": 5, "revisit": 2, "continuation": 3}
    heads = {f["WARC-Record-ID"]: (f, block) for f, block in by_type["response"]}
    for f, block in by_type["response"] + by_type["revisit"]:
        status, _, payload = block.partition(b"\r\n\r\n")
        assert status.startswith(b"HTTP/1.1 200 OK\r\n") and f["Content-Type"] == "application/http;msgtype=response"
        if f["WARC-Type"] == "response" and "WARC-Segment-Number" not in f:
            assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            assert f"Content-Length: {len(payload)}".encode() in status
    for f, block in by_type["revisit"]:
        origin, _ = heads[f["WARC-Refers-To"]]
        assert origin["X-Page-ID"] == "3" and f["WARC-Payload-Digest"] == origin["WARC-Payload-Digest"]
        assert f["WARC-Profile"] == warc.SAME_PAYLOAD and f["WARC-Refers-To-Target-URI"] == origin["WARC-Target-URI"]
        assert block.endswith(b"\r\n\r\n")
    parts = sorted(by_type["continuation"], key=lambda x: int(x[0]["WARC-Segment-Number"]))
    origin, start = heads[parts[0][0]["WARC-Segment-Origin-ID"]]
    assert origin["WARC-Segment-Number"] == "1" and [f["WARC-Segment-Number"] for f, _ in parts] == ["2", "3", "4"]
    whole = start + b"".join(block for _, block in parts)
    assert [f.get("WARC-Segment-Total-Length") for f, _ in parts] == [None, None, str(len(whole))]
    assert whole.partition(b"\r\n\r\n")[2].decode() == "long " * 700
    uris = {f["X-Page-ID"]: f["WARC-Target-URI"] for f, _ in by_type["response"] if "X-Page-ID" in f}
    assert uris == {"3": "http://a/3%20a", "9": "urn:page:9", "4": "http://a/4", "6": "http://a/6"}
    assert {f["WARC-Target-URI"] for f, _ in by_type["response"] if "X-Page-ID" not in f} == {"urn:page:none"}


def test_many_copies_of_one_page(spark):
    """More copies than one row of the work list stands for, with and without page_id."""
    n, text = warc.COPIES * 2 + 3, "copied " * 20
    frame = spark.range(n).selectExpr("cast(7 AS long) AS page_id", f"'{text}' AS html")
    frame = frame.unionByName(spark.range(n).selectExpr("cast(NULL AS long) AS page_id", f"'{text}' AS html"))
    frame = frame.unionByName(spark.range(n).selectExpr("cast(NULL AS long) AS page_id", "'few' AS html"))
    got = {tuple(r)[:-1]: r["count"] for r in warc.round_trip(frame).groupBy("page_id", "record_type", "refers_to", "payload_bytes").count().collect()}
    size = len(text)
    assert got == {
        (7, "response", None, size): 1, (7, "revisit", 7, size): n - 1, (None, "revisit", 7, size): n, (None, "response", None, 3): n,
    }


def test_a_record_across_archives_is_digested_from_its_parts(spark):
    rows = [(k, "u", f"{k} " * 900 * (k + 1)) for k in range(6)]
    frame = spark.createDataFrame(rows, PAGES).coalesce(1)
    assert ordered(warc.round_trip(frame, chunk_bytes=500, records_per_file=7).collect()) == ordered(
        expected([(i, h) for i, _, h in rows])
    )
