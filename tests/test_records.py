"""Landed records: rows that cannot be read."""

from scriptorium.session import scratch_dir
from scriptorium.sources import records


def test_corrupt_xml_rows_are_told_by_their_own_text(spark):
    path = scratch_dir(spark, "corrupt-xml-test")
    numbers = [("one" if i % 5 == 0 else str(i), "en" if i % 3 else None) for i in range(200)]
    spark.createDataFrame(numbers, "doc_id string, lang string").coalesce(1).write.format("xml").option("rowTag", "doc").save(path)
    read = records.read_landed(spark, path, "doc_id long, lang string", "xml", keep_corrupt=True, rowTag="doc")
    bad = [r[records.CORRUPT] for r in read.collect() if r[records.CORRUPT] is not None]
    assert len(bad) == 40
    assert all(text.count("<doc>") == 1 and "one" in text for text in bad)  # not the whole file each
    assert {(r.status, r.n) for r in records.corrupt_report(read).collect()} == {("corrupt", 40), ("read", 160)}


def test_the_report_reads_every_column(spark):
    path = scratch_dir(spark, "corrupt-csv-test")
    spark.createDataFrame([("1,2,en",), ("1,x,en",), ("y,2,",), (",,",), ("3",)], "value string").write.text(path)
    read = records.read_landed(spark, path, "a long, b long, `c.d` string", "csv", keep_corrupt=True)
    assert {(r.status, r.n) for r in records.corrupt_report(read).collect()} == {("corrupt", 3), ("read", 2)}
    assert records.corrupt_report(read.where("a > 5")).collect() == []
