"""Streaming merges and exports that survive restarts, replays and kills."""

import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from settings import ROOT, SF_SMALL

from scriptorium.operators import lexical, merge
from scriptorium.plans import catalog
from scriptorium.plans import fixtures as fx
from scriptorium.session import scratch_dir
from scriptorium.sources import corpus, generations
from scriptorium.streaming import incremental

RECORD = "doi string, title string, source string, priority int, seq long"


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def _found(spark, out):
    df = merge.join_multi(incremental.read_results(spark, out))
    return sorted((r.doi, r.title, r.source) for r in df.collect())


def _failing(df):
    """The same rows; the job fails in the task that holds the last of them."""
    last = df.agg(F.max("seq")).head()[0]
    seq = F.when(F.col("seq") == last, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("seq"))
    return df.repartition(3, "doi").withColumn("seq", seq)


FIRST = [(f"d{i}", f"old {i}", "scopus", 0, i) for i in range(20)] + [("d3", "again", "pubmed", 0, 90)]
SECOND = [("d1", "new", "crossref", 1, 1), ("d50", "fifty", "crossref", 1, 2)]
AFTER_TWO = sorted(
    [(f"d{i}", f"old {i}", {1: "crossref|scopus", 3: "pubmed|scopus"}.get(i, "scopus")) for i in range(20)] + [("d50", "fifty", "crossref")]
)


def test_three_epochs_a_replay_and_a_new_checkpoint(spark):
    out = scratch_dir(spark, "t-results")
    incremental.merge_epoch(_records(spark, FIRST), 0, out, "a")
    assert len(_found(spark, out)) == 21  # the first load is stored as it is
    incremental.merge_epoch(_records(spark, SECOND), 1, out, "a")
    assert _found(spark, out) == AFTER_TWO
    incremental.merge_epoch(_records(spark, SECOND), 1, out, "a")  # replayed: left out
    assert _found(spark, out) == AFTER_TWO
    # another checkpoint counts its epochs from 0; nothing is lost
    incremental.merge_epoch(_records(spark, [("d60", "sixty", "pubmed", 2, 1), ("d2", "x", "pubmed", 2, 2)]), 0, out, "b")
    expected = {d: (t, s) for d, t, s in AFTER_TWO} | {"d60": ("sixty", "pubmed"), "d2": ("old 2", "pubmed|scopus")}
    assert _found(spark, out) == sorted((k, *v) for k, v in expected.items())


@pytest.mark.parametrize("epoch", [0, 1])
def test_a_write_that_fails_changes_nothing_and_is_made_up_for(spark, epoch):
    out = scratch_dir(spark, "t-results")
    batches = [_records(spark, FIRST), _records(spark, SECOND)]
    for e in range(epoch):
        incremental.merge_epoch(batches[e], e, out, "a")
    with pytest.raises(Exception, match="killed"):
        incremental.merge_epoch(_failing(batches[epoch]), epoch, out, "a")
    if epoch:
        assert len(_found(spark, out)) == 21
    else:
        with pytest.raises(FileNotFoundError):
            incremental.read_results(spark, out)
    for e in range(epoch, 2):
        incremental.merge_epoch(batches[e], e, out, "a")
    assert _found(spark, out) == AFTER_TWO


KILLED = """
import sys, time
sys.path.insert(0, {root!r})
from scriptorium.session import get_session
from scriptorium.streaming import incremental
spark = get_session("local[2]", shuffle_partitions=2)

def slow(batches):
    for batch in batches:
        yield batch
        open({flag!r}, "w").close()
        time.sleep(120)

rows = spark.createDataFrame({rows!r}, {record!r}).coalesce(1)
incremental.merge_epoch(rows.mapInArrow(slow, rows.schema), 1, {out!r}, "a")
"""


def test_a_process_killed_while_it_writes(spark, tmp_path):
    out, flag = scratch_dir(spark, "t-results"), str(tmp_path / "flag")
    incremental.merge_epoch(_records(spark, FIRST), 0, out, "a")
    code = KILLED.format(root=ROOT, flag=flag, rows=SECOND, record=RECORD, out=out)
    job = subprocess.Popen([sys.executable, "-c", code], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        for _ in range(600):
            if os.path.exists(flag) or job.poll() is not None:
                break
            time.sleep(0.2)
        assert os.path.exists(flag)
    finally:
        os.killpg(job.pid, signal.SIGKILL)
        job.wait()
    assert len(generations._numbers(spark, incremental._results(out))) == 2  # the dead one is there, but not marked
    assert len(_found(spark, out)) == 21
    incremental.merge_epoch(_records(spark, SECOND), 1, out, "a")
    assert _found(spark, out) == AFTER_TWO


def _files(root):
    return {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}


def test_a_batch_rewrites_nothing_of_the_others(spark):
    out = scratch_dir(spark, "t-results")
    many = [(f"d{i}", "t", "scopus", 0, i) for i in range(5000)]
    incremental.merge_epoch(_records(spark, many), 0, out, "a")
    before = _files(out)
    incremental.merge_epoch(_records(spark, [(f"d{5 * i}", "u", "pubmed", 1, i) for i in range(1000)]), 1, out, "a")
    assert before <= _files(out) and incremental.read_results(spark, out).count() == 5000


def test_generations_are_merged_as_they_gather(spark):
    out = scratch_dir(spark, "t-results")
    rows = [(f"d{i % 7}", f"t{e}", ("scopus", "pubmed")[e % 2], e, i) for e in range(11) for i in range(e, e + 3)]
    for e in range(11):
        incremental.merge_epoch(_records(spark, [r for r in rows if r[3] == e]), e, out, "a", merge_at=4)
        found = generations.live(spark, incremental._results(out))
        assert len(found) <= 6
    assert any(g.note.get("merged") for g in found)
    expected = sorted((r.doi, r.title, r.source) for r in merge.join_multi(merge.merge_duplicates(_records(spark, rows))).collect())
    assert _found(spark, out) == expected
    incremental.merge_epoch(_records(spark, rows[:3]), 10, out, "a", merge_at=4)  # merged generations remember their epochs
    assert _found(spark, out) == expected
    incremental.compact_results(spark, out)
    assert len(generations.live(spark, incremental._results(out))) == 1 and _found(spark, out) == expected
    generations.drop_covered(spark, incremental._results(out))
    assert len(generations._numbers(spark, incremental._results(out))) == 1 and _found(spark, out) == expected
    incremental.merge_epoch(_records(spark, [("d99", "late", "scopus", 0, 1)]), 11, out, "a")
    assert _found(spark, out) == sorted([*expected, ("d99", "late", "scopus")])


def test_stream_rerun_without_new_files_changes_nothing(spark):
    land, out, ckpt = scratch_dir(spark, "t-land"), scratch_dir(spark, "t-out"), scratch_dir(spark, "t-ckpt")
    p = fx.papers(spark, SF_SMALL)
    counts = []
    for engine in (0, None, 1):
        if engine is not None:
            p.where(F.col("priority") == engine).write.mode("append").json(land)
        incremental.stream_append_results(spark, land, catalog.PAPER_SCHEMA, out, ckpt).awaitTermination()
        counts.append(incremental.read_results(spark, out).count())
    assert counts[0] == counts[1] != counts[2]


def test_term_counts_add_up(spark):
    out = scratch_dir(spark, "t-terms")
    rows = [(2000 + i % 3, None if i % 5 == 0 else f"word{i % 4} Other") for i in range(40)] + [(None, "word1"), (2009, None)]
    frame = spark.createDataFrame(rows, "year int, abstract string")
    words, labelled = ["word1", "other"], {"a_b": "word[23]"}
    for e in range(6):
        part = spark.createDataFrame(rows[e::6], "year int, abstract string")
        incremental.add_term_counts(part, e, out, "a", words, labelled, merge_at=3)
        incremental.add_term_counts(part, e, out, "a", words, labelled, merge_at=3)  # replayed
    key = lambda r: tuple(map(str, r))
    found = sorted(map(tuple, incremental.read_term_frequency(spark, out).collect()), key=key)
    assert found == sorted(map(tuple, lexical.term_frequency(frame, words, labelled=labelled).collect()), key=key)
    with pytest.raises(ValueError, match="other words"):
        incremental.add_term_counts(frame, 6, out, "a", ["word1"])


# --- corpus ---------------------------------------------------------------------------


def _papers(spark, keys, title):
    rows = [(f"10.1/{k}", title, f"/{k}.pdf", k, title, f"about {k}") for k in keys]
    frame = spark.createDataFrame(rows, "_DOI string, _title string, _path string, _zoteroID string, title string, abstract string")
    return frame.withColumn("text_segments", F.expr("named_struct('segments', array(named_struct('_type', 'method', '_VALUE', _title)))"))


def _held(spark, out):
    found = sorted((r.item_key, r.title, r.method) for r in corpus.read_corpus(spark, out).collect())
    assert sorted(k for k, _, _ in found) == sorted(r.item_key for r in corpus.exported_keys(spark, out).collect())
    return [(k, t) for k, t, m in found if m == t]


def test_flat_corpora_are_gone_on_with(spark):
    out = scratch_dir(spark, "t-corpus")
    assert corpus.exported_keys(spark, out) is None
    corpus.write_corpus(_papers(spark, ["K1", "K2", "K3"], "flat"), out)
    corpus.add_papers(_papers(spark, ["K4"], "added"), out)
    assert _held(spark, out) == [("K1", "flat"), ("K2", "flat"), ("K3", "flat"), ("K4", "added")]
    corpus.replace_papers(_papers(spark, ["K2", "K4", "K5"], "over"), out)
    corpus.replace_papers(_papers(spark, ["K4"], "again"), out)
    assert _held(spark, out) == [("K1", "flat"), ("K2", "over"), ("K3", "flat"), ("K4", "again"), ("K5", "over")]


def test_one_file_per_paper_without_key_attribute(spark, tmp_path):
    out = str(tmp_path / "corpus")
    os.makedirs(out)
    for k in ("K1", "K2"):
        with open(f"{out}/{k}.xml", "w") as f:
            f.write(f'<paper DOI="10.1/{k}" title="one"><text_segments><segments type="method">one</segments></text_segments></paper>')
    assert _held(spark, out) == [("K1", "one"), ("K2", "one")]
    corpus.add_papers(_papers(spark, ["K3"], "added"), out)
    corpus.replace_papers(_papers(spark, ["K2"], "over"), out)
    assert _held(spark, out) == [("K1", "one"), ("K2", "over"), ("K3", "added")]


def test_bucketed_corpora_of_earlier_versions(spark):
    out = scratch_dir(spark, "t-corpus")
    old = _papers(spark, ["K1", "K2", "K3"], "old").withColumn("bucket", F.pmod(F.xxhash64("_zoteroID"), F.lit(64)).cast("int"))
    old.write.format("xml").option("rowTag", "paper").option("rootTag", "papers").partitionBy("bucket").save(out)
    corpus.add_papers(_papers(spark, ["K4"], "added"), out)
    corpus.replace_papers(_papers(spark, ["K1"], "over"), out)
    assert _held(spark, out) == [("K1", "over"), ("K2", "old"), ("K3", "old"), ("K4", "added")]


def test_a_corpus_write_that_fails_changes_nothing(spark):
    out = scratch_dir(spark, "t-corpus")
    corpus.add_papers(_papers(spark, ["K1", "K2"], "old"), out)
    new = _papers(spark, ["K1", "K2", "K3"], "new").repartition(3, "_zoteroID")
    bad = new.withColumn("abstract", F.when(F.col("_zoteroID") == "K2", F.raise_error(F.lit("killed"))).otherwise(F.col("abstract")))
    for write in (corpus.replace_papers, corpus.add_papers):
        with pytest.raises(Exception, match="killed"):
            write(bad, out)
        assert _held(spark, out) == [("K1", "old"), ("K2", "old")]
    corpus.replace_papers(new, out)
    assert _held(spark, out) == [("K1", "new"), ("K2", "new"), ("K3", "new")]


def test_exports_skip_retry_and_replace(spark):
    out = scratch_dir(spark, "t-corpus")

    def report(**kwargs):
        return {r.status: r.n for r in catalog._export(spark, SF_SMALL, out, **kwargs).collect()}

    def keys():
        found = [r.item_key for r in corpus.exported_keys(spark, out).collect()]
        assert len(found) == len(set(found))
        return set(found)

    first = report(damaged=True)
    assert first["exported"] > 0 and first["failed"] > 0 and first["skipped"] == 0
    assert len(keys()) == first["exported"]
    second = report()
    assert second["exported"] == first["failed"] and second["skipped"] == first["exported"] and second["failed"] == 0
    everything = keys()
    third = report()
    assert third["exported"] == 0 and third["skipped"] == len(everything) == len(keys())
    fourth = report(overwrite=True)
    assert fourth["exported"] == len(everything) and keys() == everything
