"""Corpus files: compressed, whole in every part, and found by their names."""

import gzip
import os

from pyspark.sql import functions as F

from scriptorium.plans import catalog
from scriptorium.plans import fixtures as fx
from scriptorium.session import scratch_dir
from scriptorium.sources import corpus, tei


def _tables(spark, n=40):
    """A folder with the tables that corpus rows are made from."""
    folder = scratch_dir(spark, "corpus-tables")
    lines = ["Head", "About", "first words", "more words, again", "", "end & < >"]
    docs = [(i, "\n".join(lines[: 1 + i % 6]) + f" {i % 9}", "en", f"s{i % 3}", 10 + i) for i in range(n)]
    docs.append((n, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    parts = [(k, f"name {k}", f"brand{k % 4}", k % 50, 1.5 * k, "STEEL") for k in range(2 * n + 7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double, p_type string").write.parquet(
        f"{folder}/part.parquet"
    )
    return folder


def _told(df):
    return sorted(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"])


def test_the_rounds_of_a_corpus_make_up_the_whole(spark):
    folder = _tables(spark)
    whole = _told(catalog._corpus_rows(spark, folder))
    rounds = [_told(catalog._corpus_rows(spark, folder, k, 3)) for k in range(3)]
    assert sorted(sum(rounds, [])) == whole and len(whole) == 41
    assert all(12 <= len(r) <= 14 for r in rounds)


def test_tei_is_built_for_the_papers_asked_for(spark):
    folder = _tables(spark)
    keys = spark.createDataFrame([(3,), (20,), (40,), (999,)], "item_key long")
    some, whole = fx.tei_documents(spark, folder, keys), fx.tei_documents(spark, folder)
    assert _told(some) == _told(whole.where("item_key IN (3, 20, 40, 999)")) and some.count() == 3


def test_papers_are_shredded_a_few_at_a_time_and_once(spark):
    texts = [(k, f"<TEI><text><body><p>{k}</p></body></text></TEI>" if k % 7 else "<TEI>") for k in range(300)]
    good = tei.shred_tei(spark.createDataFrame(texts, "item_key long, content string")).where("error IS NULL")
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 1
    assert sorted(r.item_key for r in good.collect()) == [k for k in range(300) if k % 7]


def test_corpus_files_are_compressed_and_read_by_their_names(spark, tmp_path):
    folder, out = _tables(spark, 200), f"{tmp_path}/corpus"
    rows = catalog._corpus_rows(spark, folder)
    corpus.write_corpus(rows.coalesce(1), out)
    files = [f"{out}/{f}" for f in os.listdir(out) if f.startswith("part-")]
    assert sum(map(os.path.getsize, files)) < sum(len(gzip.open(f).read()) for f in files) / 4
    with gzip.open(f"{out}/K9.xml.gz", "wt") as f:
        f.write('<papers><paper DOI="10/9" title="T"><abstract>A</abstract></paper></papers>')
    with open(f"{out}/K8.xml", "w") as f:
        f.write('<papers><paper DOI="10/8" title="T"><abstract>A</abstract></paper></papers>')
    keys = {r.item_key for r in corpus.read_corpus(spark, out).collect()}
    assert keys == {str(i) for i in range(201)} | {"K8", "K9"}
