"""The answer table: no prompt is asked twice, whatever dies; failures are reported and asked again."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from settings import SF_SMALL

from scriptorium.operators import screening as scr
from scriptorium.plans import catalog
from scriptorium.plans import fixtures as fx
from scriptorium.session import scratch_dir
from scriptorium.sources import generations


def counting(folder, factory=fx.rule_model_factory, most=10**9, bad=None, sizes=None):
    """The rule model; notes every prompt it answers in a file of its own."""

    def make():
        model = factory()

        def predict(prompts):
            if len(prompts) > most:
                raise RuntimeError("too many prompts")
            if bad and any(bad in m["content"] for p in prompts for m in p):
                raise RuntimeError("no answer")
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                for p in prompts:
                    f.write(repr(p).replace("\n", " ") + "\n")
            return model(prompts)

        return predict

    return make


def asked(folder):
    return Counter(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)))


@pytest.fixture(scope="module")
def articles(spark):
    found = catalog._articles(spark, SF_SMALL)
    return spark.createDataFrame(found.collect(), found.schema)


def _rows(df):
    return sorted((str(tuple(r)) for r in df.select(*catalog.SCREEN_OUT).collect()))


def test_a_job_that_died_is_gone_on_with(spark, articles, tmp_path, monkeypatch):
    expected = _rows(scr.screen_abstracts(articles, fx.rule_model_factory))
    path, add, calls = scratch_dir(spark, "t-answers"), generations.add, []

    def dies(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return add(*args, **kwargs)

    monkeypatch.setattr(generations, "add", dies)
    with pytest.raises(KeyboardInterrupt):
        scr.screen_abstracts(articles, counting(str(tmp_path)), answers_path=path)
    before = asked(tmp_path)
    assert before and set(before.values()) == {1}
    assert _rows(scr.screen_abstracts(articles, counting(str(tmp_path)), answers_path=path)) == expected
    after = asked(tmp_path)
    assert set(after.values()) == {1} and len(after) > len(before)
    # everything has its answer: a third job asks nothing
    assert _rows(scr.screen_abstracts(articles, counting(str(tmp_path)), answers_path=path, waves=3)) == expected
    assert asked(tmp_path) == after


def test_copies_are_asked_once_and_in_batches(spark, articles, tmp_path):
    twice = articles.unionByName(articles.withColumn("doi", F.concat("doi", F.lit("x"))))
    found = scr.screen_abstracts(twice, counting(str(tmp_path), most=5), batch_size=5, waves=2)
    assert found.count() == 2 * articles.count() and found.where("error IS NOT NULL").isEmpty()
    assert set(asked(tmp_path).values()) == {1}


def test_failures_are_reported_and_asked_again(spark, articles, tmp_path):
    path = scratch_dir(spark, "t-answers")
    title = max(r.title for r in articles.collect())
    failing = scr.screen_abstracts(articles, counting(str(tmp_path), bad=title), answers_path=path)
    failed = failing.where("error IS NOT NULL").collect()
    assert {r.title for r in failed} == {title} and all(r.language is None and r.fundus_vessel_segmentation is None for r in failed)
    expected = _rows(scr.screen_abstracts(articles, fx.rule_model_factory))
    assert _rows(scr.screen_abstracts(articles, counting(str(tmp_path)), answers_path=path)) == expected
    assert set(asked(tmp_path).values()) == {1}


def test_a_model_that_gives_too_few_answers(spark):
    prompts = spark.createDataFrame([(i, [{"role": "user", "content": str(i)}]) for i in range(9)], "i int, messages array<struct<role:string,content:string>>")

    def forgetful():
        return lambda batch: [p[0]["content"] for p in batch if p[0]["content"] != "4"]

    found = {r.i: (r.response, r.error) for r in scr.answer_prompts(prompts.coalesce(1), forgetful).collect()}
    assert found.pop(4) == (None, "ValueError: 0 answers to 1 prompts")
    assert found == {i: (str(i), None) for i in range(9) if i != 4}


def test_empty_tables(spark, articles):
    assert scr.known_answers(spark, scratch_dir(spark, "t-answers")).isEmpty()
    assert scr.screen_abstracts(articles.limit(0), fx.rule_model_factory).columns == scr.screen_abstracts(articles, fx.rule_model_factory).columns
