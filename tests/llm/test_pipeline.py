"""The pipeline's stages against brute-force versions of their decisions that share no code with them."""

import re
from collections import Counter

import corpus_pipeline
import pytest
SF_SMALL = "/root/testdata/sf0.001"

from scriptorium.llm.common import staged
from tests.llm.test_bpe import expected as encoded
from tests.llm.test_mixing import size, slow_targets
from tests.llm.test_quality import slow_scores
from tests.llm.test_secret_scan import slow_masked
from tests.llm.test_simhash import slow_components, slow_fingerprint

STAGES = dict(corpus_pipeline.STAGES)
LABELS = "doc_id long, quality int, toxic int"
order = lambda r: tuple(map(str, r))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def pairs(frame):
    return Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def check_near_duplicates(before, after):
    rows = list(pairs(before).elements())
    prints = [slow_fingerprint(t) for _, t in rows]
    groups = slow_components(prints)
    members = {}
    for row, p in zip(rows, prints, strict=True):
        members.setdefault(groups[p], []).append(row)
    kept = {}
    for i, t in pairs(after).elements():
        group = groups[slow_fingerprint(t)]
        assert group not in kept and (i, t) in members[group]  # one row of each group, as it was
        kept[group] = i
    least = {g: min((i for i, _ in m if i is not None), default=None) for g, m in members.items()}
    assert kept == least


def check_secrets(before, after):
    masked = Counter()
    for (i, t), n in pairs(before).items():
        masked[i, None if t is None else slow_masked(t)] += n
    assert pairs(after) == masked
    assert all(r.n_chars == len(r.text) for r in after.select("n_chars", "text").collect() if r.text and "[SECRET]" in r.text)


def check_mix(before, after, block=128):
    sizes, taken, whole, got, texts = Counter(), Counter(), Counter(), Counter(), {}
    for r in before.select("doc_id", "text", "source").collect():
        sizes[r.source] += size(r.text)
        whole.update((r.doc_id, w) for w in words(r.text))
        texts.setdefault(r.doc_id, []).append(words(r.text))
    for r in after.select("doc_id", "text", "source").collect():
        taken[r.source] += size(r.text)
        got.update((r.doc_id, w) for w in words(r.text))
        assert any(is_part(words(r.text), t) for t in texts[r.doc_id])
    assert all(n <= 2 * whole[w] for w, n in got.items())  # at most twice its words, and only its own
    for source, target in slow_targets(sizes).items():
        assert abs(taken[source] - target) <= max(block, 0.02 * target)


def is_part(some, every):
    """Whether the words stand in this order among the others."""
    left = iter(every)
    return all(w in left for w in some)


def check_encoding(before, after):
    expected = [(i, *encoded(t)) for i, t in pairs(before).elements()]
    assert sorted(map(tuple, after.collect()), key=order) == sorted(expected, key=order)


CHECKS = {
    "simhash_near_dedup": check_near_duplicates, "secret_scan": check_secrets,
    "source_mixing": check_mix, "bpe_encoding": check_encoding,
}


def check_after_quality(spark, held, sf_dir):
    columns = held.columns
    for name, check in CHECKS.items():
        result = staged(STAGES[name](spark, held, sf_dir), "pipeline-test")
        assert name == "bpe_encoding" or result.columns == columns
        check(held, result)
        held = result


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = staged(STAGES["quality_classifier"](spark, docs, SF_SMALL), "pipeline-test")
    scores = slow_scores(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    assert all(abs(s - 0.7) > 1e-4 for _, _, s in scores)  # no score so close that rounding decides
    good = Counter((i, t) for i, t, s in scores if s >= 0.7)
    assert pairs(kept) == good and 0 < sum(good.values()) < len(scores)
    assert kept.columns == docs.columns
    check_after_quality(spark, kept, SF_SMALL)


def test_stages_on_edge_rows(spark, edge_docs):
    check_after_quality(spark, staged(edge_docs, "pipeline-test"), SF_SMALL)


@pytest.mark.parametrize("known", [[], [(2, 0, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)]])
def test_run_on_edge_rows(spark, edge_docs, tmp_path, known):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(known, LABELS)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [(i, t) for i, t, s in slow_scores(edge_docs, labels) if s >= 0.7]
    ids = {i for i, t in good}
    # without labels of both classes all scores are a half, and nothing is kept
    assert {r.doc_id for r in found} <= ids and (bool(known) or not ids)
    assert all(r.n_tokens > 0 for r in found)


def test_run_on_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.collect() == []


def test_run_is_the_registered_query(spark):
    import __spark_entry__ as entry

    run = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert run and sorted(map(tuple, run), key=order) == sorted(map(tuple, entry.queries()["pipeline"](spark, SF_SMALL).collect()), key=order)


def test_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
