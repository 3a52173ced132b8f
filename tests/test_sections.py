"""Section pipeline against hand-worked papers, and its independence of row order and partitioning."""

import pytest
from settings import SF_SMALL
from pyspark.sql import functions as F

from scriptorium.operators import sections as secops
from scriptorium.plans import fixtures as fx

SCHEMA = (
    "item_key long, pos int, heading string, num string, text string, "
    "publication_refs array<string>, figure_refs array<string>, table_refs array<string>"
)
# input rows (heading, num, text) -> expected sections (heading, num, text, type), worked out by hand from the rules
CASES = {
    "intro_fallback": (
        [("a", "", "x"), ("b", "", "y")],
        [("a", "", "x", "introduction"), ("b", "", "y", "method")],
    ),
    "override": ([("introduction and results", "", "t")], [("introduction and results", "", "t", "evaluation")]),
    "method_fallback_overwrites": (
        [("introduction", "", "a"), ("related work", "", "b"), ("results", "", "c")],
        [("introduction", "", "a", "introduction"), ("related work", "", "b", "method"), ("results", "", "c", "evaluation")],
    ),
    "stop_at_conclusion": (
        [("introduction", "", "a"), ("method", "", "b"), ("conclusion", "", "c"), ("appendix", "", "d")],
        [("introduction", "", "a", "introduction"), ("method", "", "b", "method"), ("conclusion", "", "c", "conclusion"), ("appendix", "", "d", "")],
    ),
    "carried_forward": (
        [("introduction", "", "a"), ("our method", "", "b"), ("more", "", "c"), ("results", "", "d"), ("tables", "", "e")],
        [("introduction", "", "a", "introduction"), ("our method", "", "b", "method"), ("more", "", "c", "method"),
         ("results", "", "d", "evaluation"), ("tables", "", "e", "evaluation")],
    ),
    "numbering": (
        [("A", "1", "a"), ("B", "2", "b"), ("C", "2.1", "c"), ("D", "", "d")],
        [("a", "1", "a", "introduction"), ("b", "2", "b\n\n2.1 C\n-----\ncD d\nd", "method")],
    ),
    "numbering_dot": (
        [("A", "1.", "a"), ("B", "1.1", "b"), ("C", "2.", "c")],
        [("a", "1.", "a\n\n1.1 B\n-----\nb", "introduction"), ("c", "2.", "c", "method")],
    ),
    "roman": (
        [("I. Intro", "", "a"), ("IX. End", "", "b"), ("X. More", "", "c")],
        [(" intro", "1.", "a", "introduction"), (" end", "9.", "b\n\n X. More\n--------\nc", "method")],
    ),
    "capitals": (
        [("INTRODUCTION", "", "a"), ("Data", "", "b"), ("RESULTS And more", "", "c")],
        [("introduction", "0.", "a\n\n Data\n-----\nb", "introduction"), ("results", "1.", "c", "method")],
    ),
    "replace_on_repeat": (
        [("Intro", "1.", "a"), ("Sub", "1.1", "b"), ("Intro", "1.", "c"), ("Next", "2.", "d")],
        [("intro", "1.", "c", "introduction"), ("next", "2.", "d", "method")],
    ),
    "kind_empty_first": (
        [("", "", "pre"), ("Intro", "1.", "a"), ("", "", "b"), ("Q", "3.1", "")],
        [("Introduction", "", " pre\npre", "introduction"), ("intro", "1.", "a b\nbQ ", "method")],
    ),
    "headings_merge": (
        [("Alpha", "", "a"), ("", "", "b"), ("Beta", "", "c"), ("alpha", "", "d")],
        [("alpha", "", "a b\nb\nd", "introduction"), ("beta", "", "c", "method")],
    ),
}


def _paper(spark, rows):
    return spark.createDataFrame([(1, i, h, n, t, [f"b{i}"], [], [f"t{i}"]) for i, (h, n, t) in enumerate(rows)], SCHEMA)


def _sections(df):
    return [(r.heading, r.num, r.text, r.type) for r in df.orderBy("sec_idx").collect()]


@pytest.mark.parametrize("name", sorted(CASES))
def test_hand_cases(spark, name):
    rows, expected = CASES[name]
    assert _sections(secops.classify_sections(_paper(spark, rows))) == expected


def test_refs_follow_their_sections(spark):
    found = secops.classify_sections(_paper(spark, CASES["numbering"][0])).orderBy("sec_idx").collect()
    assert [r.publication_refs for r in found] == [["b0"], ["b1", "b2", "b3"]]
    assert [r.table_refs for r in found] == [["t0"], ["t1", "t2", "t3"]] and found[0].figure_refs == []


def test_near_duplicates(spark):
    long = "w" * 300
    df = _paper(spark, [("S", "1.", long), ("S", "1.", "w" * 200 + "!"), ("T", "2.", "z")])
    assert _sections(secops.classify_sections(df, n_word_chars=100)) == [("s", "1.", long, "introduction"), ("t", "2.", "z", "method")]
    # compared whole, as by default, the second is another section, and replaces the first
    whole = _sections(secops.classify_sections(df))
    assert whole == [("s", "1.", "w" * 200 + "!", "introduction"), ("t", "2.", "z", "method")]


def test_row_order_and_partitioning_do_not_matter(spark):
    raw = fx.sections(spark, SF_SMALL)
    expected = sorted(map(str, secops.classify_sections(raw).collect()))
    mixed = raw.repartition(7).orderBy(F.rand(3))
    assert sorted(map(str, secops.classify_sections(mixed).collect())) == expected


def test_every_line_of_a_heading_paper_is_kept(spark):
    # headings only (scheme H) append, so all texts that near-duplicate removal keeps come back
    raw = fx.sections(spark, SF_SMALL).where(F.col("item_key") % 4 == 3)
    kept = raw.join(secops.drop_near_duplicates(raw).select("item_key", "pos"), ["item_key", "pos"])
    joined = {r.item_key: "\n".join(x.text for x in sorted(r.s, key=lambda x: x.sec_idx)) for r in
              secops.classify_sections(raw).groupBy("item_key").agg(F.collect_list(F.struct("sec_idx", "text")).alias("s")).collect()}
    assert all(r.text in joined[r.item_key] for r in kept.collect())


def test_a_very_long_paper(spark):
    """Work is linear in the sections: headings that repeat append, numbered ones replace."""
    n = 20_000
    headings = _paper(spark, [(f"Head {i * 7919 % 5000}", "", f"t{i}") for i in range(n)])
    expected = {}
    for i in range(n):
        expected.setdefault(f"head {i * 7919 % 5000}", []).append(f"t{i}")
    found = _sections(secops.classify_sections(headings))
    assert [(h, t) for h, _, t, _ in found] == [(h, "\n".join(t)) for h, t in expected.items()]
    numbered = [("Part", f"{i % 3000 + 1}.", f"t{i}") for i in range(n)] + [("Sub", "2000.1", "last")]
    found = _sections(secops.classify_sections(_paper(spark, numbered)))
    last = {f"{i % 3000 + 1}.": f"t{i}" for i in range(n)}
    assert found[1999][2] == "t19999\n\n2000.1 Sub\n----------\nlast" and len(found) == 3000
    assert all(text == last[num] for _, num, text, _ in found if num != "2000.")


def test_sections_without_paper_and_missing_values(spark):
    rows = [(None, 0, "Alpha", "", "a", None, None, ["t"]), (None, 1, None, None, None, ["b"], [], None), (None, 2, "Beta", None, "c", [], [], [])]
    found = secops.classify_sections(spark.createDataFrame(rows, SCHEMA)).orderBy("sec_idx").collect()
    assert [(r.item_key, r.heading, r.num, r.text) for r in found] == [(None, "alpha", "", "a "), (None, "beta", "", "c")]
    assert found[0].publication_refs == ["b"] and found[0].table_refs == ["t"]
    bare = secops.classify_sections(spark.createDataFrame(rows, SCHEMA).select("item_key", "pos", "heading", "num", "text"))
    assert bare.orderBy("sec_idx").first().figure_refs == []


def test_empty_input_gives_no_sections(spark):
    df = fx.sections(spark, SF_SMALL).limit(0)
    assert secops.classify_sections(df).count() == 0
