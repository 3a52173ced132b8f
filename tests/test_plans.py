"""Scale properties of the physical plans (checked on the initial adaptive plan)."""

import re

from settings import SF_SMALL

from scriptorium.operators import search
from scriptorium.plans import catalog
from scriptorium.plans import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _hash_exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def _shuffled_rows(df) -> list[int]:
    """Rows that each exchange of an executed plan wrote."""
    spark = df.sparkSession
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [int(n) for n in re.findall(r"ShuffleQueryStage .*rowCount=(\d+)", df._jdf.queryExecution().explainString(mode))]


def test_section_pipeline_shuffles_once_by_paper(spark):
    plan = _plan(catalog.q_classify_sections(spark, SF_SMALL))
    keys = _hash_exchanges(plan)
    assert len(keys) == 1 and keys[0].startswith("item_key")


def test_section_pipeline_has_no_window(spark):
    assert "Window" not in _plan(catalog.q_classify_sections(spark, SF_SMALL))


def test_text_segments_moves_section_text_once(spark):
    plan = _plan(catalog.q_text_segments(spark, SF_SMALL))
    # sections repartitioned by paper once; the other exchanges carry the small sides only
    assert sum(1 for k in _hash_exchanges(plan) if k.startswith("item_key")) >= 1
    assert plan.count("Generate posexplode") == 2  # sections and figures fixtures, no re-explode


def test_merge_combines_map_side(spark):
    plan = _plan(catalog.q_merge_duplicates(spark, SF_SMALL))
    assert "partial_min_by" in plan and "partial_collect_set" in plan
    assert len(_hash_exchanges(plan)) == 1


def test_cap_has_one_plan_of_two_phases(spark):
    o = fx.table(spark, SF_SMALL, "orders").selectExpr("o_orderkey", "year(o_orderdate) AS year")
    for n in (5, 5000):
        plan = _plan(search.cap_per_group(o, n, ["year"], ["o_orderkey"]))
        assert plan.count("row_number()") >= 2 and "_salt" in plan
    plan = _plan(catalog.q_cap_per_year(spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cap_shuffles_a_bounded_number_of_rows_per_task(spark):
    """What a task sends of a group is at most the cap, however large the group is."""
    rows = spark.range(0, 40_000, 1, 4).selectExpr("id AS seq", "int(if(id % 10 < 9, 2000, 2001)) AS year")
    capped = search.cap_per_group(rows, 5, ["year"], ["seq"])
    assert len(capped.collect()) == 10
    sent = _shuffled_rows(capped)
    assert sent and max(sent) <= 4 * 2 * 5


def test_list_local_path_is_one_join_tree(spark):
    plan = _plan(catalog.q_list_local_path(spark, SF_SMALL))
    assert len(re.findall(r"(SortMerge|BroadcastHash|ShuffledHash)Join", plan)) <= 9


def test_token_frequency_scans_once(spark):
    plan = _plan(catalog.q_token_frequency(spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1


def test_field_pivot_reuses_the_item_join(spark):
    plan = _plan(catalog.q_fetch_item_fields(spark, SF_SMALL))
    assert not any(k.startswith("zoteroID") for k in _hash_exchanges(plan))


def test_has_doi_does_not_shuffle_values(spark):
    plan = _plan(catalog.q_has_doi(spark, SF_SMALL))
    assert not any(k.startswith("value") for k in _hash_exchanges(plan))


def test_distinct_titles_ranks_without_sort_aggregate(spark):
    plan = _plan(catalog.q_distinct_titles(spark, SF_SMALL))
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_doi_fill_takes_null_keys_around_the_join(spark):
    from scriptorium.sources import records

    df = spark.createDataFrame([(None, None, "a", 2000), (None, "t", "a", 2000), ("d", "t", "a", 2000), (None, "t", "a", None)], "doi string, title string, first_author string, year int")
    works = spark.createDataFrame([("T ", "A", 2000, "w")], "title string, author string, year int, DOI string")
    filled = records.fill_missing_doi(df, works)
    assert sorted(str(r.doi) for r in filled.collect()) == ["None", "None", "d", "w"]


def test_scans_are_left_alone_unless_asked(spark):
    assert "RoundRobin" not in _plan(fx.table(spark, SF_SMALL, "documents"))


def test_filters_reach_the_scan(spark):
    plan = _plan(catalog.q_search_papers(spark, SF_SMALL))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "DataFilters: [" in scan and "DataFilters: []" not in scan
    assert "PushedFilters: [IsNotNull(doc_id)]" in scan
    # only the columns the search and merge use are read (no lang, no n_chars)
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in scan


def test_top_terms_limits_before_shuffle(spark):
    plan = _plan(catalog.q_top_terms(spark, SF_SMALL))
    assert "partial_count" in plan
    assert "WindowGroupLimit" in plan
