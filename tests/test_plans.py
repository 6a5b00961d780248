"""Plans of all registered queries: built-in expressions only, no product joins, no unplanned single task."""

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from catalog import registry

SF = "/root/testdata/sf0.001"
# Global totals over rows that are already aggregated, and top-10 lists.
# Sums of all rows in one row, the result or a number that it needs.
ONE_TASK = {"funnel", "completion_metrics", "avg_time_to_complete", "list_sites", "stored_replies", "frequent_words", "stem_counts_stop_table",
            "site_keywords_stop_table", "language_profiles", "detected_languages"}


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith("stream_")))
def test_plan(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                "FlatMapGroupsInPandas"):
        assert bad not in plan, bad
    if name not in ONE_TASK:
        assert "SinglePartition" not in plan


def test_scan_is_pruned_and_filters_pushed(spark):
    plan = registry.QUERIES["brand_detection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in plan
    plan = registry.QUERIES["duplicate_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_extraction_runs_once(spark):
    """Site scores are one shuffle over one extraction: comments are cut once, the tag list is taken once."""
    plan = registry.QUERIES["pillar_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1
    assert plan.count("<!--.*?-->") <= 2  # the expression and its alias line


@pytest.mark.parametrize("name", ["site_profile", "site_signals", "pillar_scores", "topics_per_page"])
def test_jobs_read_their_pages_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("hashpartitioning(") <= 1


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = registry.QUERIES["optimize_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
