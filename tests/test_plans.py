"""Plan shape of every registered query: no pattern that fails at scale."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "SortAggregate"]
# these run Spark jobs while the DataFrame is built (streaming, export, model fit)
BUILT_BY_JOBS = {"stream_ingest", "stream_ingest_state", "stream_ingest_first", "export_by_source", "json_round_trip", "csv_round_trip", "lda_topics",
                 "lda_topic_facts"}
# the operators of the optional subpackage state their own style
NAMES = sorted(n for n in set(E.queries()) - BUILT_BY_JOBS if n not in E.LLM_QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_forbidden_operators(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert not [f for f in FORBIDDEN if f in plan], plan


@pytest.mark.parametrize("name", ["kpis", "pubs_per_year", "impact_box_stats", "coauthor_edges", "olap_slice"])
def test_dashboard_scans_prune_years(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pf = [line for line in plan.splitlines() if line.startswith("PartitionFilters:")]
    assert pf and all("Annee" in line and ">= 2000" in line and "<= 2024" in line for line in pf)


def test_scans_read_only_needed_columns(spark):
    plan = E.queries()["trends"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<date_pub:string>" in plan
