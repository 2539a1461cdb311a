"""What the physical plans may and may not hold."""

import pytest

from wayfold.registry import load
from wayfold.registry.base import bound

ROOT = "/root/testdata/sf0.001"
PYTHON_STEPS = {"page_titles", "built_page_records", "built_page_evidence", "page_records", "page_evidence", "service_page_facts", "service_registry", "audit_chain"}
RUNS_JOBS = {"merge_roots", "evidence_reparented", "discovery_funnel", "screened_services", "appended_log_by_status", "audit_chain",
             "delivery_event_stream", "send_volume_stream", "recontact_stream", "target_status_stream",
             "follow_up_stream", "source_document_register", "looked_up_targets", "counts_in_tenant_scope"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(load()) - RUNS_JOBS))
def test_no_cross_join_and_python_only_where_declared(spark, name):
    plan = plan_of(load()[name].run(spark, ROOT))
    assert "CartesianProduct" not in plan
    if name not in ("null_safe_lookup", "suppression_register"):  # null-safe keys are hashed too, see below
        assert "BroadcastNestedLoopJoin" not in plan
    assert ("MapInPandas" in plan or "Python" in plan) == (name in PYTHON_STEPS)


def test_null_safe_keys_are_hash_joined(spark):
    for name in ("null_safe_lookup", "suppression_register"):
        plan = plan_of(load()[name].run(spark, ROOT))
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_are_pushed_to_the_scan(spark):
    plan = plan_of(load()["campaigns_with_large_target"].run(spark, ROOT))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_rank_filters_cut_before_the_shuffle(spark):
    plan = plan_of(load()["newest_three_events"].run(spark, ROOT))
    partial = plan.index("Partial") if "Partial" in plan else -1
    assert "WindowGroupLimit" in plan and partial > plan.index("Exchange")


def test_newest_row_is_folded_on_the_map_side(spark):
    plan = plan_of(load()["newest_event_per_entity"].run(spark, ROOT))
    assert "partial_max_by" in plan and plan.count("Exchange hashpartitioning") == 1


def test_bindings_cover_their_whole_table(spark):
    from wayfold.registry.base import BINDINGS
    for name, (table, _cols) in BINDINGS.items():
        assert bound(spark, ROOT, name).count() == spark.read.parquet(f"{ROOT}/{table}.parquet").count()
