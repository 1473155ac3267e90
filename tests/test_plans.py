"""What the physical plans must not contain, with broadcasts off as they would be on large tables."""

from __future__ import annotations

import re

import pytest

from funnelworks import study as study_module
from funnelworks.fixture.bindings import bound_tables
from funnelworks.fixture.queries import SETTINGS
from funnelworks.operators import intervals, order_stats
from funnelworks.study import RELATIONAL, Study

# Written out before the plan is complete; their sorts send out one row per sort task.
EAGER = {"ltv_dataset", "ltv_fill_values"}


def explained(df) -> str:
    """The formatted plan, with that of subqueries."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def written_tables(spark, sf_dir, tmp_path_factory):
    """The bound tables, those of users in folders of their own."""
    folder, tables = tmp_path_factory.mktemp("large"), bound_tables(spark, sf_dir)
    large = {}
    for name in ("app_events", "user_transactions", "user_profiles"):
        path = str(folder / name)
        getattr(tables, name).write.parquet(path)
        large[name] = spark.read.parquet(path)
    return tables._replace(**large)


def all_plans(monkeypatch, tables, name: str) -> str:
    """Every plan of a report: of the tables it writes on the way and of what it returns."""
    plans = []
    for module in (study_module, intervals, order_stats):
        def recorded(df, label, write=module.materialise):
            plans.append(explained(df))
            return write(df, label)

        monkeypatch.setattr(module, "materialise", recorded)
    spark = tables.app_events.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.append(explained(RELATIONAL[name](Study(tables, SETTINGS))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return "\n".join(plans)


def scans(plans: str, table: str) -> int:
    return len(re.findall(rf"Location: \S+ \[\S*{table}", plans))


@pytest.mark.parametrize("name", ["channel_stats", "campaign_stats", "role_profile", "ltv_features", "ltv_labels", "user_revenue_30d", "tx_features_14d"])
def test_large_tables_are_scanned_once(monkeypatch, written_tables, name):
    plans = all_plans(monkeypatch, written_tables, name)
    assert (scans(plans, "app_events"), scans(plans, "user_transactions")) == (1, 1)


@pytest.mark.parametrize("name", ["user_revenue_30d", "ltv_labels", "tx_features_14d"])
def test_transactions_are_shuffled_once_and_joined_with_nothing(monkeypatch, written_tables, name):
    plans = all_plans(monkeypatch, written_tables, name)
    [index] = [p for p in plans.split("== Physical Plan ==") if "user_transactions" in p]
    assert "Join" not in index and "SortAggregate" not in index
    # One exchange deals out the stack of transactions and edges, the other one the users' first events.
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", index)
    assert len(keys) == 2 and sum("bucket" in k for k in keys) == 1


@pytest.mark.parametrize("name", ["eligible_installs", "ltv_features"])
def test_first_events_carry_no_text_in_aggregations(monkeypatch, written_tables, name):
    assert "SortAggregate" not in all_plans(monkeypatch, written_tables, name)


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        study = Study(bound_tables(spark, sf_dir), SETTINGS)
        return {
            name: report(study)._jdf.queryExecution().executedPlan().toString()
            for name, report in RELATIONAL.items() if name not in EAGER
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("forbidden", ["CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "Python"])
def test_no_cross_joins_forced_broadcasts_or_python(plans, forbidden):
    assert [name for name, plan in plans.items() if forbidden in plan] == []


def test_single_partition_steps_only_follow_an_aggregation(plans):
    """A step that needs all rows in one task may only see already aggregated rows."""
    for name, plan in plans.items():
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            depth = len(re.match(r"[\s:+\-]*", line).group(0))
            below = []
            for later in lines[i + 1:]:
                if len(re.match(r"[\s:+\-]*", later).group(0)) <= depth:
                    break
                below.append(later)
            scans = sum("FileScan" in x for x in below)
            assert scans and any("Aggregate(" in x for x in below), (name, line)


def test_scans_read_only_needed_columns(plans):
    assert "l_linenumber" not in plans["spend_daily_campaign"] and "l_quantity" not in plans["weekly_spend_share"]
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint>", plans["eligible_installs"])
