"""Shapes of physical plans: what is shuffled, scanned and joined."""

import re

import pytest
from conftest import SMALL

from panelcast.operators import features, grid
from panelcast.plans.checks import Bound, orphan_facts
from panelcast.sources.scratch import Scratch, checkpoint_root


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bound(spark):
    bound = Bound(spark, SMALL)
    yield bound
    bound.scratch.close()


def test_feature_frame_shuffles_cells_once(bound, monkeypatch):
    monkeypatch.setattr(grid, "CELLS_PER_TASK", 1000)
    plan = plan_of(features.feature_frame(bound.at(bound.as_of).complete, "ca"))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"Window \[lag", plan)) == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sums_combine_before_the_shuffle(bound):
    plan = plan_of(grid.monthly_sums(bound.history))
    assert plan.count("partial_sum") >= 4
    # One exchange of facts, summed by label, and one of what is left by month.
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 2 and "periode" in exchanges[1] and "period#" in exchanges[0]
    # No label is parsed below the first sum.
    assert not re.search("gettimestamp|to_date|cast.*as date", plan.split(exchanges[1])[1])


def test_scans_read_needed_columns_only(bound):
    plan = plan_of(bound.history)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("l_extendedprice" in s and "l_tax" not in s for s in schemas)
    assert not any("o_totalprice" in s or "c_name" in s for s in schemas)


def test_orphans_do_not_shuffle_facts(bound):
    plan = plan_of(orphan_facts(bound))
    assert "Exchange hashpartitioning" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_whole_outlook_has_no_product_of_frames(bound):
    plan = plan_of(bound.fixed_outlook())
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_another_day_shares_what_is_written(bound):
    import datetime as dt

    other = bound.at(dt.date(2001, 7, 15))
    assert other.sums is bound.sums
    assert other.bounds.current_month == bound.bounds.current_month - 1


def test_scratch_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    root = checkpoint_root(spark)
    assert root == (before or spark.sparkContext.getCheckpointDir())
    assert Scratch(spark).path.startswith(root)


def test_rolling_forward_reads_the_last_month_only(bound):
    plan = plan_of(bound.rolled("ca"))
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(scans) == 1 and "is_last" in scans[0]
