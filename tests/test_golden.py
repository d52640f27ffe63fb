"""The hand-worked fixture, stage by stage."""

import pytest
from conftest import AS_OF

from panelcast.operators import features, model, roll
from panelcast.operators.calendar import distinct_periods, month_calendar, read_horizon
from panelcast.operators.catalog import Catalog
from panelcast.operators.grid import dense_grid, monthly_sums
from panelcast.plans.outlook import build_panel, run_outlook


@pytest.fixture
def grid(micro):
    history, lists = micro
    sums = monthly_sums(history)
    calendar = month_calendar(distinct_periods(sums))
    return dense_grid(sums, Catalog.of(lists), calendar, 4)


def test_dense_grid(grid):
    rows = {(r.series_id, r.month): r.ca for r in grid.collect()}
    assert rows == {
        (0, 0): 10.0, (0, 1): 0.0, (0, 2): 30.0, (0, 3): 5.0,
        (1, 0): 0.0, (1, 1): 0.0, (1, 2): 0.0, (1, 3): 0.0,
    }


def test_features(grid):
    framed = features.feature_frame(grid, "ca").filter("series_id = 0").orderBy("month")
    got = [(r.ca, r.lag_1, r.diff_1, r.lag_2, r.diff_2) for r in framed.collect()]
    assert got == [(10, 0, 0, 0, 0), (0, 10, 10, 0, 0), (30, 0, -10, 10, 10), (5, 30, 30, 0, -10)]


def test_bounds(micro):
    history, _ = micro
    bounds = read_horizon(month_calendar(distinct_periods(history)), AS_OF)
    assert (bounds.current_month, bounds.last_month, bounds.last_predicted) == (4, 3, 9)


@pytest.mark.parametrize("retrain", ["once", "each_step"])
def test_recursion(micro, scratch, retrain):
    history, lists = micro
    panel = build_panel(history, scratch, lists, AS_OF)
    predicted = roll.recursive_predict(
        features.measure_frame(panel.lagged, "ca"),
        model.fixed_weights(0.5, 0.5),
        panel.bounds.last_month,
        scratch,
        retrain=retrain,
    )
    rows = {(r.series_id, r.month): r.y_pred for r in predicted.collect()}
    assert [rows[0, m] for m in range(4, 10)] == [17.5, 11.25, 14.375, 12.8125, 13.59375, 13.203125]
    assert [rows[1, m] for m in range(4, 10)] == [0.0] * 6


def test_whole_job(micro, scratch):
    history, lists = micro
    outlook, bounds = run_outlook(
        history, scratch, lists, AS_OF, estimator=model.fixed_weights(0.5, 0.5), retrain="once"
    )
    rows = {(r.bu, r.month): r for r in outlook.collect()}
    assert len(rows) == 2 * 10
    assert (rows["A", 2].ca, rows["A", 2].ca_pred) == (30.0, None)
    assert (rows["A", 4].ca, rows["A", 4].ca_pred) == (None, 17.5)
    assert rows["A", 4].mg_pred == 0.0
    assert str(rows["A", 3].period_end) == "2021-04-30"
    assert str(rows["B", 9].period_end) == "2021-10-31"
