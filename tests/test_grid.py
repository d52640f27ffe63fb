from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelcast.operators import grid
from panelcast.operators.calendar import distinct_periods, month_calendar
from panelcast.operators.catalog import Catalog

LISTS = {"bu": ["A", "B", "C"], "ctt": ["c"], "ope": ["o"], "pthrough": ["p"]}
FACT = st.tuples(
    st.sampled_from(["2021-01", "2021-02", "2021-05", "2021-6", "2021-06", "2022-01"]),
    st.sampled_from(["A", "B", "C", "Z", None]),
    st.one_of(st.none(), st.integers(-999, 999).map(str)),
)


@settings(
    max_examples=12,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(rows=st.lists(FACT, min_size=1, max_size=25))
def test_grid_against_nested_loops(facts, lists, rows):
    """Every series and month by brute force over the facts."""
    key = {p: "2021-06" if p == "2021-6" else p for p, _, _ in rows}
    periods = sorted({key[p] for p, _, _ in rows})
    sums = grid.monthly_sums(facts(rows))
    calendar = month_calendar(distinct_periods(sums))
    dense = grid.dense_grid(sums, Catalog.of(lists(**LISTS)), calendar, len(periods))
    got = {(r.series_id, r.month): r.ca for r in dense.collect()}
    expected = {
        (i, j): float(
            sum(Decimal(ca) for p, b, ca in rows if b == bu and key[p] == period and ca is not None)
        )
        for i, bu in enumerate(LISTS["bu"])
        for j, period in enumerate(periods)
    }
    assert got == expected


@pytest.fixture
def parts(micro):
    history, lists = micro
    sums = grid.monthly_sums(history)
    return sums, Catalog.of(lists), month_calendar(distinct_periods(sums))


def test_null_measures_and_orphans(parts):
    sums, catalog, calendar = parts
    dense = grid.dense_grid(sums, catalog, calendar, 4)
    assert dense.count() == 2 * 4
    assert dense.agg({"ca": "sum"}).first()[0] == 45.0
    cells = grid.series_cells(sums, catalog, calendar, 4)
    missing = grid.sparse_grid(cells, catalog, 4).filter("ca IS NULL").count()
    assert missing == 5


def test_cut_before_the_current_month(parts):
    sums, catalog, calendar = parts
    cut = grid.dense_grid(sums, catalog, calendar, 3)
    whole = grid.dense_grid(sums, catalog, calendar, 4).filter("month < 3")
    assert sorted(cut.collect()) == sorted(whole.collect())


def test_unpivot_undoes_pivot(parts):
    sums, catalog, calendar = parts
    dense = grid.dense_grid(sums, catalog, calendar, 4)
    wide = grid.pivot_months(dense, "ca", 4)
    assert wide.columns == ["series_id", "m0", "m1", "m2", "m3"]
    long = grid.unpivot_months(wide, "ca")
    assert sorted(long.collect()) == sorted(dense.select("series_id", "month", "ca").collect())


def test_zero_grid_and_shape(parts):
    _, catalog, calendar = parts
    assert grid.zero_grid(catalog, 4).agg({"y": "sum"}).first()[0] == 0.0
    assert grid.zero_grid(catalog, 4).count() == 8
    months = calendar.select("month")
    assert tuple(grid.grid_shape(catalog.ids().crossJoin(months)).first()) == (2, 4, 8)


def test_calendar_left_join(parts):
    sums, _, calendar = parts
    joined = grid.calendar_left_join(sums.filter("bu = 'A'"), calendar, ["ca"]).orderBy("month")
    assert [r.ca for r in joined.collect()] == [10.0, 0.0, 30.0, 5.0]


def test_sort(parts):
    sums, catalog, calendar = parts
    rows = grid.sort_long(grid.dense_grid(sums, catalog, calendar, 4)).collect()
    assert [(r.month, r.series_id) for r in rows] == [(m, s) for m in range(4) for s in range(2)]


def test_tasks_follow_the_grid():
    assert grid.grid_tasks(1, 8) == 1
    assert grid.grid_tasks(59_250, 8) == 1
    assert grid.grid_tasks(150_000, 8) == 3
    assert grid.grid_tasks(10**6, 2) == 4
    assert grid.grid_tasks(10**6, 8) == 8
    assert grid.grid_tasks(10**10, 8000) == 40_000
    assert grid.grid_tasks(10**15, 8000) == grid.MOST_TASKS


def test_several_tasks_give_the_same_grid(parts, monkeypatch):
    sums, catalog, calendar = parts
    one = grid.dense_grid(sums, catalog, calendar, 4).collect()
    monkeypatch.setattr(grid, "CELLS_PER_TASK", 1)
    many = grid.dense_grid(sums, catalog, calendar, 4)
    assert many.rdd.getNumPartitions() == 8
    assert sorted(many.collect()) == sorted(one)


def test_hot_series_leaves_partial_sums_only(spark, lists):
    """Half of all facts in one series: each task hands on one row per month of it."""
    facts = spark.range(0, 40_000, 1, 4).selectExpr(
        "format_string('2021-%02d', 1 + id % 12) AS periode",
        "IF(id % 2 = 0, 'A', IF(id % 3 = 0, 'B', 'C')) AS bu",
        "'c' AS ctt", "'o' AS ope", "'p' AS pthrough",
        "CAST(id AS decimal(18,4)) AS ca", "CAST(1 AS decimal(18,4)) AS mg",
    )
    sums = grid.monthly_sums(facts)
    calendar = month_calendar(distinct_periods(sums))
    dense = grid.dense_grid(sums, Catalog.of(lists(**LISTS)), calendar, 12)
    by_series = {r[0]: r[1:] for r in dense.groupBy("series_id").sum("ca", "mg").collect()}
    expected = {0: 0, 1: 0, 2: 0}
    for i in range(40_000):
        expected[0 if i % 2 == 0 else 1 if i % 3 == 0 else 2] += i
    assert {k: v[0] for k, v in by_series.items()} == expected
    assert sum(v[1] for v in by_series.values()) == 40_000
    shuffled = sums._jdf.queryExecution().executedPlan().toString().split("Exchange")[1]
    assert "partial_sum" in shuffled
