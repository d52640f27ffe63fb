import datetime as dt

import pytest

from panelcast.functions.periods import parse_period
from panelcast.operators import calendar as months


def day(text):
    return dt.date.fromisoformat(text)


def numbered(calendar):
    return [str(r.period)[:7] for r in calendar.orderBy("month").collect()]


def test_two_spellings_are_one_month(facts):
    history = facts([("2021-1", "A", "1"), ("2021-01", "A", "1"), ("2021-10", "A", "1")])
    calendar = months.month_calendar(months.distinct_periods(history))
    assert numbered(calendar) == ["2021-01", "2021-10"]


@pytest.mark.parametrize("label", ["2021/01", "2021-13", "", None])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_labels_fail(spark, label, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        frame = spark.createDataFrame([(label,)], "periode string")
        with pytest.raises(Exception, match="PARSE|period|parse"):
            frame.select(parse_period("periode")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_modes_differ_on_a_gap(facts):
    periods = months.distinct_periods(facts([("2021-01", "A", "1"), ("2021-04", "A", "1")]))
    assert numbered(months.month_calendar(periods)) == ["2021-01", "2021-04"]
    filled = months.month_calendar(periods, "contiguous")
    assert numbered(filled) == ["2021-01", "2021-02", "2021-03", "2021-04"]
    assert [r.month for r in filled.orderBy("month").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        months.month_calendar(periods, "other")


@pytest.mark.parametrize(
    "as_of, current",
    [("2021-03-31", 2), ("2021-04-01", 3), ("2021-05-01", 4), ("2030-01-01", 4)],
)
def test_current_month(facts, as_of, current):
    history = facts([(f"2021-{m:02d}", "A", "1") for m in range(1, 5)])
    calendar = months.month_calendar(months.distinct_periods(history))
    bounds = months.read_horizon(calendar, day(as_of), 6)
    assert (bounds.current_month, bounds.last_month) == (current, current - 1)
    assert bounds.last_predicted == current + 5
    assert bounds.n_months == 4
    row = months.horizon_bounds(calendar, day(as_of), 6).first()
    assert tuple(row) == (current, current - 1, current + 5)


def test_nothing_complete(facts):
    calendar = months.month_calendar(months.distinct_periods(facts([("2021-01", "A", "1")])))
    with pytest.raises(ValueError, match="complete"):
        months.read_horizon(calendar, day("2021-01-20"))
    with pytest.raises(ValueError, match="no period"):
        months.read_horizon(calendar.filter("false"), day("2021-01-20"))


def test_spine_counts_on_across_the_year(facts):
    history = facts([("2020-11", "A", "1"), ("2020-12", "A", "1"), ("2021-01", "A", "1")])
    calendar = months.month_calendar(months.distinct_periods(history))
    bounds = months.read_horizon(calendar, day("2021-01-15"), 3)
    spine = months.month_spine(calendar, bounds).orderBy("month").collect()
    assert [(r.month, str(r.period_end)) for r in spine] == [
        (0, "2020-11-30"), (1, "2020-12-31"), (2, "2021-01-31"), (3, "2021-02-28"),
        (4, "2021-03-31"),
    ]


def test_split(spark):
    frame = spark.range(4).selectExpr("int(id) AS month")
    split = months.train_score_split(frame, 2).orderBy("month").collect()
    assert [(r.month, r.split) for r in split] == [(0, "train"), (1, "train"), (2, "score")]
