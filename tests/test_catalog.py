import itertools
import random

import pytest

from panelcast.functions.ordinals import number_members
from panelcast.functions.sizes import broadcast_if_small
from panelcast.operators.calendar import distinct_periods, month_calendar
from panelcast.operators.catalog import Catalog, cross_join, observed_members
from panelcast.operators.grid import dense_grid, monthly_sums

VALUES = {"bu": ["x", "y", "z"], "ctt": ["k", "l"], "ope": ["1", "2"], "pthrough": ["O", "N"]}


def test_numbering_is_the_row_order_of_nested_loops(lists):
    catalog = Catalog.of(lists(**VALUES))
    rows = catalog.series().orderBy("series_id").collect()
    expected = list(itertools.product(*VALUES.values()))
    assert [tuple(r)[1:] for r in rows] == expected
    assert [r.series_id for r in rows] == list(range(len(expected)))
    assert catalog.n_series == 24


def test_cross_join_of_two_lists(lists):
    pairs = cross_join(Catalog.of(lists(**VALUES)), "bu", "ctt").collect()
    assert sorted(map(tuple, pairs)) == sorted(itertools.product(VALUES["bu"], VALUES["ctt"]))


def test_encode_undoes_decode(lists):
    catalog = Catalog.of(lists(**VALUES))
    coded = catalog.encode(catalog.series().withColumnRenamed("series_id", "was"))
    assert coded.filter("was = series_id").count() == 24


@pytest.mark.parametrize("n_bytes", [0, 10**12])
def test_same_result_with_and_without_broadcast(lists, n_bytes):
    checked = Catalog.of(lists(**VALUES))
    catalog = Catalog(checked.lists, checked.sizes, {k: n_bytes for k in checked.sizes})
    assert [tuple(r)[1:] for r in catalog.series().orderBy("series_id").collect()] == list(
        itertools.product(*VALUES.values())
    )


def test_hint_depends_on_size(spark):
    frame = spark.range(3)
    assert "ResolvedHint" in broadcast_if_small(frame, 10)._jdf.queryExecution().toString()
    assert "ResolvedHint" not in broadcast_if_small(frame, 1 << 40)._jdf.queryExecution().toString()


def test_bad_lists_are_rejected(spark, lists):
    with pytest.raises(ValueError, match="duplicates"):
        Catalog.of(lists(**{**VALUES, "bu": ["x", "x"]}))
    with pytest.raises(ValueError, match="duplicates"):
        Catalog.of(lists(**{**VALUES, "bu": [None, None]}))
    with pytest.raises(ValueError, match="empty"):
        Catalog.of(lists(**{**VALUES, "ope": []}))
    shifted = lists(**VALUES).selectExpr("dim", "value", "ord + 1 AS ord")
    with pytest.raises(ValueError, match="numbered"):
        Catalog.of(shifted)


def test_orphans_and_nulls_leave_the_sums(facts, lists):
    history = facts([("2021-01", "A", "1"), ("2021-01", "Q", "2"), ("2021-01", None, "3")])
    catalog = Catalog.of(lists(bu=["A", "B"], ctt=["c"], ope=["o"], pthrough=["p"]))
    assert sorted(float(r.ca) for r in catalog.orphans(history).collect()) == [2.0, 3.0]
    assert [r.ca for r in catalog.encode(monthly_sums(history)).collect()] == [1.0]


def test_blank_label_is_a_series_without_facts(facts, lists):
    catalog = Catalog.of(lists(bu=["A", None], ctt=["c"], ope=["o"], pthrough=["p"]))
    sums = monthly_sums(facts([("2021-01", "A", "1"), ("2021-01", None, "3")]))
    calendar = month_calendar(distinct_periods(sums))
    labelled = catalog.decode(dense_grid(sums, catalog, calendar, 1))
    assert {r.bu: r.ca for r in labelled.collect()} == {"A": 1.0, None: 0.0}


def test_observed_lists_are_sorted(facts, scratch):
    history = facts([("2021-01", b, "1") for b in ["b", "a", "é", "B", None, "a"]])
    rows = observed_members(history, scratch).filter("dim = 'bu'").orderBy("ord").collect()
    assert [(r.value, r.ord) for r in rows] == [("B", 0), ("a", 1), ("b", 2), ("é", 3)]


def test_numbering_over_many_slices(spark, scratch):
    """Slices of one partition each, a dimension that spans many of them."""
    random.seed(3)
    wanted = {
        "d": [f"{i:05d}" for i in random.sample(range(100_000), 3000)],
        "e": ["only"],
        "f": [f"f{i}" for i in range(50)],
    }
    rows = [(d, v) for d, values in wanted.items() for v in values]
    random.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        members = spark.createDataFrame(rows, "dim string, value string")
        numbered = number_members(members, scratch).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.dim, r.value): r.ord for r in numbered}
    assert got == {(d, v): i for d, vs in wanted.items() for i, v in enumerate(sorted(vs))}
