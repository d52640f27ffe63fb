import math

import pytest

from panelcast.operators import features, model, roll
from panelcast.operators.boosting import Boosting
from panelcast.operators.origins import cut_offs, origin_errors, rolling_origins


def amount(series, month):
    return 0.0 if series == 0 else 100.0 * series + 40.0 * math.sin(month * math.pi / 6) + month


@pytest.fixture
def lagged(spark, scratch):
    rows = [(s, m, amount(s, m)) for s in range(4) for m in range(30)]
    frame = spark.createDataFrame(rows, "series_id long, month int, y double")
    return scratch.save(features.with_lags(frame, ["y"], 12), "lagged")


def test_cut_offs():
    assert cut_offs(78) == [54, 60, 66, 72]
    assert cut_offs(20, n=3, every=1, horizon=2) == [16, 17, 18]
    assert cut_offs(10, n=9, every=4, horizon=6) == [0, 4]
    for refused in ({"last_month": 5}, {"last_month": 50, "n": 0}, {"last_month": 50, "every": 0}):
        with pytest.raises(ValueError):
            cut_offs(**refused)


def test_against_plain_recursion(lagged, scratch):
    """Fixed weights by hand, at cut-offs whose leads overlap and pass the end of the panel."""
    found = rolling_origins(lagged, model.fixed_weights(0.5, 0.5), [27, 20, 23, 23], scratch)
    expected = {}
    for origin in (20, 23, 27):
        for s in range(4):
            before, y = amount(s, origin - 1), amount(s, origin)
            for lead in range(1, 7):
                before, y = y, 0.5 * y + 0.5 * before
                if origin + lead < 30:
                    expected[origin, s, origin + lead, lead] = (amount(s, origin + lead), y)
    rows = found.collect()
    got = {(r.origin, r.series_id, r.month, r.lead): (r.y, r.y_pred) for r in rows}
    assert len(rows) == len(expected) and got.keys() == expected.keys()
    for key, pair in expected.items():
        assert got[key] == pytest.approx(pair)

    errors = {r.lead: r for r in origin_errors(found).collect()}
    for lead in range(1, 7):
        pairs = [pair for key, pair in expected.items() if key[3] == lead]
        off = [predicted - y for y, predicted in pairs]
        row = errors[lead]
        assert row.n_cells == len(pairs)
        assert row.mean_error == pytest.approx(sum(off) / len(off), abs=1e-4)
        assert row.mean_abs_error == pytest.approx(sum(map(abs, off)) / len(off), abs=1e-4)
        assert row.worst_error == pytest.approx(max(map(abs, off)))
        share = sum(map(abs, off)) / sum(abs(y) for y, _ in pairs)
        assert row.abs_error_share == pytest.approx(share, rel=1e-4)
    by_origin = origin_errors(found, ["origin", "series_id"])
    assert by_origin.count() == 3 * 4
    assert {r.abs_error_share for r in by_origin.filter("series_id = 0").collect()} == {None}


def test_no_later_month_is_known(spark, lagged, scratch):
    """A panel whose later months are other ones gives the same trees and predictions."""
    trees = Boosting(n_trees=5, learning_rate=0.3)
    full = rolling_origins(lagged, trees, [20], scratch, horizon=3)
    changed = scratch.save(
        lagged.selectExpr(
            "series_id", "month", "IF(month > 20, -7 * y - 1, y) AS y",
            *[f"IF(month > 20, 5D, lag_{k}) AS lag_{k}" for k in range(1, 13)],
        ),
        "changed",
    )
    other = rolling_origins(changed, trees, [20], scratch, horizon=3)
    names = ["series_id", "month", "y_pred"]
    assert sorted(full.select(*names).collect()) == sorted(other.select(*names).collect())
    alone = roll.recursive_predict(
        lagged.filter("month <= 20"), trees, 20, scratch, horizon=3, retrain="once"
    )
    assert sorted(full.select(*names).collect()) == sorted(alone.select(*names).collect())


def test_order_of_summation_does_not_matter(lagged, scratch):
    found = rolling_origins(lagged, model.fixed_weights(0.3, 0.7), [20, 21], scratch)
    one, many = (origin_errors(found.repartition(n)).orderBy("lead").collect() for n in (1, 9))
    assert one == many


def test_edges(lagged, scratch):
    weights = model.fixed_weights(1.0)
    with pytest.raises(ValueError):
        rolling_origins(lagged, weights, [], scratch)
    none = rolling_origins(lagged.filter("month < 0"), weights, [20], scratch)
    assert none.count() == 0 and origin_errors(none).count() == 0
    assert rolling_origins(lagged, weights, [29], scratch).count() == 0
