import math

import pytest

from panelcast.operators import features, model, roll


@pytest.fixture
def lagged(spark, scratch):
    """Seasonal series of different levels, and one without facts."""
    rows = [
        (s, m, 0.0 if s == 0 else 100.0 * s + 40.0 * s * math.sin(m * math.pi / 6) + 2 * m)
        for s in range(8)
        for m in range(48)
    ]
    frame = spark.createDataFrame(rows, "series_id long, month int, y double")
    return scratch.save(features.with_lags(frame, ["y"], 12), "lagged")


def test_back_test(lagged, scratch):
    """Train up to month 41, compare the six months after it with what happened."""
    known = lagged.filter("month <= 41")
    estimator = model.pooled_gbt(n_trees=20, learning_rate=0.2)
    predicted = roll.recursive_predict(known, estimator, 41, scratch, retrain="once")
    actual = lagged.filter("month > 41").select("series_id", "month", "y")
    rows = actual.join(predicted, ["series_id", "month"]).collect()
    assert len(rows) == 8 * 6
    error = sum((r.y - r.y_pred) ** 2 for r in rows)
    assert error < 0.1 * sum(r.y**2 for r in rows)


def test_each_step_trains_on_earlier_predictions(lagged, scratch):
    """Two steps of refitting by hand."""
    known = lagged.filter("month <= 41")
    estimator = model.pooled_gbt(n_trees=5, learning_rate=0.3)
    predicted = roll.recursive_predict(known, estimator, 41, scratch, horizon=2)
    got = {(r.series_id, r.month): r.y_pred for r in predicted.collect()}

    first = model.fit_pooled_model(known, estimator)
    opening = features.next_month(known.filter("month = 41"), "y")
    step = scratch.save(model.score_month(opening, first), "by-hand")
    train = known.unionByName(step.withColumnRenamed("y_pred", "y"))
    second = model.fit_pooled_model(train, estimator)
    last = model.score_month(features.next_month(step, "y_pred"), second)
    expected = {(r.series_id, r.month): r.y_pred for r in step.unionByName(last).collect()}
    assert got == pytest.approx(expected)
    assert {m for _, m in got} == {42, 43}


def test_fit_once_equals_refit_for_fixed_weights(lagged, scratch):
    known = lagged.filter("month <= 41")
    both = [
        roll.recursive_predict(known, model.fixed_weights(0.6, 0.3, 0.1), 41, scratch, retrain=r)
        for r in ("once", "each_step")
    ]
    assert sorted(both[0].collect()) == sorted(both[1].collect())
    with pytest.raises(ValueError):
        roll.recursive_predict(known, model.fixed_weights(1), 41, scratch, retrain="never")


def test_predictions_are_not_copied_into_a_filter(lagged, scratch):
    """The chain is scored once per step, not again inside an inferred predicate."""
    known = lagged.filter("month <= 41")
    estimator = model.pooled_gbt(n_trees=2)
    predicted = roll.recursive_predict(known, estimator, 41, scratch, retrain="once")
    plan = predicted._jdf.queryExecution().optimizedPlan().toString()
    assert "array_insert" not in "".join(x for x in plan.splitlines() if "Filter" in x)
    assert "Exchange" not in predicted._jdf.queryExecution().executedPlan().toString()


def test_model_settings():
    stages = model.pooled_gbt().getStages()
    booster = stages[1]
    assert len(stages[0].getInputCols()) == 24
    assert booster.getMaxIter() == 500
    assert booster.getStepSize() == 0.03
    assert booster.getMaxDepth() == 3
    assert booster.getMaxBins() == 510
    assert booster.getFeatureSubsetStrategy() == "0.64"
