import numpy as np
import pandas as pd
import pytest

from panelcast.operators import features
from panelcast.schema import N_LAGS


@pytest.fixture
def long(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        [(s, m, float(rng.integers(0, 1000))) for s in range(4) for m in range(20)],
        columns=["series_id", "month", "ca"],
    )
    return frame, spark.createDataFrame(frame, "series_id long, month int, ca double")


def test_against_shift(long):
    plain, frame = long
    got = features.feature_frame(frame, "ca").toPandas().sort_values(["series_id", "month"])
    got = got.reset_index(drop=True)
    for k in range(1, N_LAGS + 1):
        lag = plain.groupby("series_id")["ca"].shift(k, fill_value=0)
        diff = lag.groupby(plain["series_id"]).diff().fillna(0)
        assert (got[f"lag_{k}"] == lag).all()
        assert (got[f"diff_{k}"] == diff).all()


def test_features_look_back_only(long):
    plain, frame = long
    changed = frame.selectExpr("series_id", "month", "IF(month = 9, ca + 1, ca) AS ca")
    before = features.feature_frame(frame, "ca").drop("ca").filter("month <= 9")
    after = features.feature_frame(changed, "ca").drop("ca").filter("month <= 9")
    assert sorted(before.collect()) == sorted(after.collect())


def test_next_month_equals_the_window(long):
    """Scoring rows made by projection are the rows the window would give."""
    _, frame = long
    lagged = features.with_lags(frame, ["ca"], N_LAGS + 1)
    projected = features.next_month(lagged.filter("month = 18"), "ca")
    windowed = lagged.filter("month = 19").select(*projected.columns)
    assert sorted(projected.collect()) == sorted(windowed.collect())


def test_both_measures_at_once(long):
    _, frame = long
    two = frame.withColumn("mg", frame.ca * -2)
    lagged = features.with_lags(two, ["ca", "mg"], N_LAGS + 1, prefixed=True)
    alone = features.with_lags(frame.withColumnRenamed("ca", "y"), ["y"], N_LAGS + 1)
    apart = features.measure_frame(lagged, "ca")
    assert sorted(apart.collect()) == sorted(alone.select(*apart.columns).collect())
