"""Rolling-origin evaluation: the predictor of the job judged at earlier cut-offs of its own panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.boosting import Boosting
from panelcast.operators.roll import recursive_predict
from panelcast.schema import HORIZON, N_LAGS
from panelcast.sources.scratch import Scratch

# Errors are counted in this fraction of the unit, so that their sums are whole numbers and do not
# depend on the order of summation.
FRACTION = 1 << 14


def cut_offs(last_month: int, n: int = 4, every: int = HORIZON, horizon: int = HORIZON) -> list[int]:
    """The latest ``n`` months, ``every`` so many, all of whose ``horizon`` leads are observed.

    A short history has fewer of them; one that has none is refused.
    """
    if n < 1 or every < 1 or horizon < 1:
        raise ValueError("cut-offs, their distance and the horizon are at least one")
    latest = last_month - horizon
    found = [m for m in range(latest - (n - 1) * every, latest + 1, every) if m >= 0]
    if not found:
        raise ValueError(f"no month before the last {horizon} to cut off at")
    return found


def rolling_origins(
    lagged: DataFrame,
    estimator: Estimator | Boosting,
    origins: Sequence[int],
    scratch: Scratch,
    horizon: int = HORIZON,
    n_lags: int = N_LAGS,
    retrain: str = "once",
) -> DataFrame:
    """``(origin, series_id, month, lead, y, y_pred)``: what was predicted at each cut-off, by
    a model that knew no later month, next to what was observed.

    ``lagged`` is one stored panel for all cut-offs, as ``recursive_predict`` takes it. Its lags look
    back only, so the rows up to a cut-off are the panel of that day and nothing is built anew. Each
    cut-off is fitted once (or before every month with ``retrain='each_step'``) and its predictions
    are written, which keeps plans short and lets a lost executor cost one of them at most. The
    observed values are joined once, for all cut-offs together; leads beyond the panel are left out.
    """
    if not origins:
        raise ValueError("no cut-off given")
    predictions = []
    for origin in sorted(set(origins)):
        known = lagged.filter(F.col("month") <= origin)
        rolled = recursive_predict(known, estimator, origin, scratch, horizon, n_lags, retrain)
        stored = rolled.select(
            F.lit(origin).alias("origin"),
            "series_id",
            F.col("month").cast("int").alias("month"),
            "y_pred",
        )
        predictions.append(scratch.save(stored, f"origin-{origin}"))
    first = min(origins)
    observed = lagged.filter(
        (F.col("month") > first) & (F.col("month") <= max(origins) + horizon)
    ).select("series_id", "month", "y")
    return (
        reduce(DataFrame.unionByName, predictions)
        .join(observed, ["series_id", "month"])
        .select(
            "origin",
            "series_id",
            "month",
            (F.col("month") - F.col("origin")).alias("lead"),
            "y",
            "y_pred",
        )
    )


def _counted(amount: Column) -> Column:
    """An amount as a whole number of fractions; exact sums of any length."""
    return F.floor(amount * FRACTION + 0.5).cast("decimal(28,0)")


def origin_errors(evaluated: DataFrame, by: Sequence[str] = ("lead",)) -> DataFrame:
    """Errors of ``rolling_origins`` by lead, or by other of its columns.

    ``n_cells``, ``mean_error`` (predicted less observed), ``mean_abs_error``, ``worst_error`` and
    ``abs_error_share``, the absolute errors over the absolute amounts observed (null where all are
    zero). One row per group leaves each task, so a hot group costs no more than another.
    """
    error = F.col("y_pred") - F.col("y")
    sums = evaluated.groupBy(*by).agg(
        F.count("*").alias("n_cells"),
        F.sum(_counted(error)).cast("double").alias("errors"),
        F.sum(_counted(F.abs(error))).cast("double").alias("abs_errors"),
        F.sum(_counted(F.abs("y"))).cast("double").alias("amounts"),
        F.max(F.abs(error)).alias("worst_error"),
    )
    return sums.select(
        *by,
        "n_cells",
        (F.col("errors") / F.col("n_cells") / FRACTION).alias("mean_error"),
        (F.col("abs_errors") / F.col("n_cells") / FRACTION).alias("mean_abs_error"),
        "worst_error",
        F.try_divide("abs_errors", "amounts").alias("abs_error_share"),
    )
