"""Lags and differences: one definition for training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelcast.schema import N_LAGS, lag_name


def with_lags(
    grid: DataFrame, measures: Sequence[str], n_lags: int, prefixed: bool = False
) -> DataFrame:
    """Add the lags 1..``n_lags`` of each measure, zero before the first month.

    All of them share one window specification, hence one sort of one partitioning.
    """
    by_month = "PARTITION BY series_id ORDER BY month"
    lags = [
        f"lag({m}, {k}, 0D) OVER ({by_month}) AS {lag_name(k, m if prefixed else None)}"
        for m in measures
        for k in range(1, n_lags + 1)
    ]
    return grid.selectExpr("*", *lags)


def with_diffs(frame: DataFrame, n_lags: int = N_LAGS) -> DataFrame:
    """Add ``diff_k``, the change of ``lag_k`` from one month to the next.

    That is ``lag_k - lag_(k+1)``, so one lag more than differences is needed and no second
    window.
    """
    diffs = [f"lag_{k} - lag_{k + 1} AS diff_{k}" for k in range(1, n_lags + 1)]
    return frame.selectExpr("*", *diffs)


def lag_features(grid: DataFrame, measure: str, n_lags: int = N_LAGS) -> DataFrame:
    lagged = with_lags(grid.select("series_id", "month", measure), [measure], n_lags)
    return lagged.drop(measure)


def diff_features(grid: DataFrame, measure: str, n_lags: int = N_LAGS) -> DataFrame:
    framed = feature_frame(grid, measure, n_lags)
    return framed.select("series_id", "month", *[f"diff_{k}" for k in range(1, n_lags + 1)])


def feature_frame(grid: DataFrame, measure: str, n_lags: int = N_LAGS) -> DataFrame:
    """The grid with all lags and differences of one measure."""
    lagged = with_lags(grid.select("series_id", "month", measure), [measure], n_lags + 1)
    return with_diffs(lagged, n_lags).drop(f"lag_{n_lags + 1}")


def measure_frame(lagged: DataFrame, measure: str, n_lags: int = N_LAGS) -> DataFrame:
    """One measure of a frame with prefixed lags, as ``(series_id, month, y, lag_*)``."""
    lags = [f"{lag_name(k, measure)} AS {lag_name(k)}" for k in range(1, n_lags + 2)]
    return lagged.selectExpr("series_id", "month", f"{measure} AS y", *lags)


def next_month(
    frame: DataFrame, value: str, n_lags: int = N_LAGS, keep: Sequence[str] = ()
) -> DataFrame:
    """The lags of the following month, read off the rows of one month and their value.

    A projection: once history has its lags, rolling forward needs no window and no shuffle.
    """
    shifted = [f"lag_{k} AS lag_{k + 1}" for k in range(1, n_lags + 1)]
    return frame.selectExpr(
        "series_id", "month + 1 AS month", f"{value} AS lag_1", *shifted, *keep
    )
