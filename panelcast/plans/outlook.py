"""The whole job: history and dimension lists in, published outlook out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.boosting import Boosting
from panelcast.operators.calendar import (
    Horizon,
    distinct_periods,
    month_calendar,
    month_spine,
    read_horizon,
)
from panelcast.operators.catalog import Catalog, observed_members, relabel_series
from panelcast.operators.features import with_lags
from panelcast.operators.grid import dense_grid, monthly_sums
from panelcast.operators.publish import append_predictions, split_actual_predicted
from panelcast.operators.roll import predict_measures
from panelcast.schema import HORIZON, MEASURES, N_LAGS, published_schema
from panelcast.sources.scratch import Scratch
from panelcast.sources.sinks import publish_partitions
from panelcast.sources.snapshots import publish_snapshot


@dataclass(frozen=True)
class Panel:
    """Everything the predictors need; ``lagged`` is a written table of complete months and
    ``opening`` its last month, stored apart."""

    catalog: Catalog
    calendar: DataFrame
    bounds: Horizon
    lagged: DataFrame
    opening: DataFrame


def store_lagged(
    grid: DataFrame, last_month: int, scratch: Scratch, measures: Sequence[str], n_lags: int
) -> tuple[DataFrame, DataFrame]:
    """The grid with the lags of all measures, and the rows of its last month.

    One write puts the last month into a partition of its own, so that what starts from it reads
    one row per series and not the whole panel.
    """
    lagged = with_lags(grid, measures, n_lags + 1, prefixed=True)
    marked = lagged.withColumn("is_last", F.col("month") == last_month)
    stored = scratch.save(marked, "lagged", by=["is_last"])
    return stored.drop("is_last"), stored.filter("is_last").drop("is_last")


def build_panel(
    history: DataFrame,
    scratch: Scratch,
    dimensions: DataFrame | None = None,
    as_of: dt.date | None = None,
    horizon: int = HORIZON,
    n_lags: int = N_LAGS,
    measures: Sequence[str] = MEASURES,
    calendar_mode: str = "contiguous",
    summed: bool = False,
) -> Panel:
    """Aggregate, densify and lag the history (or, if ``summed``, what ``monthly_sums`` made of it).

    Facts are scanned once: the monthly sums are written, and calendar, dimension lists (where
    none are given) and grid are derived from them. The incomplete month is cut before the
    lags, which look back only.
    """
    sums = history if summed else monthly_sums(history, measures=measures)
    sums = scratch.save(sums, "sums")
    calendar = scratch.save(month_calendar(distinct_periods(sums), calendar_mode), "calendar")
    bounds = read_horizon(calendar, as_of, horizon)
    catalog = Catalog.of(observed_members(sums, scratch) if dimensions is None else dimensions)
    grid = dense_grid(sums, catalog, calendar, bounds.current_month, measures)
    lagged, opening = store_lagged(grid, bounds.last_month, scratch, measures, n_lags)
    return Panel(catalog, calendar, bounds, lagged, opening)


def run_outlook(
    history: DataFrame,
    scratch: Scratch,
    dimensions: DataFrame | None = None,
    as_of: dt.date | None = None,
    horizon: int = HORIZON,
    n_lags: int = N_LAGS,
    estimator: Estimator | Boosting | None = None,
    retrain: str = "each_step",
    calendar_mode: str = "contiguous",
    measures: Sequence[str] = MEASURES,
    summed: bool = False,
) -> tuple[DataFrame, Horizon]:
    """Actual months and ``horizon`` predicted ones for every series, in published columns."""
    panel = build_panel(
        history, scratch, dimensions, as_of, horizon, n_lags, measures, calendar_mode, summed
    )
    return outlook_of(panel, scratch, estimator, n_lags, retrain, measures), panel.bounds


def outlook_of(
    panel: Panel,
    scratch: Scratch,
    estimator: Estimator | Boosting | None = None,
    n_lags: int = N_LAGS,
    retrain: str = "each_step",
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """Predict all measures of a panel and shape the result."""
    bounds = panel.bounds
    predictions = predict_measures(
        panel.lagged,
        Boosting(n_lags=n_lags) if estimator is None else estimator,
        bounds.last_month,
        scratch,
        measures,
        bounds.steps,
        n_lags,
        retrain,
        panel.opening,
    )
    whole = append_predictions(panel.lagged, predictions, bounds.last_month)
    shaped = split_actual_predicted(whole, bounds.last_month, measures)
    spine = month_spine(panel.calendar, bounds)
    labelled = relabel_series(shaped, panel.catalog, spine)
    return labelled.select(*published_schema(measures).names)


def publish_outlook(
    history: DataFrame,
    path: str,
    dimensions: DataFrame | None = None,
    replace_from: str = "current",
    snapshots: bool = False,
    **options,
) -> Horizon:
    """Run the job, publish it to ``path`` and drop the intermediate tables.

    With ``snapshots`` the table is published as a whole or not at all (``sources.snapshots``).
    ``replace_from='current'`` renews the current month and later ones; ``'last'`` also the
    last complete month, so that its earlier prediction gives way to what was observed.
    """
    if replace_from not in ("current", "last"):
        raise ValueError(f"unknown replace_from: {replace_from}")
    scratch = Scratch(history.sparkSession)
    try:
        outlook, bounds = run_outlook(history, scratch, dimensions, **options)
        first = bounds.current_month if replace_from == "current" else bounds.last_month
        publish = publish_snapshot if snapshots else publish_partitions
        publish(
            outlook, path, bounds.period_end(first), bounds.period_end(bounds.last_predicted)
        )
    finally:
        scratch.close()
    return bounds
