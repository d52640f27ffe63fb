"""Shaping actual and predicted months into the published form."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.schema import KEYS, MEASURES, PUBLISHED_LABELS

CELL_KEYS = ("month", "period_end", *KEYS)


def append_predictions(
    grid: DataFrame, predictions: dict[str, DataFrame], last_month: int
) -> DataFrame:
    """Actual months up to ``last_month`` followed by the predicted ones, in the same columns.

    Measures are joined for the predicted months only, on ``(series_id, month)``.
    """
    ahead = reduce(
        lambda left, right: left.join(right, ["series_id", "month"]),
        [p.withColumnRenamed("y_pred", m) for m, p in predictions.items()],
    )
    actual = grid.filter(F.col("month") <= last_month)
    return actual.select("series_id", "month", *predictions).unionByName(ahead)


def split_actual_predicted(
    frame: DataFrame, last_month: int, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Keep a measure for actual months and move it to ``<measure>_pred`` for later ones."""
    actual = F.col("month") <= last_month
    columns = [
        column
        for m in measures
        for column in (
            F.when(actual, F.col(m)).alias(m),
            F.when(~actual, F.col(m)).alias(f"{m}_pred"),
        )
    ]
    return frame.select("series_id", "month", *columns)


def join_measures(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = CELL_KEYS
) -> DataFrame:
    """Left join on all key columns, null keys matching each other."""
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    added = [right[c] for c in right.columns if c not in keys]
    return left.join(right, same, "left").select(*[left[c] for c in left.columns], *added)


def publish_replace_slice(
    published: DataFrame, fresh: DataFrame, replace_from: dt.date
) -> DataFrame:
    """Published months that end before ``replace_from`` and fresh ones from there on; rerunning
    it changes nothing.

    Months are told apart by the day they end, not by their number, which counts from the first month
    of one history and would mean another month in a history that begins elsewhere.
    """
    kept = published.filter(F.col("period_end") < F.lit(replace_from))
    renewed = fresh.filter(F.col("period_end") >= F.lit(replace_from))
    return kept.unionByName(renewed).select(*published.columns)


def with_file_labels(frame: DataFrame) -> DataFrame:
    """Columns under the labels of the exchanged file; others keep their name."""
    return frame.select(*[F.col(c).alias(PUBLISHED_LABELS.get(c, c)) for c in frame.columns])
