"""Months: the calendar of a history, its spine into the future, and the cut-off."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.periods import clock, first_day, month_end, parse_period, period_end
from panelcast.schema import HORIZON


def distinct_labels(history: DataFrame) -> DataFrame:
    """Distinct period labels with the month each one names."""
    return history.select("periode").distinct().withColumn("period", parse_period("periode"))


def distinct_periods(frame: DataFrame) -> DataFrame:
    """Distinct months, compared after parsing so that spellings of one month are one month."""
    if "period" not in frame.columns:
        frame = distinct_labels(frame)
    return frame.select("period").distinct()


def month_bounds(periods: DataFrame) -> DataFrame:
    return periods.select(
        "period", first_day("period").alias("first_day"), period_end("period").alias("last_day")
    )


def month_calendar(periods: DataFrame, mode: str = "observed") -> DataFrame:
    """Number the distinct months 0, 1, ... in date order.

    ``observed`` numbers the months that occur; ``contiguous`` also those missing in between.
    A four-digit year leaves fewer than 120,000 months whatever the size of the history, which
    bounds both the one-partition window here and the broadcasts of the calendar elsewhere.
    """
    if mode == "observed":
        number = F.row_number().over(Window.orderBy("period")) - 1
        return periods.distinct().select("period", number.cast("int").alias("month"))
    if mode == "contiguous":
        span = periods.agg(F.min("period").alias("start"), F.max("period").alias("stop"))
        months = F.sequence("start", "stop", F.expr("interval 1 month"))
        return span.filter(F.col("start").isNotNull()).select(
            F.posexplode(months).alias("month", "period")
        ).select("period", "month")
    raise ValueError(f"unknown calendar mode: {mode}")


@dataclass(frozen=True)
class Horizon:
    """The few scalars the job is planned with."""

    current_month: int
    last_month: int
    last_predicted: int
    n_months: int
    last_period: dt.date

    @property
    def steps(self) -> int:
        return self.last_predicted - self.last_month

    def period_end(self, month: int) -> dt.date:
        """Last day of a month from the last complete one on, counted as the spine does."""
        return month_end(self.last_period, month - self.last_month)


def _measured(calendar: DataFrame, as_of: dt.date | None, horizon: int) -> DataFrame:
    is_current = F.col("period") == first_day(clock(as_of))
    current = F.coalesce(F.max(F.when(is_current, F.col("month"))), F.max("month") + 1)
    return calendar.agg(
        current.cast("int").alias("current_month"), F.count("*").alias("n_months")
    ).select(
        "current_month",
        (F.col("current_month") - 1).alias("last_month"),
        (F.col("current_month") - 1 + F.lit(horizon)).alias("last_predicted"),
        "n_months",
    )


def horizon_bounds(
    calendar: DataFrame, as_of: dt.date | None = None, horizon: int = HORIZON
) -> DataFrame:
    """One row: number of the current month (one past the end if absent), of the last complete
    month and of the last month to predict."""
    return _measured(calendar, as_of, horizon).drop("n_months")


def read_horizon(
    calendar: DataFrame, as_of: dt.date | None = None, horizon: int = HORIZON
) -> Horizon:
    """Fetch the bounds (one row) to the driver."""
    row = _measured(calendar, as_of, horizon).first()
    if not row["n_months"]:
        raise ValueError("the history holds no period")
    if row["last_month"] < 0:
        raise ValueError("the history holds no complete month before the current one")
    last = calendar.filter(F.col("month") == row["last_month"]).first()
    return Horizon(
        row["current_month"],
        row["last_month"],
        row["last_predicted"],
        row["n_months"],
        last["period"],
    )


def month_spine(calendar: DataFrame, bounds: Horizon) -> DataFrame:
    """Months 0 to the last predicted one with their last day, the future ones counted on from
    the last complete month."""
    past = calendar.filter(F.col("month") <= bounds.last_month).select(
        "month", period_end("period").alias("period_end")
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(bounds.steps)))
    future = (
        calendar.filter(F.col("month") == bounds.last_month)
        .select("period", "month", ahead.alias("step"))
        .select(
            (F.col("month") + F.col("step")).alias("month"),
            period_end(F.add_months("period", F.col("step"))).alias("period_end"),
        )
    )
    return past.unionByName(future)


def drop_incomplete_months(frame: DataFrame, current_month: int) -> DataFrame:
    return frame.filter(F.col("month") < current_month)


def months_from(frame: DataFrame, month: int) -> DataFrame:
    return frame.filter(F.col("month") >= month)


def month_slice(frame: DataFrame, month: int) -> DataFrame:
    return frame.filter(F.col("month") == month)


def train_score_split(frame: DataFrame, month: int) -> DataFrame:
    """Mark rows before ``month`` for training and those of ``month`` for scoring."""
    side = F.when(F.col("month") < month, "train").otherwise("score")
    return frame.filter(F.col("month") <= month).withColumn("split", side)


def attach_period(frame: DataFrame, spine: DataFrame) -> DataFrame:
    """Left join of the period end; the spine is bounded like the calendar."""
    return frame.join(F.broadcast(spine), "month", "left")
