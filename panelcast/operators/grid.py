"""From facts to the dense grid of series and months."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.nulls import zero_fill
from panelcast.functions.periods import parse_period
from panelcast.operators.catalog import Catalog
from panelcast.schema import KEYS, MEASURES


CELLS_PER_TASK = 250_000
FEWEST_CELLS = 60_000
MOST_TASKS = 50_000


def grid_tasks(n_cells: int, cores: int) -> int:
    """Partitions for a grid: about 50 MB of lagged cells each, less while cores are idle."""
    by_size = math.ceil(n_cells / CELLS_PER_TASK)
    by_cores = min(cores, math.ceil(n_cells / FEWEST_CELLS))
    return max(1, min(MOST_TASKS, max(by_size, by_cores)))


def monthly_sums(
    history: DataFrame, keys: Sequence[str] = KEYS, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Sum of all measures per key and month in one pass, nulls as zero.

    This is the only step that shuffles by facts' keys. Partial sums leave each task at most one row per
    series and month, so a hot series costs no more than any other. Decimals are summed as
    decimals and cast afterwards, which makes the result independent of summation order.

    Facts are summed by label first. Only then are labels parsed and the spellings of one month
    brought together, which takes a second sum over what little is left.
    """
    return period_sums(label_sums(history, keys, measures), keys, measures)


def label_sums(
    history: DataFrame, keys: Sequence[str] = KEYS, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Exact sums by key and period label; sums of parts of a history add up to those of all."""
    return history.groupBy(*keys, "periode").agg(*[F.sum(m).alias(m) for m in measures])


def period_sums(
    by_label: DataFrame, keys: Sequence[str] = KEYS, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Sums by key and month from one or more sums by label, as doubles, nulls as zero."""
    sums = [F.coalesce(F.sum(m).cast("double"), F.lit(0.0)).alias(m) for m in measures]
    return (
        by_label.withColumn("period", parse_period("periode")).groupBy(*keys, "period").agg(*sums)
    )


def series_cells(
    sums: DataFrame,
    catalog: Catalog,
    calendar: DataFrame,
    n_months: int,
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """Monthly sums under ``(series_id, month)``, before month ``n_months``."""
    kept = F.broadcast(calendar.filter(F.col("month") < n_months))
    return catalog.encode(sums.join(kept, "period")).select("series_id", "month", *measures)


def sparse_grid(
    cells: DataFrame, catalog: Catalog, n_months: int, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Every series × month, with nulls where there is no cell.

    Each series opens with a marker before month 0; each row then fills the months up to the
    next one. Only the markers and the cells that exist are shuffled, by ``series_id``; the
    grid is unfolded behind that shuffle and stays partitioned for the windows to come. The
    number of partitions follows the size of the unfolded grid, which AQE cannot foresee from
    the bytes it shuffles.
    """
    opening = catalog.ids().select("series_id", F.lit(-1).alias("month"))
    by_month = Window.partitionBy("series_id").orderBy("month")
    upto = F.coalesce(F.lead("month").over(by_month), F.lit(n_months)) - 1
    own = F.col("slot") == F.col("month")
    cores = cells.sparkSession.sparkContext.defaultParallelism
    return (
        opening.unionByName(cells, allowMissingColumns=True)
        .repartition(grid_tasks(catalog.n_series * n_months, cores), "series_id")
        .withColumn("upto", upto)
        .withColumn("slot", F.explode(F.sequence("month", "upto")))
        .filter(F.col("slot") >= 0)
        .select(
            "series_id",
            F.col("slot").alias("month"),
            *[F.when(own, F.col(m)).alias(m) for m in measures],
        )
    )


def dense_grid(
    sums: DataFrame,
    catalog: Catalog,
    calendar: DataFrame,
    n_months: int,
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """Every series × month below ``n_months``, zero where there are no facts."""
    cells = series_cells(sums, catalog, calendar, n_months, measures)
    return zero_fill(sparse_grid(cells, catalog, n_months, measures), measures)


def zero_grid(catalog: Catalog, n_months: int) -> DataFrame:
    months = F.explode(F.sequence(F.lit(0), F.lit(n_months - 1)))
    return catalog.ids().select("series_id", months.alias("month"), F.lit(0.0).alias("y"))


def scoring_frame(catalog: Catalog, month: int) -> DataFrame:
    """One row per series for a month to come, measure zero."""
    return catalog.ids().select("series_id", F.lit(month).alias("month"), F.lit(0.0).alias("y"))


def calendar_left_join(
    sums: DataFrame, calendar: DataFrame, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """All months of the calendar with the sums of one series, zero where it has none."""
    joined = calendar.join(sums.select("period", *measures), "period", "left")
    return zero_fill(joined, measures).select("month", "period", *measures)


def grid_shape(grid: DataFrame) -> DataFrame:
    """Series, months and cells of a grid, counted: one row per series and one per month, then
    their sums."""
    one, none, cells = F.lit(1), F.lit(0), F.count("*")
    by_series = grid.groupBy("series_id").agg(
        one.alias("series"), none.alias("months"), cells.alias("cells")
    )
    by_month = grid.groupBy("month").agg(
        none.alias("series"), one.alias("months"), none.cast("long").alias("cells")
    )
    counted = by_series.drop("series_id").unionByName(by_month.drop("month"))
    return counted.agg(*[F.sum(c).alias(f"n_{c}") for c in ("series", "months", "cells")])


def pivot_months(grid: DataFrame, measure: str, n_months: int) -> DataFrame:
    """One row per series, one column ``m<k>`` per month.

    For export only: the job itself stays in long form, whose width does not grow.
    """
    months = list(range(n_months))
    wide = grid.groupBy("series_id").pivot("month", months).agg(F.sum(measure))
    return wide.select(
        "series_id", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m{m}") for m in months]
    )


def unpivot_months(wide: DataFrame, measure: str) -> DataFrame:
    months = [c for c in wide.columns if c != "series_id"]
    long = wide.unpivot("series_id", months, "label", measure)
    return long.select("series_id", F.expr("int(substr(label, 2))").alias("month"), measure)


def sort_long(grid: DataFrame) -> DataFrame:
    return grid.orderBy("month", "series_id")
