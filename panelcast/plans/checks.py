"""Every operator as a query over the test tables."""

from __future__ import annotations

import copy
import datetime as dt
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.nulls import zero_fill
from panelcast.operators import calendar as months
from panelcast.operators import catalog as series
from panelcast.operators import features, grid, model, origins, publish, roll
from panelcast.operators.boosting import Boosting
from panelcast.plans.outlook import Panel, outlook_of, run_outlook, store_lagged
from panelcast.schema import (
    HISTORY_LABELS,
    HORIZON,
    KEYS,
    MEASURES,
    N_LAGS,
    PUBLISHED,
    PUBLISHED_LABELS,
    feature_names,
)
from panelcast.sources.bindings import bound_history
from panelcast.sources.scratch import Scratch
from panelcast.sources.sinks import export_csv, publish_partitions
from panelcast.sources.snapshots import publish_snapshot, read_snapshot
from panelcast.sources.sums import SumStore
from panelcast.sources.tables import CSV_READ, read_published, rename_columns
from panelcast.streaming.drop import ingest_drop, read_audit, read_ingested

AS_OF = dt.date(2001, 8, 15)
EARLIER = dt.date(2001, 7, 15)
LONG_BEFORE = dt.date(2001, 1, 15)
REDUCED_OUT = "BUILDING"
N_TREES = 20
LEARNING_RATE = 0.1


class Bound:
    """The stages of the job over one data directory, each computed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF):
        self.spark = spark
        self.as_of = as_of
        self.history = bound_history(spark, sf_dir)
        self.scratch = Scratch(spark)

    def at(self, as_of: dt.date) -> Bound:
        """The same sums, catalog and calendar seen on another day."""
        other = copy.copy(self)
        other.__dict__.update(
            sums=self.sums, lists=self.lists, catalog=self.catalog, calendar=self.calendar
        )
        for name in ("bounds", "grid", "complete", "stored", "spine"):
            other.__dict__.pop(name, None)
        other.as_of = as_of
        return other

    @cached_property
    def sums(self) -> DataFrame:
        return self.scratch.save(grid.monthly_sums(self.history), "sums")

    @cached_property
    def lists(self) -> DataFrame:
        """From the sums where they are needed anyway, else from the distinct keys alone."""
        facts = self.__dict__.get("sums")
        if facts is None:
            facts = series.distinct_series(self.history)
        return series.observed_members(facts, self.scratch)

    @cached_property
    def catalog(self) -> series.Catalog:
        return series.Catalog.of(self.lists)

    @cached_property
    def calendar(self) -> DataFrame:
        return self.scratch.save(
            months.month_calendar(months.distinct_periods(self.sums)), "calendar"
        )

    @cached_property
    def bounds(self) -> months.Horizon:
        return months.read_horizon(self.calendar, self.as_of)

    @cached_property
    def grid(self) -> DataFrame:
        return grid.dense_grid(self.sums, self.catalog, self.calendar, self.bounds.n_months)

    @cached_property
    def complete(self) -> DataFrame:
        """The grid before the current month, cut ahead of any window."""
        return grid.dense_grid(self.sums, self.catalog, self.calendar, self.bounds.current_month)

    @cached_property
    def stored(self) -> tuple[DataFrame, DataFrame]:
        return store_lagged(
            self.complete, self.bounds.last_month, self.scratch, MEASURES, N_LAGS
        )

    @property
    def lagged(self) -> DataFrame:
        return self.stored[0]

    @property
    def opening(self) -> DataFrame:
        return self.stored[1]

    @cached_property
    def spine(self) -> DataFrame:
        return months.month_spine(self.calendar, self.bounds)

    @cached_property
    def first_keys(self) -> dict[str, str]:
        """Business keys of series 0."""
        return self.catalog.decode(
            self.spark.range(1).withColumnRenamed("id", "series_id")
        ).select(*KEYS).first().asDict()

    def measure(self, name: str) -> DataFrame:
        return features.measure_frame(self.lagged, name)

    def rolled(self, name: str, predictor=None, retrain: str = "once") -> DataFrame:
        return roll.recursive_predict(
            self.measure(name),
            predictor or fixed(),
            self.bounds.last_month,
            self.scratch,
            retrain=retrain,
            opening=features.measure_frame(self.opening, name),
        )

    def shaped(self) -> DataFrame:
        """Both measures, actual and predicted by the fixed weights, by series."""
        predictions = {m: self.rolled(m) for m in MEASURES}
        last = self.bounds.last_month
        return publish.split_actual_predicted(
            publish.append_predictions(self.lagged, predictions, last), last
        )

    def shaped_one(self, name: str) -> DataFrame:
        last = self.bounds.last_month
        whole = publish.append_predictions(self.lagged, {name: self.rolled(name)}, last)
        return publish.split_actual_predicted(whole, last, [name])

    def labelled_one(self, name: str) -> DataFrame:
        return series.relabel_series(self.shaped_one(name), self.catalog, self.spine)

    def fixed_outlook(self) -> DataFrame:
        panel = Panel(self.catalog, self.calendar, self.bounds, self.lagged, self.opening)
        return outlook_of(panel, self.scratch, fixed(), retrain="once")


def fixed():
    return model.fixed_weights(0.5, 0.5)


def boosted() -> Boosting:
    return Boosting(n_trees=N_TREES, learning_rate=LEARNING_RATE)


def _amounts(frame: DataFrame) -> DataFrame:
    """Exact amounts as doubles, for comparison."""
    exact = [f.name for f in frame.schema if isinstance(f.dataType, T.DecimalType)]
    return frame.withColumns({c: F.col(c).cast("double") for c in exact})


def scan_history(b: Bound) -> DataFrame:
    return _amounts(b.history)


def scan_dimensions(b: Bound) -> DataFrame:
    return b.lists


def rename(b: Bound) -> DataFrame:
    labels = {"periode": "period_label", **{k: k for k in KEYS}, "ca": "ca_mois", "mg": "mg_mois"}
    return _amounts(rename_columns(b.history, labels))


def drop_columns(b: Bound) -> DataFrame:
    return _amounts(b.history.drop("mg"))


def calendar_left_join(b: Bound) -> DataFrame:
    own = series.filter_series(b.sums, **b.first_keys)
    return grid.calendar_left_join(own, b.calendar, ["ca"])


def filter_series(b: Bound) -> DataFrame:
    return _amounts(series.filter_series(b.history, **b.first_keys).select("periode", "ca", "mg"))


def orphan_facts(b: Bound) -> DataFrame:
    kept = b.lists.filter((F.col("dim") != "bu") | (F.col("value") != REDUCED_OUT)).select(
        "dim", "value"
    )
    reduced = series.Catalog.of(series.dimension_members(kept, b.scratch))
    return _amounts(reduced.orphans(b.history))


def zero_fill_cells(b: Bound) -> DataFrame:
    cells = grid.series_cells(b.sums, b.catalog, b.calendar, b.bounds.n_months, ["ca"])
    sparse = grid.sparse_grid(cells, b.catalog, b.bounds.n_months, ["ca"])
    return zero_fill(sparse.withColumn("ca_raw", F.col("ca")), ["ca"]).select(
        "series_id", "month", "ca_raw", "ca"
    )


def pivot_months(b: Bound) -> DataFrame:
    return grid.pivot_months(b.grid, "ca", b.bounds.n_months)


def union_by_name(b: Bound) -> DataFrame:
    lagged = features.with_lags(b.complete.select("series_id", "month", "ca"), ["ca"], 1)
    scoring = grid.scoring_frame(b.catalog, b.bounds.last_month + 1)
    return lagged.withColumnRenamed("ca", "y").unionByName(scoring, allowMissingColumns=True)


def assemble_features(b: Bound) -> DataFrame:
    vectors = model.assemble_features(b.measure("ca"))
    parts = vectors.select("series_id", "month", vector_to_array("features").alias("f"))
    return parts.select(
        "series_id",
        "month",
        F.size("f").alias("n_features"),
        *[F.get("f", F.lit(i)).alias(f"f_{name}") for i, name in enumerate(feature_names())],
    )


def fit_pooled_model(b: Bound) -> DataFrame:
    train = b.measure("ca")
    trees = model.fit_pooled_model(train, boosted())
    seen = train.agg(
        F.count("*").alias("n_train"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_if(F.col("y") != 0).alias("n_not_zero"),
    )
    return seen.select(
        F.lit(trees.n_trees).cast("int").alias("n_trees"),
        F.lit(trees.n_features).cast("int").alias("n_features"),
        "*",
    )


def score_month(b: Bound) -> DataFrame:
    train = b.measure("ca")
    fitted = model.fit_pooled_model(train, boosted())
    scoring = features.next_month(features.measure_frame(b.opening, "ca"), "y")
    return model.score_month(scoring, fitted).select("series_id", "month", "y_pred")


def predict_all_measures(b: Bound) -> DataFrame:
    predictions = roll.predict_measures(
        b.lagged,
        boosted(),
        b.bounds.last_month,
        b.scratch,
        retrain="once",
        opening=b.opening,
    )
    named = [
        frame.select(F.lit(m).alias("measure"), "series_id", "month", "y_pred")
        for m, frame in predictions.items()
    ]
    return reduce(DataFrame.unionByName, named)


def predicted_cells(b: Bound) -> DataFrame:
    """Which cells are predicted, and whether each prediction is a number."""
    finite = F.coalesce(~F.isnan("y_pred") & (F.abs("y_pred") < float("inf")), F.lit(False))
    return predict_all_measures(b).select(
        "measure", "series_id", "month", finite.alias("is_finite")
    )


def rolling_origins(b: Bound) -> DataFrame:
    """The fixed weights at four earlier cut-offs of the panel."""
    return origins.rolling_origins(
        b.measure("ca"), fixed(), origins.cut_offs(b.bounds.last_month), b.scratch
    )


def join_measures(b: Bound) -> DataFrame:
    return publish.join_measures(b.labelled_one("ca"), b.labelled_one("mg"))


def publish_replace_slice(b: Bound) -> DataFrame:
    published = b.at(EARLIER).fixed_outlook()
    first = b.bounds.period_end(b.bounds.current_month)
    return publish.publish_replace_slice(published, b.fixed_outlook(), first)


def _published(b: Bound, days: list[dt.date]) -> DataFrame:
    """The table after one publication on each of some days, each outlook computed once."""
    path = b.scratch.folder("published-table")
    outlooks = {day: b.at(day) for day in dict.fromkeys(days)}
    written = {
        day: b.scratch.save(view.fixed_outlook(), "outlook") for day, view in outlooks.items()
    }
    for day in days:
        bounds = outlooks[day].bounds
        first, last = bounds.current_month, bounds.last_predicted
        publish_partitions(written[day], path, bounds.period_end(first), bounds.period_end(last))
    return read_published(b.spark, path)


def publish_twice(b: Bound) -> DataFrame:
    return _published(b, [EARLIER, b.as_of, b.as_of])


def publish_after_pause(b: Bound) -> DataFrame:
    """The former run's predictions end two months before the current month."""
    return _published(b, [LONG_BEFORE, b.as_of])


def publish_by_snapshots(b: Bound) -> DataFrame:
    """Published as of last month, then as of now, each at once."""
    path = b.scratch.folder("snapshots")
    for day in (EARLIER, b.as_of):
        seen = b.at(day)
        first, last = seen.bounds.current_month, seen.bounds.last_predicted
        publish_snapshot(
            seen.fixed_outlook(), path, seen.bounds.period_end(first), seen.bounds.period_end(last)
        )
    return read_snapshot(b.spark, path)


def merged_sums(b: Bound) -> DataFrame:
    """The history taken up in three drops that share months and series, summed batch by batch."""
    drop, history, audit, progress, sums = (
        b.scratch.folder(name) for name in ("drop", "history", "audit", "progress", "sums")
    )
    labelled = [F.col(name).alias(label) for label, name in HISTORY_LABELS.items()]
    stored = b.scratch.save(b.history.withColumn("part", F.pmod(F.hash("ca"), F.lit(3))), "parts")
    store = SumStore(b.spark, sums)
    for part in range(3):
        stored.filter(F.col("part") == part).select(*labelled).write.mode("append").parquet(drop)
        ingest_drop(b.spark, drop, history, audit, progress)
        store.catch_up(history)
        if part == 1:
            store.compact()
    return store.merged()


def export_labelled(b: Bound) -> DataFrame:
    path = b.scratch.folder("export")
    export_csv(b.scratch.save(b.fixed_outlook(), "outlook"), path)
    types = {f.name: f.dataType for f in PUBLISHED.fields}
    labelled = T.StructType(
        [T.StructField(label, types[name]) for name, label in PUBLISHED_LABELS.items()]
    )
    return b.spark.read.schema(labelled).options(**CSV_READ).csv(path)


def end_to_end(b: Bound) -> DataFrame:
    outlook, _ = run_outlook(
        b.history, b.scratch, as_of=b.as_of, estimator=boosted(), retrain="once"
    )
    return outlook


def end_to_end_cells(b: Bound) -> DataFrame:
    """The whole job's actual values, and which cells hold a prediction that is a number."""

    def finite(name: str) -> Column:
        value = F.col(name)
        return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))

    flags = [finite(f"{m}_pred").alias(f"{m}_predicted") for m in MEASURES]
    return end_to_end(b).select("month", "period_end", *KEYS, *MEASURES, *flags)


def _drop(b: Bound) -> tuple[str, str]:
    """Drop the history as files, take it up twice, return the two tables' paths."""
    drop, history, audit, progress = (
        b.scratch.folder(name) for name in ("drop", "history", "audit", "progress")
    )
    labelled = [F.col(name).alias(label) for label, name in HISTORY_LABELS.items()]
    b.history.select(*labelled).write.parquet(drop)
    for _ in range(2):
        ingest_drop(b.spark, drop, history, audit, progress)
    return history, audit


def ingested(b: Bound) -> DataFrame:
    return _amounts(read_ingested(b.spark, _drop(b)[0]))


def ingest_audit(b: Bound) -> DataFrame:
    return read_audit(b.spark, _drop(b)[1])


def ingest_counts(b: Bound) -> DataFrame:
    """Whether the audit lists each file once, all in the first batch, by name."""
    audit = read_audit(b.spark, _drop(b)[1])
    return audit.agg(
        (F.count("*") == F.count_distinct("file_path")).alias("each_once"),
        F.max("batch_id").alias("last_batch"),
        (F.count_if(F.col("file_size") > 0) == F.count("*")).alias("all_sized"),
    )


STAGES: dict[str, Callable[[Bound], DataFrame]] = {
    "scan_history": scan_history,
    "scan_dimensions": scan_dimensions,
    "rename_columns": rename,
    "drop_columns": drop_columns,
    "parse_period": lambda b: months.distinct_labels(b.history),
    "month_bounds": lambda b: months.month_bounds(months.distinct_periods(b.history)),
    "distinct_periods": lambda b: months.distinct_periods(b.history),
    "distinct_series": lambda b: series.distinct_series(b.history),
    "count_distinct_periods": lambda b: months.distinct_periods(b.history).agg(
        F.count("*").alias("n_periods")
    ),
    "month_calendar": lambda b: months.month_calendar(months.distinct_periods(b.history)),
    "month_spine": lambda b: b.spine,
    "horizon_bounds": lambda b: months.horizon_bounds(b.calendar, b.as_of, HORIZON),
    "cross_join": lambda b: series.cross_join(b.catalog, "bu", "ctt"),
    "series_catalog": lambda b: b.catalog.series(),
    "filter_series": filter_series,
    "orphan_facts": orphan_facts,
    "merged_sums": merged_sums,
    "monthly_sums": lambda b: grid.monthly_sums(b.history),
    "calendar_left_join": calendar_left_join,
    "zero_grid": lambda b: grid.zero_grid(b.catalog, b.bounds.n_months),
    "dense_grid": lambda b: b.grid,
    "zero_fill": zero_fill_cells,
    "grid_shape": lambda b: grid.grid_shape(b.grid),
    "pivot_months": pivot_months,
    "unpivot_months": lambda b: grid.unpivot_months(pivot_months(b), "ca"),
    "sort_long": lambda b: grid.sort_long(b.grid.select("month", "series_id", "ca")),
    "lag_features": lambda b: features.lag_features(b.grid, "ca"),
    "diff_features": lambda b: features.diff_features(b.grid, "ca"),
    "feature_frame": lambda b: features.feature_frame(b.grid, "ca"),
    "drop_incomplete_months": lambda b: months.drop_incomplete_months(
        b.grid, b.bounds.current_month
    ),
    "train_score_split": lambda b: months.train_score_split(b.grid, b.bounds.last_month).select(
        "series_id", "month", "split"
    ),
    "scoring_frame": lambda b: grid.scoring_frame(b.catalog, b.bounds.last_month + 1),
    "union_by_name": union_by_name,
    "assemble_features": assemble_features,
    "recursive_predict_fixed": lambda b: b.rolled("ca"),
    "fit_pooled_model": fit_pooled_model,
    "score_month": score_month,
    "recursive_predict": lambda b: b.rolled("ca", boosted(), "each_step"),
    "predict_all_measures": predict_all_measures,
    "predicted_cells": predicted_cells,
    "rolling_origins": rolling_origins,
    "origin_errors": lambda b: origins.origin_errors(rolling_origins(b)),
    "split_actual_predicted": lambda b: b.shaped_one("ca"),
    "future_slice": lambda b: months.months_from(b.shaped_one("ca"), b.bounds.current_month),
    "last_horizon_slice": lambda b: months.month_slice(
        b.shaped_one("ca"), b.bounds.last_predicted
    ),
    "attach_period": lambda b: months.attach_period(
        b.grid.select("series_id", "month", "ca"), b.spine
    ).select("series_id", "month", "period_end", "ca"),
    "relabel_series": lambda b: b.labelled_one("ca"),
    "join_measures": join_measures,
    "publish_replace_slice": publish_replace_slice,
    "publish_partitions": publish_twice,
    "publish_after_pause": publish_after_pause,
    "publish_snapshot": publish_by_snapshots,
    "export_csv": export_labelled,
    "end_to_end": end_to_end,
    "end_to_end_cells": end_to_end_cells,
    "ingest_drop": ingested,
    "ingest_audit": ingest_audit,
    "ingest_counts": ingest_counts,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(stage: Callable[[Bound], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: stage(Bound(spark, sf_dir))

    return {name: runner(stage) for name, stage in STAGES.items()}
