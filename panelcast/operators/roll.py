"""Rolling a one-step predictor forward over several months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.boosting import Boosting, Training
from panelcast.operators.features import measure_frame, next_month
from panelcast.operators.model import fit_pooled_model, score_month
from panelcast.schema import HORIZON, MEASURES, N_LAGS
from panelcast.sources.scratch import Scratch


def recursive_predict(
    lagged: DataFrame,
    estimator: Estimator | Boosting,
    last_month: int,
    scratch: Scratch,
    horizon: int = HORIZON,
    n_lags: int = N_LAGS,
    retrain: str = "each_step",
    opening: DataFrame | None = None,
) -> DataFrame:
    """Predict the months after ``last_month``, each from lags that include earlier predictions.

    ``lagged`` is ``(series_id, month, y, lag_1..lag_(n_lags+1))`` up to ``last_month``, read
    from a written table since training passes over it several times. The state of the loop is
    one row per series with its trailing lags, so every step is a projection of the one before.
    It starts from the rows of ``last_month``, given as ``opening`` where they are stored apart.

    ``each_step`` refits before every month with earlier predictions as further labels and
    stores each step once; ``once`` fits on actual months only and scores all steps in a single
    pass over the last month.
    """
    last = lagged.filter(F.col("month") == last_month) if opening is None else opening
    scoring = next_month(last, "y", n_lags)
    if retrain not in ("each_step", "once"):
        raise ValueError(f"unknown retrain mode: {retrain}")
    if isinstance(estimator, Boosting):
        settings = replace(estimator, n_lags=n_lags)
        return _boosted(
            {"y": lagged}, {"y": scoring}, settings, last_month, scratch, horizon, retrain
        )["y"]
    if retrain == "each_step":
        return _refitted(lagged, scoring, estimator, last_month, scratch, horizon, n_lags)
    model = fit_pooled_model(lagged.filter(F.col("month") <= last_month), estimator, n_lags)
    return _chained(scoring, model, last_month, horizon, n_lags)


def _boosted(
    lagged: Mapping[str, DataFrame],
    scoring: Mapping[str, DataFrame],
    settings: Boosting,
    last_month: int,
    scratch: Scratch,
    horizon: int,
    retrain: str,
) -> dict[str, DataFrame]:
    """All measures together: every pass over the data sums for the trees of each.

    Refitting adds the month just predicted to the binned rows and their sums; nothing of the
    history is binned or summed by amount again.
    """
    known = {m: frame.filter(F.col("month") <= last_month) for m, frame in lagged.items()}
    n_lags = settings.n_lags
    predicted: dict[str, DataFrame] = {}
    with Training(known, settings, scratch) as training:
        if retrain == "once":
            models = training.fit()
            return {
                m: _chained(scoring[m], models[m], last_month, horizon, n_lags) for m in known
            }
        for step in range(1, horizon + 1):
            models = training.fit()
            scored = {
                m: scratch.save(score_month(scoring[m], models[m], n_lags), f"step-{step}")
                for m in known
            }
            predicted = {
                m: predicted[m].unionByName(frame) if m in predicted else frame
                for m, frame in scored.items()
            }
            if step < horizon:
                training.add(
                    {m: f.withColumnRenamed("y_pred", "y") for m, f in scored.items()}
                )
                scoring = {m: next_month(f, "y_pred", n_lags) for m, f in scored.items()}
    return {m: f.select("series_id", "month", "y_pred") for m, f in predicted.items()}


def _refitted(
    lagged: DataFrame,
    scoring: DataFrame,
    estimator: Estimator,
    last_month: int,
    scratch: Scratch,
    horizon: int,
    n_lags: int,
) -> DataFrame:
    history = lagged.filter(F.col("month") <= last_month)
    predicted = None
    for step in range(1, horizon + 1):
        train = history
        if predicted is not None:
            train = history.unionByName(predicted.withColumnRenamed("y_pred", "y"))
        model = fit_pooled_model(train, estimator, n_lags)
        scored = scratch.save(score_month(scoring, model, n_lags), f"step-{step}")
        predicted = scored if predicted is None else predicted.unionByName(scored)
        scoring = next_month(scored, "y_pred", n_lags)
    return predicted.select("series_id", "month", "y_pred")


def _chained(
    scoring: DataFrame, model, last_month: int, horizon: int, n_lags: int
) -> DataFrame:
    """All steps by one model, in a single pass over the last month."""
    no_steps = F.array().cast("array<double>")
    scoring = scoring.withColumn("path", no_steps)
    for _ in range(horizon):
        scored = score_month(scoring, model, n_lags)
        path = F.array_append("path", F.col("y_pred"))
        scoring = next_month(scored.withColumn("path", path), "y_pred", n_lags, keep=["path"])
    # The outer form: for the inner one the optimizer adds a filter on the size of the path and
    # copies all chained predictions into it.
    steps = F.posexplode_outer("path").alias("step", "y_pred")
    return scoring.select("series_id", steps).select(
        "series_id", (F.col("step") + last_month + 1).alias("month"), "y_pred"
    )


def predict_measures(
    lagged: DataFrame,
    estimator: Estimator | Boosting,
    last_month: int,
    scratch: Scratch,
    measures: Sequence[str] = MEASURES,
    horizon: int = HORIZON,
    n_lags: int = N_LAGS,
    retrain: str = "each_step",
    opening: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The same procedure for each measure of a frame with prefixed lags.

    Measures do not depend on each other. ``Boosting`` fits them together; any other estimator is
    driven by a thread for each, so that the many short stages of one training fill the gaps of
    the other.
    """
    if isinstance(estimator, Boosting):
        if retrain not in ("each_step", "once"):
            raise ValueError(f"unknown retrain mode: {retrain}")
        frames = {m: measure_frame(lagged, m, n_lags) for m in measures}
        last = {
            m: frames[m].filter(F.col("month") == last_month)
            if opening is None
            else measure_frame(opening, m, n_lags)
            for m in measures
        }
        return _boosted(
            frames,
            {m: next_month(f, "y", n_lags) for m, f in last.items()},
            replace(estimator, n_lags=n_lags),
            last_month,
            scratch,
            horizon,
            retrain,
        )

    def roll(measure: str) -> DataFrame:
        return recursive_predict(
            measure_frame(lagged, measure, n_lags),
            estimator.copy(),
            last_month,
            scratch,
            horizon,
            n_lags,
            retrain,
            None if opening is None else measure_frame(opening, measure, n_lags),
        )

    with ThreadPool(len(measures)) as pool:
        inheriting = inheritable_thread_target(lagged.sparkSession)(roll)
        tasks = [pool.apply_async(inheriting, (m,)) for m in measures]
        return {m: task.get() for m, task in zip(measures, tasks)}
