"""Pooled predictors, as Spark ML estimators that write ``y_pred``."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame

from panelcast.operators.features import with_diffs
from panelcast.schema import N_LAGS, feature_names


def feature_assembler(n_lags: int = N_LAGS) -> VectorAssembler:
    return VectorAssembler(inputCols=feature_names(n_lags), outputCol="features")


# The settings of the trees below (500, 0.03, 3, 510, 0.64).
def pooled_gbt(
    n_trees: int = 500,
    learning_rate: float = 0.03,
    max_depth: int = 3,
    max_bins: int = 510,
    feature_share: float = 0.64,
    row_share: float = 1.0,
    checkpoint_every: int = 10,
    n_lags: int = N_LAGS,
    seed: int = 1,
) -> Pipeline:
    """One gradient-boosted regressor for all series, trained distributed.

    Residuals are checkpointed to the shared folder every few rounds, so that their lineage
    stays short however many trees are asked for.
    """
    booster = GBTRegressor(
        featuresCol="features",
        labelCol="y",
        predictionCol="y_pred",
        maxIter=n_trees,
        stepSize=learning_rate,
        maxDepth=max_depth,
        maxBins=max_bins,
        featureSubsetStrategy=str(feature_share),
        subsamplingRate=row_share,
        checkpointInterval=checkpoint_every,
        maxMemoryInMB=512,
        seed=seed,
    )
    return Pipeline(stages=[feature_assembler(n_lags), booster])


def fixed_weights(*weights: float) -> Pipeline:
    """A predictor without training: the weighted sum of the first lags."""
    terms = " + ".join(f"{float(w)!r}D * lag_{k}" for k, w in enumerate(weights, 1))
    return Pipeline(
        stages=[SQLTransformer(statement=f"SELECT *, {terms} AS y_pred FROM __THIS__")]
    )


def assemble_features(lagged: DataFrame, n_lags: int = N_LAGS) -> DataFrame:
    """Feature vectors of a frame with the lags 1..``n_lags`` + 1."""
    return feature_assembler(n_lags).transform(with_diffs(lagged, n_lags))


def fit_pooled_model(lagged: DataFrame, estimator: Estimator, n_lags: int = N_LAGS) -> Transformer:
    """Train on all rows of ``(series_id, month, y, lag_*)``."""
    return estimator.fit(with_diffs(lagged, n_lags))


def score_month(scoring: DataFrame, model: Transformer, n_lags: int = N_LAGS) -> DataFrame:
    """Predict the rows of one month from their lags; keeps the lags for the month after."""
    return model.transform(with_diffs(scoring, n_lags)).select(*scoring.columns, "y_pred")
