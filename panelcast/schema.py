"""Names and schemas shared by every module."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

KEYS = ("bu", "ctt", "ope", "pthrough")
MEASURES = ("ca", "mg")
N_LAGS = 11
HORIZON = 6

# Column labels of the exchanged files, in file order.
HISTORY_LABELS = {
    "période": "periode",
    "bu": "bu",
    "ctt": "ctt",
    "opé": "ope",
    "pthrough ?": "pthrough",
    "ca mois": "ca",
    "mg mois": "mg",
}
PUBLISHED_LABELS = {
    "month": "Month",
    "period_end": "periode",
    "bu": "bu",
    "ctt": "ctt",
    "ope": "ope",
    "pthrough": "pthrough ?",
    "ca": "ca mois",
    "ca_pred": "Forecast CA Month",
    "mg": "mg mois",
    "mg_pred": "Forecast Mg Month",
}
# The list each key column is taken from.
DIMENSION_LISTS = {
    "bu": "Departements",
    "ctt": "ctt",
    "ope": "typeOpe",
    "pthrough": "SousTraitance",
}

AMOUNT = T.DecimalType(18, 4)


def history_schema(measures: Sequence[str] = MEASURES) -> T.StructType:
    """Facts: a period label, the business keys and the amounts."""
    return T.StructType(
        [T.StructField("periode", T.StringType())]
        + [T.StructField(key, T.StringType()) for key in KEYS]
        + [T.StructField(measure, AMOUNT) for measure in measures]
    )


def published_schema(measures: Sequence[str] = MEASURES) -> T.StructType:
    """Months of the outlook: for each measure what was observed and what was predicted."""
    return T.StructType(
        [T.StructField("month", T.IntegerType()), T.StructField("period_end", T.DateType())]
        + [T.StructField(key, T.StringType()) for key in KEYS]
        + [
            T.StructField(name, T.DoubleType())
            for measure in measures
            for name in (measure, f"{measure}_pred")
        ]
    )


HISTORY = history_schema()
PUBLISHED = published_schema()

AUDIT = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_mtime", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def lag_name(k: int, measure: str | None = None) -> str:
    return f"lag_{k}" if measure is None else f"{measure}_lag_{k}"


def feature_names(n_lags: int = N_LAGS) -> list[str]:
    """Model inputs: the series number, the month and all lags and differences."""
    return (
        ["series_id", "month"]
        + [f"lag_{k}" for k in range(1, n_lags + 1)]
        + [f"diff_{k}" for k in range(1, n_lags + 1)]
    )
