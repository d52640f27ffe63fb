"""Scans of history, dimension lists and the published table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.catalog import dimension_members
from panelcast.schema import (
    DIMENSION_LISTS,
    HISTORY_LABELS,
    MEASURES,
    history_schema,
    published_schema,
)
from panelcast.sources.scratch import Scratch


# Quotes are doubled inside quotes, as spreadsheets do it; files read together must agree on
# their header; a ragged row fails the query.
CSV_READ = {"header": True, "escape": '"', "enforceSchema": False, "mode": "FAILFAST"}


def scan(
    spark: SparkSession, path: str | Sequence[str], fmt: str, options: dict | None = None
) -> DataFrame:
    defaults = CSV_READ if fmt == "csv" else {}
    reader = spark.read.format(fmt).options(**{**defaults, **(options or {})})
    return reader.load(path if isinstance(path, str) else list(path))


def rename_columns(frame: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Project to the labelled columns, in the order of ``labels``, under their new names.

    A missing column raises.
    """
    return frame.select(*[F.col(f"`{old}`").alias(new) for old, new in labels.items()])


def normalise_history(
    raw: DataFrame, decimal: str = ".", measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Period, keys and measures under internal names and types; other columns of the file are not
    read.

    ``decimal`` is the mark that amounts written as text have.
    """
    schema = history_schema(measures)
    named = raw
    if "période" in raw.columns:
        label_of = {name: label for label, name in HISTORY_LABELS.items()}
        named = rename_columns(raw, {label_of.get(name, name): name for name in schema.names})
    texts = {f.name for f in named.schema if isinstance(f.dataType, T.StringType)}

    def typed(field: T.StructField) -> Column:
        value = F.col(field.name)
        if decimal != "." and field.name in texts and isinstance(field.dataType, T.DecimalType):
            value = F.replace(value, F.lit(decimal), F.lit("."))
        return value.cast(field.dataType).alias(field.name)

    return named.select(*[typed(f) for f in schema.fields])


def read_history(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    measures: Sequence[str] = MEASURES,
    **options,
) -> DataFrame:
    """Fact scan; accepts the labels of the exchanged file or the internal names.

    ``options`` go to the reader, for instance ``sep=";"``; ``decimal=","`` is for amounts with a
    decimal comma.
    """
    decimal = options.pop("decimal", ".")
    return normalise_history(scan(spark, path, fmt, options), decimal, measures)


def read_dimensions(
    spark: SparkSession, path: str, scratch: Scratch, fmt: str = "parquet"
) -> DataFrame:
    """The four dimension lists under ``path`` as one frame ``(dim, value, ord)``.

    Each list has its values in the first column and may carry its own 0-based ``ord``;
    a list without one is numbered by sorted value.
    """
    numbered, plain = [], []
    for dim, sheet in DIMENSION_LISTS.items():
        members = scan(spark, f"{path.rstrip('/')}/{sheet}", fmt)
        value = F.col(f"`{members.columns[0]}`").cast("string").alias("value")
        if "ord" in members.columns:
            place = F.col("ord").cast("int")
            numbered.append(members.select(F.lit(dim).alias("dim"), value, place))
        else:
            plain.append(members.select(F.lit(dim).alias("dim"), value))
    if plain:
        merged = plain[0]
        for other in plain[1:]:
            merged = merged.unionByName(other)
        numbered.append(dimension_members(merged, scratch))
    lists = numbered[0]
    for other in numbered[1:]:
        lists = lists.unionByName(other)
    return lists


def read_if_present(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame | None:
    """A stored table, or None where nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_published(
    spark: SparkSession, path: str, measures: Sequence[str] = MEASURES
) -> DataFrame:
    schema = published_schema(measures)
    return spark.read.schema(schema).parquet(path).select(*schema.names)
