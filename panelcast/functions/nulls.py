"""Null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zero_fill(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls of the given measures by zero."""
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
