"""Broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64


def broadcast_if_small(frame: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast below ``limit``; beyond it the join shuffles (AQE splits hot keys)."""
    return F.broadcast(frame) if n_bytes <= limit else frame
