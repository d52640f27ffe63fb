"""What boosting does in Python workers, on blocks of binned rows.

These functions travel by value, so that a cluster needs no copy of the package; they are kept apart
and small, since they travel with every pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def descend(codes: np.ndarray, feature: np.ndarray, bin_: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after some levels; ``codes`` has a row per feature."""
    node = np.zeros(codes.shape[1], dtype=np.intp)
    rows = np.arange(codes.shape[1])
    for _ in range(levels):
        node = 2 * node + 1 + (codes[feature[node], rows] > bin_[node])
    return node


def subtract(residual: np.ndarray, codes: np.ndarray, trees: tuple) -> np.ndarray:
    """Residuals after further trees, given as arrays of features, bins and leaf values."""
    depth = trees[2].shape[1].bit_length() - 1
    residual = residual.copy()
    for feature, bin_, value in zip(*trees):
        leaf = descend(codes, feature, bin_, depth) - (len(value) - 1)
        residual -= value[leaf]
    return residual


def sums_by_key(weights: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Exact sums by key: amounts have up to 31 bits and a block far fewer than 2^21 rows, so the
    floats that they are summed in hold them exactly."""
    return np.bincount(keys, weights=weights, minlength=n).astype(np.int64)


def pack(batches: Iterator[pa.RecordBatch], n_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``(measure, y, codes)`` as blocks of arrays."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def block(measure: int) -> pa.RecordBatch:
        y = np.concatenate([w[0] for w in waiting])
        codes = np.ascontiguousarray(np.concatenate([w[1] for w in waiting]).T)
        waiting.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([measure], pa.int32()),
                pa.array([len(y)], pa.int32()),
                pa.array([y.tobytes()], pa.binary()),
                pa.array([codes.tobytes()], pa.binary()),
            ],
            names=["measure", "n", "y", "codes"],
        )

    measure = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        measure = batch.column(0)[0].as_py()
        codes = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        waiting.append((batch.column(1).to_numpy().astype(np.int64), codes.astype(np.uint16)))
        if sum(len(w[0]) for w in waiting) >= n_rows:
            yield block(measure)
    if waiting:
        yield block(measure)


def unpack(row) -> tuple[int, np.ndarray, np.ndarray]:
    y = np.frombuffer(bytes(row["y"]), dtype=np.int64)
    codes = np.frombuffer(bytes(row["codes"]), dtype=np.uint16).reshape(-1, row["n"])
    return row["measure"], y, codes
