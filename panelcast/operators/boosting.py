"""Gradient boosting of regression trees from additive histograms of whole numbers.

Amounts are counted in a power of two, the unit of their measure, and features in bins, so every sum
below is a whole number: it does not depend on the order or the partitions it is taken in, sums of
parts add up to the sum of all, and equal inputs give equal trees wherever they are fitted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.features import with_diffs
from panelcast.operators.histograms import descend, pack, subtract, sums_by_key, unpack
from panelcast.schema import N_LAGS, feature_names
from panelcast.sources.scratch import Scratch

VALUE_BITS, SUM_BITS = 28, 61
BLOCK = "measure int, n int, y binary, codes binary"
TREE = "array<struct<feature:array<int>,bin:array<int>,value:array<bigint>>>"


# The settings of the trees below (500, 0.03, 3, 510, 0.64, 1.2, 1.4, 20).
@dataclass(frozen=True)
class Boosting:
    """Settings of ``n_trees`` trees of depth ``max_depth``; takes the place of an estimator.

    ``l1`` and ``l2`` shrink sums of residuals and leaves, ``least_rows`` bounds a leaf from below,
    ``feature_share`` of the features, another choice for each tree, may be split on. Residuals
    are taken from the amounts anew every ``refresh_every`` trees, and a task reads about
    ``rows_per_task`` rows: both move cost only.
    """

    n_trees: int = 500
    learning_rate: float = 0.03
    max_depth: int = 3
    max_bins: int = 510
    feature_share: float = 0.64
    l1: float = 1.2
    l2: float = 1.4
    least_rows: int = 20
    n_lags: int = N_LAGS
    seed: int = 1
    refresh_every: int = 10
    rows_per_task: int = 65_536

    def fit(self, frame: DataFrame) -> BoostedTrees:
        """Trees of one measure, given as ``(series_id, month, y, lag_*)``."""
        scratch = Scratch(frame.sparkSession)
        rows = frame.drop(*[f"diff_{k}" for k in range(1, self.n_lags + 1)])
        with Training({"y": rows}, self, scratch) as training:
            model = training.fit()["y"]
        scratch.close()
        return model

    def features_of(self, tree: int) -> list[int]:
        """The features that a tree may split on: those of the least marks, squares modulo a prime
        of numbers that no two features and trees share."""
        n = 2 * self.n_lags + 2
        prime = 2_147_483_647
        marks = []
        for feature in range(n):
            mark = (((self.seed * self.n_trees + tree) * n + feature + 1) * 48_271) % prime
            marks.append(((mark * mark) % prime, feature))
        return sorted(f for _, f in sorted(marks)[: math.ceil(self.feature_share * n)])


@dataclass(frozen=True)
class Binning:
    """How one measure's amounts are counted and its features binned.

    An amount ``x`` lies at ``x / (|x| + scale)``, between -1 and 1, where amounts about as large as
    the mean one are told apart best; bins are equal there, from the least to the greatest seen.
    Series and months lie where their numbers are. Values outside fall into the outer bins.
    """

    unit: float
    n_bins: int
    series: tuple[float, float]
    month: tuple[float, float]
    level: tuple[float, float, float]
    change: tuple[float, float, float]

    def whole(self, column: str) -> str:
        """An amount in units, as SQL."""
        return f"CAST(floor({column} / {self.unit!r}D + 0.5D) AS BIGINT)"

    def _at(self, feature: str) -> tuple[str, float, float]:
        if feature in ("series_id", "month"):
            first, factor = self.series if feature == "series_id" else self.month
            return f"CAST({feature} AS DOUBLE)", first, factor
        scale, first, factor = self.level if feature.startswith("lag") else self.change
        return f"{feature} / (abs({feature}) + {scale!r}D)", first, factor

    def code(self, feature: str) -> str:
        """The bin of a feature, as SQL."""
        at, first, factor = self._at(feature)
        place = f"floor(({at} - {first!r}D) * {factor!r}D)"
        return f"CAST(least({self.n_bins - 1}, greatest(0, {place})) AS SMALLINT)"

    def codes(self, n_lags: int) -> str:
        return f"array({', '.join(map(self.code, feature_names(n_lags)))})"

    def border(self, feature: str, code: int) -> float:
        """About the greatest value in bin ``code`` or below, for reading."""
        _, first, factor = self._at(feature)
        if not factor or code >= self.n_bins - 1:
            return math.inf
        at = first + (code + 1) / factor
        if feature in ("series_id", "month"):
            return at
        scale = (self.level if feature.startswith("lag") else self.change)[0]
        return math.inf if abs(at) >= 1 else at * scale / (1 - abs(at))


def _even(first: float, last: float, n_bins: int) -> tuple[float, float]:
    return first, n_bins / (last - first) if last > first else 0.0


def _counted(first: int, last: int, n_bins: int) -> tuple[float, float]:
    """A bin for each number, or equal ones where there are more numbers."""
    return float(first), 1.0 if last - first < n_bins else n_bins / (last - first)


def binnings(frames: Mapping[str, DataFrame], n_bins: int) -> dict[str, Binning]:
    """Of each measure, from two scans of all frames together: extremes, then mean amounts."""
    names = list(frames)
    numbered = [
        frame.selectExpr(
            f"{i} AS measure", "series_id", "month", "y", "y - lag_1 AS change"
        )
        for i, frame in enumerate(frames.values())
    ]
    rows = numbered[0]
    for other in numbered[1:]:
        rows = rows.unionByName(other)
    ranges = [
        f(c).alias(f"{f.__name__}_{c}")
        for c in ("series_id", "month", "y", "change")
        for f in (F.min, F.max)
    ]
    found = {r["measure"]: r for r in rows.groupBy("measure").agg(F.count("*").alias("n"), *ranges).collect()}
    units = {}
    for i, name in enumerate(names):
        if i not in found:
            raise ValueError(f"no rows to fit {name} on")
        r = found[i]
        largest = max(abs(r[k]) for k in ("min_y", "max_y", "min_change", "max_change"))
        bits = min(VALUE_BITS, SUM_BITS - r["n"].bit_length())
        units[i] = math.ldexp(1.0, math.frexp(largest)[1] - bits) if largest else 1.0
    unit = F.element_at(F.create_map(*[F.lit(v) for p in units.items() for v in p]), F.col("measure"))

    def mean_size(name: str):
        counted = F.floor(F.col(name) / unit + F.lit(0.5))
        return F.sum(F.abs(counted).cast("long")).alias(name)

    sums = {
        r["measure"]: r
        for r in rows.groupBy("measure").agg(mean_size("y"), mean_size("change")).collect()
    }

    def spread(i: int, name: str) -> tuple[float, float, float]:
        mean = float(sums[i][name]) / found[i]["n"] * units[i]
        scale = mean if mean > 0 else units[i]
        ends = [
            x / (abs(x) + scale)
            for x in (min(found[i][f"min_{name}"], 0.0), max(found[i][f"max_{name}"], 0.0))
        ]
        return (scale, *_even(*ends, n_bins))

    return {
        name: Binning(
            units[i],
            n_bins,
            _counted(found[i]["min_series_id"], found[i]["max_series_id"], n_bins),
            _counted(found[i]["min_month"], found[i]["max_month"], n_bins),
            spread(i, "y"),
            spread(i, "change"),
        )
        for i, name in enumerate(names)
    }


@dataclass
class Forest:
    """Trees of one measure as arrays: a split per inner node, a whole value per leaf.

    Children of node ``i`` are ``2 i + 1`` (codes up to ``bin``) and ``2 i + 2``. Where a node has
    no split, all codes go left.
    """

    base: int
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, base: int, depth: int) -> Forest:
        inner, leaves = (1 << depth) - 1, 1 << depth
        return cls(
            base,
            np.zeros((0, inner), np.int32),
            np.zeros((0, inner), np.int32),
            np.zeros((0, leaves), np.int64),
        )

    def plus(self, feature: np.ndarray, bin_: np.ndarray, value: np.ndarray) -> Forest:
        return Forest(
            self.base,
            np.vstack([self.feature, feature]),
            np.vstack([self.bin, bin_]),
            np.vstack([self.value, value]),
        )

    def since(self, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.feature[tree:], self.bin[tree:], self.value[tree:]


class Training:
    """The binned rows of several measures, fitted together and added to from month to month.

    Rows are binned once and written as blocks. The sums of amounts and rows by feature and bin
    (``roots``), from which the first split of the first tree is found, are kept: further rows are
    read once and added. Binning stays that of the first rows, so fitting after additions gives the
    trees of a fit on all rows with that binning.

    Every level of a tree takes one pass for all measures: tasks sum residuals and rows by node,
    feature and bin over their blocks, partial sums are merged in a tree of tasks, and the split is
    searched over the merged sums, whose size depends on nodes, features and bins alone. Only left
    children are summed; their siblings are the rest of the parent.
    """

    def __init__(
        self,
        frames: Mapping[str, DataFrame],
        settings: Boosting,
        scratch: Scratch,
        binning: Mapping[str, Binning] | None = None,
    ):
        self.settings, self.scratch = settings, scratch
        self.names = list(frames)
        self.binning = dict(binning or binnings(frames, settings.max_bins))
        self.blocks: list[RDD] = []
        n_features = 2 * settings.n_lags + 2
        shape = (len(self.names), n_features, settings.max_bins)
        self.root_rows, self.root_amounts = (np.zeros(shape, np.int64) for _ in range(2))
        self.add(frames)

    def __enter__(self) -> Training:
        return self

    def __exit__(self, *_) -> None:
        for blocks in self.blocks:
            blocks.unpersist()

    def add(self, frames: Mapping[str, DataFrame]) -> None:
        """Further rows ``(series_id, month, y, lag_*)`` of each measure; only these are read."""
        n_lags, n_bins = self.settings.n_lags, self.settings.max_bins
        size = self.settings.rows_per_task
        packed = None
        for i, name in enumerate(self.names):
            binning = self.binning[name]
            rows = with_diffs(frames[name], n_lags).selectExpr(
                f"{i} AS measure", f"{binning.whole('y')} AS y", f"{binning.codes(n_lags)} AS codes"
            )
            blocks = rows.mapInArrow(lambda batches: pack(batches, size), BLOCK)
            packed = blocks if packed is None else packed.unionByName(blocks)
        stored = self.scratch.save(packed, "blocks")
        n_rows, n_parts = stored.agg(F.sum("n"), F.count("*")).first()
        tasks = max(1, min(n_parts or 1, math.ceil((n_rows or 0) / size)))
        blocks = stored.rdd.map(unpack).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        n_measures, n_features = self.root_rows.shape[:2]

        def totals(part: Iterator[tuple]) -> Iterator[np.ndarray]:
            sums = np.zeros((2, n_measures, n_features, n_bins), np.int64)
            for measure, y, codes in part:
                for f in range(n_features):
                    sums[0, measure, f] += np.bincount(codes[f], minlength=n_bins)
                    sums[1, measure, f] += sums_by_key(y, codes[f], n_bins)
            yield sums

        rows, amounts = blocks.mapPartitions(totals).treeReduce(np.add)
        self.root_rows += rows
        self.root_amounts += amounts
        self.blocks.append(blocks)

    def fit(self) -> dict[str, BoostedTrees]:
        """Fit all measures on all rows so far."""
        settings = self.settings
        forests = []
        for rows, amounts in zip(self.root_rows[:, 0], self.root_amounts[:, 0]):
            n = int(rows.sum())
            base = math.floor(float(amounts.sum()) / n + 0.5) if n else 0
            forests.append(Forest.empty(base, settings.max_depth))
        blocks = self.blocks[0]
        for more in self.blocks[1:]:
            blocks = blocks.union(more)
        tasks = math.ceil(int(self.root_rows[:, 0].sum()) / settings.rows_per_task)
        blocks = blocks.coalesce(max(1, tasks))
        residuals = None
        for tree in range(settings.n_trees):
            before = residuals
            if tree % settings.refresh_every == 0:
                residuals = self._residuals(blocks, forests)
            else:
                residuals = self._further(before, [f.since(tree - 1) for f in forests])
            grown = self._grow(residuals, tree, forests)
            forests = [f.plus(*g) for f, g in zip(forests, grown)]
            if before is not None:
                before.unpersist()
        if residuals is not None:
            residuals.unpersist()
        return {
            name: BoostedTrees(self.binning[name], forest, settings.n_lags)
            for name, forest in zip(self.names, forests)
        }

    @staticmethod
    def _further(residuals: RDD, last: list[tuple]) -> RDD:
        """What the last tree leaves of the residuals before it; written by the pass that first
        reads it."""

        def left(block: tuple) -> tuple:
            measure, residual, codes = block
            return measure, subtract(residual, codes, last[measure]), codes

        return residuals.map(left).persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def _residuals(blocks: RDD, forests: list[Forest]) -> RDD:
        """What all trees so far leave, from the amounts themselves: no block depends on more than
        the stored table and a few trees' passes."""

        all_trees = [(f.base, f.since(0)) for f in forests]

        def left(block: tuple) -> tuple:
            measure, y, codes = block
            base, trees = all_trees[measure]
            return measure, subtract(y - base, codes, trees), codes

        return blocks.map(left).persist(StorageLevel.MEMORY_AND_DISK)

    def _grow(self, residuals: RDD, tree: int, forests: list[Forest]) -> list:
        """One tree for each measure: ``(feature, bin, value)`` by node."""
        settings = self.settings
        features = settings.features_of(tree)
        depth, n_measures = settings.max_depth, len(self.names)
        inner = (1 << depth) - 1
        split_feature = np.zeros((n_measures, inner), np.int32)
        split_bin = np.full((n_measures, inner), settings.max_bins, np.int32)
        values = np.zeros((n_measures, inner + 1), np.int64)
        parents = None
        for level in range(depth):
            if level == 0 and tree == 0:
                bases = np.array([f.base for f in forests])[:, None, None]
                rows = self.root_rows[:, features]
                sums = np.stack([self.root_amounts[:, features] - bases * rows, rows])[:, :, None]
            else:
                sums = self._level_sums(residuals, features, level, split_feature, split_bin)
                if level == 0:
                    sums[1] = self.root_rows[:, features][:, None]
            if level:
                # Left children were summed; the right ones are the rest.
                sums = np.stack([sums, parents - sums], axis=3).reshape(
                    2, n_measures, 1 << level, len(features), settings.max_bins
                )
            parents = sums
            first = (1 << level) - 1
            for m in range(n_measures):
                unit = self.binning[self.names[m]].unit
                for k in range(1 << level):
                    found = best_split(sums[0, m, k], sums[1, m, k], settings, unit)
                    at, leaves = first + k, 2 * k
                    if found.feature is not None:
                        split_feature[m, at] = features[found.feature]
                        split_bin[m, at] = found.bin
                    if level == depth - 1:
                        values[m, leaves : leaves + 2] = found.values
        return [(split_feature[m], split_bin[m], values[m]) for m in range(n_measures)]

    def _level_sums(
        self,
        residuals: RDD,
        features: list[int],
        level: int,
        split_feature: np.ndarray,
        split_bin: np.ndarray,
    ) -> np.ndarray:
        """Sums of residuals and rows by measure, node, feature and bin; of left children only. The
        rows of the root are known and not counted again."""
        n_bins, n_measures = self.settings.max_bins, len(self.names)
        n_nodes = max(1, (1 << level) >> 1)

        def partial(part: Iterator[tuple]) -> Iterator[np.ndarray]:
            sums = np.zeros((2, n_measures, n_nodes, len(features), n_bins), np.int64)
            size = n_nodes * n_bins
            for measure, residual, codes in part:
                residual = residual.astype(np.float64)
                if not level:
                    for at, feature in enumerate(features):
                        sums[0, measure, 0, at] += sums_by_key(residual, codes[feature], size)
                    continue
                node = descend(codes, split_feature[measure], split_bin[measure], level)
                node -= (1 << level) - 1
                left = np.flatnonzero(node % 2 == 0)
                residual, start = residual[left], (node[left] >> 1) * n_bins
                for at, feature in enumerate(features):
                    keys = start + codes[feature][left]
                    by_node = (n_nodes, n_bins)
                    sums[0, measure, :, at] += sums_by_key(residual, keys, size).reshape(by_node)
                    sums[1, measure, :, at] += np.bincount(keys, minlength=size).reshape(by_node)
            yield sums

        return residuals.mapPartitions(partial).treeReduce(np.add)


@dataclass(frozen=True)
class Split:
    """The best split of a node (none if ``feature`` is None) and the values of its children."""

    feature: int | None
    bin: int
    values: tuple[int, int]


def best_split(sums: np.ndarray, rows: np.ndarray, settings: Boosting, unit: float) -> Split:
    """Search the residual sums and row counts of one node, by feature and bin.

    The split whose children explain most is taken, the first feature and bin of equal ones. It must
    explain more than the node itself and leave ``least_rows`` rows on either side.
    """
    l1, l2 = settings.l1 / unit, settings.l2

    def shrunk(total):
        return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)

    def explained(total, n):
        return shrunk(total) * shrunk(total) / (n + l2)

    def value(total: int, n: int) -> int:
        return math.floor(settings.learning_rate * float(shrunk(float(total))) / (n + l2) + 0.5)

    total, n = int(sums[0].sum()), int(rows[0].sum())
    left, n_left = np.cumsum(sums, axis=1), np.cumsum(rows, axis=1)
    right, n_right = total - left, n - n_left
    gains = explained(left.astype(np.float64), n_left) + explained(right.astype(np.float64), n_right)
    allowed = (n_left >= settings.least_rows) & (n_right >= settings.least_rows)
    gains = np.where(allowed, gains, -1.0)
    best = int(np.argmax(gains))
    feature, code = divmod(best, sums.shape[1])
    if gains[feature, code] <= explained(float(total), n):
        return Split(None, 0, (value(total, n), 0))
    sides = (
        (int(left[feature, code]), int(n_left[feature, code])),
        (int(right[feature, code]), int(n_right[feature, code])),
    )
    return Split(feature, code, tuple(value(*side) for side in sides))


TABLE = (
    "tree int, node int, feature string, bin int, border double, value bigint, is_leaf boolean"
)


@dataclass(frozen=True)
class BoostedTrees:
    """Fitted trees of one measure, as a table of nodes and as one column expression."""

    binning: Binning
    forest: Forest
    n_lags: int = N_LAGS

    @property
    def n_trees(self) -> int:
        return len(self.forest.value)

    @property
    def n_features(self) -> int:
        return len(feature_names(self.n_lags))

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per node: rows whose code of ``feature`` is at most ``bin`` (values up to about
        ``border``) go to node ``2 n + 1``, the others to ``2 n + 2``; leaves have a ``value`` in
        units. Tree -1 has one leaf, the mean."""
        names, rows = feature_names(self.n_lags), []
        rows.append((-1, 0, None, None, None, self.forest.base, True))
        for t, (feature, bin_, value) in enumerate(
            zip(self.forest.feature, self.forest.bin, self.forest.value)
        ):
            for n, (f, b) in enumerate(zip(feature.tolist(), bin_.tolist())):
                rows.append((t, n, names[f], b, self.binning.border(names[f], b), None, False))
            for k, v in enumerate(value.tolist()):
                rows.append((t, len(feature) + k, None, None, None, v, True))
        return spark.createDataFrame(rows, TABLE)

    @classmethod
    def of_table(cls, table: DataFrame, binning: Binning, n_lags: int = N_LAGS) -> BoostedTrees:
        """The trees of a table, whose size is that of a model."""
        number = {name: i for i, name in enumerate(feature_names(n_lags))}
        rows = table.orderBy("tree", "node").collect()
        trees: dict[int, list] = {}
        for row in rows:
            trees.setdefault(row["tree"], []).append(row)
        base = trees.pop(-1)[0]["value"]
        parts = [[], [], []]
        for _, nodes in sorted(trees.items()):
            inner = [r for r in nodes if not r["is_leaf"]]
            parts[0].append([number[r["feature"]] for r in inner])
            parts[1].append([r["bin"] for r in inner])
            parts[2].append([r["value"] for r in nodes if r["is_leaf"]])
        forest = Forest(
            base, *(np.array(p, dtype=t) for p, t in zip(parts, (np.int32, np.int32, np.int64)))
        )
        return cls(binning, forest, n_lags)

    def prediction(self) -> str:
        """The predicted amount from ``series_id, month, lag_*, diff_*``, as SQL.

        The trees are one constant of arrays, walked by each row; the expression does not grow
        with their number.
        """
        trees = [
            {"feature": f.tolist(), "bin": b.tolist(), "value": v.tolist()}
            for f, b, v in zip(self.forest.feature, self.forest.bin, self.forest.value)
        ]
        leaves = self.forest.value.shape[1]
        levels = leaves.bit_length() - 1
        step = "2 * n + 1 + IF(codes[t.feature[n]] > t.bin[n], 1, 0)"
        walk = f"aggregate(sequence(1, {levels}), 0, (n, k) -> {step})"
        sums = (
            f"aggregate(from_json('{json.dumps(trees)}', '{TREE}'), {self.forest.base}L, "
            f"(total, t) -> total + t.value[{walk} - {leaves - 1}])"
        )
        codes = self.binning.codes(self.n_lags)
        return f"transform(array({codes}), codes -> {sums})[0] * {self.binning.unit!r}D"

    def transform(self, frame: DataFrame) -> DataFrame:
        return frame.selectExpr("*", f"{self.prediction()} AS y_pred")

