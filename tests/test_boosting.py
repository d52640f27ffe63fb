"""Boosting by whole-number histograms: exact sums, the same trees however they are come by."""

import math
import random

import numpy as np
import pytest

from panelcast.operators import features, roll
from panelcast.operators.boosting import BoostedTrees, Boosting, Training, best_split, binnings

SETTINGS = Boosting(n_trees=12, learning_rate=0.3, max_bins=40, least_rows=5, refresh_every=4)


@pytest.fixture
def lagged(spark, scratch):
    """Seasonal series of different levels, and one without facts."""
    rows = [
        (s, m, 0.0 if s == 0 else 100.0 * s + 40.0 * s * math.sin(m * math.pi / 6) + 2 * m)
        for s in range(8)
        for m in range(48)
    ]
    frame = spark.createDataFrame(rows, "series_id long, month int, y double")
    return scratch.save(features.with_lags(frame, ["y"], 12), "lagged")


def trees_of(frames, settings, scratch, binning=None):
    with Training(frames, settings, scratch, binning) as training:
        return training.fit()


def same(a: BoostedTrees, b: BoostedTrees):
    assert a.binning == b.binning and a.forest.base == b.forest.base
    for x, y in ((a.forest.feature, b.forest.feature), (a.forest.bin, b.forest.bin)):
        assert np.array_equal(x, y)
    assert np.array_equal(a.forest.value, b.forest.value)


def test_partitions_do_not_matter(lagged, scratch):
    whole = trees_of({"y": lagged}, SETTINGS, scratch)["y"]
    for parts, size in ((7, 20), (3, 1000)):
        again = Boosting(**{**vars(SETTINGS), "rows_per_task": size, "refresh_every": 1 + parts})
        same(whole, trees_of({"y": lagged.repartition(parts)}, again, scratch)["y"])


def test_measures_together_as_alone(lagged, scratch):
    other = lagged.selectExpr("series_id", "month", "-3 * y AS y", *[
        f"-3 * lag_{k} AS lag_{k}" for k in range(1, 13)
    ])
    both = trees_of({"a": lagged, "b": other}, SETTINGS, scratch)
    same(both["a"], trees_of({"y": lagged}, SETTINGS, scratch)["y"])
    same(both["b"], trees_of({"y": other}, SETTINGS, scratch)["y"])


def test_added_months_give_the_trees_of_all(lagged, scratch):
    """Month by month: equal to a fit on all rows with the first rows' binning."""
    known = {"y": lagged.filter("month < 40")}
    with Training(known, SETTINGS, scratch) as training:
        for month in (40, 41, 42):
            # Rows of earlier months could not be read again: these frames hold one month.
            training.add({"y": lagged.filter(f"month = {month}")})
        added = training.fit()["y"]
        rows = training.root_rows.copy()
        amounts = training.root_amounts.copy()
        with Training(
            {"y": lagged.filter("month < 43")}, SETTINGS, scratch, training.binning
        ) as anew:
            assert np.array_equal(rows, anew.root_rows)
            assert np.array_equal(amounts, anew.root_amounts)
            same(added, anew.fit()["y"])


def test_passes(spark, lagged, scratch):
    """A job for each level of a tree for all measures; none for the first split."""
    with Training({"a": lagged, "b": lagged}, SETTINGS, scratch) as training:
        context = spark.sparkContext
        context.setJobGroup("passes", "")
        training.fit()
        jobs = context.statusTracker().getJobIdsForGroup("passes")
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 3 * SETTINGS.n_trees - 1


def plain_split(sums, rows, settings, unit):
    def shrunk(total):
        return math.copysign(max(abs(total) - settings.l1 / unit, 0.0), total)

    def explained(total, n):
        return shrunk(total) ** 2 / (n + settings.l2)

    total, n = sum(sums[0]), sum(rows[0])
    best = (explained(total, n), None, None)
    for f in range(len(sums)):
        for b in range(len(sums[f]) - 1):
            left, n_left = sum(sums[f][: b + 1]), sum(rows[f][: b + 1])
            if min(n_left, n - n_left) >= settings.least_rows:
                gain = explained(left, n_left) + explained(total - left, n - n_left)
                if gain > best[0]:
                    best = (gain, f, b)
    return best[1:]


def test_best_split():
    rng = random.Random(3)
    for trial in range(60):
        n_bins = rng.randint(2, 12)
        keys = [[rng.randrange(n_bins) for _ in range(40)] for _ in range(3)]
        amounts = [rng.randint(-500, 500) for _ in range(40)]
        sums, rows = np.zeros((2, 3, n_bins), np.int64)
        for f in range(3):
            np.add.at(sums[f], keys[f], amounts)
            np.add.at(rows[f], keys[f], 1)
        settings = Boosting(least_rows=rng.choice([1, 5, 18, 30]), l1=rng.choice([0.0, 200.0]))
        found = best_split(sums, rows, settings, 1.0)
        feature, code = plain_split(sums.tolist(), rows.tolist(), settings, 1.0)
        assert found.feature == feature and (feature is None or found.bin == code)


def test_plain_boosting(lagged, scratch):
    """The whole fit against a plain one over rows."""
    settings = Boosting(n_trees=4, max_bins=20, least_rows=10, learning_rate=0.5, refresh_every=3)
    model = trees_of({"y": lagged}, settings, scratch)["y"]
    binning = model.binning
    rows = (
        features.with_diffs(lagged, 11)
        .selectExpr(f"{binning.whole('y')} AS y", f"{binning.codes(11)} AS codes")
        .collect()
    )
    y, codes = [r["y"] for r in rows], [r["codes"] for r in rows]
    left_over = [v - model.forest.base for v in y]
    assert model.forest.base == math.floor(sum(y) / len(y) + 0.5)
    for t in range(settings.n_trees):
        node, chosen = [0] * len(y), settings.features_of(t)
        assert len(chosen) == 16 and chosen == sorted(set(chosen))
        for level in range(3):
            for k in range((1 << level) - 1, (2 << level) - 1):
                at = [i for i in range(len(y)) if node[i] == k]
                sums, counts = np.zeros((2, len(chosen), settings.max_bins), np.int64)
                for j, f in enumerate(chosen):
                    for i in at:
                        sums[j][codes[i][f]] += left_over[i]
                        counts[j][codes[i][f]] += 1
                feature, code = plain_split(sums.tolist(), counts.tolist(), settings, binning.unit)
                found = (model.forest.feature[t][k], model.forest.bin[t][k])
                assert found == ((0, 20) if feature is None else (chosen[feature], code))
                for i in at:
                    node[i] = 2 * k + 1 + (codes[i][found[0]] > found[1])
        left_over = [r - model.forest.value[t][k - 7] for r, k in zip(left_over, node)]
    predicted = model.transform(features.with_diffs(lagged, 11)).select("y", "y_pred").collect()
    assert [r["y_pred"] for r in predicted] == [
        (v - r) * binning.unit for v, r in zip(y, left_over)
    ]


def test_table(spark, lagged, scratch):
    model = trees_of({"y": lagged}, SETTINGS, scratch)["y"]
    table = scratch.save(model.table(spark), "trees")
    assert table.filter("NOT is_leaf").count() == 7 * SETTINGS.n_trees
    same(model, BoostedTrees.of_table(table, model.binning))
    # Borders are in the features' own amounts: counting by them gives the rows of the codes.
    split = table.filter("tree = 0 AND node = 0").first()
    frame = features.with_diffs(lagged, 11)
    code = model.binning.code(split["feature"])
    by_code = frame.filter(f"{code} <= {split['bin']}").count()
    by_border = frame.filter(f"{split['feature']} < {split['border']!r}D").count()
    assert by_code == by_border


def test_scoring_does_not_grow_with_the_trees(lagged, scratch):
    known = lagged.filter("month <= 41")
    few, many = (
        roll.recursive_predict(
            known, Boosting(n_trees=n, least_rows=5), 41, scratch, retrain="once"
        )
        for n in (2, 30)
    )
    sizes = [len(f._jdf.queryExecution().optimizedPlan().toString().split("aggregate(")) for f in (few, many)]
    assert sizes[0] == sizes[1]
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("retrain", ["once", "each_step"])
def test_back_test(lagged, scratch, retrain):
    """Train up to month 41, compare the six months after it with what happened."""
    known = lagged.filter("month <= 41")
    settings = Boosting(n_trees=20, learning_rate=0.2, least_rows=5)
    predicted = roll.recursive_predict(known, settings, 41, scratch, retrain=retrain)
    actual = lagged.filter("month > 41").select("series_id", "month", "y")
    rows = actual.join(predicted, ["series_id", "month"]).collect()
    assert len(rows) == 8 * 6
    error = sum((r.y - r.y_pred) ** 2 for r in rows)
    assert error < 0.1 * sum(r.y**2 for r in rows)


def test_edges(spark, lagged, scratch):
    """Constant amounts, no amounts, no rows."""
    level = lagged.selectExpr("series_id", "month", "7D AS y", *[f"7D AS lag_{k}" for k in range(1, 13)])
    model = trees_of({"y": level}, SETTINGS, scratch)["y"]
    scored = model.transform(features.with_diffs(level, 11)).select("y_pred").distinct().collect()
    assert [r[0] for r in scored] == pytest.approx([7.0])
    none = lagged.selectExpr("series_id", "month", "0D AS y", *[f"0D AS lag_{k}" for k in range(1, 13)])
    model = trees_of({"y": none}, SETTINGS, scratch)["y"]
    scored = model.transform(features.with_diffs(lagged, 11)).select("y_pred").distinct().collect()
    assert [r[0] for r in scored] == [0.0]
    with pytest.raises(ValueError):
        binnings({"y": lagged.limit(0)}, 10)
