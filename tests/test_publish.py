import csv
import datetime as dt
import glob

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from panelcast import publish_outlook
from panelcast.functions.periods import month_end
from panelcast.operators import model
from panelcast.operators.publish import join_measures
from panelcast.schema import PUBLISHED, PUBLISHED_LABELS
from panelcast.sources import sinks
from panelcast.sources.scratch import Scratch
from panelcast.sources.tables import read_published

@pytest.fixture
def publisher(micro, tmp_path):
    history, lists = micro
    path = str(tmp_path / "published")

    def run(as_of, **more):
        return publish_outlook(
            history,
            path,
            lists,
            as_of=as_of,
            estimator=model.fixed_weights(0.5, 0.5),
            retrain="once",
            **more,
        )

    return path, run


def table(spark, path):
    return sorted(read_published(spark, path).collect(), key=lambda r: (r.month, r.bu))


def test_twice_is_once(spark, publisher):
    path, run = publisher
    run(AS_OF)
    first = table(spark, path)
    run(AS_OF)
    assert table(spark, path) == first
    assert len(first) == 2 * 10


def test_earlier_months_stay_as_published(spark, publisher):
    path, run = publisher
    run(dt.date(2021, 4, 10))  # April is incomplete: months 0..2 known, 3..8 predicted
    run(AS_OF)  # April is known now
    rows = {(r.month, r.bu): r for r in table(spark, path)}
    assert (rows[3, "A"].ca, rows[3, "A"].ca_pred) == (None, 15.0)
    assert rows[4, "A"].ca_pred == 17.5
    assert max(m for m, _ in rows) == 9


def test_last_month_can_be_renewed(spark, publisher):
    path, run = publisher
    run(dt.date(2021, 4, 10))
    run(AS_OF, replace_from="last")
    rows = {(r.month, r.bu): r for r in table(spark, path)}
    assert (rows[3, "A"].ca, rows[3, "A"].ca_pred) == (5.0, None)


def test_going_back_removes_surplus_months(spark, publisher):
    path, run = publisher
    run(AS_OF)
    run(dt.date(2021, 4, 10))
    rows = table(spark, path)
    assert max(r.month for r in rows) == 8
    assert {r.month: r.ca_pred for r in rows if r.bu == "A"}[3] == 15.0
    assert len(rows) == 2 * 9


def test_intermediate_tables_are_dropped(spark, publisher, monkeypatch):
    path, run = publisher
    made = []
    plain = Scratch.__init__

    def noted(self, session):
        plain(self, session)
        made.append(self.path)

    monkeypatch.setattr(Scratch, "__init__", noted)
    run(AS_OF)
    assert made and not any(glob.glob(f"{p}*") for p in made)


def outlook_rows(spark, n):
    rows = [
        (m, month_end(dt.date(2021, 1, 1), m), "A,\"1\"", "é", None, "p", 0.1 + m, None, None, 1 / 3)
        for m in range(n)
    ]
    return spark.createDataFrame(rows, PUBLISHED)


def exported(path):
    parts = sorted(glob.glob(f"{path}/part-*.csv"))
    return [list(csv.reader(open(p, encoding="utf-8"))) for p in parts]


def test_export_is_one_sorted_file(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.export_csv(outlook_rows(spark, 5).repartition(3), path)
    (rows,) = exported(path)
    assert rows[0] == list(PUBLISHED_LABELS.values())
    assert [r[0] for r in rows[1:]] == ["0", "1", "2", "3", "4"]
    assert rows[1][2:6] == ['A,"1"', "é", "", "p"]
    assert float(rows[2][6]) == 1.1


def test_long_exports_are_split_not_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 4)
    path = str(tmp_path / "out")
    sinks.export_csv(outlook_rows(spark, 21), path)
    files = exported(path)
    assert len(files) > 5 and all(len(rows) <= 1 + 4 for rows in files)
    # The files follow one another in order.
    assert [int(r[0]) for rows in files for r in rows[1:]] == list(range(21))


def test_a_single_file_is_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 4)
    path = str(tmp_path / "out")
    sinks.export_csv(outlook_rows(spark, 21).repartition(3), path, single_file=True)
    (rows,) = exported(path)
    assert [int(r[0]) for r in rows[1:]] == list(range(21))


def frame_of(spark, first, last, predicted_from, value):
    """Rows of months ``first`` to ``last``, counted from January 2020, numbered from 0."""
    rows = [
        (
            m - first, month_end(dt.date(2020, 1, 1), m), "A", "c", "o", "p",
            value if m < predicted_from else None, None if m < predicted_from else value, 0.0, None,
        )
        for m in range(first, last + 1)
    ]
    return spark.createDataFrame(rows, PUBLISHED)


def publish(spark, path, first, last, predicted_from, value):
    sinks.publish_partitions(
        frame_of(spark, first, last, predicted_from, value),
        path,
        month_end(dt.date(2020, 1, 1), predicted_from),
        month_end(dt.date(2020, 1, 1), last),
    )
    rows = read_published(spark, path).orderBy("period_end").collect()
    assert len({r.period_end for r in rows}) == len(rows)
    months = {(r.period_end.year - 2020) * 12 + r.period_end.month - 1: r for r in rows}
    return {m: r.ca if r.ca is not None else r.ca_pred for m, r in months.items()}


def test_a_pause_leaves_no_hole(spark, tmp_path):
    path = str(tmp_path / "table")
    publish(spark, path, 0, 20, 15, 1.0)
    found = publish(spark, path, 0, 30, 25, 2.0)
    assert found == {m: 1.0 if m <= 20 else 2.0 for m in range(31)}


@pytest.mark.parametrize("begin", [3, -3])
def test_a_history_that_begins_elsewhere(spark, tmp_path, begin):
    path = str(tmp_path / "table")
    publish(spark, path, 0, 20, 15, 1.0)
    found = publish(spark, path, begin, 21, 16, 2.0)
    assert found == {m: 1.0 if m < 16 else 2.0 for m in range(22)}


def test_a_failed_run_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    before = publish(spark, path, 0, 20, 15, 1.0)
    broken = frame_of(spark, 0, 12, 8, 2.0).withColumn(
        "ca", F.when(F.col("month") == 12, F.raise_error(F.lit("broken")).cast("double"))
    )
    with pytest.raises(Exception, match="broken"):
        sinks.publish_partitions(broken, path, dt.date(2020, 9, 30), dt.date(2021, 1, 31))
    rows = read_published(spark, path).collect()
    assert sorted((r.period_end.year - 2020) * 12 + r.period_end.month - 1 for r in rows) == sorted(
        before
    )


def test_a_table_by_month_numbers_is_refused(spark, tmp_path):
    path = str(tmp_path / "table")
    frame_of(spark, 0, 2, 1, 1.0).write.partitionBy("month").parquet(path)
    with pytest.raises(ValueError, match="month numbers"):
        publish(spark, path, 0, 2, 1, 1.0)


def test_null_keys_match_in_the_measure_join(spark):
    schema = "month int, period_end date, bu string, ctt string, ope string, pthrough string"
    keys = [(1, None, "A", None, "o", "p"), (2, None, "A", None, "o", "p")]
    left = spark.createDataFrame([k + (1.0,) for k in keys], f"{schema}, ca double")
    right = spark.createDataFrame([keys[0] + (7.0,)], f"{schema}, mg double")
    joined = join_measures(left, right).orderBy("month")
    assert [(r.month, r.ca, r.mg) for r in joined.collect()] == [(1, 1.0, 7.0), (2, 1.0, None)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
