"""Sums kept by batch: the same as summing all facts, without reading earlier ones again."""

import datetime as dt

import pytest

from panelcast.operators.grid import monthly_sums
from panelcast.plans.job import run_job
from panelcast.operators.model import fixed_weights
from panelcast.sources.sums import SumStore


@pytest.fixture
def batches(facts):
    first = facts([("2021-01", "A", "4.1"), ("2021-01", "B", "6"), ("2021-02", "A", None)])
    late = facts([("2021-1", "A", "0.2"), ("2020-12", "C", "7"), ("2021-02", "A", "1")])
    more = facts([("2021-01", "A", "-4.3"), ("2021-03", None, "5")])
    return [first, late, more]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def stored(spark, path, batch, number):
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def test_any_order_of_batches_and_merges(spark, scratch, batches):
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    expected = rows(monthly_sums(whole))
    for merge_after in (set(), {0}, {1}, {0, 1, 2}):
        history = scratch.folder("history")
        store = SumStore(spark, scratch.folder("sums"))
        for number, batch in enumerate(batches):
            stored(spark, history, batch, number)
            assert store.catch_up(history) == [number]
            assert store.catch_up(history) == []
            if number in merge_after:
                store.compact()
                store.compact()
        assert rows(store.merged()) == expected


def test_earlier_facts_are_not_read_again(spark, scratch, batches):
    history, sums = scratch.folder("history"), scratch.folder("sums")
    stored(spark, history, batches[0], 0)
    SumStore(spark, sums).catch_up(history)
    # Whoever read these would fail.
    spark.range(1).selectExpr("'no facts' AS ca").write.mode("overwrite").parquet(
        f"{history}/batch_id=0"
    )
    stored(spark, history, batches[1], 1)
    store = SumStore(spark, sums)
    assert store.catch_up(history) == [1]
    assert rows(store.merged()) == rows(monthly_sums(batches[0].unionByName(batches[1])))


def test_a_batch_that_failed_does_not_count(spark, scratch, batches):
    history, sums = scratch.folder("history"), scratch.folder("sums")
    stored(spark, history, batches[0], 0)
    store = SumStore(spark, sums)
    # A folder that its writer never completed.
    batches[2].write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{sums}/batch=0"
    )
    assert store.merged().count() == 0
    assert store.catch_up(history) == [0]
    store.put(batches[0], 0)
    assert rows(store.merged()) == rows(monthly_sums(batches[0]))


def test_merging_keeps_what_readers_have_begun(spark, scratch, batches):
    store = SumStore(spark, scratch.folder("sums"))
    for number, batch in enumerate(batches[:2]):
        store.put(batch, number)
    begun = store.merged()
    store.compact()
    assert rows(begun) == rows(store.merged())
    store.put(batches[2], 2)
    store.compact()
    assert store._complete("batch=") == [2] and store._complete("upto=") == [1, 2]


def test_nothing_yet(spark, scratch):
    store = SumStore(spark, scratch.folder("sums"))
    assert store.catch_up(scratch.folder("history")) == []
    store.compact()
    assert store.merged().count() == 0


def test_the_job_adds_files(spark, scratch, facts):
    """Two drops that add to one another give the job of both at once."""
    months = [f"20{y}-{m:02d}" for y in (19, 20) for m in range(1, 13)]
    first = facts([(p, bu, str(10 + i)) for i, p in enumerate(months) for bu in ("A", "B")])
    late = facts([(p, "A", "0.5") for p in months[1::3]])
    options = dict(
        fmt="parquet",
        whole_history_per_file=False,
        as_of=dt.date(2020, 12, 10),
        estimator=fixed_weights(1.0),
        retrain="once",
    )
    apart, together = scratch.folder("apart"), scratch.folder("together")
    for part in (first, late):
        part.write.mode("append").parquet(f"{apart}/drop")
        bounds = run_job(spark, f"{apart}/drop", f"{apart}/store", snapshots=True, **options)
        part.write.mode("append").parquet(f"{together}/drop")
    assert bounds == run_job(spark, f"{together}/drop", f"{together}/store", **options)
    # Published months stay as they were; the months ahead follow from all facts.
    exports = [
        rows(
            spark.read.option("header", True)
            .csv(f"{p}/store/export")
            .filter("periode >= '2020-12-31'")
        )
        for p in (apart, together)
    ]
    assert exports[0] == exports[1] and len(exports[0]) == 12
    assert {r[7] for r in exports[0]} == {"32.5", "32.0"}
