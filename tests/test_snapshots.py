"""A publication is seen as a whole or not at all."""

import datetime as dt

import pytest

from panelcast.schema import PUBLISHED
from panelcast.sources import snapshots as snap
from panelcast.sources.folders import names_in

ENDS = [dt.date(2021, m, d) for m, d in ((1, 31), (2, 28), (3, 31), (4, 30), (5, 31))]


def outlook(spark, ends, ca):
    rows = [(i, end, bu, "c", "o", "p", ca, None, 0.0, None) for i, end in enumerate(ends) for bu in "AB"]
    return spark.createDataFrame(rows, PUBLISHED)


def seen(spark, path, number=None):
    frame = snap.read_snapshot(spark, path, number=number)
    assert frame.columns == PUBLISHED.names
    return sorted({(r["period_end"], r["ca"]) for r in frame.collect()})


def publish(spark, path, ends, ca, first, last=ENDS[-1]):
    return snap.publish_snapshot(outlook(spark, ends, ca), path, first, last)


def test_replaces_from_a_month_on(spark, scratch):
    path = scratch.folder("table")
    assert seen(spark, path) == []
    assert publish(spark, path, ENDS[:4], 1.0, ENDS[0]) == 1
    assert publish(spark, path, ENDS, 2.0, ENDS[2]) == 2
    assert seen(spark, path) == [(e, 1.0) for e in ENDS[:2]] + [(e, 2.0) for e in ENDS[2:]]
    # The former table is still there, for readers that have begun.
    assert seen(spark, path, 1) == [(e, 1.0) for e in ENDS[:4]]


def test_trailing_months_go_and_gaps_are_filled(spark, scratch):
    path = scratch.folder("table")
    publish(spark, path, ENDS, 1.0, ENDS[0])
    publish(spark, path, ENDS[:3], 2.0, ENDS[2], last=ENDS[2])
    assert seen(spark, path) == [(ENDS[0], 1.0), (ENDS[1], 1.0), (ENDS[2], 2.0)]
    # Months 4 and 5 were never reached: they are written though the run starts at month 5.
    publish(spark, path, ENDS, 3.0, ENDS[4])
    assert seen(spark, path)[3:] == [(ENDS[3], 3.0), (ENDS[4], 3.0)]


@pytest.mark.parametrize("when", ["data", "list"])
def test_a_killed_run_leaves_the_former_table(spark, scratch, monkeypatch, when):
    path = scratch.folder("table")
    publish(spark, path, ENDS[:4], 1.0, ENDS[0])
    before = seen(spark, path)
    if when == "data":
        # Some months are written, then the writer dies.
        bad = outlook(spark, ENDS, 2.0).selectExpr(
            "* EXCEPT (ca)", "IF(month = 3, raise_error('killed'), ca) AS ca"
        ).select(*PUBLISHED.names)
        with pytest.raises(Exception, match="killed"):
            snap.publish_snapshot(bad, path, ENDS[2], ENDS[-1])
    else:
        # All months are written, and a list that was never completed.
        outlook(spark, ENDS, 2.0).limit(1).selectExpr("period_end", "'none' AS run").write.option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
        ).json(f"{path}/snapshots/snapshot=2")
    assert seen(spark, path) == before and snap.snapshots(spark, path) == [1]
    # The run is repeated.
    assert publish(spark, path, ENDS, 2.0, ENDS[2]) == 2
    assert seen(spark, path)[-1] == (ENDS[-1], 2.0)


def test_expire(spark, scratch):
    path = scratch.folder("table")
    for k in range(1, 5):
        publish(spark, path, ENDS, float(k), ENDS[2])
    table = seen(spark, path)
    snap.expire(spark, path, keep=2)
    assert snap.snapshots(spark, path) == [3, 4] and seen(spark, path) == table
    # The first run's early months are still read, the second run is not.
    assert len(names_in(spark, f"{path}/data")) >= 3
    runs = [n for n in names_in(spark, f"{path}/data") if n.startswith("run=")]
    assert len(runs) == 3
