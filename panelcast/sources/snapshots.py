"""The published table as snapshots: a reader sees all of a publication or nothing of it.

Months are written into a folder of their run, which no later run touches. A snapshot is a small
list, a row per month, that names the run each month is read from; it counts once it is complete,
and the newest one is the table. So there is one moment at which readers change over, and
a run that fails at any other leaves the former table, with files that nobody reads.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.periods import month_end
from panelcast.schema import MEASURES, published_schema
from panelcast.sources.folders import delete_folder, names_in
from panelcast.sources.sinks import PARTITION

SNAPSHOT, RUN = "snapshot=", "run="
# Fixed value: the file that Spark writes into a folder last.
DONE = "_SUCCESS"
LISTED = f"{PARTITION} date, run string"


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots."""
    root = f"{path.rstrip('/')}/snapshots"
    return sorted(
        int(name.removeprefix(SNAPSHOT))
        for name in names_in(spark, root)
        if name.startswith(SNAPSHOT) and DONE in names_in(spark, f"{root}/{name}")
    )


def listed_months(spark: SparkSession, path: str, number: int) -> dict[dt.date, str]:
    """The run that each month of a snapshot is read from; a table has at most 120,000 months."""
    rows = spark.read.schema(LISTED).json(f"{path.rstrip('/')}/snapshots/{SNAPSHOT}{number}")
    return {row[PARTITION]: row["run"] for row in rows.collect()}


def publish_snapshot(
    fresh: DataFrame, path: str, replace_from: dt.date, last_predicted: dt.date
) -> int:
    """Publish the months from ``replace_from`` on, and return the snapshot's number.

    Earlier months stay as they are, months that no earlier run reached are written as well, and
    months beyond ``last_predicted`` go, all in the same moment. Of two runs at once one fails, as
    both want the same number.
    """
    spark, path = fresh.sparkSession, path.rstrip("/")
    known = snapshots(spark, path)
    before = listed_months(spark, path, known[-1]) if known else {}
    if before:
        first = min(replace_from, month_end(max(before), 1))
        fresh = fresh.filter(F.col(PARTITION) >= F.lit(first))
    run = uuid.uuid4().hex
    folder = f"{path}/data/{RUN}{run}"
    (
        fresh.hint("rebalance", PARTITION)
        .write.partitionBy(PARTITION)
        .mode("errorifexists")
        .parquet(folder)
    )
    prefix = f"{PARTITION}="
    written = [
        dt.date.fromisoformat(name.removeprefix(prefix))
        for name in names_in(spark, folder)
        if name.startswith(prefix)
    ]
    listed = {**before, **dict.fromkeys(written, run)}
    rows = [(end, r) for end, r in sorted(listed.items()) if end <= last_predicted]
    number = known[-1] + 1 if known else 1
    target = f"{path}/snapshots/{SNAPSHOT}{number}"
    if DONE not in names_in(spark, target):
        delete_folder(spark, target)  # Begun by a run that failed.
    spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("errorifexists").json(target)
    return number


def read_snapshot(
    spark: SparkSession,
    path: str,
    measures: Sequence[str] = MEASURES,
    number: int | None = None,
) -> DataFrame:
    """The table as of a snapshot, the newest one by default."""
    path, schema = path.rstrip("/"), published_schema(measures)
    known = snapshots(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    listed = listed_months(spark, path, known[-1] if number is None else number)
    folders = [
        f"{path}/data/{RUN}{run}/{PARTITION}={end.isoformat()}" for end, run in listed.items()
    ]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)
    return rows.select(*schema.names)


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest snapshots, and the runs that none of those is read from."""
    path, known = path.rstrip("/"), snapshots(spark, path)
    kept = known[-keep:]
    used = {run for number in kept for run in listed_months(spark, path, number).values()}
    for number in known[: len(known) - len(kept)]:
        delete_folder(spark, f"{path}/snapshots/{SNAPSHOT}{number}")
    for name in names_in(spark, f"{path}/data"):
        if name.startswith(RUN) and name.removeprefix(RUN) not in used:
            delete_folder(spark, f"{path}/data/{name}")
