"""The published table and its file export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.periods import month_end
from panelcast.operators.publish import with_file_labels
from panelcast.sources.folders import delete_folder, names_in

PARTITION = "period_end"
# Fixed value: a worksheet ends at row 1,048,576, the header included.
ROWS_PER_FILE = 1_048_575


def published_months(spark: SparkSession, path: str) -> list[dt.date]:
    """Last days of the published months, from the names of the table's partitions."""
    prefix = f"{PARTITION}="
    names = names_in(spark, path)
    if any(name.startswith("month=") for name in names):
        raise ValueError(f"{path} is partitioned by month numbers; publish it anew")
    ends = [name.removeprefix(prefix) for name in names if name.startswith(prefix)]
    return sorted(dt.date.fromisoformat(end) for end in ends)


def publish_partitions(
    fresh: DataFrame, path: str, replace_from: dt.date, last_predicted: dt.date
) -> None:
    """Write the months from ``replace_from`` on, leaving older partitions alone.

    A month is a partition under its last day, whatever its number in this history. Months that no
    earlier run reached are written as well, so that a pause between runs leaves no hole. Whole
    partitions are overwritten, so a repeated run leaves the same table, and a run that fails leaves
    the table as it was. Months beyond ``last_predicted`` that an earlier run had published are
    removed last; until then, or until the run is repeated, they merely stay. The rebalance hint
    gives each month one writer, and several to a month that is large.
    """
    spark = fresh.sparkSession
    before = published_months(spark, path)
    if before:
        first = min(replace_from, month_end(before[-1], 1))
        fresh = fresh.filter(F.col(PARTITION) >= F.lit(first))
    (
        fresh.hint("rebalance", PARTITION)
        .write.partitionBy(PARTITION)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
    for end in before:
        if end > last_predicted:
            delete_folder(spark, f"{path.rstrip('/')}/{PARTITION}={end.isoformat()}")


def export_csv(published: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV under the original labels, sorted by month and keys: a sequence of files, in order, of at
    most ``ROWS_PER_FILE`` rows, whatever the number of rows.

    ``single_file`` puts all rows into one file of any length, by one task.
    """
    labelled = with_file_labels(published)
    order = [F.col(f"`{c}`") for c in ["periode", "bu", "ctt", "ope", "pthrough ?"]]
    arranged = labelled.coalesce(1) if single_file else labelled.repartitionByRange(*order)
    writer = arranged.sortWithinPartitions(*order).write.options(header=True, escape='"')
    if not single_file:
        writer = writer.option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.mode("overwrite").csv(path)
