"""Files dropped into a directory are taken up once, by a checkpointed file stream."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.schema import AUDIT, MEASURES, history_schema
from panelcast.sources.tables import read_history, read_if_present, scan

# The stream forgets nothing it has seen, so a file's age is no reason to pass it over.
NO_AGE_LIMIT = "36500d"
HEADERS_AT_ONCE = 16
# Fixed value: the columns Spark gives to files read as a whole.
FILES = "path string, modificationTime timestamp, length long, content binary"


def _append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch under its number; a replayed batch replaces itself."""
    (
        batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.partitionBy("batch_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def _literal(path: str) -> str:
    """A path without wildcards, whatever its file is called."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _read_by_header(
    spark: SparkSession,
    paths: list[str],
    fmt: str,
    measures: Sequence[str],
    options: dict[str, str],
) -> DataFrame:
    """Files read by column name, each by its own header.

    A header is one line (or footer) of a file, fetched for at most ``max_files`` files; files that
    agree are read in one scan.
    """

    reading = {k: v for k, v in options.items() if k != "decimal"}

    def header(path: str) -> tuple[str, ...]:
        return tuple(scan(spark, path, fmt, reading).columns)

    with ThreadPool(min(len(paths), HEADERS_AT_ONCE)) as pool:
        headers = pool.map(inheritable_thread_target(spark)(header), paths)
    alike: dict[tuple[str, ...], list[str]] = {}
    for path, columns in zip(paths, headers):
        alike.setdefault(columns, []).append(path)
    parts = [read_history(spark, group, fmt, measures, **options) for group in alike.values()]
    return reduce(DataFrame.unionByName, parts)


def ingest_drop(
    spark: SparkSession,
    drop_dir: str,
    history_path: str,
    audit_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files: int = 1000,
    newest_only: bool = False,
    reader_options: dict[str, str] | None = None,
    measures: Sequence[str] = MEASURES,
) -> None:
    """Take up everything new in ``drop_dir`` and return; without new files nothing happens.

    The stream is one of files: their contents are not read by it, only their names, at most
    ``max_files`` to a batch and oldest first. Each file is then read by its own header, so that
    columns may come in any order and others beside them, whatever else is in the batch. A file
    counts as new until it was taken up, however old its time stamp. The files stay in place. A run
    that fails is repeated from its checkpoint, and both tables are overwritten per batch, so no fact
    and no audit row is lost or doubled.

    ``newest_only`` is for files that each hold the whole history: of a batch only the newest file's
    facts are stored (of equal times the last by name), while all of its files are audited.
    ``reader_options`` go to ``read_history``.
    """
    options = reader_options or {}
    files = (
        spark.readStream.schema(FILES)
        .option("maxFilesPerTrigger", max_files)
        .option("maxFileAge", NO_AGE_LIMIT)
        .format("binaryFile")
        .load(drop_dir)
        .select(
            F.col("path").alias("file_path"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("file_mtime"),
        )
    )

    def take_up(batch: DataFrame, batch_id: int) -> None:
        # At most max_files names.
        files = sorted(batch.select("file_mtime", "file_path").collect())
        if files:
            read = files[-1:] if newest_only else files
            paths = [_literal(file["file_path"]) for file in read]
            facts = _read_by_header(batch.sparkSession, paths, fmt, measures, options)
            _append_once(facts, batch_id, history_path)
            _append_once(batch, batch_id, audit_path)

    query = (
        files.writeStream.foreachBatch(take_up)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_ingested(
    spark: SparkSession,
    history_path: str,
    audit_path: str | None = None,
    measures: Sequence[str] = MEASURES,
) -> DataFrame | None:
    """All facts taken up so far; with the audit table, only those of its newest batch.

    The latter suits files that each hold the whole history, taken up with ``newest_only``.
    Before the first file there is nothing to read: the result is None.
    """
    facts = history_schema(measures)
    stored = T.StructType([*facts.fields, T.StructField("batch_id", T.LongType())])
    history = read_if_present(spark, stored, history_path)
    if history is None:
        return None
    if audit_path is not None:
        audit = spark.read.schema(AUDIT).parquet(audit_path)
        newest = audit.agg(F.max("batch_id")).first()[0]
        history = history.filter(F.col("batch_id") == newest)
    return history.select(*facts.names)


def read_audit(spark: SparkSession, audit_path: str) -> DataFrame:
    """The files taken up so far, by name."""
    audit = spark.read.schema(AUDIT).parquet(audit_path).select(*AUDIT.names)
    title = F.element_at(F.split("file_path", "/"), -1)
    return audit.orderBy(title, "file_path")
