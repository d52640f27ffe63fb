"""The job as it is run: take up new files, project, publish, export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import SparkSession

from panelcast.operators.calendar import Horizon
from panelcast.plans.outlook import publish_outlook
from panelcast.schema import MEASURES
from panelcast.sources.scratch import Scratch
from panelcast.sources.sinks import export_csv
from panelcast.sources.snapshots import read_snapshot
from panelcast.sources.sums import SumStore
from panelcast.sources.tables import read_dimensions, read_published
from panelcast.streaming.drop import ingest_drop, read_ingested


def run_job(
    spark: SparkSession,
    drop_dir: str,
    store: str,
    dimensions_dir: str | None = None,
    fmt: str = "csv",
    whole_history_per_file: bool = True,
    as_of: dt.date | None = None,
    replace_from: str = "current",
    retrain: str = "each_step",
    estimator: Estimator | None = None,
    reader_options: dict[str, str] | None = None,
    single_file: bool = False,
    measures: Sequence[str] = MEASURES,
    snapshots: bool = False,
    **options,
) -> Horizon | None:
    """Keep history, audit, published table and export under ``store``.

    By default every dropped file is the whole history and the newest one counts; otherwise
    files add to one another: their monthly sums are kept under ``store`` as well, so that a run reads
    only the facts that are new. As long as no file was ever dropped nothing is done. With
    ``snapshots`` readers see the published table change at once (``sources.snapshots``).
    ``reader_options`` are those of ``read_history`` for the dropped files (``sep``, ``encoding``,
    ``decimal``), ``measures`` the columns to project, ``single_file`` is that of the export, and ``options`` (``horizon``, ``n_lags``,
    ``calendar_mode``) are those of ``run_outlook``.
    """
    store = store.rstrip("/")
    history_path, audit_path = f"{store}/history", f"{store}/audit"
    published_path, export_path = f"{store}/published", f"{store}/export"
    ingest_drop(
        spark,
        drop_dir,
        history_path,
        audit_path,
        f"{store}/progress",
        fmt,
        newest_only=whole_history_per_file,
        reader_options=reader_options,
        measures=measures,
    )
    history = read_ingested(
        spark, history_path, audit_path if whole_history_per_file else None, measures
    )
    if history is None:
        return None
    store_of_sums = None
    if not whole_history_per_file:
        store_of_sums = SumStore(spark, f"{store}/sums", measures)
        store_of_sums.catch_up(history_path)
        history = store_of_sums.merged()
    scratch = Scratch(spark)
    try:
        dimensions = None
        if dimensions_dir is not None:
            dimensions = read_dimensions(spark, dimensions_dir, scratch, fmt)
        bounds = publish_outlook(
            history,
            published_path,
            dimensions,
            replace_from,
            as_of=as_of,
            retrain=retrain,
            estimator=estimator,
            measures=measures,
            snapshots=snapshots,
            summed=store_of_sums is not None,
            **options,
        )
    finally:
        scratch.close()
    if store_of_sums is not None:
        store_of_sums.compact()
    read = read_snapshot if snapshots else read_published
    export_csv(read(spark, published_path, measures), export_path, single_file)
    return bounds
