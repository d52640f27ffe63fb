"""Intermediate tables in the folder the cluster shares for checkpoints."""

from __future__ import annotations

import atexit
import itertools
import shutil
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelcast.sources.folders import delete_folder


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on a local master, a folder that goes with the
    process.

    The context is pointed to the same folder, for the checkpoints of iterative training.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    already_set = spark.sparkContext.getCheckpointDir()
    if configured:
        if not already_set:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if already_set:
        return already_set
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = f"/tmp/checkpoints/panelcast-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(root)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """A folder of written tables that cut lineage and survive lost executors.

    Unlike ``DataFrame.checkpoint`` a written table is computed once, stays columnar and lets
    later scans prune columns and skip row groups.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/panelcast-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)

    def folder(self, name: str) -> str:
        """A path not used before."""
        return f"{self.path}/{next(self._numbers):03d}-{name}"

    def save(self, frame: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """Write ``frame`` once, partitioned ``by`` some columns, and return a scan of it."""
        path = self.folder(name)
        frame.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def close(self) -> None:
        """Delete the folder; frames that still read from it become unusable."""
        delete_folder(self.spark, self.path)
