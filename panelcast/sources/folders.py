"""Folders on whatever file system Spark reads; the only use of the JVM's own objects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    """Spark has no public call for listing or deleting; Hadoop's is reached through the gateway."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if there is no such folder."""
    file_system, hadoop_path = _opened(spark, path)
    if not file_system.exists(hadoop_path):
        return []
    return sorted(entry.getPath().getName() for entry in file_system.listStatus(hadoop_path))


def delete_folder(spark: SparkSession, path: str) -> None:
    file_system, hadoop_path = _opened(spark, path)
    file_system.delete(hadoop_path, True)
