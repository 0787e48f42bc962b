"""Fresh folders that driver and executors share, for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="quarrymill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local master may go without the setting and gets a temporary folder, removed at exit."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{_local_folder()}"
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written to a fresh folder and read again, so that a loop's plan stays short, and the folder."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def drop(spark: SparkSession, *folders: str) -> None:
    """Delete folders of rounds that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
