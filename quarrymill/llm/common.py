"""Shared folder handling and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id; before all others.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), as a whole URI.

    A path without a scheme lies on the cluster's default file system. Only a local master
    may go without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, path, True)
        folder = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if "://" in folder:
        return folder
    system, path = _file_system(spark, folder)
    whole = system.makeQualified(path).toString()
    return whole if "://" in whole else whole.replace("file:", "file://", 1)


def _file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, data: bytes, piece: int = 1 << 20) -> None:
    """Write a file of the shared folder from the driver."""
    system, at = _file_system(spark, path)
    out = system.create(at)
    try:
        for k in range(0, len(data), piece):
            out.write(bytearray(data[k : k + piece]))
    finally:
        out.close()


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``materialize`` has written; a mark for ``delete_since``."""
    return len(_written)


def delete_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete what was written from ``mark`` on but the table ``keep``; nothing else may read it any more."""
    kept = _folders(keep)
    for path in [p for p in _written[mark:] if not any(k.rstrip("/").endswith(p.rsplit("/", 1)[1]) for k in kept)]:
        system, at = _file_system(spark, path)
        system.delete(at, True)
        _written.remove(path)


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    for folder in _folders(df):
        system, at = _file_system(spark, folder)
        system.delete(at, True)


def _folders(df: DataFrame) -> set[str]:
    return {file.rsplit("/", 1)[0] for file in df.inputFiles()}


def own_id(doc: str):
    """The doc_id behind the column doc of ``numbered_rows``."""
    return F.nullif(F.col(doc), F.lit(NULL_ID))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def numbered_rows(docs: DataFrame, *extra: str) -> DataFrame:
    """doc (the id, null as the least long), turn, text and extra columns: turn tells rows of one doc_id apart, in text order; the ids are only counted where all differ."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    repeated = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    if not repeated:
        return rows.select("doc", F.lit(0).alias("turn"), "text", *extra)
    return rows.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1).alias("turn"), "text", *extra)
