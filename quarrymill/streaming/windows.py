"""Streaming extension: windowed aggregates, deduplication and per-key state over timestamped events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_instant(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A zone-less time read as UTC, which watermarks need (set the session time zone to UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, ts: str, length: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Rows and their sum of ``value`` per window and key; with ``late``, windows close behind the watermark."""
    if late:
        df = df.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    if late:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Keep the last row per key in a Parquet table, batch by batch; restartable from the checkpoint.

    Each batch writes a new version of the table beside the last one, whose number is the
    batch's, so a repeated batch writes the same version again; older versions are deleted.
    """
    from ..sources.tables import last_wins

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}").unionByName(batch)
        last_wins(rows, keys, [F.col(order)]).write.mode("overwrite").parquet(f"{path}/version={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
