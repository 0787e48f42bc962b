"""Runs and label switches of endless tracks, as a stream with timers and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.sequences import islands

_KINDS = [StructField("kind", StringType()), StructField("label", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("rows", LongType())]


def track_runs(df: DataFrame, keys: list[str], frame: str, label: str) -> DataFrame:
    """keys, kind, label, start, end, rows: every run of one label over consecutive frames, and every switch between two
    known labels that follow each other (start and end are their frames, rows is 1).

    A frame's rows count once, with their smallest label; a frame of null labels is part of
    a run of nulls and skipped by switches.
    """
    once = df.groupBy(*keys, frame).agg(F.min(label).alias(label))
    runs = islands(once, keys, frame, label).select(*keys, F.lit("run").alias("kind"), F.col(label).alias("label"), "start", "end", "rows")
    w = Window.partitionBy(*keys).orderBy(frame)
    known = once.where(F.col(label).isNotNull()).withColumn("_before", F.lag(label).over(w)).withColumn("start", F.lag(frame).over(w))
    switches = known.where(F.col("_before") != F.col(label)).select(*keys, F.lit("switch").alias("kind"), F.col(label).alias("label"), "start", F.col(frame).alias("end"), F.lit(1).cast("long").alias("rows"))
    return runs.unionByName(switches)


class _Track(StatefulProcessor):
    """Frames wait until the watermark has passed them, then join the open run in order."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame long", "label string, ms long")
        self.run = handle.getValueState("run", "label string, start long, end long, rows long, ms long, known string, known_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            for frame, label, ms in zip(part["at_frame"].tolist(), part["at_label"].tolist(), part["at_ms"].tolist(), strict=True):
                label = None if pd.isna(label) else label
                if self.waiting.containsKey((frame,)):
                    other, seen = self.waiting.getValue((frame,))
                    label, ms = min((x for x in (label, other) if x is not None), default=None), max(ms, seen)
                self.waiting.updateValue((frame,), (label, ms))
                last = ms if last is None else max(last, ms)
        if last is not None:
            self.handle.registerTimer(last)
        yield self._table(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        due = sorted((f[0], *v) for f, v in self.waiting.iterator() if v[1] <= now)
        run = self.run.get() if self.run.exists() else None
        for frame, label, ms in due:
            self.waiting.removeKey((frame,))
            known, known_at = (run[5], run[6]) if run else (None, None)
            if label is not None:
                if known is not None and known != label:
                    out.append(("switch", label, known_at, frame, 1))
                known, known_at = label, frame
            if run and run[0] == label and run[2] + 1 == frame:
                run = (label, run[1], frame, run[3] + 1, ms, known, known_at)
            else:
                if run:
                    out.append(("run", *run[:4]))
                run = (label, frame, frame, 1, ms, known, known_at)
        if run and run[4] + self.idle_ms <= now and not any(True for _ in self.waiting.keys()):
            out.append(("run", *run[:4]))
            self.run.clear()
        elif run:
            self.run.update(tuple(run))
            self.handle.registerTimer(max(run[4] + self.idle_ms, now + 1))
        yield self._table(key, out)

    def _table(self, key, out: list) -> pd.DataFrame:
        columns = ["track_key", *(f.name for f in _KINDS)]
        return pd.DataFrame([(*key, *row) for row in out], columns=columns).astype({c: "Int64" for c in ("start", "end", "rows")})

    def close(self) -> None:
        pass


def streamed_runs(stream: DataFrame, keys: list[str], frame: str, label: str, ts: str, late: str, idle_seconds: float) -> DataFrame:
    """``track_runs`` of a stream: a row comes out once it is final, that is when the watermark, ``late`` behind the
    newest time, has passed it. Rows in any order and repeated ones within the watermark change nothing.

    A track without rows for ``idle_seconds`` is over: its last run comes out and its state goes,
    so memory follows the live tracks. Tracks whose frames follow each other faster than that
    give what the batch gives. Rows behind the watermark or without frame or time are left out.
    The session needs the RocksDB state store.
    """
    rows = stream.where(F.col(frame).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    key = F.to_json(F.struct(*keys))  # one text, as nulls in keys don't survive the way through pandas
    rows = rows.select(key.alias("track_key"), ts, F.col(frame).cast("long").alias("at_frame"), F.col(label).cast("string").alias("at_label"), F.unix_millis(ts).alias("at_ms"))
    out = rows.groupBy("track_key").transformWithStateInPandas(_Track(int(idle_seconds * 1000)), StructType([StructField("track_key", StringType()), *_KINDS]), "Append", "EventTime")
    key_schema = StructType([stream.schema[k] for k in keys])
    return out.withColumn("track_key", F.from_json("track_key", key_schema)).select("track_key.*", *(f.name for f in _KINDS))
