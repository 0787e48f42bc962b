"""Runs and switches: batch against SQL, stream against batch under late and repeated rows and a restart."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from quarrymill.streaming import tracks as K

SCHEMA = "track long, frame long, label string, ts timestamp"
START = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def listed(df):
    return sorted(map(tuple, df.select("track", "kind", "label", "start", "end", "rows").collect()), key=repr)


def test_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(2)
    rows = []
    for track in (1, 2, None):
        for frame in range(120):
            if rng.random() < 0.9:
                rows.append((track, frame, rng.choice(["a", "a", "b", None]) if frame % 7 == 0 else "ab"[frame // 20 % 2], START + timedelta(seconds=frame)))
    shuffled = sorted(rows, key=lambda r: r[3].timestamp() + rng.random() * 8)  # up to 8 s out of order
    parts = [shuffled[k : k + 90] for k in range(0, len(shuffled), 90)]
    parts = [p + rng.sample(p, 10) for p in parts]  # repeated rows
    parts.append([(99, 0, "end", START + timedelta(days=1))])  # moves the watermark past all others
    source, checkpoint, sink = (str(tmp_path / n) for n in ("in", "state", "out"))

    def run():
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = K.streamed_runs(stream, ["track"], "frame", "label", "ts", "10 seconds", 60)
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(240)

    for k, part in enumerate(parts):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (1, len(parts) - 1):
            run()  # stopped and taken up again from the checkpoint
    want = listed(K.track_runs(rocks.createDataFrame(rows, SCHEMA), ["track"], "frame", "label"))
    got = [r for r in listed(rocks.read.parquet(sink)) if r[0] != 99]
    assert got == want and any(r[1] == "switch" for r in got) and any(r[2] is None for r in got)
