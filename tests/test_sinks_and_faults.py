"""Versioned sinks that fail half way, and files that don't parse."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.sources import tables as S


def test_a_failed_write_leaves_the_old_pair(spark, tmp_path):
    root = f"file://{tmp_path}/pair"
    old = spark.range(10)
    S.write_versions({"a": old, "b": old.select((F.col("id") * 2).alias("id"))}, root)

    def state():
        return {k: sorted(r.id for r in v.collect()) for k, v in S.read_version(spark, root).items()}

    before = state()
    assert before == {"a": list(range(10)), "b": list(range(0, 20, 2))}
    broken = spark.range(20).select(F.when(F.col("id") == 19, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        S.write_versions({"a": spark.range(20), "b": broken}, root)
    assert state() == before
    with pytest.raises(ValueError, match="differ"):
        S.write_versions({"a": spark.range(20), "b": spark.range(19)}, root)
    assert state() == before
    S.write_versions({"a": spark.range(3), "b": spark.range(0)}, root, same_rows=False)
    assert state() == {"a": [0, 1, 2], "b": []}
    with pytest.raises(ValueError):
        S.write_versions({}, root)


def test_one_corrupt_file_among_many(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"{k:03}.json").write_text('{"n": %d,\n "extra": [1]}' % k)
    odd = {"007": b"{\"n\": 7", "008": b"", "009": b"\xff\xfe{}", "010": b"[{\"n\": 1}]", "011": b"{\"n\": \"x\"}", "012": b"{}", "013": b"null"}
    for name, data in odd.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    rows = {r.path[-8:-5]: r for r in S.isolated_documents(spark, f"file://{tmp_path}/*.json", StructType().add("n", "long")).collect()}
    assert len(rows) == 200
    kind = "no JSON object of this kind"
    assert {k: r.reason for k, r in rows.items() if r.reason} == {"007": kind, "008": "empty file", "009": "not UTF-8", "010": kind, "011": kind, "013": kind}
    assert rows["012"].record.n is None and all((r.record is None) == (r.reason is not None) for r in rows.values())
    assert all(rows[f"{k:03}"].record.n == k for k in range(14, 200))
