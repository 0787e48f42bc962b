"""Stages that are stale run, current ones don't, failed ones are taken up again."""

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import ledger as L


@pytest.fixture
def place(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).write.parquet(source)
    return source, f"file://{tmp_path}/out"


def chain(source, calls, broken=False, version="1", problems=None):
    def first(spark, path):
        calls.append("first")
        return spark.read.parquet(path).select((F.col("id") * 2).alias("id"))

    def second(spark, rows):
        calls.append("second")
        wrong = F.raise_error(F.lit("killed")).cast("long")
        return rows.select(F.when(F.col("id") == 30, wrong).otherwise(F.col("id")).alias("id")) if broken else rows.where("id > 10")

    def third(spark, rows, path):
        calls.append("third")
        return rows.unionByName(spark.read.parquet(path))

    return [L.Stage("first", (source,), first), L.Stage("second", ("first",), second, version, problems), L.Stage("third", ("second", source), third)]


def states(done):
    return [done[s][0] for s in ("first", "second", "third")]


def test_only_what_is_stale_runs(spark, place):
    source, root = place
    calls: list[str] = []
    assert states(L.run_stages(spark, root, chain(source, calls))) == ["written"] * 3
    done = L.run_stages(spark, root, chain(source, calls))
    assert states(done) == ["current"] * 3 and calls == ["first", "second", "third"]
    assert done["third"][1].count() == 14 + 20
    assert states(L.run_stages(spark, root, chain(source, calls, version="2"))) == ["current", "written", "written"]
    spark.range(5).write.mode("append").parquet(source)
    done = L.run_stages(spark, root, chain(source, calls, version="2"))
    assert states(done) == ["written"] * 3 and done["third"][1].count() == 14 + 25


def test_a_failed_stage_is_taken_up_again(spark, place):
    source, root = place
    calls: list[str] = []
    with pytest.raises(Exception, match="killed"):
        L.run_stages(spark, root, chain(source, calls, broken=True))
    assert calls == ["first", "second"]
    done = L.run_stages(spark, root, chain(source, calls))
    assert states(done) == ["current", "written", "written"] and done["third"][1].count() == 34
    with pytest.raises(L.Rejected, match="too few"):
        L.run_stages(spark, root, chain(source, calls, version="2", problems=lambda df: ["too few"] if df.count() < 50 else []))
    assert states(L.run_stages(spark, root, chain(source, calls))) == ["current"] * 3  # the old result is still whole


def test_lost_files_make_a_stage_stale(spark, place, tmp_path):
    source, root = place
    calls: list[str] = []
    L.run_stages(spark, root, chain(source, calls))
    next((tmp_path / "out" / "second").glob("rows-*/part-*.parquet")).unlink()
    done = L.run_stages(spark, root, chain(source, calls))
    assert states(done) == ["current", "written", "written"] and done["third"][1].count() == 34
    with pytest.raises(FileNotFoundError):
        L.run_stages(spark, root, [L.Stage("x", ("nowhere",), lambda spark, path: spark.range(1))])
    with pytest.raises(ValueError, match="share"):
        L.run_stages(spark, root, chain(source, calls)[:1] * 2)
