"""Small worked examples of joins, aggregates, sequences, selection, graphs, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import aggregates as A
from quarrymill.operators import graphs as G
from quarrymill.operators import joins as J
from quarrymill.operators import retrieval as R
from quarrymill.operators import selection as S
from quarrymill.operators import sequences as Q
from quarrymill.sources import tables as X


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_nearest_prefers_the_earlier_and_keeps_lonely_rows(spark):
    left = spark.createDataFrame([("a", 10), ("a", 16), ("b", 1), ("a", 100)], "k string, t int")
    right = spark.createDataFrame([("a", 8, 1.0), ("a", 12, 2.0), ("a", 19, 3.0)], "k string, r int, v double")
    got = J.nearest(left, right, ["k"], "t", "r", "v", tolerance=30)
    assert rows(got, "k", "t") == [("a", 10, 8.0, 1.0), ("a", 16, 19.0, 3.0), ("a", 100, None, None), ("b", 1, None, None)]


def test_overlap_anti_counts_touching_edges(spark):
    w = spark.createDataFrame([(1, 0.0, 10.0), (1, 20.0, 30.0), (2, 0.0, 10.0)], "h int, s double, e double")
    ev = spark.createDataFrame([(1, 12.0), (2, 12.1)], "h int, t double")
    assert rows(J.overlap_anti(w, ev, ["h"], "s", "e", "t", 2.0, 7.0), "h", "s") == [(1, 20.0, 30.0), (2, 0.0, 10.0)]


def test_sliding_vote_uses_raw_labels(spark):
    labels = ["a", "a", "b", "a", "abstain", "b"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, l string").withColumn("k", F.lit(1))
    got = rows(Q.sliding_vote(df, ["k"], "i", "l", radius=2).select("i", "voted"), "i")
    assert [x[1] for x in got] == ["a", "a", "a", "a", "abstain", "b"]


def test_bridge_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.8), (1, 3, 3.0, 0.6), (1, 10, 9.0, 0.9)], "k int, f int, v double, c double")
    got = rows(Q.bridge_gaps(df, ["k"], "f", "v", "c"), "f")
    assert [(r[1], round(r[2], 6), round(r[3], 6), r[4]) for r in got if r[4] == "interpolated"] == [(1, 1.0, 0.39, "interpolated"), (2, 2.0, 0.39, "interpolated")]


def test_best_path_skips_the_outlier(spark):
    pts = [(1, 0, 0.0, 0.0, 0.5), (1, 1, 1.0, 0.0, 0.5), (1, 1, 900.0, 900.0, 0.6), (1, 2, 2.0, 0.0, 0.5)]
    got = rows(Q.best_path(spark.createDataFrame(pts, "k int, f int, x double, y double, c double"), ["k"], "f", "x", "y", "c", 1000.0), "f")
    assert [r[2] for r in got] == [0.0, 1.0, 2.0]


def test_greedy_match_breaks_ties_by_higher_numbers(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 1, 0.5), (1, 2, 2, 0.1)], "f int, a int, b int, s double")
    assert rows(Q.greedy_match(p, ["f"], "a", "b", "s", 0.3), "a") == [(1, 0, 0, 0.5), (1, 1, 1, 0.5)]


def test_continuity_resets_at_empty_frames(spark):
    d = spark.createDataFrame([("c", 0, 1), ("c", 0, 2), ("c", 1, 1), ("c", 3, 1), ("c", 4, 1), ("c", 4, 2)], "clip string, f int, t int")
    f = spark.createDataFrame([("c", k) for k in range(5)], "clip string, f int")
    r = A.continuity(d, f, "clip", "f", "t").first()
    assert (r.frames, r.detections, r.tracks, round(r.empty_rate, 3), r.retention) == (5, 6, 2, 0.2, 0.5)


def test_majorities(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, l string, p int")
    assert A.first_seen_majority(df, ["k"], "l", "p").first().majority == "b"
    assert A.smallest_mode(df, ["k"], "l").first()["mode"] == "a"
    assert A.vocabulary_majority(df, ["k"], "l", ["b", "a"]).first().majority == "b"


def test_two_way_vote_tie_and_abstention(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", -1, 0.5), ("n", 1, 1.0), ("o", 1, 1.0), ("o", 1, 1.0)], "k string, s int, w double")
    got = {r.k: (r.status, r.direction) for r in A.two_way_vote(df, ["k"], F.col("s"), F.col("w"), 2, 0.75).collect()}
    assert got == {"m": ("conflicting", None), "n": ("insufficient", None), "o": ("calibrated", 1)}


def test_calibration_error_drops_a_confidence_of_one(spark):
    df = spark.createDataFrame([(1.0, True), (0.95, True), (0.05, False)], "c double, ok boolean")
    assert [r.bin for r in A.calibration_error(df, "c", F.col("ok")).orderBy("bin").collect()] == [0, 9]


def test_precision_divides_by_what_there_is(spark):
    df = spark.createDataFrame([("q", 1, True), ("q", 2, False)], "q string, r int, good boolean")
    assert rows(A.precision_at(df, ["q"], [F.col("r")], "good", [1, 5]), "k") == [("q", 1, 1, 1.0), ("q", 5, 2, 0.5)]


def test_balanced_quota_and_assignment(spark):
    s = [(i, q, float(v)) for i, row in enumerate([(9, 1, 1), (8, 2, 1), (7, 6, 1), (6, 5, 4), (5, 4, 3), (4, 3, 2), (3, 2, 1), (2, 1, 0)]) for q, v in zip("abc", row, strict=True)]
    got = rows(S.balanced_quota(spark.createDataFrame(s, "id int, q string, s double"), "id", "q", "s", 8, ["a", "b", "c"]))
    assert sorted(x[1] for x in got) == ["a"] * 3 + ["b"] * 3 + ["c"] * 2 and len({x[0] for x in got}) == 8
    a = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.8), (2, "x", 0.7), (2, "y", 0.1)], "id int, l string, s double")
    assert rows(S.assign(a, "id", "l", "s", 1), "id") == [(1, "y", 0.8), (2, "x", 0.7)]


def test_assignment_takes_any_number_of_items(spark):
    """The best total of every way to place seven items, and more items than are looked at in sequence."""
    import itertools
    import random

    rng = random.Random(5)
    for capacity in (1, 2):
        s = {(i, q): rng.randint(0, 9) / 10 for i in range(7) for q in "xy"}
        got = S.assign(spark.createDataFrame([(*k, v) for k, v in s.items()], "id int, l string, s double"), "id", "l", "s", capacity).collect()
        want = max(sum(s[i, q] for i, q in zip(ids, "x" * capacity + "y" * capacity, strict=True)) for ids in itertools.permutations(range(7), 2 * capacity))
        assert len({r.id for r in got}) == len(got) == 2 * capacity and abs(sum(r.s for r in got) - want) < 1e-9
    many = spark.range(6000).select("id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("l"), (F.col("id") / 6000).alias("s"))
    assert sorted(r.id for r in S.assign(many, "id", "l", "s", 2).collect()) == [5996, 5997, 5998, 5999]


def test_round_robin_is_global(spark):
    got = rows(S.round_robin(spark.range(50).repartition(7), ["id"], 4), "id")
    assert got == [(k, k % 4) for k in range(50)]


def test_spanning_tree_and_medoid(spark):
    n = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 5.0, 0.0), (1, 3, 2.0, 0.0)], "f int, n int, x double, y double")
    assert {(r.a, r.b) for r in G.spanning_tree(n, ["f"], "n", "x", "y").collect()} == {(0, 1), (1, 3), (3, 2)}
    v = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.8, 0.6]), ("g", 3, [0.0, 1.0])], "g string, id int, v array<double>")
    assert G.medoid_by_sum(v, ["g"], "id", "v").first().medoid == 2


def test_hybrid_ranks_the_document_with_the_terms(spark):
    d = spark.createDataFrame([(1, "compact low block"), (2, "high press"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.bm25 for r in R.bm25(d, "low-block low").collect()}
    assert got[1] > 0 and got[2] == 0 and got[3] == 0
    assert all(r.bm25 == 0 for r in R.bm25(d, "!!").collect())


def test_sources(spark, tmp_path):
    doc = tmp_path / "m.json"
    doc.write_text(json.dumps({"jobs": [{"id": "a", "match_id": "m", "half": 1}, {"id": "a", "match_id": "m", "half": 2}, {"id": "b", "match_id": "m", "half": 1.5}]}))
    got = X.checked_manifest(X.manifest(spark, f"file://{doc}", ["clips", "jobs"]))
    assert sorted((r.id, r.problem) for r in got.collect()) == [("a", "repeated id"), ("a", "repeated id"), ("b", "half is not 1 or 2")]
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    from pyspark.sql.types import LongType, StructField, StructType

    back = X.json_lines(spark, f"file://{lines}", StructType([StructField("a", LongType())])).cache()
    assert sorted((r.a or 0, r._corrupt_record) for r in back.collect()) == [(0, "not json"), (1, None), (2, None)]
    csv = tmp_path / "p.csv"
    csv.write_text("index,duration\n1,4.5\n2,\n")
    assert rows(X.delimited(spark, f"file://{csv}")) == [("1", "4.5"), ("2", None)]
    X.write_table(spark.range(3), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3
    assert X.file_digests(spark, f"file://{csv}").first().bytes == 24
    assert X.newest_file(spark, f"file://{tmp_path}/*.json*", r"/(\w)\.jsonl?$").count() == 2


def test_boxes_and_labels(spark):
    i = spark.createDataFrame([("1", "000005.jpg", True), ("2", "000006.jpg", False)], "image_id string, file_name string, is_labeled boolean")
    a = spark.createDataFrame([("1", 7, 1, (1.0, 2.0, 3.0, 4.0)), ("1", 8, 4, (0.0, 0.0, 1.0, 1.0)), ("2", 9, 1, (0.0, 0.0, 1.0, 1.0))], "image_id string, track_id int, category_id int, bbox_image struct<x: double, y: double, w: double, h: double>")
    assert rows(X.boxes(i, a, [1, 2])) == [(4, 7, 1.0, 2.0, 4.0, 6.0)]
    m = spark.createDataFrame([({"k": "bad"},)], "labels map<string, string>")
    with pytest.raises(Exception, match="label not allowed"):
        X.label_map(m, "labels", ["good"]).collect()


def test_stream_and_batch_agree(spark, data, tmp_path):
    from quarrymill.streaming import windows as W

    events = W.as_instant(X.table(spark, data, "events"))
    W_rows = rows(W.tumbling(events, "ts", "1 day", ["event_type"]).drop("total"), "start", "event_type")
    stream = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parquet*")
    q = W.tumbling(W.as_instant(stream), "ts", "1 day", ["event_type"], late="1 hour").drop("total").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("tumbled"), "start", "event_type") == W_rows


def test_upsert_stream_keeps_the_last_row(spark, tmp_path):
    from quarrymill.streaming import windows as W

    for k, part in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(part, "id int, at int, v string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        s = spark.readStream.schema("id int, at int, v string").parquet(f"file://{tmp_path}/in")
        W.upsert_batches(s, f"file://{tmp_path}/out", ["id"], "at", f"file://{tmp_path}/cp").awaitTermination(120)
        got = rows(spark.read.parquet(f"file://{tmp_path}/out/version={k}"), "id")
    assert got == [(1, 2, "c"), (2, 1, "b")]
