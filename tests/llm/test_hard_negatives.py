"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from quarrymill.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, key string, list int, score string"


def plain(rows, positives=5, negatives=3):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(good):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m == label) for b, (j, m, w) in enumerate(good) if a != b)
        for p, p_null, pid, _ in [s for s in scored if s[3]][:positives]:
            fits = [s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, None if p_null else pid, r, None if s[1] else s[2], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, m, "x", 1, "y") for i, v, m in rows], SCHEMA).repartition(3)


def random_rows(n, centres=12, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    vectors = at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.3
    vectors[: n // 3] = np.round(vectors[0], 1)  # a third are copies of one row
    return [(k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))) for k, v in enumerate(vectors)]


@pytest.mark.parametrize("block,slice_,first", [(4096, 65_536, 2), (20, 3, 1)])
def test_against_all_pairs(spark, monkeypatch, block, slice_, first):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "SLICE_ANCHORS", slice_)
    monkeypatch.setattr(H, "FIRST_LISTS", first)
    rows = random_rows(400)
    got, want = rows_of(H.hard_negatives(frame(spark, rows))), plain(rows)
    assert got == want and len(want) > 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.6, 0.5], 2), (3, [0.6, 0.5], 2), (3, [0.6, 0.5], 2), (None, [0.6, 0.5], 2), (None, [0.9, 0.4], 1)]
    rows += [(50, [], 3), (51, [1.0], 3), (52, [], 4), (100, [-1.0, 0.0], 5), (101, [1.0, 0.0], 5), (102, [-0.5, 0.0], 6), (150, [1.0, 0.0], 77), (49, [0.7, 0.2], -11), (200, [0.1, 0.2], -10)]
    bad = [(200, None, 1), (250, [None, 1.0], 1), (300, [nan, 1.0], 1), (350, [1.0, -inf], 2), (400, [1.0, 1.0], None)]
    random.Random(3).shuffle(rows)
    assert rows_of(H.hard_negatives(frame(spark, rows + bad))) == plain(rows + bad) != []
    assert rows_of(H.hard_negatives(frame(spark, bad))) == []
    assert rows_of(H.hard_negatives(frame(spark, rows).limit(0))) == []
    with pytest.raises(ValueError):
        H.hard_negatives(frame(spark, [(0, [1e9], 1)]))


def test_lists_are_pruned(spark):
    rows = [(k, [float(np.float32(x)) for x in v], k % 3) for k, v in enumerate(np.repeat(np.eye(8), 60, axis=0) + np.random.default_rng(2).normal(size=(480, 8)) * 0.01)]
    lists = H.build_lists(H.usable(frame(spark, rows)))
    stored = lists.rows.collect()
    assert len(stored) == 480 and lists.sizes.sum() == 480
    for r in stored:  # the radius holds for every row
        assert np.linalg.norm(np.array(r.vec) - lists.centroids[r.list]) <= lists.radii[r.list] * (1 + 1e-12)
    full = H.F.array(H.F.lit(30_000).cast("long"))
    asked = lists.rows.select("key", "label", "vec", full.alias("least"), (H.F.array(H.F.lit(H.EXACT).cast("long"))).alias("most"), H.F.array().cast("array<int>").alias("seen"))
    visits = [len(r.visits) for r in H._routed(lists, asked, False).collect()]
    assert max(visits) < np.count_nonzero(lists.sizes)


def test_percent(spark):
    xs = [0, 1, 19, 20, 99, 100, 101, 12_345, (1 << 53) - 1]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", H._percent(H.F.col("x"), 95).alias("most"), (-H._percent(-H.F.col("x"), 50)).alias("least")).collect()
    assert all((r.most, r.least) == (r.x * 95 // 100, -(-r.x * 50 // 100)) for r in got)
