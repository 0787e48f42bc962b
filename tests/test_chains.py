"""Chains of candidates, windows of frames, numbered chains and class heads against plain loops and SQL."""

import numpy as np
import pandas as pd

from quarrymill import catalog
from quarrymill.operators import sequences as Q


def plain_chain(g, diagonal, beam, gap_limit):
    """One key's steadiest chain, frame by frame."""
    g = g.sort_values(["frame", "x", "y"], kind="stable").reset_index(drop=True)
    f, x, y, gain = (g[c].to_numpy(float) for c in ("frame", "x", "y", "c"))
    gain = 0.35 + 4 * gain
    score, before, ends = gain.copy(), np.full(len(g), -1), []
    for number in np.unique(f):
        now = np.flatnonzero(f == number)
        for n in now:
            for e in ends if len(ends) and number - f[ends[0]] <= gap_limit else []:
                total = score[e] + gain[n] - 7.0 * (np.hypot(x[n] - x[e], y[n] - y[e]) / diagonal) - 0.18 * (number - f[e] - 1)
                if total > score[n]:
                    score[n], before[n] = total, e
        ends = now[np.argsort(-score[now], kind="stable")][:beam]
    chain, at = [], int(score.argmax())
    while at >= 0:
        chain.append(at)
        at = before[at]
    return [tuple(r) for r in g.loc[chain[::-1]].itertuples(index=False)]


def test_best_path_of_many_keys_at_once(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"k": rng.integers(0, 40, 3000), "frame": rng.integers(0, 120, 3000), "x": rng.integers(0, 6, 3000) * 1.0, "y": rng.integers(0, 4, 3000) * 1.0, "c": rng.integers(0, 3, 3000) / 4})
    rows = pd.concat([rows, rows[rows.k == 3].assign(k=99, frame=7), pd.DataFrame([[77, 5, 1.0, 1.0, 0.5]], columns=rows.columns)])
    rows.loc[rows.k == 8, "frame"] *= 5  # gaps beyond the limit
    for beam in (20, 2):
        got = {}
        for r in Q.best_path(spark.createDataFrame(rows).repartition(3), ["k"], "frame", "x", "y", "c", 10.0, beam=beam).collect():
            got.setdefault(r.k, []).append(tuple(r))
        assert got == {k: plain_chain(g, 10.0, beam, 8) for k, g in rows.groupby("k")}


def test_keys_are_handed_on_by_many_rows(spark):
    """200 keys of 50 rows in one partition: one call of the function, not one a batch of Arrow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        df = spark.range(10_000).selectExpr("id % 200 as k", "id as v").coalesce(1)
        got = Q.whole_keys(df, ["k"], lambda g: pd.DataFrame({"keys": [g.k.nunique()], "rows": [len(g)]}), "keys long, rows long", 100_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["keys"] for r in got) == 200 and sum(r["rows"] for r in got) == 10_000 and len(got) <= 4


def test_five_points_with_gaps(spark):
    frames = {1: [1, 2, 30, 31, 60], 2: [5], None: [10, 35, 10_000]}
    df = spark.createDataFrame([(k, f) for k, v in frames.items() for f in v], "k long, f long")
    got = {(r.k, r.f): list(r.nearest) for r in Q.five_point_windows(df, ["k"], "f").collect()}
    assert got == {(k, f): [min(v, key=lambda a: (abs(a - f - o), a)) for o in (-25, -12, 0, 12, 25)] for k, v in frames.items() for f in v}


def test_plans_spread_and_compile(spark, data):
    """No row is repeated before a sort, no window has a flag's rows in one task, no head goes through functions over arrays."""
    plan = lambda name: catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    five = plan("five_point_windows_all")
    assert five.index("Generate") < five.index("Window")  # printed from the top: the rows are repeated last
    assert "transform(" not in plan("softmax_heads") and "aggregate(" not in plan("softmax_heads")
    assert "_part" in next(line for line in plan("ordered_chains").splitlines() if "Window" in line)
