"""Models against numpy: two-means per fixture, leave-one-group-out regressions, boosted trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill import catalog
from quarrymill.operators import boosted as B
from quarrymill.operators import folds as O
from quarrymill.operators import teams as M
from quarrymill.plans import learning as L


def lloyd(x, w, a, b):
    """Centres, sides and inertia of weighted two-means from two first centres."""
    while True:
        da, db = ((x - a) ** 2).sum(1), ((x - b) ** 2).sum(1)
        side = da > db
        new = [np.average(x[s], axis=0, weights=w[s]) if s.any() else old for s, old in ((~side, a), (side, b))]
        if np.allclose(new[0], a, atol=1e-12) and np.allclose(new[1], b, atol=1e-12):
            return new[0], new[1], float((w * np.minimum(da, db)).sum())
        a, b = new


def groups_of(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_two_means_per_group(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in (0, 1, None):
        middle = rng.normal(size=(2, 5)) * 6
        for k in range(40):
            rows.append((g, (g or 7) * 100 + k, [float(z) for z in middle[k % 2] + rng.normal(size=5)], float(rng.integers(1, 26))))
    rows += [(2, 900 + k, [1.0] * 5, 1.0) for k in range(3)] + [(3, 950, [2.0] * 5, 1.0), (3, 951, None, 1.0), (3, 952, [9.0] * 5, 0.0)]
    df = spark.createDataFrame(rows, "g long, id long, v array<double>, w double").repartition(5)
    got = {r.g: r for r in M.two_means(df, "g", "id", "v", "w").collect()}
    assert set(got) == {0, 1, None, 2, 3}
    for g in (0, 1, None):
        mine = [r for r in rows if r[0] == g]
        x, w = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        least = min((lloyd(x, w, x[i], x[j]) for i in range(0, 40, 5) for j in range(1, 40, 6) if i != j), key=lambda r: r[2])
        assert got[g].inertia == pytest.approx(least[2], rel=1e-9)
        first = x[min(range(40), key=lambda k: mine[k][1])]
        a, b = np.array(got[g].a), np.array(got[g].b)
        assert ((first - a) ** 2).sum() <= ((first - b) ** 2).sum()
        assert sorted([list(a), list(b)]) == [pytest.approx(list(c), abs=1e-9) for c in sorted([list(least[0]), list(least[1])])]
    assert got[2].a == got[2].b == [1.0] * 5 and got[3].a == [2.0] * 5
    assert M.two_means(df.limit(0), "g", "id", "v", "w").count() == 0


def test_two_means_by_blocks_of_groups(spark):
    """Every group ends at centres that are the means of their rows, also when groups are taken one by one."""
    x = np.random.default_rng(2).normal(size=(60, 2))
    rows = [(g, k, [float(z) for z in x[k]], 1.0) for g in (0, 1, None) for k in range(60)]
    df = spark.createDataFrame(rows, "g long, id long, v array<double>, w double").repartition(3)
    found = M.two_means(df, "g", "id", "v", "w", groups_at_once=1).collect()
    assert {r.g for r in found} == {0, 1, None}
    for r in found:
        near = ((x - r.a) ** 2).sum(axis=1) <= ((x - r.b) ** 2).sum(axis=1)
        assert np.allclose(x[near].mean(axis=0), r.a, atol=1e-9) and np.allclose(x[~near].mean(axis=0), r.b, atol=1e-9)


def test_two_means_go_on_until_they_stand(spark):
    """Many rows without clusters: most starts need more than 100 rounds."""
    x = np.random.default_rng(1).normal(size=(20_000, 8))
    df = spark.createDataFrame([(1, k, [float(z) for z in v], 1.0) for k, v in enumerate(x)], "g long, id long, v array<double>, w double").repartition(2)
    (r,) = M.two_means(df, "g", "id", "v", "w").collect()
    near = ((x - r.a) ** 2).sum(axis=1) <= ((x - r.b) ** 2).sum(axis=1)
    assert np.allclose(x[near].mean(axis=0), r.a, atol=1e-8) and np.allclose(x[~near].mean(axis=0), r.b, atol=1e-8)


def test_eligible_tracks(spark):
    rows = [(g, i, ((i * 7) % 30) / 60 + (0.4 if g == 1 else 0), i % 5) for g in (1, 2) for i in range(30)] + [(None, 5, 0.1, 1)]
    df = spark.createDataFrame(rows, "g long, id long, p double, n long")
    got = groups_of(M.eligible(df, "g", "id", "p", "n", 0.6).collect(), "g")
    assert {r.id for r in got[1]} == {i for g, i, p, n in rows if g == 1 and p >= 0.6 and n >= 3}
    assert [r.id for r in sorted(got[2], key=lambda r: (-r.p, r.id))] == [i for _, i, _, _ in sorted((r for r in rows if r[0] == 2), key=lambda r: (-r[2], r[1]))[:20]]
    assert len(got[None]) == 1


@pytest.mark.parametrize("strength", [0.0, 0.5, 1.0])
def test_relabelling_stops_at_the_target(spark, strength):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(4)) or None, i, int(rng.integers(0, 40)), float(rng.integers(8)) / 8, bool(rng.random() < 0.8), float(rng.integers(8)) / 8, int(rng.integers(2)), "other" if rng.random() < 0.7 else "team_a") for i in range(300)]
    df = spark.createDataFrame(rows, "g long, id long, n long, p double, votes boolean, margin double, cluster int, label string").repartition(7)
    got = {r.id: r for r in M.relabel_excess(df, "g", "id", "n", "p", "votes", 0.5, 0.2, strength).collect()}
    assert len(got) == 300
    for part in groups_of([dict(zip(df.columns, r, strict=True)) for r in rows], "g").values():
        whole, others, moved = sum(r["n"] for r in part), sum(r["n"] for r in part if r["label"] == "other"), set()
        pool = [r for r in part if r["label"] == "other" and r["votes"] and r["p"] >= 0.5 * (1 - 0.55 * strength) and r["margin"] >= 0.2 * (1 - 0.75 * strength)]
        for r in sorted(pool, key=lambda r: (-r["margin"] * r["p"] * min(r["n"], 25), r["id"])):
            if whole <= 0 or others / whole <= 0.35 - 0.23 * strength:
                break
            others -= r["n"]
            moved.add(r["id"])
        assert {r["id"] for r in part if got[r["id"]].relabelled} == moved
        assert all(got[i].label == ("team_a", "team_b")[got[i].cluster] for i in moved)


def test_fixture_teams_are_a_fixpoint(spark, data):
    """Centres out of the eligible tracks' clusters give every track's cluster and margin back."""
    out = {r.vec_id: r for r in catalog.QUERIES["fixture_teams"](spark, data).collect()}
    rows = L.tracks(spark, data).collect()
    assert len(out) == len(rows)
    for part in groups_of(rows, "fixture").values():
        sure = [r for r in part if r.p_outfield >= L.LEAST and r.detections >= 3]
        if len(sure) < 2:
            sure = sorted(part, key=lambda r: (-r.p_outfield, r.vec_id))[:20]
        centre = [np.average([r.embedding for r in sure if out[r.vec_id].cluster == c], axis=0, weights=[min(r.detections, 25) for r in sure if out[r.vec_id].cluster == c]) for c in (0, 1)]
        for r in part:
            d = [float(np.linalg.norm(np.array(r.embedding) - c)) for c in centre]
            assert out[r.vec_id].cluster == int(d[0] > d[1])
            assert out[r.vec_id].margin == pytest.approx(abs(d[0] - d[1]) / max(*d, 1e-6), abs=2e-5)


def descend(x, y, n_classes, strength):
    """Probabilities function of a balanced, standardised softmax regression by plain accelerated descent."""
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    one = lambda v: np.hstack([(v - mean) / spread, np.ones((len(v), 1))])
    seen = np.bincount(y, minlength=n_classes)
    w = (len(y) / ((seen > 0).sum() * np.maximum(seen, 1)))[y]
    sets = 1 if n_classes == 2 else n_classes
    ridge = np.append(np.full(x.shape[1], 1 / strength), 0.0)

    def p(z):
        z = np.hstack([np.zeros((len(z), 1)), z]) if sets == 1 else np.where(seen > 0, z, -1e300)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    a, hot = one(x), np.eye(n_classes)[y]
    theta = back = np.zeros((sets, a.shape[1]))
    rate = 1 / (np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 + 1 / strength)
    for k in range(6000):
        ahead = theta + k / (k + 3) * (theta - back)
        gradient = (w[:, None] * (p(a @ ahead.T) - hot)[:, -sets:]).T @ a + ridge * ahead
        back, theta = theta, ahead - rate * gradient
    return lambda v: p(one(v) @ theta.T)


@pytest.mark.parametrize("n_classes", [2, 3])
def test_left_out_groups_equal_separate_fits(spark, n_classes):
    rng = np.random.default_rng(n_classes)
    n, groups = 120, np.array([f"v{k}" for k in (0, 0, 0, 1, 2, 2, 3)])[rng.integers(0, 7, 120)]
    y = rng.integers(0, n_classes, n)
    x = rng.normal(size=(n, 4)) + y[:, None] * np.array([1.0, -0.5, 0.0, 0.3])
    x[:, 3] = np.where(groups == "v0", x[:, 3], 5.0)  # constant without the first group
    rows = [(i, str(groups[i]), [float(v) for v in x[i]], "abc"[y[i]]) for i in range(n)]
    odd = [(900, None, [0.0] * 4, "a"), (901, "v0", None, "a"), (902, "v0", [0.0] * 4, None), (903, "v0", [0.0, None, 0.0, 0.0], "a")]
    df = spark.createDataFrame(rows + odd, "id long, video string, x array<double>, team string").repartition(5)
    out, skipped = O.leave_one_group_out(df, "id", "video", "x", "team", folds_at_once=3)
    got = {r.id: r for r in out.collect()}
    assert not skipped and set(got) == set(range(n))
    for g in set(groups.tolist()):
        p = descend(x[groups != g], y[groups != g], n_classes, 1.0)(x[groups == g])
        for i, q in zip(np.flatnonzero(groups == g), p, strict=True):
            assert got[i].confidence == pytest.approx(q.max(), abs=1e-5)
            assert got[i].guess == "abc"[q.argmax()] or q.max() < 0.5 + 1e-5


def test_folds_of_one_class_are_skipped_and_listed(spark):
    rows = [(i, "x" if i < 6 else "y", [float(i), 1.0], "a" if i >= 6 or i % 2 else "b") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, video string, x array<double>, team string")
    out, skipped = O.leave_one_group_out(df, "id", "video", "x", "team")
    assert skipped == ["x"] and {r.id for r in out.collect()} == set(range(6, 12))
    out, skipped = O.leave_one_group_out(df.where("video = 'x'"), "id", "video", "x", "team")
    assert skipped == ["x"] and out.count() == 0
    out, skipped = O.leave_one_group_out(df.limit(0), "id", "video", "x", "team")
    assert skipped == [] and out.count() == 0


def test_left_out_report_lists_every_fold(spark, data):
    rows = {r.fold: r for r in catalog.QUERIES["left_out_report"](spark, data).collect()}
    assert rows["all"].rows == sum(r.rows or 0 for f, r in rows.items() if f != "all")
    assert rows["all"].accuracy > 0.5


def boost(x, y, n_classes, rounds, rate, depth, most_leaves, l2, least_rows):
    """Softmax boosting over the values themselves, sets of rows in place of nodes."""
    n = len(y)
    w = (n / (n_classes * np.bincount(y)))[y]
    z = np.zeros((n, n_classes))

    def best_split(rows, g, h):
        gain = lambda part: g[part].sum() ** 2 / (h[part].sum() + l2)
        options = []
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(low), len(high)) >= least_rows:
                    options.append((round(gain(low) + gain(high) - gain(rows), 9), -f, -v, low, high))
        best = max(options, key=lambda o: o[:3], default=None)
        return best if best and best[0] > 1e-8 else None

    for _ in range(rounds):
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        for k in range(n_classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            level, leaves, step = [np.arange(n)], 1, np.zeros(n)
            for _ in range(depth):
                found = [s for rows in level if (s := best_split(rows, g, h))]
                level = []
                for _, _, _, low, high in sorted(found, key=lambda o: -o[0]):
                    if leaves < most_leaves:
                        leaves += 1
                        level += [low, high]
                        for rows in (low, high):
                            step[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            z[:, k] += step
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@pytest.mark.parametrize(("n_classes", "most_leaves"), [(2, 20), (3, 20), (3, 3)])
def test_boosting_equals_numpy(spark, n_classes, most_leaves):
    rng = np.random.default_rng(10 + n_classes)
    y = np.concatenate([np.arange(n_classes), rng.integers(0, n_classes, 150)])
    x = np.round(rng.normal(size=(len(y), 3)) + y[:, None] * np.array([0.9, -0.6, 0.0]), 1).clip(-2, 3)
    rows = [(i, [float(v) for v in x[i]], "abc"[y[i]]) for i in range(len(y))] + [(900, None, "a"), (901, [0.0] * 3, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, role string").repartition(4)
    model = B.fit(df, "x", "role", rounds=5, rate=0.3, depth=3, most_leaves=most_leaves, l2=1.0, least_rows=5, bins=400, keep_every=2)
    want = boost(x, y, n_classes, 5, 0.3, 3, most_leaves, 1.0, 5)
    got = {r.id: r for r in B.predict(model, df, "id", "x").collect()}
    assert len(got) == len(rows) and len(model.rounds) == 5
    for i in range(len(y)):
        assert got[i].probabilities == pytest.approx(list(want[i]), abs=1e-7)
        assert got[i].guess == model.classes[int(want[i].argmax())] or want[i].max() < 0.5


def test_boosting_of_odd_tables(spark):
    df = spark.createDataFrame([(i, [float(i), float("nan") if i % 2 else None], "a" if i % 2 else "b") for i in range(60)], "id long, x array<double>, role string")
    assert {r.guess for r in B.predict(B.fit(df.where("role = 'a'"), "x", "role"), df, "id", "x").collect()} == {"a"}
    model = B.fit(df, "x", "role", rounds=3)
    assert all(sum(r.probabilities) == pytest.approx(1) for r in B.predict(model, df, "id", "x").collect())
    assert {r.guess for r in B.predict(B.fit(df.limit(0), "x", "role"), df, "id", "x").collect()} == {None}


def test_boosted_roles_beat_the_commonest_on_held_out_rows(spark, data):
    rows = catalog.QUERIES["boosted_roles"](spark, data.replace("sf0.001", "sf0.01")).where("held_out and role <> 'goalkeeper'").collect()
    share = lambda f: np.mean([f(r) for r in rows])
    assert share(lambda r: (r.guess == "other") == (r.role == "other")) > max(0.9, share(lambda r: r.role == "outfield"))


def test_statistics_read_texts_once(spark, data):
    """A fit reads its rows many times; these are numbers in a kept table, not expressions over texts."""
    files = L.statistics(spark, data).inputFiles()
    assert files and not any("documents" in f for f in files)
