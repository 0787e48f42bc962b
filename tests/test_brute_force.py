"""Operators without SQL against brute force on small fixtures, and the work of single large keys."""

import random
import re
import time
import unicodedata
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quarrymill import catalog
from quarrymill.functions import text as T
from quarrymill.operators import aggregates as A
from quarrymill.operators import graphs as G
from quarrymill.operators import identity as I
from quarrymill.operators import joins as J
from quarrymill.operators import reviews as V
from quarrymill.operators import selection as S
from quarrymill.operators import sequences as Q
from quarrymill.sources import tables as X


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(k, f, round(rng.random(), 3)) for k in ("a", "b", None) for f in rng.sample(range(60), 40)]


@pytest.fixture(scope="module")
def scored(spark, rows):
    return spark.createDataFrame(rows, "k string, frame long, q double").repartition(5)


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_spaced_best(scored, rows):
    want = []
    for own in by_key(rows).values():
        taken = []
        for r in sorted(own, key=lambda r: (-r[2], r[1])):
            if len(taken) < 4 and all(abs(r[1] - t[1]) >= 5 for t in taken):
                taken.append(r)
        want += taken
    assert sorted(map(tuple, Q.spaced_best(scored, ["k"], "frame", "q", 5, 4).collect()), key=repr) == sorted(want, key=repr)


def test_diverse_in_time(scored, rows):
    want = []
    for own in by_key(rows).values():
        free, low, high = sorted(own, key=lambda r: r[1]), min(r[1] for r in own), max(r[1] for r in own)
        for k in range(3):
            target = low + (high - low) * k / 2
            top = max(r[2] for r in free)
            best = max(free, key=lambda r: (r[2] / top - 0.55 * abs(r[1] - target) / (high - low), -r[1]))
            free.remove(best)
            want.append(best)
    assert sorted(map(tuple, Q.diverse_in_time(scored, ["k"], "frame", "q", 3).collect()), key=repr) == sorted(want, key=repr)


def test_stratified_and_unique_top(scored, rows):
    got = S.stratified(scored.withColumn("id", F.concat_ws("-", "k", "frame")), ["k"], "id", 6).collect()
    hashes = {r.id: r.h for r in scored.select(F.concat_ws("-", "k", "frame").alias("id"), F.xxhash64(F.concat_ws("-", "k", "frame"), F.lit(0)).alias("h")).collect()}
    names = {k: [f"{k}-{f}" if k else str(f) for _, f, _ in own] for k, own in by_key(rows).items()}
    assert {(r.k, r.id) for r in got} == {(k, x) for k, ids in names.items() for x in sorted(ids, key=lambda i: (hashes[i], i))[:6]}
    known = [r for r in rows if r[0]]
    gone, want = set(), set()
    for k in ("a", "b"):
        for r in [r for r in sorted(by_key(known)[k], key=lambda r: (-r[2], r[1])) if r[1] not in gone][:15]:
            gone.add(r[1])
            want.add((k, r[1]))
    assert {(r.k, r.frame) for r in S.unique_top(scored.where("k is not null"), "frame", "k", "q", 15).collect()} == want


def test_balanced_quota_in_turns(spark):
    rng = random.Random(2)
    scores = [(i, q, rng.randrange(20) / 20) for q in "xyz" for i in rng.sample(range(14), {"x": 3, "y": 10, "z": 12}[q])]
    got = S.balanced_quota(spark.createDataFrame(scores, "i long, q string, s double"), "i", "q", "s", 11, ["x", "y", "z"]).orderBy("position").collect()
    pools = {q: sorted((r for r in scores if r[1] == q), key=lambda r: (-r[2], r[0]))[:11] for q in "xyz"}
    left, taken, want = {"x": 4, "y": 4, "z": 3}, set(), []
    for _ in range(4):
        for q in "xyz":
            free = [r for r in pools[q] if r[0] not in taken]
            if left[q] and free:
                left[q] -= 1
                taken.add(free[0][0])
                want.append(free[0])
    assert [(r.i, r.q, r.s) for r in got] == want


def test_labelled_metrics_and_report(spark):
    rng = random.Random(8)
    truth = [(f, a) for f in range(6) for a in range(rng.randint(0, 4))]
    guess = [(f, b) for f in range(6) for b in range(rng.randint(0, 4))]
    pairs = [(f, a, b, rng.choice([0.2, 0.5, 0.7, 0.9])) for f, a in truth for g, b in guess if f == g]
    matched = []
    for f in range(6):
        used_a, used_b = set(), set()
        for _, a, b, s in sorted((p for p in pairs if p[0] == f and p[3] >= 0.5), key=lambda p: (-p[3], -p[1], -p[2])):
            if a not in used_a and b not in used_b:
                used_a.add(a), used_b.add(b)
                matched.append((f, a, b, s))
    df = spark.createDataFrame(pairs, "frame long, a long, b long, s double")
    m = Q.greedy_match(df, ["frame"], "a", "b", "s", 0.5)
    assert sorted(map(tuple, m.collect())) == sorted(matched)
    t, p = spark.createDataFrame(truth, "frame long, a long"), spark.createDataFrame(guess, "frame long, b long")
    counts = I.labelled_counts(t, p, m, ["frame"]).agg(F.sum("tp"), F.sum("fn")).first()
    assert tuple(counts) == (len(matched), len(truth) - len(matched))
    r = V.labelled_report(t, p, m, ["frame"], spark.createDataFrame([(2,)], "switches long"), "s").first()
    assert (r.tp, r.fp, r.fn, r.id_switches) == (len(matched), len(guess) - len(matched), len(truth) - len(matched), 2)
    assert r.f1 == pytest.approx(2 * len(matched) / (len(truth) + len(guess))) and r.mean_iou == pytest.approx(sum(x[3] for x in matched) / len(matched))


def test_assignment_against_every_one(spark):
    rng = random.Random(3)
    for _ in range(3):
        scores = [(i, label, rng.randrange(100) / 100) for i in range(5) for label in "xy" if rng.random() < 0.8]
        got = S.assign(spark.createDataFrame(scores, "i long, l string, s double"), "i", "l", "s", 2).collect()
        value = {(i, label): s for i, label, s in scores}
        options = [[(i, label) for i, label in zip(order, "xxyy", strict=True) if (i, label) in value] for order in permutations(range(-2, 5), 4)]
        most = max(len(o) for o in options)
        assert len(got) == most and sum(r.s for r in got) == pytest.approx(max(sum(value[x] for x in o) for o in options if len(o) == most), abs=1e-6)


def test_models_learn_what_is_easy(spark, data):
    """The three model queries give every item one answer."""
    for name in ("kmeans_teams", "logistic_teams", "forest_roles"):
        df = catalog.QUERIES[name](spark, data)
        rows = df.collect()
        assert rows and all(x is not None for r in rows for x in r)


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [2.0] * 50, [1.0] * 5 + [9.0] * 5, [float(k * k % 97) for k in range(301)], [-1e9, 0.0, 1e-9, 1e9]])
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([(k, v + k) for k in (0, 1) for v in values] + [(0, None)], "k int, v double").repartition(3)
    assert {r.k: r.median for r in A.exact_median(df, "k", "v", 8).collect()} == {k: pytest.approx(statistics.median(v + k for v in values)) for k in (0, 1)}


def test_whole_keys_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k if k % 4 else None, j) for k in range(30) for j in range(k % 11)]
        df = spark.createDataFrame(rows, "k long, j long").repartition(3)
        got = Q.per_key(df, ["k"], lambda g: g.assign(j=len(g)).head(1), df.schema).collect()
        want = {}
        for k, _ in rows:
            want[k] = want.get(k, 0) + 1
        assert sorted(map(tuple, got), key=repr) == sorted(want.items(), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_key_of_200_000_rows(spark):
    """Nearest rows and filled gaps take time in proportion to a key's rows."""
    n = 200_000
    left = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, n, 7).select(F.lit(1).alias("k"), F.col("id").alias("rt"), F.col("id").alias("v"))
    began = time.time()
    got = J.nearest(left, right, ["k"], "t", "rt", "v").agg(F.sum(F.abs(F.col("t") - F.col("nearest_value"))).alias("s"), F.count("*").alias("n")).first()
    assert (got.s, got.n) == (sum(min(t % 7, 7 - t % 7) if t - t % 7 + 7 < n else t % 7 for t in range(n)), n)
    gaps = left.select("k", "t", F.when(F.col("t") % 5 == 0, F.col("t").cast("double")).alias("x"))
    filled = Q.fill_or_hold(gaps, ["k"], "t", "x").where("filled is not null and abs(filled - t) < 5").count()
    assert filled == n
    assert time.time() - began < 40  # a quadratic plan takes hours


def test_prototypes_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    vectors = [(k, [rng.random() for _ in range(4)]) for k in range(60)]
    items, protos = spark.createDataFrame(vectors, "id long, v array<double>"), spark.createDataFrame([(f"p{k}", v) for k, v in vectors[:30]], "label string, p array<double>")
    whole = sorted(map(tuple, G.nearest_prototype(items, protos, "id", "v", "label", "p").collect()))
    veto = sorted((r.id, r.other_distance, r.veto) for r in G.vetoed(items.withColumn("distance", F.lit(0.5)), protos, "id", "v", "p").collect())
    monkeypatch.setattr(G, "BROADCAST_BYTES", 500)
    monkeypatch.setattr(G, "is_small", lambda df: False)
    assert sorted(map(tuple, G.nearest_prototype(items, protos, "id", "v", "label", "p").collect())) == whole
    assert sorted((r.id, r.other_distance, r.veto) for r in G.vetoed(items.withColumn("distance", F.lit(0.5)), protos, "id", "v", "p").collect()) == veto


def test_only_small_tables_are_broadcast(spark):
    assert J.is_small(spark.range(10)) and not J.is_small(spark.range(10), 20)
    assert not J.is_small(spark.range(3).withColumn("t", F.repeat(F.lit("x"), 100)), 200)


def test_slug_is_compatible_ascii(spark):
    names = ["Beşiktaş JK", "Śląsk Wrocław", "Újpest FC", "Győri ETO", "Čelik – ﬁnal", "Ǆ ½ ™ Ⅷ", "Ｆｕｌｌ　ｗｉｄｔｈ", "Ångström №5", "Þór ØL", "İstanbul", "ǆ ĳ ŉ", "東京 Tokyo", "", "--a--"]

    def plain(name):
        flat = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", flat).strip("-")

    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", T.slug(F.col("n")).alias("s")).collect()}
    assert got == {n: plain(n) for n in names}


def test_intents_by_their_words(spark):
    """The patterns against words that are written down here."""
    cases = {
        "corner kick from the left": (True, None), "a throw-in": (True, None), "red  card": (True, None), "penalty area": (True, None), "Low-block": (False, "low_block"), "defending deep": (False, "low_block"), "compact near their box": (False, "low_block"),
        "most players behind the ball": (False, "low_block"), "wing press": (False, "high_press_wing"), "pressing near the touchline": (False, "high_press_wing"), "wide pressing lane": (False, "high_press_wing"), "high press through the centre": (False, "high_press_central"),
        "press central build-up": (False, "high_press_central"), "central pressure": (False, "high_press_central"), "mid block": (False, "medium_press"), "middle third press": (False, "medium_press"), "middle-third pressure": (False, None), "cornerstone": (False, None), "goal": (False, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "q string").select("q", *T.intent(F.col("q"))).toDF("q", "unsupported", "preferred")
    assert {r.q: (r.unsupported, r.preferred) for r in df.collect()} == cases


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"a": {k}}}' if k % 5 else ("  " if k % 2 else "{broken") for k in range(2000)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "y.jsonl").write_text("[1]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = X.checked_json_lines(spark, f"{tmp_path}/*.jsonl", X.StructType().add("a", "long"))
        rows = {(r.file[-7:], r.line): (r.record and r.record.a, r.problem) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("x.jsonl", k + 1): ((k, None) if k % 5 else (None, f"line {k + 1} is no JSON object")) for k, line in enumerate(lines) if line.strip()}
    assert rows == want | {("y.jsonl", 1): (None, "line 1 is no JSON object")}
    (tmp_path / "z.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="no lines"):
        X.checked_json_lines(spark, f"{tmp_path}/z.txt", X.StructType().add("a", "long"))


def test_fatal_problems_fail_and_others_stay(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "late")], "k int, f string, e string")
    assert [(r.k, r.status, r.reason) for r in V.collected(df, F.col("f"), F.col("e")).orderBy("k").collect()] == [(1, "accepted", None), (2, "excluded", "late")]
    with pytest.raises(Exception, match="configuration: bad"):
        V.collected(df.union(spark.createDataFrame([(3, "bad", None)], "k int, f string, e string")), F.col("f"), F.col("e")).collect()
