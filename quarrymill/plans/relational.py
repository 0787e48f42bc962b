"""Join, aggregate, selection and set queries.

Analogies: an order is a chain or frame and its lines are members; events of a user are a
track's observations; labels stand for reviews.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import selection as S
from ..sources.tables import last_wins, only_keys, table
from .registry import query

_EV = """SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t, epoch_us(ts) // 3600000000 AS hour FROM events"""


def _events(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds.alias("t"), F.floor(seconds / 3600).cast("long").alias("hour"))


# ------------------------------------------------------------------- joins


@query("""SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def broadcast_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    j = J.lookup(c, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def semi_needed(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return only_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), wanted, ["l_orderkey"])


@query(f"""WITH e AS ({_EV}), w AS (SELECT DISTINCT user_id, hour * 3600.0 AS s, hour * 3600.0 + 1800.0 AS f FROM e), p AS (SELECT user_id, t FROM e WHERE event_type = 'purchase')
SELECT user_id, s::BIGINT AS start, f::BIGINT AS finish FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = w.user_id AND p.t BETWEEN s - 600 AND f + 600)""")
def anti_overlap_windows(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = e.select("user_id", (F.col("hour") * 3600.0).alias("start"), (F.col("hour") * 3600.0 + 1800.0).alias("finish")).distinct()
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("t").cast("double").alias("t"))
    kept = J.overlap_anti(w, marks, ["user_id"], "start", "finish", "t", 600.0, 3600.0)
    return kept.select("user_id", F.col("start").cast("long").alias("start"), F.col("finish").cast("long").alias("finish"))


@query(f"""WITH e AS ({_EV}), w AS (SELECT user_id, min(t) AS s, min(t) + 86400 * 3 AS f FROM e GROUP BY user_id)
SELECT e.event_id, w.s AS start FROM e JOIN w ON e.user_id = w.user_id AND e.t >= w.s AND e.t < w.f""")
def range_window_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = e.groupBy("user_id").agg(F.min("t").alias("start")).withColumn("finish", F.col("start") + 86400 * 3)
    return J.range_join(e, w, ["user_id"], "t", "start", "finish", 86400.0).select("event_id", "start")


_NEAR = f"""WITH e AS ({_EV}), r AS (SELECT user_id, t, min(value) AS value FROM e WHERE event_type = 'view' GROUP BY user_id, t),
l AS (SELECT * FROM e WHERE event_type = 'purchase'), j AS (SELECT l.event_id, abs(l.t - r.t) AS gap, r.t AS place, r.value FROM l LEFT JOIN r ON l.user_id = r.user_id),
g AS (SELECT event_id, arg_min({{v}}, (gap, place)) FILTER (place IS NOT NULL) AS v1, arg_min(place, (gap, place)) FILTER (place IS NOT NULL) AS p1, min(gap) AS gap FROM j GROUP BY event_id)"""


@query(_NEAR.format(v="value") + " SELECT event_id, p1::DOUBLE AS nearest_at, v1 AS nearest_value FROM g")
def nearest_asof(spark, sf_dir):
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", F.col("t").alias("rt"), "value")
    return J.nearest(left, right, ["user_id"], "t", "rt", "value").select("event_id", "nearest_at", "nearest_value")


@query(_NEAR.format(v="value") + " SELECT event_id, CASE WHEN gap <= 20000 THEN p1::DOUBLE END AS nearest_at, CASE WHEN gap <= 20000 THEN v1 END AS nearest_value FROM g")
def nearest_within(spark, sf_dir):
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", F.col("t").alias("rt"), "value")
    return J.nearest(left, right, ["user_id"], "t", "rt", "value", 20000.0).select("event_id", "nearest_at", "nearest_value")


_PL = "SELECT l_orderkey AS frame, l_linenumber AS player, l_linestatus AS team, l_quantity * 2.1 - 52.5 AS x, l_extendedprice % 68 - 34 AS y FROM lineitem"


@query(f"""WITH p AS ({_PL}), o AS (SELECT o_orderkey AS frame, o_totalprice % 105 - 52.5 AS ex, o_totalprice % 68 - 34 AS ey FROM orders),
d AS (SELECT o.frame, player, sqrt((x - ex) ** 2 + (y - ey) ** 2) AS d FROM o JOIN p USING (frame))
SELECT frame, round(min(d), 6) AS distance, arg_min(player, (d, player)) AS nearest FROM d GROUP BY frame""")
def nearest_player(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_totalprice") % 105 - 52.5).alias("ex"), (F.col("o_totalprice") % 68 - 34).alias("ey"))
    got = J.nearest_in_group(o, players(spark, sf_dir), ["frame"], "ex", "ey", "x", "y", "player")
    return got.select("frame", F.round("distance", 6).alias("distance"), "nearest")


def players(spark, sf_dir, *more):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *more,
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("player"), F.col("l_linestatus").alias("team"), (F.col("l_quantity") * 2.1 - 52.5).alias("x"), (F.col("l_extendedprice") % 68 - 34).alias("y")
    )


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 1 THEN 'good' END, 'unknown') AS label,
CASE WHEN l.toxic = 1 THEN 'human' WHEN l.quality = 1 THEN 'agent' ELSE 'default' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def precedence_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    human = labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("label"))
    agent = labels.where("quality = 1").select("doc_id", F.lit("good").alias("label"))
    return J.precedence(table(spark, sf_dir, "documents").select("doc_id"), [("human", human), ("agent", agent)], ["doc_id"], "label", "unknown")


@query(f"""WITH b AS (SELECT l_orderkey AS frame, l_linenumber AS k, l_suppkey AS s, l_quantity AS x1, l_quantity + 20 AS x2 FROM lineitem),
o AS (SELECT frame, s AS old_track, x1 AS a1, x2 AS a2 FROM b WHERE k = 1), n AS (SELECT frame, s AS new_track, x1 AS b1, x2 AS b2 FROM b WHERE k = 2),
i AS (SELECT old_track, new_track, greatest(0, least(a2, b2) - greatest(a1, b1)) AS i FROM o JOIN n USING (frame))
SELECT old_track, new_track, count(*) AS shared, round(avg(i / (40 - i)), 6) AS mean_iou FROM i GROUP BY old_track, new_track""")
def track_similarity(spark, sf_dir):
    """Suppliers of first lines against suppliers of second lines, with the order as frame."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_linenumber", "l_suppkey", F.col("l_quantity").alias("x1"))
    old = b.where("l_linenumber = 1").select("frame", F.col("l_suppkey").alias("old_track"), F.col("x1").alias("a1"))
    new = b.where("l_linenumber = 2").select("frame", F.col("l_suppkey").alias("new_track"), F.col("x1").alias("b1"))
    iou = G.box_iou([F.col("a1"), F.lit(0.0), F.col("a1") + 20, F.lit(1.0)], [F.col("b1"), F.lit(0.0), F.col("b1") + 20, F.lit(1.0)])
    return J.track_similarity(old, new, ["frame"], "old_track", "new_track", iou).withColumn("mean_iou", F.round("mean_iou", 6))


@query("""WITH b AS (SELECT l_orderkey AS frame, l_linenumber AS k, l_suppkey AS s, l_quantity AS x1, l_quantity + 20 AS x2 FROM lineitem),
o AS (SELECT frame, s AS old_track, x1 AS a1, x2 AS a2 FROM b WHERE k = 1), n AS (SELECT frame, s AS new_track, x1 AS b1, x2 AS b2 FROM b WHERE k = 2),
i AS (SELECT old_track, new_track, greatest(0, least(a2, b2) - greatest(a1, b1)) AS i FROM o JOIN n USING (frame))
SELECT old_track, new_track, count(*) AS shared, round(avg(i / (40 - i)), 6) AS mean_iou FROM i GROUP BY old_track, new_track""")
def track_similarity_all(spark, sf_dir):
    """The same, under the name that it had when ``track_similarity`` took a part of the orders."""
    return track_similarity(spark, sf_dir)


@query("""SELECT coalesce(o.o_orderkey, l.l_orderkey) AS k, o.o_orderkey IS NOT NULL AND l.l_orderkey IS NOT NULL AS aligned FROM
(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey""")
def aligned_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return J.by_position(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), "k")


# -------------------------------------------------------------- aggregates


@query(f"""WITH e AS ({_EV}), m AS (SELECT user_id, event_type, median(value) AS md, count(value) AS observations, count(DISTINCT hour) AS frames FROM e GROUP BY ALL)
SELECT user_id, event_type, round(any_value(md), 6) AS median, round(median(abs(value - md)), 6) AS mad, any_value(observations) AS observations, any_value(frames) AS frames
FROM e JOIN m USING (user_id, event_type) GROUP BY user_id, event_type""")
def robust_anchor(spark, sf_dir):
    a = A.robust_anchor(_events(spark, sf_dir), ["user_id", "event_type"], "value", "hour")
    return a.select("user_id", "event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "observations", "frames")


@query(f"""WITH e AS ({_EV}), v AS (SELECT user_id, CASE WHEN value > 50 THEN 1 ELSE -1 END AS side, 0.5 + 0.5 * (value % 1) AS w FROM e),
g AS (SELECT user_id, sum(CASE WHEN side = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN side = -1 THEN w ELSE 0 END) AS m, count(*) FILTER (side = 1) AS np, count(*) FILTER (side = -1) AS nm FROM v GROUP BY user_id)
SELECT user_id, round(greatest(p, m) / (p + m), 6) AS confidence, round(abs(p - m) / (p + m), 6) AS margin, CASE WHEN np + nm < 2 THEN 'insufficient'
  WHEN greatest(p, m) / (p + m) >= 0.75 AND CASE WHEN p > m THEN np ELSE nm END >= 2 THEN 'calibrated' ELSE 'conflicting' END AS status,
CASE WHEN np + nm >= 2 AND greatest(p, m) / (p + m) >= 0.75 AND CASE WHEN p > m THEN np ELSE nm END >= 2 THEN CASE WHEN p > m THEN 1 ELSE -1 END END AS direction FROM g""")
def weighted_vote(spark, sf_dir):
    e = _events(spark, sf_dir)
    v = A.two_way_vote(e, ["user_id"], F.when(F.col("value") > 50, 1).otherwise(-1), 0.5 + 0.5 * (F.col("value") % 1), 2, 0.75)
    return v.select("user_id", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "status", "direction")


@query(f"""WITH e AS ({_EV}), c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY ALL)
SELECT user_id, arg_max(event_type, (n, -f)) AS majority, max(n) AS votes, sum(n)::BIGINT AS total FROM c GROUP BY user_id""")
def first_seen_majority(spark, sf_dir):
    return A.first_seen_majority(_events(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query(f"""WITH e AS ({_EV}), c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT user_id, max(n) AS b FROM c GROUP BY user_id)
SELECT user_id, min(event_type) AS mode FROM c JOIN m USING (user_id) WHERE n = b GROUP BY user_id""")
def smallest_mode(spark, sf_dir):
    return A.smallest_mode(_events(spark, sf_dir), ["user_id"], "event_type")


_VOCAB = ["view", "click", "purchase", "signup", "error"]


@query(f"""WITH e AS (SELECT *, t // 86400 AS day FROM ({_EV})), c AS (SELECT user_id, day, event_type, count(*) AS n, list_position({_VOCAB}, event_type) AS r FROM e GROUP BY ALL),
m AS (SELECT user_id, day, arg_max(event_type, (n, -r)) AS majority, max(n) AS votes FROM c GROUP BY ALL), s AS (SELECT user_id, day, count(*) AS rows, (min(t) + max(t)) / 2 AS middle FROM e GROUP BY ALL)
SELECT user_id, day, any_value(majority) AS majority, any_value(votes) AS votes, any_value(rows) AS rows, round(avg(value), 6) AS confidence, arg_min(t, (-value, abs(t - middle), t)) AS representative, round(any_value(votes / rows), 6) AS agreement
FROM e JOIN m USING (user_id, day) JOIN s USING (user_id, day) WHERE event_type = majority GROUP BY user_id, day""")
def window_summary(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    w = A.window_summary(e, ["user_id", "day"], "event_type", "value", "t", _VOCAB)
    return w.select("user_id", "day", "majority", "votes", "rows", F.round("confidence", 6).alias("confidence"), "representative", F.round("agreement", 6).alias("agreement"))


@query(f"""WITH e AS (SELECT *, t // 86400 AS day FROM ({_EV})), c AS (SELECT event_type, value, CASE WHEN event_id % 50 > 0 THEN value END AS v, user_id FROM e)
SELECT user_id, round(CASE WHEN count(v) = count(*) THEN min(v) END, 6) AS least, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS mean, list_sort(list(DISTINCT event_type)) AS kinds, bool_and(value > 5) AS usable FROM c GROUP BY user_id""")
def direction_evidence(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 50 > 0, F.col("value")))
    return e.groupBy("user_id").agg(F.round(A.complete_minimum("v"), 6).alias("least"), F.round(A.complete_mean("v"), 6).alias("mean"), A.distinct_sorted("event_type").alias("kinds"), F.bool_and(F.col("value") > 5).alias("usable"))


_DET = f"SELECT event_type AS clip, t // 86400 AS frame, user_id AS track FROM ({_EV}) WHERE value >= 30"


@query(f"""WITH d AS ({_DET}), f AS (SELECT DISTINCT c.clip, g.frame FROM (SELECT DISTINCT clip FROM d) c, (SELECT DISTINCT t // 86400 AS frame FROM ({_EV})) g),
p AS (SELECT clip, frame, count(*) AS n, list(DISTINCT track) AS ids FROM d GROUP BY ALL), s AS (SELECT f.clip, f.frame, coalesce(n, 0) AS n, coalesce(ids, []) AS ids FROM f LEFT JOIN p USING (clip, frame)),
l AS (SELECT *, lag(ids) OVER (PARTITION BY clip ORDER BY frame) AS before FROM s), k AS (SELECT clip, track, count(DISTINCT frame) AS len FROM d GROUP BY ALL),
a AS (SELECT clip, count(*) AS frames, sum(n)::BIGINT AS detections, round(avg(n), 6) AS mean_per_frame, median(n) AS median_per_frame, round(avg((n = 0)::INT), 6) AS empty_rate, round(avg((n BETWEEN 6 AND 22)::INT), 6) AS plausible_rate,
 round(sum(len(list_intersect(before, ids))) FILTER (len(before) > 0) / sum(len(before)), 6) AS retention FROM l GROUP BY clip),
b AS (SELECT clip, count(*) AS tracks, median(len) AS median_track_length, round(avg((len < 5)::INT), 6) AS short_rate FROM k GROUP BY clip) SELECT * FROM a JOIN b USING (clip)""")
def continuity(spark, sf_dir):
    e = _events(spark, sf_dir)
    d = e.where("value >= 30").select(F.col("event_type").alias("clip"), F.floor(F.col("t") / 86400).alias("frame"), F.col("user_id").alias("track"))
    frames = d.select("clip").distinct().crossJoin(F.broadcast(e.select(F.floor(F.col("t") / 86400).alias("frame")).distinct()))
    c = A.continuity(d, frames, "clip", "frame", "track")
    return c.withColumns({x: F.round(x, 6) for x in ("mean_per_frame", "empty_rate", "plausible_rate", "retention", "short_rate")})


@query("""WITH r AS (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rn FROM documents d JOIN labels l USING (doc_id))
SELECT source, k, count(*) AS n, round(avg((quality = 1)::INT), 6) AS precision FROM r, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rn <= k GROUP BY source, k""")
def precision_at_k(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    p = A.precision_at(j, ["source"], [F.desc("n_chars"), F.asc("doc_id")], "good", [1, 3, 5, 10])
    return p.withColumn("precision", F.round("precision", 6))


_GUESS = "SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS guess, (n_chars % 101) / 100.0::DOUBLE AS confidence FROM documents WHERE lang <> 'es'"


def _guesses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang <> 'es'")
    return d.select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("guess"), (F.col("n_chars") % 101 / 100.0).alias("confidence"))


@query(f"""WITH g AS ({_GUESS}) SELECT l.quality::VARCHAR AS actual, coalesce(g.guess::VARCHAR, 'missing') AS predicted, count(*) AS n FROM labels l LEFT JOIN g USING (doc_id) GROUP BY ALL""")
def confusion(spark, sf_dir):
    return A.confusion(table(spark, sf_dir, "labels").join(_guesses(spark, sf_dir), "doc_id", "left"), "quality", "guess")


@query(f"""WITH g AS ({_GUESS}), j AS (SELECT *, coalesce(confidence >= 0.5, false) AS sure, coalesce(quality = guess, false) AS ok FROM labels LEFT JOIN g USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (sure) AS covered, round(avg(sure::INT), 6) AS coverage, round(count(*) FILTER (sure AND ok) / count(*) FILTER (sure), 6) AS covered_accuracy, round(avg(ok::INT), 6) AS accuracy FROM j""")
def coverage_accuracy(spark, sf_dir):
    c = A.coverage_accuracy(table(spark, sf_dir, "labels"), _guesses(spark, sf_dir), ["doc_id"], "quality", "guess", "confidence", 0.5)
    return c.withColumns({x: F.round(x, 6) for x in ("coverage", "covered_accuracy", "accuracy")})


@query(f"""WITH g AS ({_GUESS}), j AS (SELECT *, floor(confidence * 10)::INT AS bin, quality = guess AS ok FROM labels JOIN g USING (doc_id)), a AS (SELECT count(*) AS total FROM j)
SELECT bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(ok::INT), 6) AS accuracy, round(abs(avg(confidence) - avg(ok::INT)) * count(*) / any_value(total), 6) AS gap FROM j, a WHERE bin BETWEEN 0 AND 9 GROUP BY bin""")
def ece(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(_guesses(spark, sf_dir), "doc_id")
    e = A.calibration_error(j, "confidence", F.col("quality") == F.col("guess"))
    return e.withColumns({x: F.round(x, 6) for x in ("confidence", "accuracy", "gap")})


@query("""WITH f AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, median(x) AS m FROM f GROUP BY ALL)
SELECT label, list_transform(list(m ORDER BY dim), lambda v: round(v / sqrt(list_sum(list_transform(list(m ORDER BY dim), lambda u: u * u))), 6)) AS vector FROM m GROUP BY label""")
def vector_median(spark, sf_dir):
    v = A.vector_median(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return v.select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("""WITH f AS (SELECT unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT dim, median(x) AS c FROM f GROUP BY dim)
SELECT dim, round(any_value(c), 6) AS centre, round(1.4826 * median(abs(x - c)), 6) AS scale FROM f JOIN c USING (dim) GROUP BY dim""")
def robust_scale(spark, sf_dir):
    s = A.robust_scale(table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    return s.select("dim", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


@query(f"""WITH e AS ({_EV}), m AS (SELECT event_type, median(value) AS md FROM e GROUP BY 1), s AS (SELECT event_type, any_value(md) AS md, 1.4826 * median(abs(value - md)) AS s FROM e JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, round(greatest(18.0, md + 4 * greatest(1.0, s)), 6) AS limit_value, round((SELECT greatest(quantile_cont(value, 0.9) * 1.15, max(value) FILTER (event_id % 10 = 0) * 1.05) FROM e WHERE e.event_type = s.event_type), 4) AS radius FROM s""")
def robust_outliers(spark, sf_dir):
    e = _events(spark, sf_dir)
    limits = A.outlier_limit(e, ["event_type"], "value").select("event_type", F.round("limit", 6).alias("limit_value"))
    return limits.join(A.acceptance_radius(e, ["event_type"], "value", F.col("event_id") % 10 == 0), "event_type").withColumn("radius", F.round("radius", 4))


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round((1.0 / n) / avg(1.0 / n) OVER (), 6) AS weight FROM n""")
def class_weights(spark, sf_dir):
    return A.class_weights(table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query(f"""WITH e AS ({_EV}) SELECT user_id, round(ln(1 + count(*)) * sqrt(max(value)) * avg(value) / 100, 6) AS quality FROM e GROUP BY user_id""")
def track_quality(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.round(A.track_quality(F.count("*"), F.max("value"), F.avg("value") / 100), 6).alias("quality"))


@query("""WITH m AS (SELECT o_orderpriority, o_orderstatus, count(*) FILTER (l_returnflag = 'A') AS tp, count(*) FILTER (l_returnflag = 'N') AS fp, count(*) FILTER (l_returnflag = 'R') AS fn FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT o_orderpriority, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m GROUP BY 1)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def detection_scores(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flags = {c: (F.col("l_returnflag") == v).cast("long") for c, v in (("tp", "A"), ("fp", "N"), ("fn", "R"))}
    s = A.detection_scores(j.withColumns(flags), ["o_orderpriority"])
    return s.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query("""WITH f AS (SELECT l_orderkey, coalesce(max((l_returnflag = 'A' AND l_quantity > 40)::INT), 0) AS a, max((l_returnflag = 'A')::INT) AS b, max((l_returnflag = 'R')::INT) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN a = 1 THEN 'high_press_wing' WHEN b = 1 THEN 'high_press_central' WHEN c = 1 THEN 'medium_press' END AS label FROM f WHERE a + b + c > 0""")
def chain_classify(spark, sf_dir):
    flag = F.col("l_returnflag")
    return A.chain_class(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [("high_press_wing", (flag == "A") & (F.col("l_quantity") > 40)), ("high_press_central", flag == "A"), ("medium_press", flag == "R")])


@query("""SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg((o_orderstatus = 'F')::INT), 6) AS agreement, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1""")
def catalogue_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(A.share(F.col("o_orderstatus") == "F"), 6).alias("agreement"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


# --------------------------------------------------------- selection and sets


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem WHERE l_quantity >= 4) WHERE rank <= 5""")
def topn_per_label(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 4").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return S.top_per(li, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5).drop("l_extendedprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""")
def global_top(spark, sf_dir):
    return S.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 30)


@query("""SELECT l_orderkey, arg_max(l_linenumber, (l_returnflag = 'A', l_tax > 0.04, l_quantity, -l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey""")
def representative_row(spark, sf_dir):
    return S.representative(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "A", F.col("l_tax") > 0.04, F.col("l_quantity"), -F.col("l_linenumber"))


@query("""SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 7)::INT AS shard FROM orders""")
def round_robin(spark, sf_dir):
    return S.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("""WITH u AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 250000) SELECT k FROM u""")
def set_targets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return a.union(table(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_custkey")).distinct()


@query("""SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%'""")
def set_contested(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderpriority like '1%'").select("o_custkey").intersect(o.where("o_orderpriority like '5%'").select("o_custkey"))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def set_missing(spark, sf_dir):
    return J.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'""")
def append_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return S.append_absent(c.where("c_acctbal >= 0").select("c_custkey", "c_name"), c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("new").alias("c_name")), ["c_custkey"])


@query("""SELECT doc_id, c::INT AS copy FROM labels, (SELECT unnest([1, 2, 3]) AS c) WHERE quality = 0""")
def oversample(spark, sf_dir):
    return S.repeated(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), 3)


@query(f"""WITH e AS ({_EV}) SELECT user_id, event_type, arg_max(value, (t, event_id)) AS value, arg_max(event_id, (t, event_id)) AS event_id FROM e GROUP BY ALL""")
def last_row_wins(spark, sf_dir):
    return last_wins(_events(spark, sf_dir), ["user_id", "event_type"], [F.col("t"), F.col("event_id")]).select("user_id", "event_type", "value", "event_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en') WHERE r <= 3""")
def capped_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("source", "doc_id", "n_chars")
    return S.top_per(d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "doc_id")


@query()
def balanced_quota(spark, sf_dir):
    """Twenty documents, near-equally many for each of three languages' length scores."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("a", "b", "c")])).alias("query_id"), "n_chars")
    score = F.pmod(F.xxhash64("doc_id", "query_id"), F.lit(1000)) / 1000.0
    return S.balanced_quota(d.withColumn("score", score), "doc_id", "query_id", "score", 20, ["a", "b", "c"])


@query()
def unique_top_per_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("a", "b", "c")])).alias("cls"))
    return S.unique_top(d.withColumn("score", F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0), "doc_id", "cls", "score", 5)


@query()
def flow_assign(spark, sf_dir):
    """Suppliers to three labels, at most ten each, by the greatest total score."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(x) for x in ("a", "b", "c")])).alias("label"))
    return S.assign(s.withColumn("score", F.pmod(F.xxhash64("s_suppkey", "label"), F.lit(1000)) / 1000.0), "s_suppkey", "label", "score", 10)


@query()
def stratified_sample(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 5)


@query("""WITH c AS (SELECT o_custkey, count(*) AS h FROM orders WHERE o_totalprice > 300000 GROUP BY 1), f AS (SELECT o.*, coalesce(h, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders o LEFT JOIN c USING (o_custkey) WHERE NOT o_totalprice > 300000)
SELECT o_orderkey, o_custkey, o_totalprice FROM f ORDER BY turn, o_totalprice DESC, o_orderkey LIMIT 25""")
def diversity_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.fill_by_diversity(o, o.where("o_totalprice > 300000"), "o_orderkey", "o_custkey", "o_totalprice", 25)
