"""Vector, graph and rule queries; an order's lines are a frame's players, their status the team."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numbers import rounded
from ..operators import graphs as G
from ..operators import rules as R
from ..sources.tables import place, table
from .registry import query
from .relational import _PL, players

_D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"


@query(f"""WITH p AS ({_PL}), d AS (SELECT a.frame, a.player AS i, b.player AS j, {_D} AS d, row_number() OVER (PARTITION BY a.frame, a.player ORDER BY {_D}, b.player) AS r FROM p a JOIN p b ON a.frame = b.frame AND a.team = b.team AND a.player <> b.player)
SELECT DISTINCT frame, least(i, j) AS a, greatest(i, j) AS b FROM d WHERE r <= 2 AND d <= 22""")
def knn_edges(spark, sf_dir):
    return G.neighbour_edges(players(spark, sf_dir), ["frame"], "player", "x", "y", "team").select("frame", "a", "b").distinct()


@query(f"""WITH p AS ({_PL}) SELECT a.frame, a.player AS a, b.player AS b, round({_D}, 6) AS distance FROM p a JOIN p b ON a.frame = b.frame AND a.team <> b.team AND a.player < b.player WHERE {_D} <= 12""")
def pressure_edges(spark, sf_dir):
    return G.pressure_edges(players(spark, sf_dir), ["frame"], "player", "x", "y", "team").withColumn("distance", F.round("distance", 6))


@query()
def spanning_tree(spark, sf_dir):
    return G.spanning_tree(players(spark, sf_dir), ["frame"], "player", "x", "y")


_DOTS = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query("WITH d AS (SELECT a.label, a.vec_id, round(sum(1 - " + _DOTS.format(a="a.embedding", b="b.embedding") + "), 6) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY ALL) SELECT label, arg_min(vec_id, (d, vec_id)) AS medoid, min(d) AS total_distance FROM d GROUP BY label")
def medoid(spark, sf_dir):
    m = G.medoid_by_sum(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return m.withColumn("total_distance", F.round("total_distance", 6))


_PROTO = "p AS (SELECT label, embedding AS proto FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)), d AS (SELECT e.vec_id, p.label, round(1 - " + _DOTS.format(a="e.embedding", b="p.proto") + ", 9) AS d FROM embeddings e, p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d)"


def _prototypes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("proto"))


@query(f"""WITH {_PROTO} SELECT a.vec_id, a.label, round(a.d, 6) AS distance, round((b.d - a.d) / greatest(b.d, 1e-8), 6) AS margin FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2""")
def prototype_classify(spark, sf_dir):
    c = G.nearest_prototype(table(spark, sf_dir, "embeddings"), _prototypes(spark, sf_dir), "vec_id", "embedding", "label", "proto")
    return c.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {_PROTO}, o AS (SELECT e.vec_id, min(round(1 - {_DOTS.format(a='e.embedding', b='x.embedding')}, 9)) AS od FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id IN (101, 102, 103)) x GROUP BY 1)
SELECT r.vec_id, round(od, 6) AS other_distance, od <= d AS veto FROM r JOIN o USING (vec_id) WHERE r = 1""")
def other_veto(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = G.nearest_prototype(e, _prototypes(spark, sf_dir), "vec_id", "embedding", "label", "proto").join(e.select("vec_id", "embedding"), "vec_id")
    others = e.where(F.col("vec_id").isin(101, 102, 103)).select(F.col("embedding").alias("other"))
    return G.vetoed(c, others, "vec_id", "embedding", "other").select("vec_id", F.round("other_distance", 6).alias("other_distance"), "veto")


@query("""WITH f AS (SELECT vec_id, list_concat(list_transform(embedding[1:32], lambda x: x::DOUBLE * sqrt(0.7)), list_transform(embedding[33:64], lambda x: x::DOUBLE * sqrt(0.3))) AS v FROM embeddings)
SELECT vec_id, len(v)::INT AS dims, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS energy, round(0.7 * (1 - v[1]) + 0.3 * (1 - v[2]), 6) AS blended FROM f""")
def fused_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    f = e.select("vec_id", V.fused([(0.7, F.slice("embedding", 1, 32)), (0.3, F.slice("embedding", 33, 32))]).alias("v"))
    return f.select("vec_id", F.size("v").alias("dims"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("energy"), F.round(V.two_signal_distance(F.col("v")[0], F.col("v")[1]), 6).alias("blended"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3 + 0.01) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM u""")
def unit_vectors(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.transform("embedding", lambda x: x.cast("double") * 3 + 0.01)).alias("v"))
    return u.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


_BALL = f"WITH p AS (SELECT l.*, o_totalprice % 105 - 52.5 AS bx, o_totalprice % 68 - 34 AS by_ FROM ({_PL}) l JOIN orders ON frame = o_orderkey), d AS (SELECT *, sqrt((x - bx) ** 2 + (y - by_) ** 2) AS d FROM p), h AS (SELECT frame, count(*) AS n, min(d) AS hd, arg_min(team, (d, player)) AS ht, arg_min(player, (d, player)) AS holder, any_value(abs(by_)) AS off FROM d GROUP BY frame)"


def _with_ball(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_totalprice") % 105 - 52.5).alias("bx"), (F.col("o_totalprice") % 68 - 34).alias("by_"))
    return players(spark, sf_dir, place().alias("place")).join(o, "frame")  # an order may have two lines of one number


@query(_BALL + ", q AS (SELECT frame, min(d) AS od FROM d JOIN h USING (frame) WHERE team <> ht GROUP BY frame) SELECT h.frame, holder, ht AS holder_team, round(hd, 6) AS holder_distance, round(od, 6) AS opponent_distance FROM h LEFT JOIN q USING (frame)")
def ball_holder(spark, sf_dir):
    distance = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by_"), 2))
    h = G.holder(_with_ball(spark, sf_dir), ["frame"], distance, "team", "player", "place")
    return h.select("frame", "holder", "holder_team", rounded("holder_distance", 6).alias("holder_distance"), rounded("opponent_distance", 6).alias("opponent_distance"))


@query(
    _BALL
    + """, f AS (SELECT frame, count(*) FILTER (d <= 8) AS w8, count(*) FILTER (d <= 12) AS w12, count(*) FILTER (d <= 16) AS w16, count(*) AS nd, min(d) AS near, max(y) - min(y) AS w, max(x) - min(x) AS h FROM d JOIN h USING (frame) WHERE team <> ht GROUP BY frame),
j AS (SELECT h.frame, n, hd, off, coalesce(w8, 0) AS w8, coalesce(w12, 0) AS w12, coalesce(w16, 0) AS w16, coalesce(nd, 0) AS nd, near, CASE WHEN nd >= 3 THEN w ELSE 99 END AS w, CASE WHEN nd >= 3 THEN f.h ELSE 99 END AS dp,
 greatest(0, least(1, 0.72 - hd / 12 + coalesce(near - hd, 0) / 12)) AS ps FROM h LEFT JOIN f USING (frame)),
r AS (SELECT *, CASE WHEN off >= 24 AND w12 >= 2 THEN 'touchline_trap' WHEN w16 >= 3 AND w8 >= 2 THEN 'intense_pressure' WHEN off <= 11.5 AND w16 >= 2 THEN 'central_block' WHEN nd >= 4 AND w <= 36 AND dp <= 30 THEN 'compact_block' WHEN nd = 0 OR near > 14 THEN 'low_pressure' ELSE 'unstructured' END AS lab,
 CASE WHEN off >= 24 AND w12 >= 2 THEN least(0.94, 0.58 + 0.09 * w12 + 0.08 * (off - 24) / 10) WHEN w16 >= 3 AND w8 >= 2 THEN least(0.92, 0.56 + 0.07 * w16 + 0.06 * w8) WHEN off <= 11.5 AND w16 >= 2 THEN least(0.88, 0.55 + 0.07 * w16)
 WHEN nd >= 4 AND w <= 36 AND dp <= 30 THEN least(0.84, 0.55 + (36 - w) / 100 + (30 - dp) / 100) WHEN nd = 0 THEN 0.58 WHEN near > 14 THEN least(0.88, 0.58 + (near - 14) / 40) ELSE 0.48 END AS cf FROM j)
SELECT frame, CASE WHEN n < 4 OR hd > 7 OR ps < 0.32 THEN 'abstain' ELSE lab END AS label, round(CASE WHEN n < 4 THEN 0 WHEN hd > 7 OR ps < 0.32 THEN ps ELSE cf * ps END, 6) AS confidence FROM r"""
)
def shape_rules(spark, sf_dir):
    s = R.shape_patterns(_with_ball(spark, sf_dir), ["frame"], "x", "y", "bx", "by_", "team", "player", "place")
    return s.select("frame", "label", F.round("confidence", 6).alias("confidence"))


_W = """WITH p AS (SELECT l_orderkey AS frame, l_quantity / 50 AS x, (l_extendedprice % 68) / 68 AS y, l_discount - 0.05 AS vx, l_tax - 0.04 AS vy, (o_totalprice % 100) / 100 AS bx, (o_totalprice % 77) / 77 AS by_, o_orderkey % 5 > 0 AS poss, o_orderkey % 3 > 0 AS tr FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT *, sqrt(((bx - x) * 105) ** 2 + ((by_ - y) * 68) ** 2) AS d FROM p), v AS (SELECT *, (vx * 105 * (bx - x) * 105 + vy * 68 * (by_ - y) * 68) / greatest(d, 1e-6) AS v FROM d),
g AS (SELECT frame, any_value(bx) AS bx, any_value(by_) AS by_, any_value(poss) AS poss, any_value(tr) AS tr, count(*) FILTER (d < 8) AS w8, count(*) FILTER (d < 12) AS w12, count(*) FILTER (d < 16) AS w16, min(d) AS near, round(list_avg(list_sort(list(d))[1:3]), 6) AS mean_three, round(max(v), 6) AS approach,
 count(*) FILTER (v > 0.7) AS ap, count(*) FILTER (x > bx AND abs(y - 0.5) < 0.14 AND x < bx + 0.32) AS sc, count(*) FILTER (d < 12 AND y > by_ + 0.025) AS il, count(*) FILTER (d < 12 AND y < by_ - 0.025) AS ir FROM v GROUP BY frame),
r AS (SELECT *, CASE WHEN NOT poss THEN 'abstain_possession' WHEN by_ < 0.22 AND w12 >= 2 AND il >= 2 THEN 'trap_left' WHEN by_ > 0.78 AND w12 >= 2 AND ir >= 2 THEN 'trap_right' WHEN bx < 0.48 AND w16 >= 3 AND (ap >= 1 OR w8 >= 2) THEN 'high_press'
 WHEN bx < 0.6 AND sc >= 2 AND w16 >= 2 THEN 'central_screen' WHEN w12 = 0 AND near > 14 THEN 'unstructured' ELSE 'abstain_ambiguous' END AS lab FROM g)"""


@query(
    _W
    + """, c AS (SELECT *, CASE WHEN lab IN ('trap_left', 'trap_right', 'high_press', 'central_screen') AND NOT tr THEN 'abstain_direction' ELSE lab END AS label FROM r)
SELECT frame, label, round(CASE label WHEN 'trap_left' THEN least(0.95, 0.62 + 0.08 * il + 0.06 * (0.22 - by_) / 0.22) WHEN 'trap_right' THEN least(0.95, 0.62 + 0.08 * ir + 0.06 * (by_ - 0.78) / 0.22) WHEN 'high_press' THEN least(0.92, 0.58 + 0.06 * w16 + 0.04 * ap)
WHEN 'central_screen' THEN least(0.9, 0.58 + 0.07 * sc) WHEN 'unstructured' THEN least(0.9, 0.62 + 0.02 * (near - 14)) ELSE 0 END, 6) AS confidence, mean_three, approach FROM c"""
)
def rule_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    p = li.join(o, F.col("l_orderkey") == k).select(
        F.col("l_orderkey").alias("frame"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") % 68 / 68).alias("y"), (F.col("l_discount") - 0.05).alias("vx"), (F.col("l_tax") - 0.04).alias("vy"),
        (F.col("o_totalprice") % 100 / 100).alias("bx"), (F.col("o_totalprice") % 77 / 77).alias("by_"),
    )
    d = R.pressure_descriptors(p, ["frame"], "x", "y", "vx", "vy", "bx", "by_")
    w = R.weak_labels(d, F.col("frame") % 5 > 0, F.col("frame") % 3 > 0)
    return w.select("frame", "label", *[F.round(c, 6).alias(c) for c in ("confidence", "mean_three", "approach")])


@query("""WITH g AS (SELECT c_custkey, list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'balance' END, CASE WHEN NOT c_custkey % 3 > 0 THEN 'key' END, CASE WHEN NOT c_mktsegment <> 'BUILDING' THEN 'segment' END], lambda x: x IS NOT NULL) AS failed FROM customer)
SELECT c_custkey, array_to_string(failed, ',') AS failed, len(failed) = 0 AS accepted FROM g""")
def gate_report(spark, sf_dir):
    failed, ok = R.gates({"balance": F.col("c_acctbal") > 0, "key": F.col("c_custkey") % 3 > 0, "segment": F.col("c_mktsegment") != "BUILDING"})
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(failed, ",").alias("failed"), ok.alias("accepted"))


@query("""SELECT l_orderkey, l_linenumber, (l_tax * 100 + 8 < l_quantity) AND (l_tax * 100 < 0.6 * l_quantity) AS outlier FROM lineitem""")
def colour_outliers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.colour_outlier(F.col("l_quantity"), F.col("l_tax") * 100).alias("outlier"))


@query()
def kmeans_teams(spark, sf_dir):
    from ..operators.models import two_clusters

    return two_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", weight=None, seed=7)


@query()
def logistic_teams(spark, sf_dir):
    from ..operators.models import logistic

    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") >= 5).cast("double"))
    return logistic(e, "vec_id", "embedding", "y")


@query()
def forest_roles(spark, sf_dir):
    from ..operators.models import forest

    return forest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", seed=7)
