"""Queries of review rows, configurations, reports and the expressions that draw and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import vectors as U
from ..operators import reviews as V
from ..operators import sequences as Q
from ..sources.tables import table
from .registry import query


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS half, o_totalprice % 1000 AS s, CASE o_orderstatus WHEN 'P' THEN 'none' ELSE (o_totalprice / 1000)::VARCHAR END AS score, o_orderpriority AS provenance FROM orders),
c AS (SELECT *, s + CASE WHEN half = 2 THEN 2700 ELSE 0 END AS a, s + 4 + CASE WHEN half = 2 THEN 2700 ELSE 0 END AS b FROM r)
SELECT o_orderkey, half, lpad(floor(a / 60)::INT::VARCHAR, 2, '0') AS minute, lpad(floor(b / 60)::INT::VARCHAR, 2, '0') AS end_minute, round(TRY_CAST(score AS DOUBLE), 6) AS retrieval_score, provenance, CASE WHEN score = 'none' THEN 'score is not numeric' END AS problem FROM c""")
def review_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderstatus") == "P", "none").otherwise((F.col("o_totalprice") / 1000).cast("string"))
    start = F.col("o_totalprice") % 1000
    r = V.review_row(o, "o_orderkey", F.when(F.col("o_orderstatus") == "F", 2).otherwise(1), start, start + 4, score, F.col("o_orderpriority"))
    minute = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    return r.select("o_orderkey", "half", minute("clock_start").alias("minute"), minute("clock_end").alias("end_minute"), F.round("retrieval_score", 6).alias("retrieval_score"), "provenance", "problem")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'no balance' WHEN c_mktsegment = 'BUILDING' THEN 'no segment' END AS reason, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'excluded' ELSE 'accepted' END AS status FROM customer""")
def collected_rows(spark, sf_dir):
    """A bad row stays as an excluded one; a bad configuration (none here) would fail the query."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    fatal = F.when(F.col("c_custkey").isNull(), "no key")
    excluded = F.when(F.col("c_acctbal") < 0, "no balance").when(F.col("c_mktsegment") == "BUILDING", "no segment")
    return V.collected(c, fatal, excluded).select("c_custkey", "reason", "status")


@query("""SELECT n_nationkey, 'reviewed' AS mapping_status, trim(r_name) AS left_name, trim(n_name) AS right_name, CASE WHEN n_regionkey = 4 THEN 'same club' WHEN n_regionkey = 3 THEN 'empty name' END AS problem, n_regionkey NOT IN (3, 4) AS mapped
FROM (SELECT n_nationkey, n_regionkey, r_name, CASE n_regionkey WHEN 4 THEN lower(r_name) || ' ' WHEN 3 THEN ' ' ELSE n_name END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
UNION ALL SELECT n_nationkey, 'unreviewed', 'left', 'right', NULL, false FROM nation""")
def team_configs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    other = F.when(F.col("n_regionkey") == 4, F.concat(F.lower("r_name"), F.lit(" "))).when(F.col("n_regionkey") == 3, " ").otherwise(F.col("n_name"))
    both = V.explicit_config(n, "n_nationkey", F.col("r_name"), other).union(V.neutral_config(n, "n_nationkey"))
    return both.select("n_nationkey", "mapping_status", "left_name", "right_name", "problem", (V.bijection(F.col("clusters")) & F.col("problem").isNull()).alias("mapped"))


@query("""SELECT event_id, 'unknown' AS label, true AS abstain, 0 AS consistent_crop_count, 'Persistent validation failure: ' || event_type AS evidence FROM events WHERE event_type = 'error'""")
def abstentions(spark, sf_dir):
    a = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", V.abstention(F.col("event_type")).alias("a"))
    return a.select("event_id", "a.label", "a.abstain", "a.consistent_crop_count", F.col("a.contradicting_evidence")[0].alias("evidence"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'label is not allowed' WHEN (l_returnflag = 'N') <> (l_tax < 0.02) THEN 'abstain and label disagree'
WHEN l_tax >= 0.02 AND l_quantity < 10 THEN 'no consistent crop' WHEN l_tax >= 0.02 AND l_linestatus = 'O' THEN 'no visual cue' END AS problem FROM lineitem""")
def label_problems(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    label = F.when((flag == "N") & (F.col("l_linenumber") == 7), "referee").when(flag == "N", "unknown").otherwise(flag)
    cues = F.when(F.col("l_linestatus") == "O", F.array().cast("array<string>")).otherwise(F.array(F.lit("shirt")))
    return li.select("l_orderkey", "l_linenumber", V.label_problem(label, F.col("l_tax") < 0.02, F.floor(F.col("l_quantity") / 10), cues, ["A", "R"]).alias("problem"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE CASE WHEN l_returnflag IN ('A', 'R') THEN CASE l_returnflag WHEN 'A' THEN 'left' ELSE 'right' END END END AS team FROM lineitem""")
def internal_teams(spark, sf_dir):
    """Lines 1 and 2 have a mapped cluster; the others fall back on their side."""
    side = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "R", "right").otherwise("middle")
    clusters = F.create_map(F.lit(1), F.lit("right"), F.lit(2), F.lit("left"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.internal_team(F.col("l_linenumber"), side, clusters).alias("team"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, lag(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS b, l_suppkey AS s FROM lineitem),
m AS (SELECT a.l_orderkey, 1 - abs(a.l_quantity - b.l_quantity) / 50 AS iou FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey - 1 AND a.l_linenumber = 1 AND b.l_linenumber = 1 WHERE abs(a.l_quantity - b.l_quantity) <= 25)
SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM m) AS fp, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM m) AS fn,
round((SELECT count(*) FROM m) / (SELECT count(*) FROM lineitem), 6) AS precision, round((SELECT count(*) FROM m) / (SELECT count(*) FROM lineitem), 6) AS recall, round((SELECT count(*) FROM m) / (SELECT count(*) FROM lineitem), 6) AS f1,
round((SELECT avg(iou) FROM m), 6) AS mean_iou, (SELECT count(*) FROM t WHERE b IS NOT NULL AND b <> s) AS id_switches""")
def labelled_report(spark, sf_dir):
    """First lines of an order against those of the next order; a part's supplier is its predicted identity."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    one = li.where("l_linenumber = 1")
    pairs = one.select("frame", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa")).join(one.select((F.col("frame") - 1).alias("frame"), F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb")), "frame")
    pairs = pairs.withColumn("iou", 1 - F.abs(F.col("qa") - F.col("qb")) / 50)
    matches = pairs.where("iou >= 0.5")
    switches = Q.id_switches(li.withColumn("at", F.struct("frame", "l_linenumber")), ["l_partkey"], "at", "l_suppkey")
    r = V.labelled_report(li, li, matches, ["frame"], switches, "iou")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "mean_iou")})


@query("""WITH g AS (SELECT o_orderpriority, count(*) AS clips, avg(o_totalprice) AS f1, CASE WHEN bool_and(o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT') THEN avg(o_custkey) END AS retention FROM orders GROUP BY 1)
SELECT o_orderpriority, clips, round(f1, 4) AS f1, round(retention, 4) AS retention, row_number() OVER (ORDER BY f1 DESC NULLS LAST, retention DESC NULLS LAST, o_orderpriority)::INT AS place FROM g""")
def experiment_roll_up(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kept = F.when(~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")), F.col("o_custkey"))
    r = V.rolled_up(o.select("o_orderpriority", F.col("o_totalprice").alias("f1"), kept.alias("retention")), "o_orderpriority", ["f1", "retention"])
    return r.select("o_orderpriority", "clips", F.round("f1", 4).alias("f1"), F.round("retention", 4).alias("retention"), "place")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.04 THEN 'a' ELSE 'b' END = CASE WHEN l_tax <= 0.04 THEN 'a' ELSE 'b' END AS agree FROM lineitem""")
def signal_agreement(spark, sf_dir):
    m = lambda c: F.create_map(F.lit("b"), F.lit(0.04), F.lit("a"), F.col(c))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.signals_agree(m("l_discount"), m("l_tax")).alias("agree"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS a, (l_tax - 0.04) / 0.02 AS b FROM lineitem), s AS (SELECT *, a + 0.1 AS s1, b AS s2, -a - b AS s3 FROM z),
e AS (SELECT *, exp(s1 - greatest(s1, s2, s3)) AS e1, exp(s2 - greatest(s1, s2, s3)) AS e2, exp(s3 - greatest(s1, s2, s3)) AS e3 FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN greatest(e1, e2, e3) / (e1 + e2 + e3) < 0.5 THEN 'unknown' WHEN e1 >= e2 AND e1 >= e3 THEN 'x' WHEN e2 >= e3 THEN 'y' ELSE 'z' END AS club, round(greatest(e1, e2, e3) / (e1 + e2 + e3), 6) AS probability FROM e""")
def softmax_heads(spark, sf_dir):
    club, p = U.softmax_head([F.col("l_quantity"), F.col("l_tax")], [25.0, 0.04], [10.0, 0.02], [[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]], [0.1, 0.0, 0.0], ["x", "y", "z"], 0.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", club.alias("club"), F.round(p, 6).alias("probability"))


_POINTS = "l_orderkey, l_linenumber, l_quantity / 50 AS x, l_tax * 10 AS y, l_discount AS v, l_returnflag = 'A' AS turn, l_quantity * 2 AS x1, l_tax * 1000 AS y1, l_quantity * 2 + 30 AS x2, l_tax * 1000 + 80 AS y2"


@query(f"""WITH p AS (SELECT {_POINTS} FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN turn THEN 1 - x ELSE x END, 6) AS ax, round(CASE WHEN turn THEN -v ELSE v END, 6) AS av,
round(greatest(0, least(100, x * 100)), 6) AS dx, round(greatest(0, least(68, y * 68)), 6) AS dy, round(10 + (x * 50 - 25 + 52.5) / 105 * 780, 6) AS cx, round(10 + (y * 68 - 34 + 34) / 68 * 580, 6) AS cy,
round(x / 120 * 105, 4) AS rx, round(y / 80 * 68, 4) AS ry, greatest(0, floor(x1 + 0.16 * 30))::INT AS t1, floor(y1 + 0.55 * 80)::INT AS t4, round((x1 + x2) / 2, 6) AS foot,
CASE WHEN turn THEN 1 ELSE 2 END AS corners FROM p""")
def drawn_points(spark, sf_dir):
    """A point seen from the other direction, on a drawing, on a canvas, at another pitch size; a box's torso and foot; known corners."""
    li = table(spark, sf_dir, "lineitem")
    x, y, v, turn = F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_discount"), F.col("l_returnflag") == "A"
    box = (F.col("l_quantity") * 2, F.col("l_tax") * 1000, F.col("l_quantity") * 2 + 30, F.col("l_tax") * 1000 + 80)
    (ax, av), (dx, dy), (rx, ry) = G.realigned(x, v, turn), G.display_point(x, y), G.rescaled(x, y)
    cx, cy = G.canvas(x * 50 - 25, y * 68 - 34, 800, 600, 10)
    t, foot = G.torso(*box), G.foot_point(box[0], box[2], box[3])[0]
    known = F.size(G.corners(F.array(x, y), F.when(~turn, F.array(y, x))))
    return li.select(
        "l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in ((ax, "ax"), (av, "av"), (dx, "dx"), (dy, "dy"), (cx, "cx"), (cy, "cy"))], rx.alias("rx"), ry.alias("ry"),
        t[0].alias("t1"), t[3].alias("t4"), F.round(foot, 6).alias("foot"), known.alias("corners"),
    )


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS fingerprint FROM customer""")
def row_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.content_fingerprint("c_custkey", "c_name").alias("fingerprint"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 7 AS a, (l_tax - 0.04) / 0.02 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a / greatest(sqrt(a * a + b * b), 1e-12), 6) AS a, round(b / greatest(sqrt(a * a + b * b), 1e-12), 6) AS b FROM z""")
def robust_vectors(spark, sf_dir):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.robust_scaled(F.array("l_quantity", "l_tax"), arr(25.0, 0.04), arr(7.0, 0.02)).alias("v"))
    return v.select("l_orderkey", "l_linenumber", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("b"))
