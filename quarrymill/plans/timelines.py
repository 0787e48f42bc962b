"""Order-dependent queries: a user's events are a track, their ranks its frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as Q
from ..sources.tables import table
from .registry import query

_E = """e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events)"""


def frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(w).cast("long"))
    return e.select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "frame")


@query(f"""WITH {_E}, l AS (SELECT *, CASE WHEN event_type = 'error' THEN 'abstain' ELSE event_type END AS label FROM e),
v AS (SELECT a.event_id, any_value(a.label) AS own, b.label, count(*) AS n, min(b.frame) AS f FROM l a JOIN l b ON a.user_id = b.user_id AND b.frame BETWEEN a.frame - 6 AND a.frame + 6 WHERE b.label <> 'abstain' GROUP BY a.event_id, b.label),
s AS (SELECT event_id, any_value(own) AS own, arg_max(label, (n, -f)) AS best, max(n) AS n, sum(n) AS total FROM v GROUP BY event_id)
SELECT l.event_id, CASE WHEN l.label <> 'abstain' AND s.n / s.total >= 0.54 THEN s.best ELSE l.label END AS voted FROM l LEFT JOIN s USING (event_id)""")
def sliding_vote(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("label", F.when(F.col("event_type") == "error", "abstain").otherwise(F.col("event_type")))
    return Q.sliding_vote(f, ["user_id"], "frame", "label").select("event_id", "voted")


@query(f"""WITH {_E} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM e""")
def moving_median_rows(spark, sf_dir):
    return Q.moving_median_rows(frames(spark, sf_dir), ["user_id"], "frame", "value").select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH {_E} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING), 6) AS smoothed FROM e""")
def moving_median_range(spark, sf_dir):
    return Q.moving_median_range(frames(spark, sf_dir), ["user_id"], "t", "value", 86400).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH {_E}, k AS (SELECT *, value / 1000 AS x FROM e WHERE event_type <> 'error'), v AS (SELECT event_id, (x - lag(x) OVER w) / (frame - lag(frame) OVER w) AS v FROM k WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT event_id, round(coalesce(greatest(-0.2, least(0.2, v)), 0), 6) AS velocity FROM v""")
def velocity(spark, sf_dir):
    k = frames(spark, sf_dir).where("event_type <> 'error'").withColumn("x", F.col("value") / 1000)
    return Q.velocity(k, ["user_id"], "frame", "x").select("event_id", F.round("velocity", 6).alias("velocity"))


@query(f"""WITH {_E}, k AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS s FROM (SELECT user_id, frame, event_type FROM e WHERE event_type <> 'error'))
SELECT user_id, count(*) FILTER (s) AS switches FROM k GROUP BY user_id""")
def id_switches(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("prediction", F.when(F.col("event_type") != "error", F.col("event_type")))
    return Q.id_switches(f, ["user_id"], "frame", "prediction")


@query(f"""WITH {_E}, k AS (SELECT * FROM e WHERE event_type <> 'error'), b AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(frame) OVER w + 1 = frame THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM b)
SELECT user_id, event_type, min(frame) AS start, max(frame) AS "end", count(*) AS rows FROM i GROUP BY user_id, island, event_type HAVING count(*) >= 2""")
def islands(spark, sf_dir):
    return Q.islands(frames(spark, sf_dir).where("event_type <> 'error'"), ["user_id"], "frame", "event_type", 2)


@query(f"""WITH {_E}, k AS (SELECT * FROM e WHERE event_type <> 'error'), b AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(frame) OVER w + 1 = frame THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM b)
SELECT event_type, count(*) AS runs, round(avg(c), 6) AS confidence, max(d) AS longest FROM (SELECT event_type, avg(value) AS c, greatest(1.6, (max(frame) - min(frame) + 1) / 25.0 + 1.0) AS d FROM i GROUP BY user_id, island, event_type) GROUP BY event_type""")
def event_rows(spark, sf_dir):
    """Runs of one label as event rows: mean confidence and padded duration, summed up per label."""
    k = frames(spark, sf_dir).where("event_type <> 'error'")
    per = Q.islands(k, ["user_id"], "frame", "event_type", 1, F.avg("value").alias("c"))
    length = F.greatest(F.lit(1.6), (F.col("end") - F.col("start") + 1) / 25.0 + 1.0)
    return per.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg("c"), 6).alias("confidence"), F.max(length).alias("longest"))


@query(f"""WITH {_E}, k AS (SELECT user_id, frame, value, 0.5 + (event_id % 5) / 10 AS c FROM e WHERE event_type <> 'error'), n AS (SELECT *, lead(frame) OVER w AS nf, lead(value) OVER w AS nv, lead(c) OVER w AS nc FROM k WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
g AS (SELECT user_id, unnest(range(frame + 1, nf)) AS f, frame, nf, value, nv, c, nc FROM n WHERE nf - frame BETWEEN 2 AND 6)
SELECT user_id, frame, round(value, 6) AS value, round(c, 6) AS c, 'detected' AS method FROM k UNION ALL SELECT user_id, f, round(value + (f - frame) / (nf - frame) * (nv - value), 6), round(least(c, nc) * 0.65, 6), 'interpolated' FROM g""")
def gap_fill(spark, sf_dir):
    k = frames(spark, sf_dir).where("event_type <> 'error'").select("user_id", "frame", "value", (0.5 + F.col("event_id") % 5 / 10).alias("c"))
    return Q.bridge_gaps(k, ["user_id"], "frame", "value", "c").select("user_id", "frame", F.round("value", 6).alias("value"), F.round("c", 6).alias("c"), "method")


@query(f"""WITH {_E}, o AS (SELECT user_id, frame, CASE WHEN frame % 20 IN (0, 1, 2, 3, 9) THEN NULL WHEN frame < 4 OR frame % 50 > 30 THEN NULL ELSE value END AS v FROM e),
g AS (SELECT a.*, (SELECT max(frame) FROM o b WHERE b.user_id = a.user_id AND b.v IS NOT NULL AND b.frame <= a.frame) AS p, (SELECT min(frame) FROM o b WHERE b.user_id = a.user_id AND b.v IS NOT NULL AND b.frame >= a.frame) AS n FROM o a),
f AS (SELECT g.user_id, g.frame, g.v, CASE WHEN g.v IS NOT NULL THEN g.v WHEN n - p <= 8 THEN b.v + (g.frame - p) / (n - p) * (c.v - b.v) END AS filled FROM g LEFT JOIN o b ON b.user_id = g.user_id AND b.frame = p LEFT JOIN o c ON c.user_id = g.user_id AND c.frame = n),
h AS (SELECT a.user_id, a.frame, min((abs(b.frame - a.frame), b.frame)) AS near FROM f a JOIN f b ON a.user_id = b.user_id AND b.filled IS NOT NULL AND abs(b.frame - a.frame) <= 4 WHERE a.filled IS NULL GROUP BY ALL)
SELECT f.user_id, f.frame, round(coalesce(f.filled, x.filled), 6) AS filled, CASE WHEN f.v IS NOT NULL THEN 'observed' WHEN f.filled IS NOT NULL THEN 'interpolated' WHEN x.filled IS NOT NULL THEN 'held' END AS method
FROM f LEFT JOIN h ON h.user_id = f.user_id AND h.frame = f.frame LEFT JOIN f x ON x.user_id = f.user_id AND x.frame = near[2]""")
def interpolate_or_hold(spark, sf_dir):
    m = F.col("frame")
    gone = (m % 20).isin(0, 1, 2, 3, 9) | (m < 4) | (m % 50 > 30)
    o = frames(spark, sf_dir).select("user_id", "frame", F.when(~gone, F.col("value")).alias("v"))
    return Q.fill_or_hold(o, ["user_id"], "frame", "v").select("user_id", "frame", F.round("filled", 6).alias("filled"), "method")


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 200)::DOUBLE AS d FROM customer), w AS (SELECT c_custkey, d, unnest(range(0, 100)) AS k FROM c)
SELECT c_custkey, (8.0 + k * 15.0)::DOUBLE AS start, (8.0 + k * 15.0 + 20.0)::DOUBLE AS "end" FROM w WHERE 8.0 + k * 15.0 + 20.0 <= d""")
def scan_windows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 200).cast("double").alias("d"))
    return Q.scan_windows(c, "d", 20.0, 15.0).drop("d")


@query(f"""WITH {_E}, n AS (SELECT user_id, max(frame) AS n FROM e GROUP BY 1), s AS (SELECT user_id, n, unnest(list_distinct(list_append(range(0, greatest(0, n - 10) + 1, 4), greatest(0, n - least(10, n))))) AS start FROM n),
p AS (SELECT s.user_id, s.start, event_type, count(*) AS c, min(frame) AS f FROM s JOIN e ON e.user_id = s.user_id AND frame > s.start AND frame <= s.start + 10 GROUP BY ALL)
SELECT user_id, start::BIGINT AS start, arg_max(event_type, (c, -f)) AS label, max(c) AS votes, sum(c)::BIGINT AS rows FROM p GROUP BY user_id, start""")
def sliding_excerpts(spark, sf_dir):
    """Ten-frame windows every four frames, the last one clamped to the end, each with its majority."""
    from ..operators.aggregates import first_seen_majority
    from ..operators.joins import range_join

    f = frames(spark, sf_dir)
    n = f.groupBy("user_id").agg(F.max("frame").alias("n"))
    starts = n.select("user_id", F.explode(Q.excerpt_starts(F.col("n"), 10, 4)).alias("start")).withColumn("start", F.col("start").cast("long"))
    windows = starts.select("user_id", "start", (F.col("start") + 1).alias("first"), (F.col("start") + 11).alias("end"))
    inside = range_join(f, windows, ["user_id"], "frame", "first", "end", 10)
    return first_seen_majority(inside, ["user_id", "start"], "event_type", "frame").select("user_id", "start", F.col("majority").alias("label"), "votes", F.col("total").alias("rows"))


@query(f"""WITH {_E}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, ntile(6) OVER (PARTITION BY user_id ORDER BY frame) AS b FROM e), p AS (SELECT *, CASE WHEN n > 6 THEN b ELSE frame END AS part FROM c)
SELECT user_id, part::INT AS part, arg_min(event_id, (-value, frame)) AS event_id FROM p GROUP BY user_id, part""")
def bucket_best(spark, sf_dir):
    return Q.lifetime_best(frames(spark, sf_dir), ["user_id"], "frame", "value", 6).select("user_id", "part", "event_id")


@query(f"""WITH {_E}, r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_id, CASE WHEN r <= CASE WHEN n > 1 THEN least(25, n - 1) ELSE 1 END THEN 'seed' ELSE 'evaluation' END AS split FROM r""")
def seed_split(spark, sf_dir):
    return Q.seed_split(frames(spark, sf_dir), ["event_type"], "value", "event_id", 25).select("event_id", "split")


@query(f"""WITH {_E}, c AS (SELECT user_id, frame AS centre FROM e WHERE frame % 10 = 0), t AS (SELECT user_id, centre, unnest([0, 1, 2, 3, 4]) AS position, unnest([-25, -12, 0, 12, 25]) AS o FROM c)
SELECT t.user_id, centre, position::INT AS position, arg_min(e.frame, (abs(e.frame - (centre + o)), e.frame)) AS frame FROM t JOIN e ON e.user_id = t.user_id GROUP BY t.user_id, centre, position""")
def five_point_windows(spark, sf_dir):
    return _five_points(frames(spark, sf_dir)).where("centre % 10 = 0")


@query()
def five_point_windows_all(spark, sf_dir):
    """``five_point_windows`` around every frame."""
    return _five_points(frames(spark, sf_dir))


def _five_points(f):
    near = Q.five_point_windows(f.select("user_id", "frame"), ["user_id"], "frame")
    return near.select("user_id", F.col("frame").alias("centre"), F.posexplode("nearest").alias("position", "frame"))


@query("""SELECT o_orderkey, list_distinct(list_append(range(0, (o_orderkey % 90)::BIGINT + 1, 7), (o_orderkey % 90)::BIGINT)).list_sort() AS frames FROM orders""")
def step_frames(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sort_array(Q.step_frames(F.lit(0).cast("long"), F.col("o_orderkey") % 90, 7)).alias("frames"))


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL)
SELECT conv_id, arg_max(role, (n, -f)) AS majority, max(n) AS votes, sum(n)::BIGINT AS total FROM c GROUP BY conv_id""")
def conversation_majority(spark, sf_dir):
    from ..operators.aggregates import first_seen_majority

    return first_seen_majority(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@query()
def greedy_match(spark, sf_dir):
    """Lines of an order against the lines of the next order, matched one to one by nearness of quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a = li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa"))
    b = li.select((F.col("l_orderkey") - 1).alias("frame"), F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, "frame").withColumn("score", 1 - F.abs(F.col("qa") - F.col("qb")) / 50)
    return Q.greedy_match(pairs, ["frame"], "a", "b", "score", 0.8)


@query()
def viterbi_path(spark, sf_dir):
    """Per order the steadiest chain through its lines, taken as candidates of ship-date frames."""
    li = table(spark, sf_dir, "lineitem")
    frame = F.dayofyear("l_shipdate").cast("long")
    p = li.select("l_suppkey", frame.alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") % 68).alias("y"), (1 - F.col("l_discount")).alias("c"))
    return Q.best_path(p, ["l_suppkey"], "frame", "x", "y", "c", 85.0)


@query()
def spaced_best(spark, sf_dir):
    return Q.spaced_best(frames(spark, sf_dir).select("user_id", "frame", "value"), ["user_id"], "frame", "value", 3, 5)


@query()
def diverse_in_time(spark, sf_dir):
    return Q.diverse_in_time(frames(spark, sf_dir).select("user_id", "frame", "value"), ["user_id"], "frame", "value", 4)
