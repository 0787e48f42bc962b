"""Frame, track and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as C
from ..operators import frames as R
from ..sources.tables import table
from .registry import query
from .relational import _PL, players


@query(f"""WITH p AS ({_PL}), t AS (SELECT frame, team, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT frame, sum(n)::BIGINT AS n, CASE WHEN count(*) >= 2 THEN min(n) ELSE 0 END AS smaller FROM t GROUP BY frame) SELECT * FROM g WHERE n >= 4 AND smaller >= 2""")
def usable_frames(spark, sf_dir):
    return R.usable_frames(players(spark, sf_dir), ["frame"], "team", 4, 2)


@query("SELECT event_id FROM events WHERE event_id % 5 = 0")
def stride_sample(spark, sf_dir):
    return R.stride(table(spark, sf_dir, "events").select("event_id"), "event_id", 5)


@query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 50) SELECT event_id FROM k WHERE n >= 6""")
def steady_tracks(spark, sf_dir):
    return R.steady_tracks(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value", 50.0, 6).select("event_id")


@query("""WITH m AS (SELECT l_orderkey, median(l_discount * 10) AS green, median(l_quantity) AS people, median(l_tax * 5) AS height FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(green, 6) AS green, people, round(height, 6) AS height, green >= 0.28 AND people >= 6 AND height <= 0.30 AS wide FROM m""")
def wide_shots(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("green"), F.col("l_quantity").alias("people"), (F.col("l_tax") * 5).alias("height"))
    w = R.wide_shots(s, ["l_orderkey"], "green", "people", "height")
    return w.select("l_orderkey", F.round("green", 6).alias("green"), "people", F.round("height", 6).alias("height"), "wide")


@query(f"""WITH p AS ({_PL}), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY team, player, x, y) AS k FROM p), f AS (SELECT * FROM r WHERE k <= 5)
SELECT frame, count(*)::INT AS nodes, round(list_sum(list(x * k)), 4) AS weighted FROM f GROUP BY frame""")
def node_assembly(spark, sf_dir):
    a = R.assemble(players(spark, sf_dir), ["frame"], ["team", "player", "x", "y"], ["x", "y"], 5)
    xs = F.transform("features", lambda v, k: v[0] * (k + 1))
    return a.select("frame", F.size(F.filter("mask", lambda m: m)).alias("nodes"), F.round(F.aggregate(xs, F.lit(0.0), lambda s, v: s + v), 4).alias("weighted"))


@query("""SELECT l_orderkey, min(l_linestatus) AS l_linestatus, list(l_quantity ORDER BY l_linenumber, l_quantity) AS "values" FROM lineitem GROUP BY l_orderkey HAVING count(*) = 5 AND count(DISTINCT l_linestatus) = 1""")
def whole_sequences(spark, sf_dir):
    return R.whole_sequences(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", 5)


@query(f"""WITH p AS ({_PL}), a AS (SELECT frame, coalesce(median(x) FILTER (team = 'F' AND player = 1), median(x) FILTER (team = 'F')) AS a, coalesce(median(x) FILTER (team = 'O' AND player = 1), median(x) FILTER (team = 'O')) AS b FROM p GROUP BY frame)
SELECT frame, CASE WHEN a IS NULL OR b IS NULL OR a <= b THEN 1 ELSE -1 END AS first, CASE WHEN a IS NULL OR b IS NULL OR a <= b THEN -1 ELSE 1 END AS second FROM a""")
def attack_directions(spark, sf_dir):
    return R.attack_directions(players(spark, sf_dir), ["frame"], "team", "x", F.col("player") == 1, ("F", "O"))


@query(f"""WITH p AS ({_PL}), b AS (SELECT frame, arg_max(team, (abs(x), team, x)) AS team, arg_max(x, (abs(x), team, x)) AS x FROM p GROUP BY frame)
SELECT frame, team, CASE WHEN x < 0 THEN 1 ELSE -1 END AS direction, round(least(1.0, 0.65 + abs(x) / 80), 6) AS confidence FROM b""")
def keeper_directions(spark, sf_dir):
    return R.deepest_keeper(players(spark, sf_dir), ["frame"], "team", "x").withColumn("confidence", F.round("confidence", 6))


@query("""WITH c AS (SELECT l_returnflag AS cluster, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT cluster, arg_max(s, (n, s)) AS side, max(n) AS n, sum(n) AS total FROM c GROUP BY cluster),
t AS (SELECT b.cluster, count(*) > 1 AS tied FROM c JOIN b ON c.cluster = b.cluster AND c.n = b.n GROUP BY 1)
SELECT b.cluster, side, round(n / total, 6) AS purity, tied, NOT tied AND count(*) OVER (PARTITION BY side) = 1 AND n / total >= 0.8 AS usable FROM b JOIN t USING (cluster)""")
def cluster_sides(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.col("l_linestatus").alias("s"))
    return R.cluster_sides(li, "cluster", "s", 0.8).withColumn("purity", F.round("purity", 6))


@query(f"""SELECT player, round(avg((abs(x) <= 40 AND abs(y) <= 30)::INT), 6) AS on_pitch, count(*) AS points FROM ({_PL}) GROUP BY player""")
def projection_quality(spark, sf_dir):
    return R.projection_quality(players(spark, sf_dir), ["player"], "x", "y", 40.0, 30.0).withColumn("on_pitch", F.round("on_pitch", 6))


@query("""WITH n AS (SELECT user_id, count(*) AS t FROM events GROUP BY 1) SELECT user_id, event_type, round(count(*) / any_value(t), 6) AS share, round(count(*) / any_value(t) * avg(value), 6) AS score FROM events JOIN n USING (user_id) GROUP BY ALL""")
def clip_coverage(spark, sf_dir):
    c = R.clip_coverage(table(spark, sf_dir, "events").select("user_id", "event_type", "value"), ["user_id"], "event_type", "value")
    return c.withColumns({x: F.round(x, 6) for x in ("share", "score")})


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), d AS (SELECT user_id, arg_max(event_type, (n, -f)) FILTER (event_type <> 'error') AS dominant, sum(n) FILTER (event_type <> 'error') / sum(n) AS coverage, max(n) FILTER (event_type = 'view') AS views FROM c GROUP BY user_id)
SELECT d.user_id, any_value(dominant) AS dominant, round(any_value(coverage), 6) AS coverage, any_value(views) AS views, round(median(value), 6) AS confidence FROM d JOIN events e ON e.user_id = d.user_id AND e.event_type = dominant GROUP BY d.user_id""")
def clip_summary(spark, sf_dir):
    s = R.clip_summary(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "event_id", "error").where("dominant is not null")
    return s.select("user_id", "dominant", F.round("coverage", 6).alias("coverage"), F.col("counts")["view"].alias("views"), F.round("confidence", 6).alias("confidence"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'segment' WHEN c_custkey % 10 = 0 THEN 'sampled' END AS excluded FROM customer""")
def ordered_exclusion(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return R.ordered_reasons(c, [("debt", F.col("c_acctbal") < 0), ("segment", F.col("c_mktsegment") == "BUILDING"), ("sampled", F.col("c_custkey") % 10 == 0)]).select("c_custkey", "excluded")


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) AS r, s_name FROM supplier) SELECT s_suppkey, CASE WHEN r > 2 THEN 'other' ELSE s_name END AS s_name FROM r""")
def relabel_excess(spark, sf_dir):
    return R.relabel_excess(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", "s_name"), ["s_nationkey"], "s_acctbal", 2, "s_name", "other").select("s_suppkey", "s_name")


@query()
def synthetic_frames(spark, sf_dir):
    return R.synthetic_frames(spark, 30_000, 42)


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 50000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL), ';') AS problems FROM orders""")
def row_problems(spark, sf_dir):
    p = C.problems({"price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus").isin("F", "O")})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(p, ";").alias("problems"))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS others, count(*) FILTER (o_orderstatus IN ('F', 'O')) = count(*) AS complete FROM orders""")
def outcome_counts(spark, sf_dir):
    return C.outcome_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'terminal' ELSE 'waiting' END AS kind FROM documents d LEFT JOIN labels l USING (doc_id)""")
def manifest_status(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string"))
    return C.with_status(table(spark, sf_dir, "documents").select("doc_id"), labels, ["doc_id"], "quality", ["1"]).select("doc_id", "kind")


@query("""SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def unreferenced_assets(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return C.unreferenced(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), [(big, "l_partkey"), (table(spark, sf_dir, "supplier"), "s_suppkey")], "k")


@query("""SELECT l_orderkey, count(DISTINCT l_linestatus) AS "values", count(DISTINCT l_linestatus) = 1 AS constant FROM lineitem GROUP BY 1""")
def constant_assignment(spark, sf_dir):
    return C.constant_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linestatus"))


@query("""SELECT l_returnflag, count(*) AS rows, count(*) FILTER (NOT l_quantity < 50) AS quantity, count(*) FILTER (NOT l_tax >= 0.01) AS tax FROM lineitem GROUP BY 1""")
def provenance_checks(spark, sf_dir):
    return C.rule_violations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"quantity": F.col("l_quantity") < 50, "tax": F.col("l_tax") >= 0.01})


@query("""SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS present FROM customer""")
def registry_completeness(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"))
    return C.expected_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), urgent, ["k"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 WHEN o_orderkey % 2 > 0 THEN o_orderkey % 2 WHEN o_orderkey > 0 THEN o_orderkey END AS frames, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS match FROM orders""")
def first_known(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.first_positive(k % 3, k % 2, k).alias("frames"), C.first_filled(status, F.col("o_orderpriority")).alias("match"))


@query("""SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'""")
def changed_jobs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("*", F.sha2(F.to_json(F.struct("c_name", "c_acctbal")), 256).alias("signature"))
    done = c.where("c_acctbal >= 0").withColumn("signature", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("old")).otherwise(F.col("signature")))
    return C.changed(c.select("c_custkey", "signature"), done.select("c_custkey", "signature"), ["c_custkey"], "signature").select("c_custkey")
