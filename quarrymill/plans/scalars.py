"""Scalar queries: identifiers, bands, clocks, geometry and validation over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import vectors as V
from ..sources.tables import resolve, table
from .registry import query


@query("""SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slugify_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("""SELECT c_custkey, nullif(trim(regexp_replace(trim(c_name), '[^A-Za-z0-9._-]+', '-', 'g'), '.-'), '') AS safe,
array_to_string(string_split(c_name || '-x-y-z', '-')[1:3], '-') AS fixture, regexp_replace(lower(trim(c_mktsegment)), '\\s+', ' ', 'g') AS club FROM customer""")
def safe_identifiers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.path_safe(F.col("c_name")).alias("safe"), T.fixture_key(F.concat("c_name", F.lit("-x-y-z"))).alias("fixture"), T.canonical_name(F.col("c_mktsegment")).alias("club"))


@query("""SELECT c_custkey, round((('0x' || substr(sha256(c_name), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615.0, 9) AS fraction,
(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615.0 < 0.2 AS held_out FROM customer""")
def hash_holdout(spark, sf_dir):
    f = T.hash_fraction(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(f, 9).alias("fraction"), (f < 0.2).alias("held_out"))


@query("""SELECT CASE WHEN l_discount * 10 < 0.60 THEN 'low' WHEN l_discount * 10 < 0.85 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1""")
def confidence_band(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(T.confidence_band(F.col("l_discount") * 10).alias("band")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_orderkey, (1 + o_orderkey % 2)::INT AS half, (o_orderkey % 2700)::DOUBLE AS s FROM orders),
t AS (SELECT *, s + CASE WHEN half = 2 THEN 2700 ELSE 0 END AS total FROM h)
SELECT o_orderkey, half, printf('%02d:%04.1f', floor(total / 60)::INT, total - floor(total / 60) * 60) AS clock FROM t""")
def match_clock(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 2).cast("int").alias("half"), (F.col("o_orderkey") % 2700).cast("double").alias("s"))
    return o.select("o_orderkey", "half", T.match_clock(F.col("half"), F.col("s")).alias("clock"))


@query("""SELECT o_orderkey, (o_orderkey % 2 + 1)::INT AS half, CASE WHEN right(o_orderpriority, 1) = 'H' THEN left(o_orderpriority, length(o_orderpriority) - 1) ELSE o_orderpriority END AS base,
right(o_orderpriority, 1) = 'H' AS had, lower(trim(o_orderstatus)) = 'true' AS loose FROM orders""")
def label_parts(spark, sf_dir):
    """Half from an id, a label's suffix, and a loose boolean."""
    o = table(spark, sf_dir, "orders")
    clip = F.concat(F.lit("game-h"), (F.col("o_orderkey") % 2 + 1).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    base, had = T.without_suffix(F.col("o_orderpriority"), "H")
    return o.select("o_orderkey", T.clip_half(F.lit(None).cast("int"), clip).alias("half"), base.alias("base"), had.alias("had"), T.loose_true(F.col("o_orderstatus")).alias("loose"))


@query("""SELECT event_id, nullif(trim(split_part(s, '=', 1)), '') AS id, nullif(trim(substr(s, strpos(s, '=') + 1)), '') AS prompt
FROM (SELECT event_id, event_type || ' = ' || props AS s FROM events)""")
def query_specs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key, prompt = T.query_spec(F.concat("event_type", F.lit(" = "), "props"))
    return e.select("event_id", key.alias("id"), prompt.alias("prompt"))


@query("""SELECT event_id, props AS object, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def embedded_objects(spark, sf_dir):
    """The JSON object inside a free text, found again and parsed."""
    e = table(spark, sf_dir, "events")
    found = T.first_object(F.concat(F.lit("answer: "), F.col("props"), F.lit(" and {more} after")))
    return e.select("event_id", found.alias("object"), F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("""WITH e AS (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '0.25' WHEN 2 THEN '1.5' ELSE 'x' END AS raw FROM events)
SELECT raw, count(*) AS n, count(CASE WHEN raw = '0.25' THEN 1 END) AS valid FROM e GROUP BY raw""")
def probability_checks(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select(F.when(k == 0, "true").when(k == 1, "0.25").when(k == 2, "1.5").otherwise("x").alias("raw"))
    return e.groupBy("raw").agg(F.count("*").alias("n"), F.count(T.probability(F.col("raw"))).alias("valid"))


_XY = "SELECT l_orderkey, l_linenumber, l_quantity * 2.1 - 52.5 AS x, l_extendedprice % 68 - 34 AS y, CASE WHEN l_linestatus = 'O' THEN 'right_to_left' ELSE 'left_to_right' END AS side FROM lineitem"


def _xy(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "right_to_left").otherwise("left_to_right")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2.1 - 52.5).alias("x"), (F.col("l_extendedprice") % 68 - 34).alias("y"), side.alias("side"))


@query(f"""WITH p AS ({_XY}), o AS (SELECT *, CASE WHEN side = 'right_to_left' THEN -1 ELSE 1 END AS s FROM p)
SELECT l_orderkey, l_linenumber, round(s * x, 3) AS ox, round(s * x + 52.5, 3) AS cx, round(s * y + 34, 3) AS cy, round((s * x + 52.5) / 105, 6) AS ux, round((s * y + 34) / 68, 6) AS uy,
CASE WHEN side = 'right_to_left' THEN 'left_to_right' ELSE 'right_to_left' END AS other FROM o""")
def pitch_coordinates(spark, sf_dir):
    x, y, side = F.col("x"), F.col("y"), F.col("side")
    cx, cy = G.from_corner(x, y, side)
    ux, uy = G.unit(x, y, F.when(side == "right_to_left", -1).otherwise(1))
    return _xy(spark, sf_dir).select("l_orderkey", "l_linenumber", G.oriented(x, side).alias("ox"), cx.alias("cx"), cy.alias("cy"), F.round(ux, 6).alias("ux"), F.round(uy, 6).alias("uy"), G.opposite_side(side).alias("other"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_tax * 100 AS y1, l_quantity + 20 AS x2, l_tax * 100 + 30 AS y2 FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i
FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)
SELECT l_orderkey, l_linenumber, round(i / (1200 - i), 6) AS iou FROM p""")
def box_overlaps(spark, sf_dir):
    box = lambda p: [F.col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2")]
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("x1"), t.alias("y1"), (q + 20).alias("x2"), (t + 30).alias("y2"))
    j = b.alias("a").join(b.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") + 1 == F.col("b.l_linenumber")))
    return j.select("a.l_orderkey", "a.l_linenumber", F.round(G.box_iou(box("a"), box("b")), 6).alias("iou"))


@query("""WITH h AS (SELECT c_custkey, 10.0 + c_custkey % 7 AS a, 5.0 AS b, c_acctbal / 100 AS u FROM customer)
SELECT c_custkey, CASE WHEN abs((u - b) / a) <= 54.5 AND abs(4.0 - 1.0) <= 36 THEN round((u - b) / a, 6) END AS px,
CASE WHEN abs((u - b) / a) <= 54.5 THEN 3.0::DOUBLE END AS py FROM h""")
def inverse_projection(spark, sf_dir):
    """Image points through the inverse of [[a, 0, b], [0, 1, 1], [0, 0, 1]]."""
    c = table(spark, sf_dir, "customer")
    one, nil = F.lit(1.0), F.lit(0.0)
    a = 10.0 + F.col("c_custkey") % 7
    px, py = G.unproject([a, nil, F.lit(5.0), nil, one, one, nil, nil, one], F.col("c_acctbal") / 100, F.lit(4.0), (54.5, 36.0))
    # a binary tie of the sixth decimal is rounded away from zero as a number, as the SQL does it, and not as decimal digits
    return c.select("c_custkey", (F.signum(px) * F.floor(F.abs(px) * 1e6 + 0.5) / 1e6).alias("px"), py.alias("py"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, 20.0 + l_linenumber AS a, 0.5 AS b, 640.0 AS c, -0.75 AS d, 18.0 AS e, 360.0 AS f, 0.001 AS g, 0.002 * l_linenumber AS h, 1.0 AS i,
  CASE WHEN l_linenumber = 7 THEN 1.0 ELSE 1920.0 / (2 * 12.8 * l_quantity) END AS sx, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE 1080.0 / (2 * 7.2 * l_quantity) END AS sy, l_extendedprice % 1280 AS pu, l_tax * 9000 AS pv FROM lineitem),
p AS (SELECT *, pu * sx AS u, pv * sy AS v FROM c), q AS (SELECT *, (d * h - e * g) * u + (b * g - a * h) * v + (a * e - b * d) AS w FROM p),
r AS (SELECT *, ((e * i - f * h) * u + (c * h - b * i) * v + (b * f - c * e)) / w AS x, ((f * g - d * i) * u + (a * i - c * g) * v + (c * d - a * f)) / w AS y FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) <= 54.5 AND abs(y) <= 36 THEN round(x, 4) END AS px, CASE WHEN abs(x) <= 54.5 AND abs(y) <= 36 THEN round(y, 4) END AS py FROM r""")
def camera_projection(spark, sf_dir):
    """Image points, scaled into the calibration's pixels, through the inverse of a full homography."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber")
    h = [20.0 + k, F.lit(0.5), F.lit(640.0), F.lit(-0.75), F.lit(18.0), F.lit(360.0), F.lit(0.001), 0.002 * k, F.lit(1.0)]
    known = lambda c: F.when(k != 7, c)
    sx, sy = G.calibration_scale(known(F.lit(960.0)), known(F.lit(540.0)), 2 * 12.8 * F.col("l_quantity"), 2 * 7.2 * F.col("l_quantity"))
    px, py = G.unproject(h, F.col("l_extendedprice") % 1280 * sx, F.col("l_tax") * 9000 * sy, (54.5, 36.0))
    return li.select("l_orderkey", "l_linenumber", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query("""SELECT p_partkey, p_size >= 6 AND p_partkey % 5 >= 2 AND p_retailprice BETWEEN 1000 AND 20000 AS reliable, round(greatest(0, least(1, 0.72 - p_size / 12.0 + (p_partkey % 5) / 12.0)), 6) AS possession,
round(greatest(0, least(1, 0.75 - p_size / 9.0 + (p_partkey % 5) / 10.0)), 6) AS possession_video, round(0.48 * p_size / 50 + 0.42 * (p_partkey % 5) / 5 + 0.10, 6) AS shot FROM part""")
def calibration_gates(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey") % 5
    return table(spark, sf_dir, "part").select(
        "p_partkey", G.reliable_calibration(size, k, F.col("p_retailprice")).alias("reliable"), F.round(G.possession_confidence(size, k), 6).alias("possession"),
        F.round(G.possession_confidence(size, k, 0.75, 9.0, 10.0), 6).alias("possession_video"), F.round(G.shot_quality(size / 50, k / 5, F.lit(1.0)), 6).alias("shot"),
    )


@query("""SELECT o_orderkey, list_transform([0, 1, 2, 3, 4], lambda k: round_even(greatest(0, o_orderkey - 5) + (o_orderkey + 20 + 5 - greatest(0, o_orderkey - 5)) * k / 4, 0)::BIGINT) AS frames FROM orders""")
def frame_samples(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.sample_frames(k, k + 20).alias("frames"))


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-greatest(-30, least(30, 2.0 * (x - 0.1) / 0.5 - 1.5 * (y + 0.2) / 0.25 + 0.3)))), 6) AS p FROM v""")
def linear_head(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.linear_head(F.slice("embedding", 1, 2), [0.1, -0.2], [0.5, 0.25], [2.0, -1.5], 0.3), 6).alias("p"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS c, CASE o_orderstatus WHEN 'P' THEN 'Ambiguous' ELSE 'ok' END AS st, (o_orderkey % 3)::INT - 1 AS raw FROM orders)
SELECT o_orderkey, c AND st = 'ok' AND raw IN (-1, 1) AS trusted, CASE WHEN raw = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END ELSE raw END AS direction,
CASE WHEN raw <> 0 THEN 'manifest' WHEN o_orderkey % 2 = 0 THEN 'registry' ELSE 'inference' END AS source FROM d""")
def direction_trust(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = (k % 3).cast("int") - 1
    label = F.when(raw == 1, "left_to_right").otherwise("right_to_left")
    status = F.when(F.col("o_orderstatus") == "P", "Ambiguous").otherwise("ok")
    direction, source = T.resolve_direction(raw, F.when(k % 2 == 0, 1), F.lit(-1))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.direction_trusted(k % 3 == 0, status, F.lit("model"), raw, label).alias("trusted"), direction.alias("direction"), source.alias("source"))


@query("""SELECT n.n_nationkey, coalesce(CASE WHEN n.n_nationkey % 4 = 0 THEN 'fixed' END, CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name END, 'neutral') AS n_name,
CASE WHEN n.n_nationkey % 4 = 0 THEN 'reviewed' WHEN n.n_nationkey % 2 = 0 THEN 'own' ELSE 'neutral' END AS source FROM nation n""")
def reviewed_registry(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    fixed = n.where("n_nationkey % 4 = 0").select("n_nationkey", F.lit("fixed").alias("n_name"))
    own = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name"))
    return resolve(own, fixed, ["n_nationkey"], "n_name", "neutral").select("n_nationkey", "n_name", "source")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END, round_even(o_totalprice * 25, 0)::BIGINT) AS frames,
(0 + 100) / 2 - least(50.0, 4.0) AS start, (0 + 100) / 2 + least(50.0, 4.0) AS finish FROM orders""")
def source_frames(spark, sf_dir):
    from ..sources.tables import frame_count

    start, finish = G.centred_excerpt(F.lit(0.0), F.lit(100.0), 8.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", frame_count(F.col("o_orderkey") % 3, F.col("o_totalprice"), F.lit(25)).alias("frames"), start.alias("start"), finish.alias("finish"))
