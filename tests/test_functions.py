"""Worked values of scalar and geometry expressions."""

import math

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import geometry as G
from quarrymill.functions import text as T
from quarrymill.functions import vectors as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(x)


def test_text(spark):
    assert one(spark, T.tokens(lit("High-Press, 4x4 é!"))) == (["high", "press", "4x4"],)
    assert one(spark, T.slug(lit("  FC Köln – São Paulo ")), T.path_safe(lit(" a b/c.")), T.path_safe(lit("///"))) == ("fc-koln-sao-paulo", "a-b-c", None)
    assert one(spark, T.fixture_key(lit("a-b-c-h1-0001")), T.fixture_key(lit("a-b-c-hd"), ("-hd",))) == ("a-b-c", "a-b-c")
    assert one(spark, T.match_clock(lit(2), lit(65.25)), T.match_clock(lit(1), lit(0.0))) == ("46:05.3", "00:00.0")
    assert one(spark, T.clip_half(lit(None).cast("int"), lit("x-h2-7")), T.clip_half(lit(1), lit("x-h2-7")), T.clip_half(lit(None).cast("int"), lit("H1clip"))) == (2, 1, 1)
    assert one(spark, *T.without_suffix(lit("team_a_goalkeeper"))) == ("team_a", True)
    assert [one(spark, T.confidence_band(lit(x)))[0] for x in (0.59, 0.6, 0.85)] == ["low", "medium", "high"]
    assert one(spark, *T.query_spec(lit("a = b = c"))) == ("a", "b = c")
    assert one(spark, *T.query_spec(lit("none"))) == (None, None)
    assert one(spark, T.loose_true(lit(" TRUE ")), T.loose_true(lit(None).cast("string")), T.half_of(lit("2 - 12:30"))) == (True, False, 2)


def test_hash_fraction_is_that_of_the_first_eight_bytes(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"clip:1").digest()[:8], "big") / (2**64 - 1)
    assert one(spark, T.hash_fraction(lit("clip:1")))[0] == pytest.approx(want, abs=1e-15)


def test_intent_and_expansion(spark):
    rows = {q: one(spark, *T.intent(lit(q))) for q in ("compact low block near the penalty area", "deep block", "Press on the wing", "high press through the centre", "mid-block", "x")}
    assert rows["compact low block near the penalty area"] == (True, None)  # "penalty" alone decides
    assert [rows[q][1] for q in ("deep block", "Press on the wing", "high press through the centre", "mid-block", "x")] == ["low_block", "high_press_wing", "high_press_central", "medium_press", None]
    assert one(spark, T.flank_class(lit("left-side pressing")), T.flank_class(lit("left")), T.flank_class(lit("left right trap"))) == ("trap_left", None, None)
    assert one(spark, T.expand_query(lit("plain")))[0] == "plain"


def test_first_object_and_probability(spark):
    assert one(spark, T.first_object(lit('x {"a": "}{", "b": {"c": 1}} {y}')), T.first_object(lit("none")), T.first_object(lit("{open"))) == ('{"a": "}{", "b": {"c": 1}}', None, None)
    assert one(spark, *[T.probability(lit(x)) for x in ("0.5", "1.01", "NaN", "true", None)]) == (0.5, None, None, None, None)


def test_direction(spark):
    args = lambda **k: [lit(k.get(n, d)) for n, d in (("c", True), ("st", "calibrated"), ("so", "clips"), ("raw", 1), ("lab", "left_to_right"))]
    got = one(spark, *[T.direction_trusted(*args(**k)) for k in ({}, {"c": False}, {"st": "Un-known"}, {"st": "un known unavailable"}, {"raw": 0}, {"lab": "right_to_left"})])
    assert got == (True, False, True, False, False, False)
    assert one(spark, *T.resolve_direction(lit(0), lit(-1), lit(1))) == (-1, "registry")


def test_geometry(spark):
    assert one(spark, G.oriented(lit(1.5), lit("right_to_left")), *G.from_corner(lit(10.0), lit(-4.0), lit("left_to_right"))) == (-1.5, 62.5, 30.0)
    assert one(spark, *G.rescaled(lit(60.0), lit(40.0))) == (52.5, 34.0)
    box = lambda *v: [lit(float(x)) for x in v]
    assert one(spark, G.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10)))[0] == pytest.approx(1 / 3)
    assert one(spark, G.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == (0.0,)
    assert one(spark, G.sample_frames(lit(100), lit(120))) == ([95, 102, 110, 118, 125],)
    assert one(spark, G.points(F.array(lit(1), lit(2), lit(3)))) == ([[1, 2]],)
    h = [lit(float(x)) for x in (2, 0, 1, 0, 4, 2, 0, 0, 1)]
    assert one(spark, *G.unproject(h, lit(7.0), lit(10.0), (54.5, 36.0))) == (3.0, 2.0)
    assert one(spark, *G.unproject(h, lit(700.0), lit(10.0), (54.5, 36.0))) == (None, None)
    with pytest.raises(Exception, match="no attacking side"):
        one(spark, G.opposite_side(lit("up")))


def test_vectors(spark):
    a, b = F.array(lit(3.0), lit(4.0)), F.array(lit(1.0), lit(0.0))
    assert one(spark, V.dot(a, b), V.norm(a)) == (3.0, 5.0)
    assert one(spark, V.unit(a))[0] == pytest.approx([0.6, 0.8])
    f = V.fused([(0.25, a), (0.75, b)])
    assert one(spark, V.dot(f, f))[0] == pytest.approx(0.25 * 25 + 0.75)
    assert one(spark, V.linear_head(a, [1.0, 2.0], [2.0, 1.0], [1.0, 1.0], 0.0))[0] == pytest.approx(1 / (1 + math.exp(-3)))
