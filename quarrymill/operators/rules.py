"""Auditable rule labels with explicit abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import possession_confidence
from .graphs import holder

Rule = tuple[str, Column, Column]


def first_rule(rules: list[Rule], default: tuple[str, Column]) -> tuple[Column, Column]:
    """(label, confidence) of the first rule whose condition holds; a null condition doesn't."""
    label, confidence = F.lit(default[0]), default[1]
    for name, condition, score in reversed(rules):
        met = F.coalesce(condition, F.lit(False))
        label, confidence = F.when(met, name).otherwise(label), F.when(met, score).otherwise(confidence)
    return label, confidence


def shape_patterns(players: DataFrame, frame: list[str], x: str, y: str, ball_x: str, ball_y: str, team: str, player: str, *ties: str) -> DataFrame:
    """One label per frame from the geometry of two teams around the ball.

    The nearest player holds the ball; under four players, beyond 7 m or with a possession
    confidence below 0.32 the frame abstains. Rules are tried in order: a ball near the
    touchline under pressure, dense pressure, a screened central ball, a compact shape,
    no near defender. The rule's confidence is multiplied by that of possession.
    """
    distance = F.sqrt(F.pow(F.col(x) - F.col(ball_x), 2) + F.pow(F.col(y) - F.col(ball_y), 2))
    sides = players.groupBy(*frame).agg(F.count("*").alias("n"), F.first(F.abs(F.col(ball_y))).alias("off_centre"))
    held = holder(players, frame, distance, team, player, *ties)
    defence = players.withColumn("_d", distance).join(held, frame).where(F.col(team) != F.col("holder_team"))
    shape = defence.groupBy(*frame).agg(
        *[F.count_if(F.col("_d") <= r).alias(f"within_{r}") for r in (8, 12, 16)], F.count("*").alias("defenders"), F.min("_d").alias("nearest"),
        (F.max(y) - F.min(y)).alias("_w"), (F.max(x) - F.min(x)).alias("_h"),
    )
    f = sides.join(held, frame).join(shape, frame, "left").fillna(0, ["within_8", "within_12", "within_16", "defenders"])
    enough = F.col("defenders") >= 3
    f = f.withColumn("width", F.when(enough, F.col("_w")).otherwise(99.0)).withColumn("depth", F.when(enough, F.col("_h")).otherwise(99.0))
    margin = F.coalesce(F.col("opponent_distance") - F.col("holder_distance"), F.lit(0.0))
    f = f.withColumn("possession", possession_confidence(F.col("holder_distance"), margin))
    off, w8, w12, w16, near = (F.col(c) for c in ("off_centre", "within_8", "within_12", "within_16", "nearest"))
    most = lambda top, c: F.least(F.lit(top), c)
    # fixed values: distances in metres and the confidence formula of each rule
    rules = [
        ("touchline_trap", (off >= 24.0) & (w12 >= 2), most(0.94, 0.58 + 0.09 * w12 + 0.08 * (off - 24) / 10)),
        ("intense_pressure", (w16 >= 3) & (w8 >= 2), most(0.92, 0.56 + 0.07 * w16 + 0.06 * w8)),
        ("central_block", (off <= 11.5) & (w16 >= 2), most(0.88, 0.55 + 0.07 * w16)),
        ("compact_block", (F.col("defenders") >= 4) & (F.col("width") <= 36.0) & (F.col("depth") <= 30.0), most(0.84, 0.55 + (36 - F.col("width")) / 100 + (30 - F.col("depth")) / 100)),
        ("low_pressure", (F.col("defenders") == 0) | (near > 14.0), F.when(F.col("defenders") == 0, F.lit(0.58)).otherwise(most(0.88, 0.58 + (near - 14) / 40))),
    ]
    label, confidence = first_rule(rules, ("unstructured", F.lit(0.48)))
    few, unclear = F.col("n") < 4, (F.col("holder_distance") > 7.0) | (F.col("possession") < 0.32)
    return f.select(
        *frame, F.when(few | unclear, "abstain").otherwise(label).alias("label"),
        F.when(few, 0.0).when(unclear, F.col("possession")).otherwise(confidence * F.col("possession")).alias("confidence"),
        F.when(few, "missing_geometry").when(unclear, "possession_ambiguous").otherwise("rule").alias("reason"), "within_8", "within_12", "within_16",
    )


def pressure_descriptors(df: DataFrame, frame: list[str], x: str, y: str, vx: str, vy: str, ball_x: str, ball_y: str) -> DataFrame:
    """Per frame, of the pressing players (0..1 pitch coordinates): counts by distance, nearest, mean of the three nearest, approach and corridor counts."""
    dx, dy = (F.col(ball_x) - F.col(x)) * 105.0, (F.col(ball_y) - F.col(y)) * 68.0
    d = df.withColumn("_d", F.sqrt(dx * dx + dy * dy))
    towards = (F.col(vx) * 105.0 * dx + F.col(vy) * 68.0 * dy) / F.greatest(F.col("_d"), F.lit(1e-6))
    d = d.withColumn("_v", towards)
    near = F.col("_d") < 12
    corridor = (F.col(x) > F.col(ball_x)) & (F.abs(F.col(y) - 0.5) < 0.14) & (F.col(x) < F.col(ball_x) + 0.32)
    three = F.slice(F.sort_array(F.collect_list("_d")), 1, 3)
    return d.groupBy(*frame).agg(
        F.first(ball_x).alias("ball_x"), F.first(ball_y).alias("ball_y"), *[F.count_if(F.col("_d") < r).alias(f"within_{r}") for r in (8, 12, 16)], F.min("_d").alias("nearest"),
        (F.aggregate(three, F.lit(0.0), lambda s, v: s + v) / F.size(three)).alias("mean_three"), F.max("_v").alias("approach"), F.count_if(F.col("_v") > 0.7).alias("approaching"),
        F.count_if(corridor).alias("screeners"), F.count_if(near & (F.col(y) > F.col(ball_y) + 0.025)).alias("inside_left"), F.count_if(near & (F.col(y) < F.col(ball_y) - 0.025)).alias("inside_right"),
    )


def weak_labels(d: DataFrame, possession: Column, trusted: Column) -> DataFrame:
    """Adds label and confidence by ordered rules over ``pressure_descriptors``; labels that depend on the attacking direction need a trusted one."""
    bx, by, w8, w12, w16, near = (F.col(c) for c in ("ball_x", "ball_y", "within_8", "within_12", "within_16", "nearest"))
    most = lambda top, c: F.least(F.lit(top), c)
    # fixed values: thresholds and the confidence formula of each rule
    rules = [
        ("abstain_possession", ~possession, F.lit(0.0)),
        ("trap_left", (by < 0.22) & (w12 >= 2) & (F.col("inside_left") >= 2), most(0.95, 0.62 + 0.08 * F.col("inside_left") + 0.06 * (0.22 - by) / 0.22)),
        ("trap_right", (by > 0.78) & (w12 >= 2) & (F.col("inside_right") >= 2), most(0.95, 0.62 + 0.08 * F.col("inside_right") + 0.06 * (by - 0.78) / 0.22)),
        ("high_press", (bx < 0.48) & (w16 >= 3) & ((F.col("approaching") >= 1) | (w8 >= 2)), most(0.92, 0.58 + 0.06 * w16 + 0.04 * F.col("approaching"))),
        ("central_screen", (bx < 0.60) & (F.col("screeners") >= 2) & (w16 >= 2), most(0.90, 0.58 + 0.07 * F.col("screeners"))),
        ("unstructured", (w12 == 0) & (near > 14), most(0.90, 0.62 + 0.02 * (near - 14))),
    ]
    label, confidence = first_rule(rules, ("abstain_ambiguous", F.lit(0.0)))
    gated = label.isin("trap_left", "trap_right", "high_press", "central_screen") & ~trusted
    return d.withColumn("label", F.when(gated, "abstain_direction").otherwise(label)).withColumn("confidence", F.when(gated, 0.0).otherwise(confidence))


def gates(conditions: dict[str, Column]) -> tuple[Column, Column]:
    """(names of the gates that fail, whether none does); a null condition fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in conditions.items()]), lambda x: x.isNotNull())
    return failed, F.size(failed) == 0


def colour_outlier(own: Column, other: Column) -> Column:
    """Whether a track's colour is clearly nearer to the other cluster."""
    return (other + 8 < own) & (other < 0.6 * own)
