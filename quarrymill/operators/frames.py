"""Operators on frames of detections: eligibility, assembly, directions and per-track summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import on_pitch


def usable_frames(players: DataFrame, frame: list[str], team: str, least: int, least_per_team: int = 0, ball: Column | None = None) -> DataFrame:
    """Frames with a ball (if asked), enough players and enough of each of two teams: n, smaller (of the two teams)."""
    per = players.where(ball) if ball is not None else players
    teams = per.groupBy(*frame, team).agg(F.count("*").alias("n"))
    g = teams.groupBy(*frame).agg(F.sum("n").alias("n"), F.when(F.count("*") >= 2, F.min("n")).otherwise(0).alias("smaller"))
    return g.where((F.col("n") >= least) & (F.col("smaller") >= least_per_team))


def stride(df: DataFrame, frame: str, step: int) -> DataFrame:
    return df.where(F.pmod(F.col(frame), F.lit(step)) == 0)


def steady_tracks(df: DataFrame, track: list[str], confidence: str, least_confidence: float, least_rows: int) -> DataFrame:
    """Detections above the confidence (strictly) of tracks that have enough such detections."""
    sure = df.where(F.col(confidence) > least_confidence)
    return sure.withColumn("_n", F.count("*").over(Window.partitionBy(*track))).where(F.col("_n") >= least_rows).drop("_n")


def wide_shots(samples: DataFrame, clip: list[str], green: str, people: str, height: str) -> DataFrame:
    """Medians over a clip's samples, a quality score, and whether it is a wide shot."""
    m = samples.groupBy(*clip).agg(*[F.median(c).alias(c) for c in (green, people, height)])
    return m.withColumn("wide", (F.col(green) >= 0.28) & (F.col(people) >= 6) & (F.col(height) <= 0.30))


def assemble(players: DataFrame, frame: list[str], order: list[str], features: list[str], size: int) -> DataFrame:
    """Node table to tensor form: per frame the first ``size`` nodes' features in order, zeros and a false mask for the rest."""
    rank = F.row_number().over(Window.partitionBy(*frame).orderBy(*order))
    first = players.withColumn("_rank", rank).where(F.col("_rank") <= size)
    rows = first.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("_rank", F.array(*[F.col(c).cast("double") for c in features]).alias("v")))).alias("_nodes"))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(features)), size - F.size("_nodes"))
    mask = F.concat(F.transform("_nodes", lambda n: F.lit(True)), F.array_repeat(F.lit(False), size - F.size("_nodes")))
    return rows.select(*frame, F.concat(F.transform("_nodes", lambda n: n["v"]), pad).alias("features"), mask.alias("mask"))


def whole_sequences(rows: DataFrame, sequence: str, order: str, value: str, label: str, length: int) -> DataFrame:
    """Sequences of exactly ``length`` rows with one label: their values in order."""
    g = rows.groupBy(sequence).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_rows"), F.countDistinct(label).alias("_labels"), F.min(label).alias(label))
    return g.where((F.size("_rows") == length) & (F.col("_labels") == 1)).select(sequence, label, F.transform("_rows", lambda r: r[value]).alias("values"))


def attack_directions(df: DataFrame, clip: list[str], team: str, x: str, keeper: Column, teams: tuple[str, str]) -> DataFrame:
    """Per clip the direction of both teams: the one whose keepers (else players) have the lower median x attacks +x; without both teams, the first does."""
    def anchor(name: str) -> Column:
        own = F.col(team) == name
        return F.coalesce(F.median(F.when(own & keeper, F.col(x))), F.median(F.when(own, F.col(x))))

    a = df.groupBy(*clip).agg(anchor(teams[0]).alias("_a"), anchor(teams[1]).alias("_b"))
    first = F.when(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") <= F.col("_b")), 1).otherwise(-1)
    return a.select(*clip, first.alias("first"), (-first).alias("second"))


def deepest_keeper(df: DataFrame, clip: list[str], team: str, x: str) -> DataFrame:
    """Per clip the anchor farthest from the middle decides: team, and a confidence that grows with its depth."""
    best = F.max_by(F.struct(F.col(team), F.col(x)), F.struct(F.abs(F.col(x)), team, x))
    g = df.groupBy(*clip).agg(best.alias("_b"))
    return g.select(*clip, F.col(f"_b.{team}").alias("team"), F.when(F.col(f"_b.{x}") < 0, 1).otherwise(-1).alias("direction"), F.least(F.lit(1.0), 0.65 + F.abs(F.col(f"_b.{x}")) / 80).alias("confidence"))


def cluster_sides(df: DataFrame, cluster: str, side: str, least_purity: float) -> DataFrame:
    """The side that most of a cluster's rows have, its purity, and whether the map is usable: pure, without ties and one to one."""
    counts = df.groupBy(cluster, side).agg(F.count("*").alias("n"))
    best = counts.groupBy(cluster).agg(F.max_by(side, F.struct("n", side)).alias("side"), F.max("n").alias("n"), F.sum("n").alias("total"), F.count("*").alias("_k"))
    ties = counts.join(best.select(cluster, F.col("n").alias("_top")), cluster).where("n = _top").groupBy(cluster).agg((F.count("*") > 1).alias("tied"))
    shared = F.count("*").over(Window.partitionBy("side")) > 1
    purity = F.col("n") / F.col("total")
    return best.join(ties, cluster).select(cluster, "side", purity.alias("purity"), "tied", (~F.col("tied") & ~shared & (purity >= least_purity)).alias("usable"))


def projection_quality(df: DataFrame, track: list[str], x: str, y: str, half_length: float, half_width: float) -> DataFrame:
    """Per track the share of points on the pitch and their number."""
    return df.groupBy(*track).agg(F.avg(on_pitch(F.col(x), F.col(y), half_length, half_width).cast("double")).alias("on_pitch"), F.count("*").alias("points"))


def clip_coverage(df: DataFrame, clip: list[str], label: str, confidence: str) -> DataFrame:
    """Per clip and class: its share of rows times its mean confidence."""
    n = F.count("*").over(Window.partitionBy(*clip))
    return df.withColumn("_n", n).groupBy(*clip, label).agg((F.count("*") / F.first("_n")).alias("share"), (F.count("*") / F.first("_n") * F.avg(confidence)).alias("score"))


def clip_summary(df: DataFrame, clip: list[str], label: str, confidence: str, position: str, abstain: str) -> DataFrame:
    """Per clip: dominant label (first seen on ties), median confidence of its rows, share of rows that don't abstain, counts by label."""
    counts = df.groupBy(*clip, label).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    usable = F.col(label) != abstain
    dominant = counts.groupBy(*clip).agg(
        F.max_by(F.when(usable, F.col(label)), F.struct(usable, "n", -F.col("_first"))).alias("dominant"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("counts"),
        (F.sum(F.when(usable, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
    )
    middle = df.join(dominant.select(*clip, "dominant"), clip).where(F.col(label) == F.col("dominant")).groupBy(*clip).agg(F.median(confidence).alias("confidence"))
    return dominant.join(middle, clip, "left")


def synthetic_frames(spark: SparkSession, n: int, seed: int, players: int = 22) -> DataFrame:
    """Random frames of two teams around a ball: each frame's numbers come from its own seeded stream, whatever task makes it."""

    def make(batches):
        for batch in batches:
            rows = []
            for frame in batch["id"]:
                rng = np.random.default_rng([seed, int(frame)])
                ball = rng.uniform([-52.5, -34], [52.5, 34])
                xy = np.clip(ball + rng.normal(0, 15, (players, 2)), [-52.5, -34], [52.5, 34])
                rows += [(int(frame), k, "team_a" if k < players // 2 else "team_b", float(a), float(b), float(ball[0]), float(ball[1])) for k, (a, b) in enumerate(xy)]
            yield pd.DataFrame(rows, columns=["frame", "player", "team", "x", "y", "ball_x", "ball_y"])

    return spark.range(n).mapInPandas(make, "frame long, player int, team string, x double, y double, ball_x double, ball_y double")


def ordered_reasons(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds excluded: the first reason that holds, or null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return df.withColumn("excluded", out)


def relabel_excess(df: DataFrame, team: list[str], margin: str, most: int, label: str, other: str) -> DataFrame:
    """Beyond ``most`` rows of a team, those with the smallest margins become ``other``."""
    rank = F.row_number().over(Window.partitionBy(*team).orderBy(F.desc(margin), F.col(label)))
    return df.withColumn("_rank", rank).withColumn(label, F.when(F.col("_rank") > most, F.lit(other)).otherwise(F.col(label))).drop("_rank")
