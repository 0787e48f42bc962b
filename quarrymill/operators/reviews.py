"""Review rows, team configurations, abstentions and error rows: the checked records around a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name, match_clock


def annotations(events: DataFrame, time: str = "gameTime", position: str = "position", label: str = "label") -> DataFrame:
    """half, seconds, label of game annotations such as ("1 - 12:30", "750000" milliseconds); either is null where it can't be read."""
    half = F.trim(F.split_part(F.col(time), F.lit(" - "), F.lit(1))).try_cast("int")
    seconds = F.col(position).cast("string").try_cast("bigint") / 1000.0
    return events.withColumn("half", half).withColumn("seconds", seconds).withColumnRenamed(label, "label")


def versioned(rows: DataFrame, version: str, wanted: str, category: str, kept: list[int]) -> DataFrame:
    """Rows of some categories, with a problem where the file's version isn't the one that the fields are known for."""
    problem = F.when(~F.coalesce(F.col(version).cast("string") == wanted, F.lit(False)), F.concat(F.lit("version is not "), F.lit(wanted)))
    return rows.where(F.col(category).isin(kept)).withColumn("problem", problem)


def newest_valid(states: DataFrame, key: str, made: str, *checks: Column) -> DataFrame:
    """Per key the newest state that passes all checks (a null check fails); keys without one are left out."""
    valid = F.lit(True)
    for check in checks:
        valid = valid & F.coalesce(check, F.lit(False))
    columns = [c for c in states.columns if c != key]
    return states.where(valid).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(made, *[c for c in columns if c != made])).alias("_s")).select(key, "_s.*")


def review_row(items: DataFrame, id_col: str, half: Column, start: Column, end: Column, score: Column, source: Column) -> DataFrame:
    """id, half, clock_start, clock_end, retrieval_score, provenance and problem (a score that is there but no finite number)."""
    number = F.when(~F.lower(score.cast("string")).isin("true", "false"), score.cast("string").try_cast("double"))
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    problem = F.when(score.isNotNull() & number.isNull(), "score is not numeric").when(score.isNotNull() & finite.isNull(), "score is not finite")
    clock = lambda s: match_clock(half, F.greatest(s, F.lit(0.0)))
    return items.select(id_col, half.alias("half"), clock(start).alias("clock_start"), clock(end).alias("clock_end"), finite.alias("retrieval_score"), source.alias("provenance"), problem.alias("problem"))


def collected(items: DataFrame, fatal: Column, excluded: Column) -> DataFrame:
    """Adds status and reason: a fatal problem of any row fails the query; an excluded row stays, with its reason, and doesn't count.

    ``fatal`` and ``excluded`` are texts, null where all is well.
    """
    stop = F.when(fatal.isNotNull(), F.raise_error(F.concat(F.lit("configuration: "), fatal)))
    reason = F.coalesce(stop.cast("string"), excluded)
    return items.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("excluded"))


def neutral_config(matches: DataFrame, match: str) -> DataFrame:
    """The configuration of a match that nobody has reviewed: neutral names and no mapping of clusters."""
    return matches.select(match, F.lit("unreviewed").alias("mapping_status"), F.lit(None).cast("map<int,string>").alias("clusters"), F.lit("left").alias("left_name"), F.lit("right").alias("right_name"), F.lit(None).cast("string").alias("problem"))


def explicit_config(matches: DataFrame, match: str, cluster_0: Column, cluster_1: Column) -> DataFrame:
    """A reviewed configuration from two club names; problem where one is empty or both are the same club."""
    a, b = F.trim(cluster_0), F.trim(cluster_1)
    problem = F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "empty name").when(canonical_name(a) == canonical_name(b), "same club")
    clusters = F.create_map(F.lit(0), F.lit("left"), F.lit(1), F.lit("right"))
    return matches.select(match, F.lit("reviewed").alias("mapping_status"), clusters.alias("clusters"), a.alias("left_name"), b.alias("right_name"), problem.alias("problem"))


def bijection(clusters: Column) -> Column:
    """Whether a map takes the clusters 0 and 1 to left and right, each to its own."""
    keys, values = F.sort_array(F.map_keys(clusters)), F.sort_array(F.map_values(clusters))
    return F.coalesce((keys == F.array(F.lit(0), F.lit(1))) & (values == F.array(F.lit("left"), F.lit("right"))), F.lit(False))


def abstention(reason: Column) -> Column:
    """The record that stands for an answer which stayed invalid: unknown in all, with the reason as evidence against."""
    no, none = F.lit(False), F.array().cast("array<string>")
    return F.struct(
        *[F.lit("unknown").alias(c) for c in ("participant_type", "role", "label")], F.lit(True).alias("abstain"),
        *[no.alias(c) for c in ("kit_visible", "identity_visible", "official_evidence_visible", "goalkeeper_seed_available", "goalkeeper_kit_match")],
        none.alias("matched_seed_images"), F.lit(0).alias("consistent_crop_count"), none.alias("primary_visual_cues"),
        F.array(F.concat(F.lit("Persistent validation failure: "), reason)).alias("contradicting_evidence"), F.lit("Abstained after repeated invalid model responses.").alias("reason"),
    )


def label_problem(label: Column, abstain: Column, crops: Column, cues: Column, allowed: list[str]) -> Column:
    """The first reason against a labeller's answer, null where it holds: enumeration, abstention that agrees, evidence."""
    return (
        F.when(~F.coalesce(label.isin(*allowed, "unknown"), F.lit(False)), "label is not allowed")
        .when(abstain.isNull(), "abstain is not a boolean")
        .when(abstain != (label == "unknown"), "abstain and label disagree")
        .when(crops.isNull() | (crops < 0), "crop count is not a whole number")
        .when(~abstain & (crops == 0), "no consistent crop")
        .when(~abstain & (F.coalesce(F.size(cues), F.lit(0)) <= 0), "no visual cue")
    )


def internal_team(cluster: Column, side: Column, clusters: Column) -> Column:
    """The internal team of a row by its cluster; without a mapped cluster its side, if that is one of the two."""
    return F.coalesce(F.try_element_at(clusters, cluster), F.when(side.isin("left", "right"), side))


def labelled_report(truth: DataFrame, predicted: DataFrame, matches: DataFrame, frame: list[str], switches: DataFrame, score: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, mean_iou of the matches and id_switches."""
    totals = [truth.agg(F.count("*").alias("n_truth")), predicted.agg(F.count("*").alias("n_predicted")), matches.agg(F.count("*").alias("tp"), F.avg(score).alias("mean_iou")), switches.agg(F.coalesce(F.sum("switches"), F.lit(0)).alias("id_switches"))]
    row = totals[0]
    for t in totals[1:]:
        row = row.crossJoin(F.broadcast(t))  # one row each
    p, r = (F.coalesce(F.try_divide(F.col("tp"), F.col(n)), F.lit(0.0)) for n in ("n_predicted", "n_truth"))
    return row.select("tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), "id_switches")


def rolled_up(rows: DataFrame, experiment: str, metrics: list[str]) -> DataFrame:
    """Per experiment the mean of every metric that all its rows have, and place: by f1, then retention, falling (without one last), then name."""
    means = [F.when(F.count(m) == F.count("*"), F.avg(m)).alias(m) for m in metrics]
    g = rows.groupBy(experiment).agg(F.count("*").alias("clips"), *means)
    order = [F.desc_nulls_last(m) for m in ("f1", "retention") if m in metrics]
    return g.withColumn("place", F.row_number().over(Window.orderBy(*order, experiment)))  # one row per experiment


def signals_agree(distances_a: Column, distances_b: Column) -> Column:
    """Whether two maps from label to distance have the same nearest label (of equal distances the smaller label)."""
    nearest = lambda m: F.array_min(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))["key"]
    return nearest(distances_a) == nearest(distances_b)
