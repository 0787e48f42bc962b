"""Identity decisions: seeds over predictions, per-detection identities, acceptance, and reports over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(evidence: DataFrame, predictions: DataFrame, key: str, split: str, reviewed: str, predicted: str) -> DataFrame:
    """label, source, status of every track: a reviewed seed first, else a prediction (an unknown one needs review), else missing."""
    j = evidence.join(predictions.select(key, predicted), key, "left")
    seed = (F.col(split) == "seed") & F.col(reviewed).isNotNull()
    label = F.when(seed, F.col(reviewed)).otherwise(F.coalesce(predicted, F.lit("unknown")))
    source = F.when(seed, "human_seed").when(F.col(predicted).isNotNull(), "model").otherwise("missing")
    status = F.when(seed, "accepted").when(F.coalesce(F.col(predicted) != "unknown", F.lit(False)), "agent_proposal").otherwise("needs_review")
    return j.select(*evidence.columns, label.alias("label"), source.alias("source"), status.alias("status"))


def identify_detections(detections: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Every detection with its track's decision; without a track or decision it is unknown and untracked."""
    d = decisions.select(*on, *[F.col(c).alias(f"_{c}") for c in ("label", "source", "status")])
    j = detections.join(d, on, "left")
    return j.select(*detections.columns, *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in (("label", "unknown"), ("source", "untracked"), ("status", "needs_review"))])


def pressure_label(counterpress: Column, x: Column) -> Column:
    """Counterpress before a high-press position before individual pressure."""
    return F.when(F.coalesce(counterpress, F.lit(False)), "counterpress").when(x >= 80.0, "high_press_candidate").otherwise("individual_pressure")


def acceptance(possession: Column, direction: Column, nodes: Column, confidence: Column) -> Column:
    """The reasons against accepting a prediction, in order."""
    met = {"possession": possession, "attack direction": direction, "visible players": nodes >= 7, "model confidence": confidence >= 0.65}
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in met.items()]), lambda x: x.isNotNull())


def only_other(teams: Column, team: Column) -> Column:
    """The opponent where a match has exactly two teams, else null."""
    rest = F.array_except(teams, F.array(team))
    return F.when(F.size(rest) == 1, rest[0])


def in_all(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Keys that every table has."""
    out = frames[0].select(*on).distinct()
    for df in frames[1:]:
        out = out.join(df.select(*on), on, "left_semi")
    return out


def assign_or_ignore(detections: DataFrame, assignments: DataFrame, on: list[str], team: str) -> DataFrame:
    """Detections with the team of their track; tracks without one are ignored, never guessed."""
    return detections.join(assignments.select(*on, F.col(team).alias("_t")), on, "left").withColumn(team, F.coalesce("_t", F.lit("ignore"))).drop("_t")


def fold_report(df: DataFrame, fold: str, actual: str, guess: str, confidence: str, least: float) -> DataFrame:
    """Per fold: rows, accuracy, balanced accuracy (mean recall over classes), accepted share and accuracy among accepted."""
    right, sure = (F.col(actual) == F.col(guess)), F.col(confidence) >= least
    recall = df.groupBy(fold, actual).agg(F.avg(right.cast("double")).alias("_recall")).groupBy(fold).agg(F.avg("_recall").alias("balanced_accuracy"))
    g = df.groupBy(fold).agg(
        F.count("*").alias("rows"), F.avg(right.cast("double")).alias("accuracy"), F.avg(sure.cast("double")).alias("accepted"),
        F.coalesce(F.try_divide(F.count_if(sure & right), F.count_if(sure)), F.lit(0.0)).alias("accepted_accuracy"),
    )
    return g.join(recall, fold)


def mean_probabilities(df: DataFrame, keys: list[str], probabilities: str, order: str) -> DataFrame:
    """Per key and class the mean probability, with the dominant class of the key (of equal ones the first by name).

    A key's probabilities are added up in ``order``, so that a mean's last bit doesn't depend on
    how tasks share the rows; the running sum goes through a sorted partition and holds no key's list.
    """
    running = Window.partitionBy(*keys, "cls").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    flat = df.select(*keys, order, F.explode(probabilities).alias("cls", "p"))
    summed = flat.withColumn("_sum", F.sum("p").over(running)).withColumn("_n", F.count("p").over(running))
    flat = summed.groupBy(*keys, "cls").agg(F.max_by(F.struct("_sum", "_n"), order).alias("_whole"))
    flat = flat.select(*keys, "cls", F.try_divide("_whole._sum", "_whole._n").alias("p"))
    best = F.first("cls").over(Window.partitionBy(*keys).orderBy(F.desc("p"), "cls"))
    return flat.withColumn("dominant", best)


def labelled_counts(truth: DataFrame, predicted: DataFrame, matches: DataFrame, frame: list[str]) -> DataFrame:
    """tp, fp, fn per frame of the truth from one-to-one matches."""
    t = truth.groupBy(*frame).agg(F.count("*").alias("_t"))
    p = predicted.groupBy(*frame).agg(F.count("*").alias("_p"))
    m = matches.groupBy(*frame).agg(F.count("*").alias("tp"))
    j = t.join(p, frame, "left").join(m, frame, "left").fillna(0, ["_p", "tp"])
    return j.select(*frame, "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"))
