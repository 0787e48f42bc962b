"""Robust, tie-aware and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def robust_anchor(df: DataFrame, keys: list[str], value: str, frame: str) -> DataFrame:
    """Per group: median, median absolute deviation, observations and distinct frames."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("observations"), F.countDistinct(frame).alias("frames"))
    spread = df.join(middle.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return middle.join(spread, keys)


def two_way_vote(df: DataFrame, keys: list[str], side: Column, weight: Column, least_rows: int, least_share: float) -> DataFrame:
    """Weighted vote between +1 and -1 with abstention: weights, counts, confidence, margin, direction (null: abstains), status.

    A tie goes to -1. The winner needs the share of the weight and as many rows.
    """
    plus, minus = (F.coalesce(F.sum(F.when(side == s, weight)), F.lit(0.0)) for s in (1, -1))
    counts = [F.count_if(side == s) for s in (1, -1)]
    v = df.groupBy(*keys).agg(plus.alias("weight_plus"), minus.alias("weight_minus"), counts[0].alias("n_plus"), counts[1].alias("n_minus"), F.count("*").alias("n_all"))
    total = F.col("weight_plus") + F.col("weight_minus")
    wins = F.col("weight_plus") > F.col("weight_minus")
    confidence = F.when(total > 1e-9, F.greatest("weight_plus", "weight_minus") / total).otherwise(0.0)
    v = v.withColumn("confidence", confidence).withColumn("margin", F.when(total > 1e-9, F.abs(F.col("weight_plus") - F.col("weight_minus")) / total).otherwise(0.0))
    few = (F.col("n_plus") + F.col("n_minus") < least_rows) | (total <= 1e-9)
    good = (F.col("confidence") >= least_share) & (F.when(wins, F.col("n_plus")).otherwise(F.col("n_minus")) >= least_rows)
    status = F.when(few, "insufficient").when(good, "calibrated").otherwise("conflicting")
    v = v.withColumn("status", status)
    return v.withColumn("direction", F.when(F.col("status") == "calibrated", F.when(wins, 1).otherwise(-1)))


def smallest_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the smallest."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias("mode"))


def first_seen_majority(df: DataFrame, keys: list[str], label: str, position: str) -> DataFrame:
    """The most frequent label; of equally frequent ones the one seen first."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("majority"), F.max("n").alias("votes"), F.sum("n").alias("total"))


def vocabulary_majority(df: DataFrame, keys: list[str], label: str, vocabulary: list[str]) -> DataFrame:
    """The most frequent label; of equally frequent ones the earlier in the vocabulary."""
    rank = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col(label))
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", -rank)).alias("majority"), F.max("n").alias("votes"))


def window_summary(df: DataFrame, keys: list[str], label: str, confidence: str, position: str, vocabulary: list[str]) -> DataFrame:
    """Per window: majority, agreement, mean confidence of the majority and its representative row.

    The representative has the highest confidence; of equal ones the one nearest to the
    middle of the window, then the earlier.
    """
    top = vocabulary_majority(df, keys, label, vocabulary)
    spans = df.groupBy(*keys).agg(F.count("*").alias("rows"), ((F.min(position) + F.max(position)) / 2).alias("middle"))
    chosen = df.join(top, keys).where(F.col(label) == F.col("majority")).join(spans, keys)
    order = F.struct(-F.col(confidence), F.abs(F.col(position) - F.col("middle")), F.col(position))
    out = chosen.groupBy(*keys).agg(F.first("majority").alias("majority"), F.first("votes").alias("votes"), F.first("rows").alias("rows"), F.avg(confidence).alias("confidence"), F.min_by(position, order).alias("representative"))
    return out.withColumn("agreement", F.col("votes") / F.col("rows"))


def complete_minimum(value: str) -> Column:
    """The least value, but only where every row has one."""
    return F.when(F.count(value) == F.count("*"), F.min(value))


def complete_mean(value: str) -> Column:
    """The mean, but only where every row has a value."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def distinct_sorted(value: str) -> Column:
    return F.sort_array(F.collect_set(value))


def continuity(detections: DataFrame, frames: DataFrame, clip: str, frame: str, track: str) -> DataFrame:
    """Tracking continuity per clip; frames without detections count and interrupt adjacency.

    frames, detections, mean_per_frame, median_per_frame, empty_rate, plausible_rate (6 to
    22), tracks, median_track_length, short_rate (under 5), retention (tracks of a frame
    that are in the next one).
    """
    per = detections.groupBy(clip, frame).agg(F.count("*").alias("n"), F.collect_set(track).alias("ids"))
    seen = frames.join(per, [clip, frame], "left").select(clip, frame, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.array().cast(per.schema["ids"].dataType)).alias("ids"))
    before = F.lag("ids").over(Window.partitionBy(clip).orderBy(frame))
    seen = seen.withColumn("kept", F.size(F.array_intersect(before, "ids"))).withColumn("from", F.size(before)).withColumn("from", F.when(F.col("from") > 0, F.col("from")))
    a = seen.groupBy(clip).agg(
        F.count("*").alias("frames"), F.sum("n").alias("detections"), F.avg("n").alias("mean_per_frame"), F.median("n").alias("median_per_frame"),
        share(F.col("n") == 0).alias("empty_rate"), share(F.col("n").between(6, 22)).alias("plausible_rate"),
        F.coalesce(F.sum(F.when(F.col("from") > 0, F.col("kept"))) / F.sum("from"), F.lit(0.0)).alias("retention"),
    )
    lengths = detections.where(F.col(track).isNotNull()).groupBy(clip, track).agg(F.countDistinct(frame).alias("length"))
    b = lengths.groupBy(clip).agg(F.count("*").alias("tracks"), F.median("length").alias("median_track_length"), share(F.col("length") < 5).alias("short_rate"))
    return a.join(b, clip, "left").withColumns({"tracks": F.coalesce("tracks", F.lit(0)), "median_track_length": F.coalesce("median_track_length", F.lit(0.0)), "short_rate": F.coalesce("short_rate", F.lit(1.0))})


def detection_scores(matched: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1 from columns tp, fp, fn summed per key."""
    s = matched.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def precision_at(ranked: DataFrame, keys: list[str], order: list[Column], relevant: str, ks: list[int]) -> DataFrame:
    """Per key and k: the share of relevant rows among the first k (over as many as there are, not over k)."""
    rows = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= max(ks))
    spread = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("_rank <= k")
    return spread.groupBy(*keys, "k").agg(F.count("*").alias("n"), F.avg(F.col(relevant).cast("double")).alias("precision"))


def coverage_accuracy(truth: DataFrame, predicted: DataFrame, on: list[str], actual: str, guess: str, confidence: str, least: float) -> DataFrame:
    """One row: n, covered (confident predictions), coverage, accuracy among them, accuracy over all."""
    j = truth.join(predicted, on, "left")
    sure = F.coalesce(F.col(confidence) >= least, F.lit(False))
    right = F.coalesce(F.col(actual) == F.col(guess), F.lit(False))
    return j.agg(
        F.count("*").alias("n"), F.count_if(sure).alias("covered"), share(sure).alias("coverage"),
        F.coalesce(F.try_divide(F.count_if(sure & right), F.count_if(sure)), F.lit(0.0)).alias("covered_accuracy"), share(right).alias("accuracy"),
    )


def confusion(df: DataFrame, actual: str, guess: str, missing: str = "missing") -> DataFrame:
    """actual, predicted, n; rows without a prediction count as ``missing``."""
    return df.groupBy(F.col(actual).cast("string").alias("actual"), F.coalesce(F.col(guess).cast("string"), F.lit(missing)).alias("predicted")).agg(F.count("*").alias("n"))


def calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence, accuracy and weighted gap per bin [low, low + 1/bins); a confidence of exactly 1 falls in no bin."""
    bin_ = F.floor(F.col(confidence) * bins).cast("int")
    kept = df.withColumn("_bin", bin_).where(F.col(confidence).isNotNull() & F.col("_bin").between(0, bins - 1))
    total = df.agg(F.count("*").alias("_all"))
    g = kept.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    return g.crossJoin(F.broadcast(total)).select(F.col("_bin").alias("bin"), "n", "confidence", "accuracy", (F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / F.col("_all")).alias("gap"))


def vector_median(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Elementwise median of a group's vectors, scaled to length one."""
    flat = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    medians = flat.groupBy(*keys, "dim").agg(F.median("x").alias("m"))
    sums = medians.groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("pairs"))
    return sums.select(*keys, F.transform("pairs", lambda p: p["m"] / F.greatest(F.col("norm"), F.lit(1e-12))).alias("vector"))


def exact_median(df: DataFrame, key: str, value: str, parts: int = 1024) -> DataFrame:
    """key, median of a key's non-null values, for a few keys of many rows each.

    Values are counted in equal parts of their key's range; only the parts that hold the
    middle are looked at more closely, as counts of distinct values, so no task holds a key's values.
    """
    known = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_x"))
    ranges = known.groupBy(key).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("_n"))
    part = F.least(F.lit(parts - 1), F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts))
    placed = known.join(ranges, key).withColumn("_part", F.when(F.col("_high") > F.col("_low"), part).otherwise(0).cast("int"))
    sums = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_c"), F.first("_n").alias("_all"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(sums), F.lit(0)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    middle = counts.where((F.col("_before") <= high) & (F.col("_before") + F.col("_c") > low)).select(key, "_part", "_before", "_all")  # two rows a key at most
    values = placed.select(key, "_part", "_x").join(middle, [key, "_part"]).groupBy(key, "_part", "_x").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_all").alias("_all"))
    inside = Window.partitionBy(key, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    holds = lambda r: (F.col("_at") <= r) & (F.col("_at") + F.col("_c") > r)
    found = values.where(holds(low) | holds(high))
    return found.groupBy(key).agg(((F.min("_x") + F.max("_x")) / 2).alias("median"))


def robust_scale(df: DataFrame, vector: str) -> DataFrame:
    """dim, centre, scale over all rows: median and 1.4826 times the median absolute deviation, 1 where that is below 1e-5."""
    flat = df.select(F.posexplode(vector).alias("dim", "x"))
    centre = exact_median(flat, "dim", "x").withColumnRenamed("median", "centre")
    off = flat.join(centre, "dim").select("dim", F.abs(F.col("x") - F.col("centre")).alias("off"))
    mad = exact_median(off, "dim", "off").join(centre, "dim").select("dim", "centre", (F.col("median") * 1.4826).alias("s"))
    return mad.select("dim", "centre", F.when(F.col("s") < 1e-5, 1.0).otherwise(F.col("s")).alias("scale"))


def outlier_limit(df: DataFrame, keys: list[str], value: str, floor: float = 18.0, times: float = 4.0) -> DataFrame:
    """Per group the limit beyond which a value is an outlier: the median and some robust deviations, at least ``floor``."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    mad = df.join(middle, keys).groupBy(*keys).agg(F.first("median").alias("median"), (1.4826 * F.median(F.abs(F.col(value) - F.col("median")))).alias("s"))
    return mad.select(*keys, F.greatest(F.lit(floor), F.col("median") + times * F.greatest(F.lit(1.0), F.col("s"))).alias("limit"))


def acceptance_radius(df: DataFrame, keys: list[str], distance: str, seed: Column) -> DataFrame:
    """The greater of the 0.9 quantile with 15 % and the largest seed distance with 5 % on top."""
    return df.groupBy(*keys).agg(F.greatest(F.percentile(distance, 0.9) * 1.15, F.coalesce(F.max(F.when(seed, F.col(distance))) * 1.05, F.lit(0.0))).alias("radius"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies with mean 1 over the classes."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    inverse = 1 / F.col("n")
    return n.select(label, "n", (inverse / F.avg(inverse).over(Window.partitionBy())).alias("weight"))


def track_quality(n: Column, area: Column, confidence: Column) -> Column:
    return F.log1p(n) * F.sqrt(area) * confidence


def chain_class(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One label per group: the first rule that some row meets; groups that meet none are dropped."""
    flags = df.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(f"_r{k}") for k, (_, c) in enumerate(rules)])
    label = F.lit(None).cast("string")
    for k, (name, _) in reversed(list(enumerate(rules))):
        label = F.when(F.col(f"_r{k}"), name).otherwise(label)
    return flags.select(*keys, label.alias("label")).where("label is not null")
