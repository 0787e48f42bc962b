"""Model queries: a label's vectors are a fixture's tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosted as B
from ..operators import folds as O
from ..operators import identity as I
from ..operators import teams as M
from ..sources.scratch import keep
from ..sources.tables import table
from .registry import query

ROLES = {"goalkeeper": "p_goalkeeper", "other": "p_other", "outfield": "p_outfield"}
LEAST, LEAST_MARGIN, STRENGTH = 0.34, 0.03, 0.6


def tracks(spark, sf_dir):
    """Vectors with made detections and role probabilities out of their own components."""
    e = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    weights = [F.exp(2 * F.col("embedding")[i].cast("double")) for i in range(3)]
    whole = weights[0] + weights[1] + weights[2]
    return e.select(
        "vec_id", "label", "embedding", (F.abs(F.hash("vec_id")) % 40 + 1).alias("detections"), (F.col("embedding")[3] > 0).alias("votes"),
        *[(w / whole).alias(c) for c, w in zip(ROLES.values(), weights, strict=True)],
    ).withColumnRenamed("label", "fixture")


@query()
def fixture_teams(spark, sf_dir):
    t = tracks(spark, sf_dir)
    sure = M.eligible(t, "fixture", "vec_id", "p_outfield", "detections", LEAST).withColumn("weight", F.least("detections", F.lit(25)))
    centres = M.two_means(sure, "fixture", "vec_id", "embedding", "weight")
    labelled = M.team_labels(t, centres, "fixture", "embedding", ROLES, LEAST, LEAST_MARGIN)
    out = M.relabel_excess(labelled, "fixture", "vec_id", "detections", "p_outfield", "votes", LEAST, LEAST_MARGIN, STRENGTH)
    return out.select("vec_id", "fixture", "cluster", F.round("margin", 6).alias("margin"), "role", F.round("role_confidence", 6).alias("role_confidence"), "goalkeeper", "label", "relabelled")


def statistics(spark, sf_dir):
    """doc_id, source, quality, toxic and the statistics of a labelled document's text, written once: fits read them many times."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", "source", "quality", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))  # used four times, so Spark keeps it a column of its own
    text, words = F.col("text"), F.col("words")
    length = F.greatest(F.length(text), F.lit(1))
    kept = lambda allowed: F.length(F.regexp_replace(text, f"[^{allowed}]+", ""))
    numbers = [
        F.log(length), F.log(F.size(words) + F.lit(1)), F.try_divide(F.length(F.array_join(words, "")), F.size(words)), F.try_divide(F.size(F.array_distinct(words)), F.size(words)),
        kept("0-9") / length, kept("A-Z") / length, F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]+", "")) / length, kept("\\n") / length, kept(".!?") / length,
    ]
    x = F.array(*[F.coalesce(n.cast("double"), F.lit(0.0)) for n in numbers])
    return keep(d.select("doc_id", "source", "quality", "toxic", x.alias("x")), "statistics")[0]


@query()
def left_out_report(spark, sf_dir):
    guesses, skipped = O.leave_one_group_out(statistics(spark, sf_dir), "doc_id", "source", "x", "quality")
    report = I.fold_report(guesses.withColumn("fold", F.explode(F.array("group", F.lit("all")))), "fold", "actual", "guess", "confidence", 0.8)
    report = report.select("fold", "rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "accepted", "accepted_accuracy")], F.lit(False).alias("skipped"))
    left = spark.createDataFrame([(g, True) for g in skipped], "fold string, skipped boolean")
    return report.unionByName(left, allowMissingColumns=True)


@query()
def boosted_roles(spark, sf_dir):
    role = F.when(F.col("quality") == 0, "other").when(F.col("toxic") == 1, "goalkeeper").otherwise("outfield")
    rows = statistics(spark, sf_dir).withColumn("role", role).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 0)
    model = B.fit(rows.where(~F.col("held_out")), "x", "role", rounds=20, rate=0.2, depth=3)
    guesses = B.predict(model, rows, "doc_id", "x").withColumnRenamed("id", "doc_id")
    sure = F.round(F.array_max("probabilities"), 6).alias("confidence")
    return rows.select("doc_id", "held_out", "role").join(guesses, "doc_id").select("doc_id", "held_out", "role", "guess", sure)
