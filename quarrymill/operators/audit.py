"""Checks that report instead of failing halfway: completeness, constancy, status and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order; a null rule is broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())


def first_problem(rules: dict[str, Column]) -> Column:
    return F.get(problems(rules), F.lit(0))


def outcome_counts(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """One row: total, a count per known status, others, and whether they add up."""
    per = [F.count_if(F.col(status) == s).alias(s) for s in known]
    c = df.agg(F.count("*").alias("total"), *per, F.count_if(~F.coalesce(F.col(status).isin(known), F.lit(False))).alias("others"))
    return c.withColumn("complete", sum((F.col(s) for s in known), F.lit(0)) == F.col("total"))


def with_status(manifest: DataFrame, status: DataFrame, on: list[str], column: str, terminal: list[str]) -> DataFrame:
    """Manifest rows with their status and its kind: terminal, waiting, or missing."""
    j = manifest.join(status.select(*on, column), on, "left")
    return j.withColumn("kind", F.when(F.col(column).isNull(), "missing").when(F.col(column).isin(terminal), "terminal").otherwise("waiting"))


def unreferenced(assets: DataFrame, references: list[tuple[DataFrame, str]], name: str) -> DataFrame:
    """Assets that no referencing column names."""
    used = None
    for df, column in references:
        part = df.select(F.col(column).alias(name))
        used = part if used is None else used.union(part)
    return assets.join(used.distinct(), name, "left_anti")


def constant_per(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per key how many distinct values there are and whether it is one."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("values")).withColumn("constant", F.col("values") == 1)


def rule_violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Per key the rows and how many break each rule."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def expected_keys(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """All expected keys with whether they are present."""
    have = present.select(*on).distinct().withColumn("present", F.lit(True))
    return expected.select(*on).distinct().join(have, on, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def first_positive(*values: Column) -> Column:
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def changed(jobs: DataFrame, done: DataFrame, on: list[str], signature: str) -> DataFrame:
    """Jobs whose signature isn't the one that was done, or that never ran."""
    return jobs.join(done.select(*on, F.col(signature).alias("_done")), on, "left").where(~F.col(signature).eqNullSafe(F.col("_done"))).drop("_done")
