"""Range, nearest-row, overlap and precedence joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 10_000_000


def is_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table's rows, written as JSON, have no more than ``most_bytes``; no more rows than fit are looked at."""
    limit = most_bytes // 16
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("size")).first()
    return seen.n <= limit and seen.size <= most_bytes


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only what is measured and found small; otherwise Spark plans the join itself."""
    return F.broadcast(df) if is_small(df) else df


def lookup(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A fact table with the columns of a dimension, broadcast if it is small."""
    return facts.join(_small(dimension), on, how)


def overlap_anti(windows: DataFrame, events: DataFrame, on: list[str], start: str, end: str, at: str, margin: float, width: float) -> DataFrame:
    """Windows of a key without an event from ``start - margin`` to ``end + margin``.

    Both sides carry the number of a ``width``-wide cell of the axis beside the key, so a
    long timeline is spread over tasks and only events of the same cells are compared.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    keyed = windows.withColumn("_id", F.struct(*on, start, end))
    low, high = F.col(start) - margin, F.col(end) + margin
    spread = keyed.select(*on, start, end, F.explode(F.sequence(cell(low), cell(high))).alias("_cell"))
    marks = events.select(*on, F.col(at).alias("_at"), cell(F.col(at)).alias("_cell")).distinct()
    hit = spread.join(marks, [*on, "_cell"]).where((F.col("_at") >= low) & (F.col("_at") <= high)).select(*on, start, end).distinct()
    return windows.join(hit, [*on, start, end], "left_anti")


def range_join(points: DataFrame, windows: DataFrame, on: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points beside the windows of their key with ``start <= at < end``, met through cells of the axis."""
    cell = lambda c: F.floor(c / width).cast("long")
    spread = windows.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    return points.withColumn("_cell", cell(F.col(at))).join(spread, [*on, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Each left row with the value and place of the nearest right row of its key; of equally near ones the earlier.

    The nearest row at or before and the nearest after come from two sorted passes, forwards
    and backwards, over the union of both sides, so no pair but these is ever formed. Beyond
    the tolerance both are null; rows without any right row stay.
    """
    from pyspark.sql import Window

    lt = left.withColumn("_at", F.col(left_at).cast("double")).withColumn("_row", F.struct(*left.columns))
    a = lt.select(*on, "_at", F.lit(1).alias("_side"), "_row", F.lit(None).cast("double").alias("_place"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    rt = right.groupBy(*on, F.col(right_at).cast("double").alias("_at")).agg(F.min(value).alias("_value"))
    b = rt.select(*on, "_at", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col("_at").alias("_place"), "_value")
    order, back_to_front = Window.partitionBy(*on).orderBy("_at", "_side"), Window.partitionBy(*on).orderBy(F.desc("_at"), F.desc("_side"))
    pair = F.when(F.col("_side") == 0, F.struct("_place", "_value"))
    both = a.union(b).withColumn("_pair", pair)
    both = both.withColumn("_before", F.last("_pair", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_after", F.last("_pair", ignorenulls=True).over(back_to_front.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    back, ahead = F.col("_at") - F.col("_before._place"), F.col("_after._place") - F.col("_at")
    chosen = F.when(ahead < F.coalesce(back, F.lit(float("inf"))), F.col("_after")).otherwise(F.col("_before"))
    both = both.withColumn("_chosen", chosen)
    gap = F.abs(F.col("_at") - F.col("_chosen._place"))
    near = F.lit(True) if tolerance is None else gap <= tolerance
    return both.select("_row.*", F.when(near, F.col("_chosen._place")).alias("nearest_at"), F.when(near, F.col("_chosen._value")).alias("nearest_value"))


def nearest_in_group(events: DataFrame, points: DataFrame, on: list[str], ex: str, ey: str, px: str, py: str, value: str) -> DataFrame:
    """The nearest point of its group to each event, as a grouped minimum; of equally near ones the smallest value."""
    distance = F.sqrt(F.pow(F.col(px) - F.col(ex), 2) + F.pow(F.col(py) - F.col(ey), 2))
    return events.join(points, on).withColumn("_d", distance).groupBy(*events.columns).agg(F.min("_d").alias("distance"), F.min_by(value, F.struct("_d", value)).alias("nearest"))


def precedence(base: DataFrame, sources: list[tuple[str, DataFrame]], on: list[str], value: str, default: str) -> DataFrame:
    """Left joins of several sources of one value; the first that has it wins and is named in ``source``."""
    out, columns = base, []
    for name, df in sources:
        column = f"_{name}"
        out = out.join(df.select(*on, F.col(value).alias(column)), on, "left")
        columns.append((name, column))
    source: Column = F.lit("default")
    for name, column in reversed(columns):
        source = F.when(F.col(column).isNotNull(), name).otherwise(source)
    return out.withColumn("source", source).withColumn(value, F.coalesce(*[F.col(c) for _, c in columns], F.lit(default))).drop(*[c for _, c in columns])


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Keys that are wanted and not present."""
    return wanted.select(*on).distinct().join(present, on, "left_anti")


def by_position(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two aligned tables by an explicit row number; a length mismatch shows as null in ``aligned``."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    return a.join(b, on, "full").withColumn("aligned", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def track_similarity(old: DataFrame, new: DataFrame, on: list[str], old_track: str, new_track: str, iou: Column) -> DataFrame:
    """For every pair of an old and a new track that share a frame: shared frames and mean overlap."""
    return old.join(new, on).groupBy(old_track, new_track).agg(F.count("*").alias("shared"), F.avg(iou).alias("mean_iou"))
