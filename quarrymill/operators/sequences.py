"""Order-dependent operators: windows over rows and ranges, islands, gaps, and the few that are sequential by nature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_vote(df: DataFrame, keys: list[str], order: str, label: str, radius: int = 6, least: float = 0.54, abstain: str = "abstain") -> DataFrame:
    """Adds voted and support: the majority of the raw labels within ``radius`` rows.

    Abstaining rows neither vote nor change. The majority is taken over if its share of the
    votes reaches ``least``; of equally frequent labels the one first in the window counts.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    votes = F.collect_list(F.when(F.col(label) != abstain, F.col(label))).over(frame)
    df = df.withColumn("_votes", votes)
    counted = F.transform(F.array_distinct("_votes"), lambda v: F.struct(F.size(F.filter("_votes", lambda x: x == v)).alias("n"), (-F.array_position("_votes", v)).alias("first"), v.alias("label")))
    best = F.array_max(counted)
    support = best["n"] / F.size("_votes")
    take = (F.col(label) != abstain) & (support >= least)
    return df.withColumn("voted", F.when(take, best["label"]).otherwise(F.col(label))).withColumn("support", F.when(take, support)).drop("_votes")


def moving_median_rows(df: DataFrame, keys: list[str], order: str, value: str, radius: int = 3) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn("smoothed", F.percentile(value, 0.5).over(frame))


def moving_median_range(df: DataFrame, keys: list[str], axis: str, value: str, radius: int = 2) -> DataFrame:
    """The median of the rows whose axis value is within ``radius``."""
    frame = Window.partitionBy(*keys).orderBy(axis).rangeBetween(-radius, radius)
    return df.withColumn("smoothed", F.percentile(value, 0.5).over(frame))


def velocity(df: DataFrame, keys: list[str], order: str, value: str, limit: float = 0.2) -> DataFrame:
    """Change since the key's previous observation over the steps between, within +-limit; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = (F.col(value) - F.lag(value).over(w)) / (F.col(order) - F.lag(order).over(w))
    return df.withColumn("velocity", F.coalesce(F.greatest(F.lit(-limit), F.least(F.lit(limit), v)), F.lit(0.0)))


def id_switches(df: DataFrame, keys: list[str], order: str, prediction: str) -> DataFrame:
    """Per key: how often the prediction differs from the last one that there was."""
    known = df.where(F.col(prediction).isNotNull())
    before = F.lag(prediction).over(Window.partitionBy(*keys).orderBy(order))
    return known.withColumn("_switch", F.coalesce(F.col(prediction) != before, F.lit(False))).groupBy(*keys).agg(F.count_if("_switch").alias("switches"))


def islands(df: DataFrame, keys: list[str], order: str, label: str, least: int = 1, *more: Column) -> DataFrame:
    """Runs of one label in consecutive frames: start, end, rows and ``more`` aggregates; runs under ``least`` rows are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.lag(order).over(w) + 1 == F.col(order))).cast("int")
    marked = df.withColumn("_island", F.sum(1 - F.coalesce(new, F.lit(0))).over(w))
    g = marked.groupBy(*keys, "_island", label).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("rows"), *more)
    return g.where(F.col("rows") >= least).drop("_island")


def bridge_gaps(df: DataFrame, keys: list[str], order: str, value: str, confidence: str, longest: int = 5, loss: float = 0.65) -> DataFrame:
    """Observed rows and straight-line points for gaps of at most ``longest`` frames, with the ends' least confidence lowered."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = df.withColumn("_n", F.lead(order).over(w)).withColumn("_v", F.lead(value).over(w)).withColumn("_c", F.lead(confidence).over(w))
    gap = F.col("_n") - F.col(order)
    fill = nxt.where((gap > 1) & (gap <= longest + 1)).withColumn("_f", F.explode(F.sequence(F.col(order) + 1, F.col("_n") - 1)))
    ratio = (F.col("_f") - F.col(order)) / gap
    filled = fill.select(*keys, F.col("_f").alias(order), (F.col(value) + ratio * (F.col("_v") - F.col(value))).alias(value), (F.least(confidence, "_c") * loss).alias(confidence), F.lit("interpolated").alias("method"))
    return df.select(*keys, order, value, confidence, F.lit("detected").alias("method")).unionByName(filled)


def fill_or_hold(df: DataFrame, keys: list[str], order: str, value: str, widest: int = 8, hold: int = 4) -> DataFrame:
    """Rows without a value get a straight line inside gaps of at most ``widest`` frames, else the nearest value within ``hold``.

    Adds filled and method (observed, interpolated, held, or null). Of two equally near values the earlier is held.
    """
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # back to front

    def ends(d: DataFrame, point: Column, tag: str) -> DataFrame:
        return d.withColumn(f"_b{tag}", F.last(point, True).over(back)).withColumn(f"_a{tag}", F.last(point, True).over(ahead))

    d = ends(df, F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("f"), F.col(value).alias("v"))), "1")
    span = F.col("_a1.f") - F.col("_b1.f")
    line = F.col("_b1.v") + (F.col(order) - F.col("_b1.f")) / span * (F.col("_a1.v") - F.col("_b1.v"))
    d = d.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(span <= widest, line))
    d = ends(d, F.when(F.col("filled").isNotNull(), F.struct(F.col(order).alias("f"), F.col("filled").alias("v"))), "2")
    before, after = F.col(order) - F.col("_b2.f"), F.col("_a2.f") - F.col(order)
    far = F.lit(1 << 40)
    near = F.when(F.coalesce(after, far) < F.coalesce(before, far), F.col("_a2")).otherwise(F.col("_b2"))
    held = F.when(F.least(F.coalesce(before, far), F.coalesce(after, far)) <= hold, near["v"])
    method = F.when(F.col(value).isNotNull(), "observed").when(F.col("filled").isNotNull(), "interpolated").when(held.isNotNull(), "held")
    return d.withColumn("method", method).withColumn("filled", F.coalesce("filled", held)).drop("_a1", "_b1", "_a2", "_b2")


def scan_windows(spans: DataFrame, duration: str, length: float, stride: float, first: float = 8.0) -> DataFrame:
    """Windows of ``length`` every ``stride`` from ``first`` on that end within the duration: start, end."""
    n = F.floor((F.col(duration) - length - first) / stride).cast("int")
    k = F.explode(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")))
    return spans.withColumn("_k", k).withColumn("start", first + F.col("_k") * stride).withColumn("end", F.col("start") + length).drop("_k")


def excerpt_starts(n: Column, span: int, stride: int) -> Column:
    """Starts of windows over n frames every ``stride``, with a last one that ends at the end."""
    last = F.greatest(F.lit(0), n - F.least(F.lit(span), n)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def lifetime_best(df: DataFrame, keys: list[str], order: str, quality: str, buckets: int) -> DataFrame:
    """The row of best quality in each of ``buckets`` parts of a key's lifetime (all rows of keys with no more than that)."""
    w = Window.partitionBy(*keys).orderBy(order)
    cut = df.withColumn("_part", F.ntile(buckets).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    cut = cut.withColumn("_part", F.when(F.col("_n") > buckets, F.col("_part")).otherwise(F.row_number().over(w)))
    best = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.desc(quality), order))
    return cut.withColumn("_rank", best).where("_rank = 1").drop("_rank", "_n").withColumnRenamed("_part", "part")


def seed_split(df: DataFrame, keys: list[str], quality: str, id_col: str, seeds: int) -> DataFrame:
    """Adds split: the best ``seeds`` rows of a key are seeds, but one row is left to evaluate; a single row is a seed."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(quality), id_col))
    best = df.select(*keys, id_col, quality).withColumn("_rank", rank).where(F.col("_rank") <= seeds)  # tasks keep no more rows of a key than that
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    chosen = best.join(n, keys).where(F.col("_rank") <= F.when(F.col("_n") > 1, F.least(F.lit(seeds), F.col("_n") - 1)).otherwise(1)).select(*keys, id_col, F.lit("seed").alias("split"))
    return df.join(chosen, [*keys, id_col], "left").withColumn("split", F.coalesce("split", F.lit("evaluation")))


def five_point_windows(df: DataFrame, keys: list[str], frame: str, offsets: tuple[int, ...] = (-25, -12, 0, 12, 25)) -> DataFrame:
    """Adds nearest: for each offset the key's frame nearest to the row's own plus that offset, of equally near ones the earlier.

    The last frame at or before each target and the first at or after come from growing windows
    over the rows themselves, forwards and backwards, so no row is repeated before they are known.
    """
    w, back = Window.partitionBy(*keys).orderBy(frame), Window.partitionBy(*keys).orderBy(F.col(f"_back{frame}"))
    start = Window.unboundedPreceding
    before = [F.max(frame).over(w.rangeBetween(start, o)) for o in offsets]
    after = [F.min(frame).over(back.rangeBetween(start, -o)) for o in offsets]
    d = df.withColumn(f"_back{frame}", -F.col(frame)).withColumn("_before", F.array(*before)).withColumn("_after", F.array(*after))

    def nearer(k: int) -> Column:
        low, high, target = F.col("_before")[k], F.col("_after")[k], F.col(frame) + offsets[k]
        return F.when(high - target < target - low, high).otherwise(F.coalesce(low, high))

    return d.withColumn("nearest", F.array(*[nearer(k) for k in range(len(offsets))])).drop(f"_back{frame}", "_before", "_after")


def step_frames(start: Column, end: Column, step: int) -> Column:
    """Every ``step``-th frame from start, and the last."""
    return F.array_distinct(F.concat(F.sequence(start, end, F.lit(step)), F.array(end)))


# -------------------------------------------------------- sequential by nature


def whole_keys(df: DataFrame, keys: list[str], f, schema, least_rows: int = 0) -> DataFrame:
    """Run a pandas function on rows sorted by key, on as many whole keys at a time as an Arrow batch holds, or
    as make up ``least_rows``.

    A task reads its keys one after another and holds a batch, or so many rows, and the key that goes on in the next one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        ready: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            last = part[keys].iloc[-1]
            same = part[keys].eq(last) | (part[keys].isna() & last.isna())
            begin = len(part) - int(same.all(axis=1).to_numpy()[::-1].cumprod().sum())  # where the last key begins
            if begin or held and not _same_key(held[0], part, keys):
                whole = pd.concat([*held, part.iloc[:begin]]) if held else part.iloc[:begin]
                held = []
                if len(whole):
                    ready.append(whole)
                if ready and sum(map(len, ready)) >= least_rows:
                    yield f(pd.concat(ready) if len(ready) > 1 else ready[0])
                    ready = []
            held.append(part.iloc[begin:])
        if held:
            yield f(pd.concat([*ready, *held]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    x, y = a[keys].iloc[0], b[keys].iloc[0]
    return bool((x.eq(y) | (x.isna() & y.isna())).all())


def per_key(df: DataFrame, keys: list[str], f, schema) -> DataFrame:
    """Run a pandas function on every key's rows."""
    return whole_keys(df, keys, lambda g: pd.concat([f(part) for _, part in g.groupby(keys, sort=False, dropna=False)]), schema)


def greedy_match(pairs: DataFrame, keys: list[str], left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one matches per key by falling score; of equal scores the higher left, then right number goes first.

    A key is one frame: its pairs are as many as boxes can overlap in a picture.
    """

    def match(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, left, right], ascending=False, kind="stable")
        frame = g.groupby(keys, sort=False, dropna=False).ngroup()
        used_l, used_r, kept = set(), set(), []
        for f, a, b in zip(frame, g[left], g[right], strict=True):
            free = (f, a) not in used_l and (f, b) not in used_r
            kept.append(free)
            if free:
                used_l.add((f, a)), used_r.add((f, b))
        return g[kept]

    chosen = pairs.where(F.col(score) >= least).select(*keys, left, right, score)
    return whole_keys(chosen, keys, match, chosen.schema)


def best_path(points: DataFrame, keys: list[str], frame: str, x: str, y: str, confidence: str, diagonal: float, beam: int = 20, gap_limit: int = 8) -> DataFrame:
    """Per key the chain of candidates that balances confidence and steadiness.

    A candidate adds 0.35 + 4 confidence; a step costs 7 times its distance over the
    diagonal and 0.18 for every frame skipped; steps reach over ``gap_limit`` frames at most, and
    only the best ``beam`` chain ends of a frame go on. A key is one clip.
    """

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        """All keys' first frames, then all second ones: a step's pairs of candidate and chain end are one array."""
        g = g.assign(_key=g.groupby(keys, sort=False, dropna=False).ngroup()).sort_values(["_key", frame, x, y], kind="stable").reset_index(drop=True)
        key, f, px, py, gain = g["_key"].to_numpy(), *(g[c].to_numpy(float) for c in (frame, x, y, confidence))
        gain = 0.35 + 4.0 * gain
        score, before = gain.copy(), np.full(len(g), -1)
        new_key = np.diff(key, prepend=-1) != 0
        begin = np.flatnonzero(new_key | (np.diff(f, prepend=np.nan) != 0))  # a cell: the candidates of a key's frame
        size, owner = np.diff(begin, append=len(g)), key[begin]
        first_cell = np.flatnonzero(new_key[begin])
        turn = np.arange(len(begin)) - first_cell[owner]
        order, bounds = np.argsort(turn, kind="stable"), np.append(0, np.cumsum(np.bincount(turn)))
        ends, end_at, end_n = np.zeros(0, int), np.zeros(len(first_cell), int), np.zeros(len(first_cell), int)  # chain ends of each key's last frame
        for step in range(len(bounds) - 1):
            cells = order[bounds[step] : bounds[step + 1]]
            cell = np.repeat(np.arange(len(cells)), size[cells])
            now = np.arange(len(cell)) - np.repeat(np.cumsum(size[cells]) - size[cells], size[cells]) + begin[cells][cell]
            if step:
                near = f[begin[cells]] - f[begin[cells - 1]] <= gap_limit
                fan = np.where(near, end_n[owner[cells]], 0)[cell]
                pair = np.repeat(np.arange(len(now)), fan)
                at = np.arange(len(pair)) - (np.cumsum(fan) - fan)[pair] + end_at[owner[cells]][cell][pair]
                n, e = now[pair], ends[at]
                far = np.hypot(px[n] - px[e], py[n] - py[e]) / diagonal
                total = score[e] + gain[n] - 7.0 * far - 0.18 * (f[n] - f[e] - 1)
                met = np.flatnonzero(fan)
                if len(met):
                    best = np.full(len(now), -np.inf)
                    best[met] = np.maximum.reduceat(total, (np.cumsum(fan) - fan)[met])
                    hit = np.flatnonzero((total == best[pair]) & (best > score[now])[pair])
                    hit = hit[np.diff(pair[hit], prepend=-1) != 0]  # of equal chains the first
                    before[n[hit]], score[n[hit]] = e[hit], total[hit]
            ranked = np.lexsort((-score[now], cell))
            kept = np.arange(len(now)) - np.repeat(np.cumsum(size[cells]) - size[cells], size[cells]) < beam
            ends, end_n[owner[cells]] = now[ranked][kept], np.minimum(size[cells], beam)
            end_at[owner[cells]] = np.cumsum(end_n[owner[cells]]) - end_n[owner[cells]]
        top = np.maximum.reduceat(score, begin[first_cell])[key]
        at = np.flatnonzero((score == top) | np.isnan(score) & np.isnan(top))
        at, chosen = at[np.diff(key[at], prepend=-1) != 0], np.zeros(len(g), bool)
        while len(at):
            chosen[at] = True
            at = before[at]
            at = at[at >= 0]
        return g.loc[chosen].drop(columns="_key")

    chosen = points.select(*keys, frame, x, y, confidence)
    return whole_keys(chosen, keys, walk, chosen.schema, 200_000)


def spaced_best(df: DataFrame, keys: list[str], frame: str, quality: str, apart: int, most: int) -> DataFrame:
    """Rows by falling quality that are at least ``apart`` frames from all taken before, up to ``most`` per key.

    Of one frame only the best row can be taken, and each row taken rules out 2 apart - 1
    frames at most, so no more than the best (most - 1) (2 apart - 1) + 1 of a key are looked at.
    """
    columns = df.columns
    best = df.groupBy(*keys, frame).agg(F.max_by(F.struct(*columns), F.struct(quality, *columns)).alias("_row")).select("_row.*")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(quality), frame))
    df = best.withColumn("_rank", rank).where(F.col("_rank") <= (most - 1) * (2 * apart - 1) + 1).drop("_rank")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        taken: list = []
        kept = []
        for k, at in g.sort_values([quality, frame], ascending=[False, True], kind="stable")[frame].items():
            if all(abs(at - t) >= apart for t in taken):
                taken.append(at)
                kept.append(k)
                if len(kept) == most:
                    break
        return g.loc[kept]

    return per_key(df, keys, pick, df.schema)


def diverse_in_time(df: DataFrame, keys: list[str], frame: str, quality: str, n: int, penalty: float = 0.55) -> DataFrame:
    """Up to n rows per key: for each of n evenly spaced moments the free row of best quality, relative to the best free one, less its relative distance."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([frame, quality], kind="stable").reset_index(drop=True)
        at, good = g[frame].to_numpy(float), g[quality].to_numpy(float)
        span = max(at.max() - at.min(), 1.0)
        free, kept = np.ones(len(g), bool), []
        for target in np.linspace(at.min(), at.max(), min(n, len(g))):
            value = np.where(free, good / max(good[free].max(), 1e-12) - penalty * np.abs(at - target) / span, -np.inf)
            k = int(value.argmax())
            free[k] = False
            kept.append(k)
        return g.loc[sorted(kept)]

    return per_key(df, keys, pick, df.schema)
