"""Hard negatives: k-means lists with radii, visited by their Cauchy-Schwarz bounds inside a window of scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Rows of a list on average, lists at least and at most, and sampled rows per list that the centroids are fitted on.
LIST_ROWS, FEWEST_LISTS, MOST_LISTS, SAMPLE = 2048, 8, 1024, 32
LLOYD_ROUNDS = 10
#: Rows of a block of a list, and anchors that meet one copy of a block.
BLOCK_ROWS, SLICE_ANCHORS = 4096, 65_536
#: Lists that are visited before the kth score stands for the first time.
FIRST_LISTS = 2
#: Below this every sum of products of whole numbers is exact as a double.
EXACT = 1 << 53
_AT_ONCE = 256  # anchors in one product of matrices


@dataclass
class Lists:
    """Inverted lists: ``rows`` (key, vec_id, label, vec, list, block), centroids, radii, and rows of each list."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.sizes // BLOCK_ROWS)


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and vec (whole numbers, floor of 256 times a component) of rows that have a label and a whole finite vector."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    good = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    vec = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256))
    return good.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), vec.alias("vec"))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly chosen different rows of the sample; a list that loses its rows keeps its place."""
    rows = np.unique(sample, axis=0)
    centroids = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)]
    for _ in range(LLOYD_ROUNDS):
        own = _nearest(sample, centroids)[0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it."""
    own = np.argmin((centroids**2).sum(1) - 2 * vectors @ centroids.T, axis=1)
    return own, np.sqrt(((vectors - centroids[own]) ** 2).sum(1))


def build_lists(vectors: DataFrame) -> Lists:
    """Assign every row (vec_id, label, vec) to the list of its nearest centroid.

    The centroids come from the SAMPLE rows per list that have the least hashes; the radius
    of a list is the greatest distance of any of all its rows, so no bound depends on the
    sample. Vectors shorter than the longest are filled up with zeros. Lists are cut into
    blocks of about BLOCK_ROWS rows by hash, so a list of a third of all rows is many blocks.
    """
    spark = vectors.sparkSession
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(squares)).first()
    if (longest or 0) >= EXACT:
        raise ValueError("vectors are too long for exact scores")
    width = max(width or 1, 1)
    filled = F.slice(F.concat("vec", F.array_repeat(F.lit(0).cast("long"), width)), 1, width).cast("array<int>")
    even = vectors.select("vec_id", "label", filled.alias("vec"))
    k = min(MOST_LISTS, max(FEWEST_LISTS, n // LIST_ROWS))
    sampled = even.orderBy(F.xxhash64("vec_id", "label", "vec"), "vec_id").select("vec").limit(SAMPLE * k).toArrow()["vec"].combine_chunks()
    centroids = _fit(_vectors(sampled), k) if n else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, far = _nearest(_vectors(batch.column("vec")), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far)], names=[*batch.schema.names, "list", "far"])

    keyed = even.select(F.monotonically_increasing_id().alias("key"), "*")
    assigned = materialize(keyed.mapInArrow(assign, "key long, vec_id long, label long, vec array<int>, list int, far double"), "negative-lists")
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for row in assigned.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # one row per list
        radii[row.list], sizes[row.list] = row.far, row.n
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(1, -(-sizes // BLOCK_ROWS))]), F.col("list") + 1)
    rows = assigned.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).drop("far")
    return Lists(rows, centroids, radii, sizes)


def _routed(lists: Lists, anchors: DataFrame, first: bool) -> DataFrame:
    """Anchors with the lists that they visit next.

    A list's scores lie within q.c +- |q| r. It is skipped where these miss every window
    (least, most) of the anchor. Lists go by their upper bound: the first round visits the
    FIRST_LISTS highest of each window, the second all that weren't ``seen`` and whose bound
    isn't strictly below ``least``, which is the kth score by then.
    """
    shared = anchors.sparkSession.sparkContext.broadcast((lists.centroids, lists.radii, lists.sizes > 0))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radii, full = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _vectors(batch.column("vec"))
            size = np.sqrt((q**2).sum(1))[:, None]
            middle, reach = q @ centroids.T, size * radii
            slack = 1e-9 * (size * (np.sqrt((centroids**2).sum(1)) + radii) + 1)  # far above the rounding of these sums
            upper, lower = middle + reach + slack, middle - reach - slack
            visits = []
            for k, (least, most, seen) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("least", "most", "seen")), strict=True)):
                chosen: set[int] = set()
                for lo, hi in zip(least, most, strict=True):
                    meets = np.flatnonzero(full & (upper[k] >= lo) & (lower[k] <= hi))
                    if first:
                        meets = meets[np.argsort(-np.minimum(upper[k][meets], hi), kind="stable")[:FIRST_LISTS]]
                    chosen.update(meets.tolist())
                visits.append(sorted(chosen.difference(seen)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "visits"])

    return anchors.mapInArrow(route, "key long, label long, vec array<int>, least array<long>, most array<long>, seen array<int>, visits array<int>")


def _top(scores: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the n greatest finite scores of each row, the first column first among equal ones; changes ``scores``."""
    rows = np.arange(len(scores))
    for _ in range(min(n, scores.shape[1])):
        at = scores.argmax(1)
        rows = rows[scores[rows, at[rows]] > -np.inf]
        if not len(rows):
            return
        yield rows, at[rows]
        scores[rows, at[rows]] = -np.inf


def _visited(lists: Lists, routed: DataFrame, slices: int, n: int, same: bool) -> DataFrame:
    """key, place (of the window), other_id, score: of each block an anchor's n best rows of its own label (or of others) in each window.

    A block's rows come before the anchors that visit it, in one sorted partition; a task
    holds one block and a batch of anchors. Each slice of anchors meets its own copy of a block.
    """
    spark = routed.sparkSession
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("least", "most")]
    spread = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    stored = lists.rows.select("list", "block", spread, F.lit(0).alias("kind"), "key", "vec_id", "label", "vec", *none)
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(1, lists.blocks)]), F.col("list") + 1)
    part = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice")
    asking = routed.select(F.explode("visits").alias("list"), "key", "label", "vec", "least", "most")
    asking = asking.select("list", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), part, F.lit(1).alias("kind"), "key", F.lit(None).cast("long").alias("vec_id"), "label", "vec", "least", "most")
    cell = ["list", "block", "slice"]
    tasks = max(shuffle_partitions(spark), int(lists.blocks.sum()) * slices // 8)
    dealt = stored.unionByName(asking).repartition(tasks, *cell).sortWithinPartitions(*cell, "kind", F.asc_nulls_last("vec_id"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*cell, "kind")]
            edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if begin == end:
                    continue
                run, place = batch.slice(begin, end - begin), tuple(int(c[begin]) for c in columns[:3])
                if place != here:
                    here, held, block = place, [], None
                if not columns[3][begin]:
                    held.append(run)
                elif held:
                    if block is None:
                        block = pa.Table.from_batches(held).combine_chunks()
                        own = [block[c].combine_chunks() for c in ("key", "vec_id", "label", "vec")]
                        block = own[0].to_numpy(), own[1], own[2].to_numpy(), _vectors(own[3]).T
                    for at in range(0, run.num_rows, _AT_ONCE):
                        yield from best(run.slice(at, _AT_ONCE), block)

    def best(asked: pa.RecordBatch, block: tuple) -> Iterator[pa.RecordBatch]:
        keys, ids, labels, vectors = block
        own, scores = asked.column("key").to_numpy(), _vectors(asked.column("vec")) @ vectors
        equal = asked.column("label").to_numpy()[:, None] == labels
        fits = equal & (own[:, None] != keys) if same else ~equal
        windows = [asked.column(c).to_pylist() for c in ("least", "most")]
        for w in range(max(map(len, windows[0]), default=0)):
            lo, hi = (np.array([x[w] if w < len(x) else empty for x in xs], np.float64)[:, None] for xs, empty in zip(windows, (1, 0), strict=True))
            for rows, at in _top(np.where(fits & (scores >= lo) & (scores <= hi), scores, -np.inf), n):
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(np.full(len(rows), w, np.int32)), ids.take(pa.array(at)), pa.array(scores[rows, at].astype(np.int64))], names=["key", "place", "other_id", "score"])

    return dealt.mapInArrow(visit, "key long, place int, other_id long, score long")


def _ranked(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search(lists: Lists, anchors: DataFrame, n: int, same: bool) -> DataFrame:
    """key, place, other_id, score, rank: of each anchor (key, label, vec, least, most) and window the n best rows, exactly.

    The windows are the arrays ``least`` and ``most`` (whole numbers, inclusive). Rows have
    the anchor's label, without the anchor itself (``same``), or another one. Ties go to the
    smaller vec_id; a null one is last.
    """
    slices = -(-max(1, anchors.count()) // SLICE_ANCHORS)
    start = materialize(_routed(lists, anchors.withColumn("seen", F.array().cast("array<int>")), True), "negative-first")
    early = materialize(_ranked(_visited(lists, start, slices, n, same), n), "negative-early")
    kth = early.where(F.col("rank") == n).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("kth"))  # one entry per window
    least = F.transform("least", lambda x, k: F.greatest(x, F.coalesce(F.element_at("kth", k.cast("int")), x)))
    rest = start.join(kth, "key", "left").select("key", "label", "vec", least.alias("least"), "most", F.col("visits").alias("seen"))
    late = _visited(lists, _routed(lists, rest, False), slices, n, same)
    return _ranked(early.drop("rank").unionByName(late), n)


def _percent(x: Column, p: int) -> Column:
    """p percent of a whole number, rounded down; by hundreds, as its product with p may be inexact as a double."""
    hundreds = F.floor(x / 100)
    return hundreds * p + F.floor((x - hundreds * 100) * p / 100)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, vec).

    An anchor's positives are its best other rows of the same label; the negatives of a
    positive are the best rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's (both inclusive; none below a negative one). Scores are exact
    whole numbers; vectors whose squared length reaches 2^53 are refused. Rows are told apart
    as rows, not by vec_id: a repeated row is a positive of its copy, and repeated anchors
    give repeated results. A null vec_id comes last among ties. A table without rows or
    anchors gives no rows, an anchor without positives or negatives none either.
    """
    lists = build_lists(vectors)
    anchors = lists.rows.where(F.coalesce(is_anchor, F.lit(False))).select("key", F.col("vec_id").alias("anchor_id"), "label", "vec")
    whole = [F.array(F.lit(x).cast("long")) for x in (-EXACT, EXACT)]
    best = search(lists, anchors.select("key", "label", "vec", whole[0].alias("least"), whole[1].alias("most")), positives, True)
    best = materialize(best.select("key", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    bounds = F.array_sort(F.collect_set("positive_score")).alias("asked")
    windows = best.where("positive_score >= 0").groupBy("key").agg(bounds)  # at most ``positives`` scores
    asking = anchors.join(windows, "key").select(
        "key", "label", "vec", "asked",
        F.transform("asked", lambda x: -_percent(-x, low)).alias("least"),
        F.transform("asked", lambda x: _percent(x, high)).alias("most"),
    )
    found = search(lists, asking.drop("asked"), negatives, False)
    scored = found.join(asking.select("key", "asked"), "key").select("key", F.get("asked", F.col("place")).alias("positive_score"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("key", "anchor_id").join(best, "key").join(scored, ["key", "positive_score"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: labels of every seventh vec_id moved on by one, every fiftieth an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(embeddings).withColumn("label", moved), F.col("vec_id") % 50 == 0)


#: The contract's query in DuckDB.
NEGATIVES_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
