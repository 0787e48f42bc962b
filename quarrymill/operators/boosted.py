"""Gradient-boosted trees for any number of classes, grown over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, keep
from .sums import matrix, numbers, task_sums


@dataclass
class Tree:
    """Nodes as parallel lists: the feature (-1: a leaf), the last bin that goes left, the left child (the right one follows), the value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> list[int]:
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for value in (left, right):
            for held, x in ((self.feature, -1), (self.cut, 0), (self.child, 0), (self.value, value)):
                held.append(x)
        return [self.child[node], self.child[node] + 1]

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        at, rows = np.zeros(len(binned), int), np.arange(len(binned))
        while (inner := feature[at] >= 0).any():
            at = np.where(inner, child[at] + (binned[rows, feature[at]] > cut[at]), at)
        return at


@dataclass
class Model:
    classes: list
    edges: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin b holds what is at most edge b and above edge b - 1; missing numbers go beyond the last edge."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), np.inf, c)) for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.int16)


def _scores(start: np.ndarray, rounds: list[list[Tree]], binned: np.ndarray) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree.value)[tree.leaves(binned)]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(df: DataFrame, vector: str, label: str, rounds: int = 180, rate: float = 0.08, depth: int = 5, most_leaves: int = 20, l2: float = 1.0, least_rows: int = 20, bins: int = 64, keep_every: int = 10) -> Model:
    """Softmax boosting with second derivatives, all classes weighted to equal totals.

    Every level of one round's trees (one a class) is one scan: a task adds gradients, second
    derivatives and rows up by node, feature and bin, the shuffle adds up the tasks, and only
    these sums reach the driver. Splits are the best gains of a level while a tree has fewer
    than ``most_leaves`` leaves; of equal gains the first feature and bin. Bins end at quantiles
    of all rows. Scores are written every ``keep_every`` rounds; the rounds since are walked
    anew, so a lost task needs nothing of others. Rows without label or vector take no part;
    missing numbers count as the largest. One class alone gives a model without trees.
    """
    spark = df.sparkSession
    rows = df.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    counted = {r.label: (r.n, r.d) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()}
    classes, d = sorted(counted), max((n[1] for n in counted.values()), default=0)
    if not d:
        return Model(classes, [])
    levels = [i / bins for i in range(1, bins)]
    finite = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    cuts = rows.select(*[F.percentile_approx(finite(i), levels, 20_000).alias(f"q{i}") for i in range(d)]).first()
    model = Model(classes, [np.unique(q or [0.0]) for q in cuts])
    n_classes, width = len(classes), bins + 1
    if n_classes < 2:
        return model
    total = sum(n for n, _ in counted.values())
    weight = np.array([total / (n_classes * counted[c][0]) for c in classes])
    code = F.coalesce(*[F.when(F.col("label") == F.lit(c), k) for k, c in enumerate(classes)])

    def start(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [model.binned(matrix(batch, "x").astype(float)), np.zeros((batch.num_rows, n_classes))] if batch.num_rows else []
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(list(lists[0]), pa.list_(pa.int16())), batch.column("y"), pa.array(list(lists[1]), pa.list_(pa.float64()))], names=["b", "y", "s"])

    schema = "b array<smallint>, y int, s array<double>"
    data, folder = keep(rows.select("x", code.alias("y")).mapInArrow(start, schema), "boosted")
    since: list[list[Tree]] = []
    for turn in range(rounds):
        grown = [Tree() for _ in classes]
        open_nodes, leaves = [(k, 0) for k in range(n_classes)], [1] * n_classes
        for _ in range(depth):
            if not open_nodes:
                break

            def add(out, batch, grown=grown, open_nodes=open_nodes, since=since):
                b, y = matrix(batch, "b"), numbers(batch, "y")
                p = _softmax(_scores(matrix(batch, "s"), since, b))
                w = weight[y]
                for k in sorted({k for k, _ in open_nodes}):
                    place = np.full(len(grown[k].feature), -1)
                    for j, (owner, node) in enumerate(open_nodes):
                        if owner == k:
                            place[node] = j
                    at = place[grown[k].leaves(b)]
                    live = at >= 0
                    cell = ((at[live, None] * d + np.arange(d)) * width + b[live]).ravel()
                    sums = (w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k]), np.ones(len(y)))
                    for part, values in enumerate(sums):
                        at_once = np.bincount(cell, np.repeat(values[live], d), len(open_nodes) * d * width)
                        out[:, part * d * width : (part + 1) * d * width] += at_once.reshape(len(open_nodes), -1)

            found = task_sums(data, len(open_nodes), 3 * d * width, add).reshape(len(open_nodes), 3, d, width)
            splits = []
            for j, (k, node) in enumerate(open_nodes):
                left = found[j].cumsum(axis=2)[:, :, :-1]
                whole = found[j].sum(axis=2)[:, :1, None]
                right = whole - left
                gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
                gain = np.where((left[2] >= least_rows - 0.5) & (right[2] >= least_rows - 0.5), gain, -np.inf)
                best = gain.max()
                if best > 1e-10:
                    f, cut = np.unravel_index(np.flatnonzero(gain.ravel() >= best * (1 - 1e-9))[0], gain.shape)
                    sides = [float(-rate * side[0, f, cut] / (side[1, f, cut] + l2)) for side in (left, right)]
                    splits.append((-best, k, node, int(f), int(cut), *sides))
            open_nodes = []
            for _, k, node, *cut in sorted(splits):
                if leaves[k] < most_leaves:
                    leaves[k] += 1
                    open_nodes += [(k, child) for child in grown[k].split(node, *cut)]
        model.rounds.append(grown)
        since = [*since, grown]
        if all(len(tree.feature) == 1 for tree in grown):
            break  # nothing is left to split, and nothing will be
        if len(since) == keep_every and turn + 1 < rounds:

            def settle(batches: Iterator[pa.RecordBatch], since=since) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        s = _scores(matrix(batch, "s"), since, matrix(batch, "b"))
                        yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("y"), pa.array(list(s), pa.list_(pa.float64()))], names=["b", "y", "s"])

            before = folder
            data, folder = keep(data.mapInArrow(settle, schema), "boosted")
            drop(spark, before)
            since = []
    drop(spark, folder)
    return model


def predict(model: Model, df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, guess, probabilities (in the order of ``model.classes``) of every row; a row without a vector counts as one of
    missing numbers. A model without classes guesses null."""
    if not model.classes:
        return df.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("guess"), F.array().cast("array<double>").alias("probabilities"))
    kind, id_type = pa.string() if isinstance(model.classes[0], str) else pa.int64(), df.schema[id_col].dataType.simpleString()
    missing = F.array_repeat(F.lit(None).cast("double"), len(model.edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _softmax(_scores(np.zeros((batch.num_rows, len(model.classes))), model.rounds, model.binned(matrix(batch, "x").astype(float))))
                guess = pa.array([model.classes[k] for k in p.argmax(axis=1)], kind)
                yield pa.RecordBatch.from_arrays([batch.column("id"), guess, pa.array(list(p), pa.list_(pa.float64()))], names=["id", "guess", "probabilities"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(vector).cast("array<double>"), missing).alias("x"))
    return rows.mapInArrow(run, f"id {id_type}, guess {'string' if isinstance(model.classes[0], str) else 'bigint'}, probabilities array<double>")
