"""Logistic regressions that leave one group out each, trained together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .sums import matrix, numbers, task_sums

def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def leave_one_group_out(df: DataFrame, id_col: str, group: str, vector: str, label: str, strength: float = 1.0, folds_at_once: int = 16, most_rounds: int = 50, tolerance: float = 1e-8) -> tuple[DataFrame, list]:
    """(id, group, actual, guess, confidence) by the model fitted without the row's group, and the groups without a model.

    A fold is a standardised softmax regression over all other groups, its classes weighted to
    equal totals and its coefficients (not the intercepts) held by ``1 / (2 * strength)`` times
    their squares; two classes have one set of coefficients. Means, deviations and class
    weights of a fold are those of all rows less its group's, so one scan serves all folds;
    a Newton round of ``folds_at_once`` folds is one more. Tasks hand on one gradient and one
    matrix of second derivatives a fold, as wide as classes times dimensions, and these alone
    reach the driver. A fold whose other groups have fewer than two classes is skipped and
    listed; so are all where there is one group. Rows with a null group, label, vector or
    component take no part. ``group`` has to be of few values (a fold is a model), ``label`` too.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(group).alias("group"), F.col(label).alias("actual"), F.col(vector).cast("array<double>").alias("x"))
    rows, _ = keep(rows.where(F.col("group").isNotNull() & F.col("actual").isNotNull() & F.forall("x", lambda v: v.isNotNull())), "folds-rows")
    pairs = rows.groupBy("group", "actual").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()
    groups, classes = sorted({r.group for r in pairs}), sorted({r.actual for r in pairs})
    place = {g: i for i, g in enumerate(groups)}
    d, n_classes, n_groups = max((r.d for r in pairs), default=0), len(classes), len(groups)
    result = f"id {df.schema[id_col].dataType.simpleString()}, group {df.schema[group].dataType.simpleString()}, actual {df.schema[label].dataType.simpleString()}, guess {df.schema[label].dataType.simpleString()}, confidence double"
    if not pairs:
        return df.sparkSession.createDataFrame([], result), []
    counts = np.zeros((n_groups, n_classes))
    for r in pairs:
        counts[place[r.group], classes.index(r.actual)] = r.n
    rest = counts.sum(axis=0) - counts
    trained = [i for i in range(n_groups) if (rest[i] > 0).sum() >= 2]
    skipped = [g for i, g in enumerate(groups) if i not in set(trained)]
    code = lambda c, values: F.coalesce(*[F.when(F.col(c) == F.lit(v), i) for i, v in enumerate(values)])
    data = rows.select("id", "group", "actual", "x", code("actual", classes).alias("y"), code("group", groups).alias("g"))
    coded = data.select("x", "y", "g")

    def add_moments(total, batch):
        x = matrix(batch, "x")
        np.add.at(total, numbers(batch, "g"), np.hstack([x, x * x]))

    moments = task_sums(coded, n_groups, 2 * d, add_moments)
    moments = moments.sum(axis=0) - moments
    size = rest.sum(axis=1, keepdims=True).clip(1)
    mean = moments[:, :d] / size
    spread = np.sqrt((moments[:, d:] / size - mean**2).clip(0))
    spread[spread <= 1e-12 * (1 + np.abs(mean))] = 1.0
    sets = 1 if n_classes == 2 else n_classes  # sets of coefficients a model
    width = sets * (d + 1)
    present = (rest > 0).sum(axis=1, keepdims=True).clip(1)
    class_weight = np.divide(size, present * rest, out=np.zeros_like(rest), where=rest > 0)
    ridge = np.tile(np.append(np.full(d, 1.0 / strength), 0.0), sets)

    def scores(x, f, theta):
        one = np.hstack([(x - mean[f]) / spread[f], np.ones((len(x), 1))])
        z = one @ theta.reshape(sets, d + 1).T
        z = np.hstack([np.zeros((len(x), 1)), z]) if sets == 1 else np.where(rest[f] > 0, z, -np.inf)
        return one, _softmax(z)

    models: dict[int, np.ndarray] = {}
    for at in range(0, len(trained), folds_at_once):
        block = trained[at : at + folds_at_once]
        theta, step = np.zeros((len(block), width)), np.zeros((len(block), width))
        loss = np.full(len(block), np.inf)
        active = list(range(len(block)))
        for _ in range(most_rounds):
            tried = theta + step

            def add(total, batch, block=block, active=active, tried=tried):
                x, y, g = matrix(batch, "x"), numbers(batch, "y"), numbers(batch, "g")
                for k in active:
                    f = block[k]
                    other = g != f
                    if not other.any():
                        continue
                    one, p = scores(x[other], f, tried[k])
                    w = class_weight[f, y[other]]
                    total[k, 0] -= (w * np.log(np.maximum(p[np.arange(len(w)), y[other]], 1e-300))).sum()
                    q = p[:, 1:] if sets == 1 else p
                    hit = (y[other][:, None] == np.arange(n_classes))[:, -q.shape[1] :]
                    total[k, 1 : 1 + width] += ((w[:, None] * (q - hit)).T @ one).ravel()
                    square = total[k, 1 + width :].reshape(sets, d + 1, sets, d + 1)
                    for a in range(sets):
                        for b in range(a, sets):
                            part = (one * (w * q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ one
                            square[a, :, b] += part
                            if a != b:
                                square[b, :, a] += part.T

            sums = task_sums(coded, len(block), 1 + width + width * width, add)
            still = []
            for k in active:
                new = sums[k, 0] + (ridge * tried[k] ** 2).sum() / 2
                if new > loss[k] + 1e-10 * (1 + abs(loss[k])):
                    step[k] /= 2  # the step went too far
                    still.append(k)
                    continue
                theta[k], loss[k] = tried[k], new
                gradient = sums[k, 1 : 1 + width] + ridge * theta[k]
                if np.abs(gradient).max() > tolerance * max(1.0, size[block[k], 0]):
                    second = sums[k, 1 + width :].reshape(width, width) + np.diag(ridge)
                    step[k] = -np.linalg.lstsq(second, gradient, rcond=1e-12)[0]
                    still.append(k)
                else:
                    step[k] = 0.0
            active = still
            if not active:
                break
        else:
            raise ValueError(f"folds {[groups[block[k]] for k in active]} still move after {most_rounds} rounds")
        models |= {f: theta[k] for k, f in enumerate(block)}

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, g = matrix(batch, "x"), numbers(batch, "g")
            best, sure = np.zeros(len(x), int), np.full(len(x), np.nan)
            for f in np.unique(g):
                if f in models:
                    p = scores(x[g == f], f, models[f])[1]
                    best[g == f], sure[g == f] = p.argmax(axis=1), p.max(axis=1)
            named = pa.array([classes[i] for i in best], batch.column("actual").type)
            columns = [*(batch.column(c) for c in ("id", "group", "actual")), named, pa.array(sure, pa.float64())]
            out = pa.RecordBatch.from_arrays(columns, names=["id", "group", "actual", "guess", "confidence"])
            yield out.filter(pa.array(~np.isnan(sure)))

    return data.mapInArrow(guess, result), skipped
