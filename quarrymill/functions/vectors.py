"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def fused(parts: list[tuple[float, Column]]) -> Column:
    """One vector whose dot product is the weighted sum of the parts' dot products."""

    def scaled(v: Column, by: float) -> Column:
        return F.transform(v, lambda x: x.cast("double") * by)

    return F.concat(*[scaled(v, float(w) ** 0.5) for w, v in parts])


def two_signal_distance(dot_a: Column, dot_b: Column, weight: float = 0.7) -> Column:
    """Weighted cosine distance of two signals."""
    return weight * (1 - dot_a) + (1 - weight) * (1 - dot_b)


def robust_scaled(v: Column, centre: Column, scale: Column) -> Column:
    """Each dimension less its centre over its scale, then length one."""
    shifted = F.zip_with(F.zip_with(v, centre, lambda x, c: x.cast("double") - c), scale, lambda x, s: x / s)
    return unit(shifted)


def linear_head(v: Column, mean: list[float], scale: list[float], coef: list[float], intercept: float) -> Column:
    """Probability of a standardised logistic head; the score is kept within 30."""
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    z = F.zip_with(F.zip_with(v, arr(mean), lambda x, m: x.cast("double") - m), arr(scale), lambda x, s: x / s)
    score = dot(z, arr(coef)) + intercept
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def softmax_head(v: list[Column], mean: list[float], scale: list[float], coef: list[list[float]], intercept: list[float], classes: list[str], least: float) -> tuple[Column, Column]:
    """(class, probability) of a standardised linear head over several classes; "unknown" under the threshold, of equal ones the first class.

    Numbers, coefficients and classes are few and known when the query is written, so that all is
    plain arithmetic on columns, which Spark compiles (functions over arrays it doesn't).
    """
    z = [(x.cast("double") - float(m)) / float(s) for x, m, s in zip(v, mean, scale, strict=True)]

    def total(columns: list[Column]) -> Column:
        out = F.lit(0.0)
        for c in columns:
            out = out + c
        return out

    scores = [total([x * float(w) for x, w in zip(z, c, strict=True)]) + float(b) for c, b in zip(coef, intercept, strict=True)]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raised = [F.exp(s - top) for s in scores]
    best = F.lit(1.0) / total(raised)  # the highest score is raised to exactly 1
    first = F.coalesce(*[F.when(e >= 1.0, F.lit(c)) for e, c in zip(raised, classes, strict=True)])
    return F.when(best >= least, first).otherwise("unknown"), best
