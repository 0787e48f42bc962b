"""Document quality: gradient-boosted trees over statistics of the text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosting import FlatTrees, fit
from .tokens import _texts

#: Labelled documents that a fit uses at most; of more, those with the smallest hashes of their ids.
TRAINING_ROWS = 30_000
THRESHOLD = 0.3

_UPPER = np.array([65 <= b <= 90 for b in range(256)], float)
_LOWER = np.array([97 <= b <= 122 for b in range(256)], float)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)], float)
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)], float)
_STOP = np.array([b in b".,;:!?'\"-()" for b in range(256)], float)
_HIGH = np.array([b >= 128 for b in range(256)], float)
_MARK = 1 - np.minimum(1, _UPPER + _LOWER + _DIGIT + _SPACE + _STOP + _HIGH)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _HIGH, _MARK])


def statistics(text: bytes) -> list[float]:
    """Numbers of a whole text that know nothing of its language, source or id."""
    n = len(text)
    if not n:
        return [0.0] * WIDTH
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (_CLASSES @ counts / n).tolist()
    p = counts[counts > 0] / n
    words = text.split()
    m = max(len(words), 1)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [line for line in text.split(b"\n") if line.strip()]
    k = max(len(lines), 1)
    line_seen = Counter(lines)
    repeated_bytes = sum(len(line) * c for line, c in line_seen.items() if c > 1)
    low = text.lower()
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *shares, float(-(p * np.log2(p)).sum()),
        len(seen) / m, sum(c == 1 for c in seen.values()) / m, top[0] / m if top else 0.0, sum(top) / m,
        float(lengths.mean()), float(lengths.std()), float(lengths.max()), float((lengths <= 2).mean()), float((lengths >= 12).mean()),
        n / k, len(line_seen) / k, repeated_bytes / n, sum(line.rstrip()[-1:] in b".!?" for line in lines) / k,
        sum(line.lstrip()[:1] in b"-*#|>0123456789" for line in lines) / k,
        counts[ord("!")] / n, counts[ord("|")] / n, counts[ord(",")] / m, counts[ord(".")] / m, sum(map(bytes.isupper, words)) / m, sum(map(bytes.isalpha, words)) / m,
        low.count(b"http") / m, text.count(b"!!") / m, text.count(b"...") / m, len(zlib.compress(text, 1)) / n,
    ]


WIDTH = len(statistics(b"a"))


def _matrix(texts: Iterator[bytes]) -> np.ndarray:
    rows = [statistics(x) for x in texts]
    return np.array(rows, float).reshape(len(rows), WIDTH)


def is_held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that no fit may see; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> FlatTrees:
    """Fit on labelled documents that aren't held out.

    No more than ``rows`` (document, label) pairs are used, chosen by the hash of the id among
    the labels whose document is there; they come to the driver as numbers and not as texts. Null
    labels and ids are left out. A label that is repeated counts once and a document with both
    labels twice; of several rows of one doc_id the one with the least statistics counts.
    Without labels of both kinds, every score is the smoothed share of ones.
    """
    known = labels.where(F.col(label).isNotNull() & ~is_held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) == 1).cast("int").alias("y")).distinct()
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    n = known.count()
    if n > rows:  # the hash leaves little more than is wanted, so that no task sorts all labels
        known = known.where(F.col("place") < int(min(1.0, (1.1 * rows + 100) / n) * (1 << 40))).orderBy("place", "doc_id", "y").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    chosen = F.broadcast(known.select("doc_id", "y"))  # at most ``rows`` rows of two numbers
    found = texts.join(chosen, "doc_id").select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, y int, x array<double>")
    found = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    x = np.array(found["x"].combine_chunks().flatten() if len(found) else [], float).reshape(-1, WIDTH)
    y, ids = np.array(found["y"], float), np.array(found["doc_id"], np.int64)
    order = np.lexsort((y, *x.T[::-1], ids))  # the same rows in any order give the same trees
    return fit(x[order], y[order])


def with_score(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1, higher: likelier good) of the whole text; a column named score is replaced.

    Null and empty texts are scored from the statistics of the empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on trees and depth alone
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.probability(_matrix(x or b"" for x in _texts(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def predicted():
    return (F.col("score") >= THRESHOLD).cast("int")
