"""Harmonic packing of token documents into fixed-capacity sequences.

Class k holds pieces of floor(capacity / k) tokens and its bins take exactly k of them, so
a bin of any class is full but for less than k tokens. A document is cut into whole
sequences, and its rest, while above ``tail`` tokens, gives up the largest class piece
that fits. What is left (at most ``tail`` tokens) is a piece of its own length, whose bins
take floor(capacity / length). Every worker numbers its pieces of a class by itself; one
offset per worker and class then makes the numbers run on, so each class has one unfilled
bin in all. The pieces of those bins (fewer than the sum of the counts per bin, about ten
thousand at 2048 whatever the input) are placed by first fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .tokens import TOKENIZER, WordEncoder, _texts

#: Rows (worker and class) of the offsets up to which they are broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 100_000


def cut_lengths(n: int, capacity: int, tail: int) -> list[int]:
    """Piece lengths, in document order, of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > tail:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return [*out, rest] if rest else out


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 1, capacity: int = 2048, tail: int = 32) -> DataFrame:
    """Encode and cut: doc_id, start, length, doc_tokens, ids (uint32 little endian), worker, number."""
    end = np.array([end_id], "<u4").tobytes()
    fields = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "worker": pa.int32(), "number": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, encoder, numbers = TaskContext.get().partitionId(), WordEncoder.get(tokenizer), Counter()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(_texts(batch)), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in cut_lengths(n, capacity, tail):
                        rows.append((doc_id, start, length, n, ids[4 * start : 4 * (start + length)], worker, numbers[length]))
                        numbers[length] += 1
                        start += length
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, worker int, number long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, schema)


def harmonic_pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each of ``token_pieces`` its sequence_id (dense, from 0) and offset (gapless from 0).

    Pieces must be materialised: their worker numbers may not change between reads.
    """
    per = F.floor(F.lit(capacity) / F.col("length"))
    counts = pieces.groupBy("length", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    # at most capacity rows, in practice under a hundred: one per class
    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", per.alias("per"), F.floor(F.col("n") / per).alias("full"))
    earlier = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("bin_base", F.coalesce(F.sum("full").over(earlier), F.lit(0)))
    offsets = materialize(
        counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(classes, "length").select("length", "worker", "base", "per", "full", "bin_base"), "pack-offsets"
    )
    small = offsets.count() <= BROADCAST_ROWS
    placed = pieces.join(F.broadcast(offsets) if small else offsets, ["length", "worker"])
    placed = placed.withColumn("rank", F.col("base") + F.col("number")).drop("base", "number", "worker")
    in_full = F.col("rank") < F.col("full") * F.col("per")

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "rank"], ascending=[False, True])
        used = np.zeros(len(rest), np.int64)
        sequence, offset = [], []
        for length in rest["length"]:
            k = int(np.argmax(used + length <= capacity))
            sequence.append(k)
            offset.append(used[k])
            used[k] += length
        return pd.DataFrame({"length": rest["length"], "rank": rest["rank"], "rest_sequence": np.array(sequence) + int(rest["bins"].iloc[0]), "rest_offset": offset})

    # bounded by the classes' counts per bin, whatever the input
    bins = offsets.agg(F.max(F.col("bin_base") + F.col("full")).alias("bins"))
    rest = placed.where(~in_full).select("length", "rank").crossJoin(F.broadcast(bins))
    rest = rest.groupBy("bins").applyInPandas(first_fit, "length long, rank long, rest_sequence long, rest_offset long")
    placed = placed.join(F.broadcast(rest), ["length", "rank"], "left")
    return placed.select(
        "doc_id", "start", "length", "doc_tokens",
        F.when(in_full, F.col("bin_base") + F.floor(F.col("rank") / F.col("per"))).otherwise(F.col("rest_sequence")).alias("sequence_id"),
        F.when(in_full, F.col("rank") % F.col("per") * F.col("length")).otherwise(F.col("rest_offset")).alias("offset"),
        "ids",
    )


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 1, capacity: int = 2048, tail: int = 32) -> DataFrame:
    """Pack ``docs(doc_id, text)``: one row per piece with its ids, sequence and offset.

    Null text counts as empty: the document is its end id alone. Rows with equal or null
    doc_id are packed like any other, each as its own document. Other columns are ignored.
    An empty table gives no row. Sequences are padded to the capacity by the reader; all
    but the last few are full but for less than the class's rounding.
    """
    return harmonic_pack(materialize(token_pieces(docs, tokenizer, end_id, capacity, tail), "pieces"), capacity)
