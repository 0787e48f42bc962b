"""Lexical, vector and hybrid search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import dot
from .selection import top_per

K1, B = 1.5, 0.75
#: Items, and queries, that one task compares; it scores QUERIES_AT_ONCE of them in one product.
BLOCK_ROWS, QUERIES_AT_ONCE = 8192, 256


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, bm25 of every document for the distinct terms of a query (0 where none occurs).

    One pass counts the query's terms in each document and drops the text; document
    frequencies and the mean length are one aggregated row beside it. The counts (a few
    numbers a document) are dealt by id, so that this one exchange serves both uses and no
    text is split twice.
    """
    terms = sorted(set(_query_tokens(query)))
    counts = docs.select(F.col(id_col), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    counts = counts.select(id_col, F.size("tokens").alias("length"), *[_count_of(w).alias(f"tf{k}") for k, w in enumerate(terms)]).repartition(id_col)
    stats = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    score: Column = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        base = F.col(f"tf{k}") + K1 * (1 - B + B * F.col("length") / F.greatest("mean", F.lit(1.0)))
        score = score + F.when(F.col(f"tf{k}") > 0, idf * F.col(f"tf{k}") * (K1 + 1) / base).otherwise(0.0)
    return counts.crossJoin(F.broadcast(stats)).select(id_col, score.alias("bm25"))


def _count_of(term: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == F.lit(term)))


def _query_tokens(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def hybrid(scored: DataFrame, weight: float = 0.65, boost: Column | None = None) -> DataFrame:
    """Adds score: the cosine moved to 0..1 and BM25 over its greatest value, blended; a boost is added before clipping to 0..1."""
    best = scored.agg(F.max("bm25").alias("best"))
    lexical = F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(0.0)
    semantic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2))
    score = weight * semantic + (1 - weight) * lexical
    if boost is not None:
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + boost))
    return scored.crossJoin(F.broadcast(best)).withColumn("score", score).drop("best")


def against_vector(items: DataFrame, queries: DataFrame, vector: str = "embedding", query_vector: str = "query") -> DataFrame:
    """Items beside each of a few query vectors, with their cosine (vectors have length one).

    ``queries`` is what the caller states: a handful of rows, broadcast.
    """
    return items.crossJoin(F.broadcast(queries)).withColumn("cosine", dot(F.col(vector), F.col(query_vector)))


def best_query(scores: DataFrame, id_col: str, query: str = "query_id", score: str = "score") -> DataFrame:
    """Per item its greatest score and the query it comes from; of equal scores the first query."""
    return scores.groupBy(id_col).agg(F.max(score).alias(score), F.min_by(query, F.struct(-F.col(score), F.col(query))).alias("matched_query"))


def top_per_query(items: DataFrame, queries: DataFrame, n: int, weight: float | None = None, clip: bool = False) -> DataFrame:
    """query_id, id, score: the best n items of every query, rounded to six digits, of equal scores the smaller id.

    Items have id, vector and base, queries query_id and query. The score is base plus the
    cosine, or with a weight plus that share of the cosine moved to 0..1; an item without a
    vector has base alone. Every pair of a block of items and a block of queries is a group
    of its own and gives its n best rows a query.
    """
    n_items, n_queries = items.count() // BLOCK_ROWS + 1, queries.count() // BLOCK_ROWS + 1
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = items.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("base").cast("double").alias("base"), block("id", n_items).alias("_i"), every(n_queries).alias("_q"))
    right = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"), block("query_id", n_queries).alias("_q"), every(n_items).alias("_i"))
    at_once = QUERIES_AT_ONCE

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(a) and len(b):
            ids, has = a["id"].to_numpy(), a["vector"].notna().to_numpy()
            vectors = np.stack(a["vector"][has].to_list()).T if has.any() else None
            for start in range(0, len(b), at_once):
                part = b.iloc[start : start + at_once]
                scores = np.tile(a["base"].to_numpy(), (len(part), 1))
                if vectors is not None:
                    cosine = np.stack(part["query"].to_list()) @ vectors
                    scores[:, has] += cosine if weight is None else weight * np.clip((cosine + 1) / 2, 0, 1)
                scores = np.round(np.clip(scores, 0, 1) if clip else scores, 6)
                for query, row in zip(part["query_id"], scores, strict=True):
                    near = np.flatnonzero(row >= np.partition(row, -n)[-n]) if len(row) > n else np.arange(len(row))
                    near = near[np.lexsort((ids[near], -row[near]))[:n]]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[near], "score": row[near]}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInPandas(best, "query_id long, id long, score double")
    return top_per(found, ["query_id"], [F.desc("score"), F.asc("id")], n).drop("rank")
