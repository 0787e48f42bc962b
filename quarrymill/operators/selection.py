"""Top-k, quotas, shards and bounded assignment."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def representative(df: DataFrame, keys: list[str], value: str, *criteria: Column) -> DataFrame:
    """Per key the value of the row that is greatest by the criteria (the last one breaks ties)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*criteria)).alias(value))


def round_robin(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds shard: rows dealt in order. The numbers come from per-range counts, so no task sees all rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    inside = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(bases), "_part").withColumn("shard", ((F.col("_base") + inside) % shards).cast("int")).drop("_part", "_id", "_base")


def _one_group(df: DataFrame, f, schema: str) -> DataFrame:
    """Run a sequential choice over rows that the caller has bounded."""
    return df.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda g: f(g.drop(columns="_all")), schema)


def balanced_quota(scores: DataFrame, id_col: str, query: str, score: str, total: int, queries: list[str]) -> DataFrame:
    """Near-equal numbers of items for every query, each item once: the queries take their best free item in turn.

    Only the best ``total`` items of each query can be taken, so no more rows than that are
    looked at in sequence.
    """
    order = [F.desc(score), F.asc(id_col)]
    pool = top_per(scores.where(F.col(query).isin(queries)), [query], order, total)

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        ranked = {q: iter(part.sort_values("rank")[[id_col, score]].itertuples(index=False, name=None)) for q, part in g.groupby(query)}
        share, rest = divmod(min(total, g[id_col].nunique()), len(queries))
        gone: set = set()
        chosen = []
        for turn in range(share + (rest > 0)):
            for q in queries if turn < share else queries[:rest]:
                best = next((x for x in ranked.get(q, ()) if x[0] not in gone), None)
                if best:
                    gone.add(best[0])
                    chosen.append((best[0], q, float(best[1])))
        return pd.DataFrame([(*x, k) for k, x in enumerate(chosen)], columns=[id_col, query, score, "position"])

    kind, qkind = scores.schema[id_col].dataType.simpleString(), scores.schema[query].dataType.simpleString()
    return _one_group(pool, choose, f"{id_col} {kind}, {query} {qkind}, {score} double, position int")


def unique_top(scores: DataFrame, id_col: str, group: str, score: str, n: int) -> DataFrame:
    """The best n items of each group in group order, leaving out items that an earlier group took."""
    groups = scores.select(group).distinct().limit(1001).collect()
    if len(groups) > 1000:
        raise ValueError("over 1,000 groups; they are served one after another")
    pool = top_per(scores, [group], [F.desc(score), F.asc(id_col)], n * max(len(groups), 1))
    columns = scores.columns

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        kept = []
        for _, part in g.sort_values([group, "rank"]).groupby(group, sort=True):
            free = part[~part[id_col].isin(taken)].head(n)
            taken.update(free[id_col])
            kept.append(free)
        return pd.concat(kept)[columns] if kept else g[columns]

    return _one_group(pool, choose, scores.schema)


#: Items that one assignment may hold.
MOST_ITEMS = 5000


def assign(scores: DataFrame, id_col: str, label: str, score: str, capacity: int) -> DataFrame:
    """Each item at most once and ``capacity`` items per label: as many as can be placed, and of those the greatest total score.

    No more than labels x capacity items are placed. One that isn't among that many best of
    its label can be exchanged for a free one that is, so only these are looked at, by
    successive shortest paths. Over MOST_ITEMS of them are an error, for the problem is a
    bounded one (items for a human reviewer).
    """
    places = scores.select(label).distinct().count() * capacity
    best = scores.groupBy(id_col, label).agg(F.max(score).alias(score))
    schema = scores.select(id_col, label, score).schema
    scores = top_per(best, [label], [F.desc(score), F.asc(id_col)], places).select(id_col, label, score)
    if scores.select(id_col).distinct().limit(MOST_ITEMS + 1).count() > MOST_ITEMS:
        raise ValueError(f"over {MOST_ITEMS} items to assign")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([id_col, label])
        items, labels = sorted(g[id_col].unique()), sorted(g[label].unique())
        n, m = len(items), len(labels)
        source, sink = n + m, n + m + 1
        graph: list[list[list]] = [[] for _ in range(n + m + 2)]

        def edge(a: int, b: int, room: int, cost: int) -> None:
            graph[a].append([b, room, cost, len(graph[b])])
            graph[b].append([a, 0, -cost, len(graph[a]) - 1])

        number = {x: k for k, x in enumerate(items)}, {x: n + k for k, x in enumerate(labels)}
        top_score = float(g[score].max()) if len(g) else 0.0
        for k in range(n):
            edge(source, k, 1, 0)
        for i, lab, s in zip(g[id_col], g[label], g[score], strict=True):
            edge(number[0][i], number[1][lab], 1, round((top_score - float(s)) * 1_000_000))
        for k in range(m):
            edge(n + k, sink, capacity, 0)
        potential = [0] * len(graph)
        while True:
            dist, via = [float("inf")] * len(graph), [None] * len(graph)
            dist[source], heap = 0, [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k, (v, room, cost, _) in enumerate(graph[u]):
                    new = d + cost + potential[u] - potential[v]
                    if room and new < dist[v]:
                        dist[v], via[v] = new, (u, k)
                        heapq.heappush(heap, (new, v))
            if dist[sink] == float("inf"):
                break
            potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
            v = sink
            while v != source:
                u, k = via[v]
                graph[u][k][1] -= 1
                graph[v][graph[u][k][3]][1] += 1
                v = u
        rows = [(items[k], labels[v - n]) for k in range(n) for v, room, cost, _ in graph[k] if n <= v < n + m and room == 0]
        return pd.DataFrame(rows, columns=[id_col, label]).merge(g[[id_col, label, score]], on=[id_col, label])

    return _one_group(scores, solve, schema)


def stratified(df: DataFrame, strata: list[str], id_col: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """A stable pseudo-random sample of each stratum, by the hash of id and seed."""
    return top_per(df.withColumn("_hash", F.xxhash64(id_col, F.lit(seed))), strata, [F.asc("_hash"), F.asc(id_col)], per_stratum).drop("_hash", "rank")


def fill_by_diversity(pool: DataFrame, chosen: DataFrame, id_col: str, group: str, score: str, n: int) -> DataFrame:
    """n more items, those of groups chosen least so far first, then by score."""
    have = chosen.groupBy(group).agg(F.count("*").alias("_have"))
    free = pool.join(chosen, id_col, "left_anti").join(have, group, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), id_col))
    return free.withColumn("_turn", turn + F.col("_have")).orderBy("_turn", F.desc(score), id_col).limit(n).drop("_turn", "_have")


def append_absent(base: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """Base rows and those of ``more`` whose key isn't there yet."""
    return base.unionByName(more.select(*base.columns).join(base.select(*on), on, "left_anti"))


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
