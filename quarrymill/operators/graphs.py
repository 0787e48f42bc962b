"""Neighbour graphs, spanning trees, medoids and prototypes."""

from __future__ import annotations

from itertools import groupby
from math import dist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .joins import BROADCAST_BYTES, is_small
from .sequences import whole_keys


def _pairs(nodes: DataFrame, frame: list[str], node: str, x: str, y: str, team: str, same: bool) -> DataFrame:
    """Pairs of a frame's nodes (a frame is a picture: at most a few dozen), with their distance."""
    a = nodes.select(*frame, F.col(node).alias("a"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), F.col(team).alias("_at"))
    b = nodes.select(*frame, F.col(node).alias("b"), F.col(x).alias("_bx"), F.col(y).alias("_by"), F.col(team).alias("_bt"))
    meets = F.col("_at") == F.col("_bt") if same else F.col("_at") != F.col("_bt")
    distance = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2))
    return a.join(b, frame).where((F.col("a") != F.col("b")) & meets).withColumn("distance", distance)


def neighbour_edges(nodes: DataFrame, frame: list[str], node: str, x: str, y: str, team: str, k: int = 2, reach: float = 22.0) -> DataFrame:
    """Undirected edges a < b to the k nearest of the own team within reach."""
    p = _pairs(nodes, frame, node, x, y, team, True)
    rank = F.row_number().over(Window.partitionBy(*frame, "a").orderBy("distance", "b"))
    near = p.withColumn("_rank", rank).where((F.col("_rank") <= k) & (F.col("distance") <= reach))
    return near.select(*frame, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def pressure_edges(nodes: DataFrame, frame: list[str], node: str, x: str, y: str, team: str, reach: float = 12.0) -> DataFrame:
    """Edges a < b between teams within reach."""
    return _pairs(nodes, frame, node, x, y, team, False).where((F.col("a") < F.col("b")) & (F.col("distance") <= reach)).select(*frame, "a", "b", "distance")


def spanning_tree(nodes: DataFrame, frame: list[str], node: str, x: str, y: str) -> DataFrame:
    """Prim's tree of each frame from its smallest node; of equal distances the earlier connected node, then the smaller one."""

    def trees(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*frame, node])
        rows: list[tuple] = []
        for key, part in groupby(zip(*(g[c].tolist() for c in (*frame, node, x, y)), strict=True), lambda r: r[: len(frame)]):
            points = [r[len(frame) :] for r in part]
            # for every node outside: its distance to the tree, and the tree's node at that distance
            near = {k: (dist(points[0][1:], points[k][1:]), 0) for k in range(1, len(points))}
            joined = [0]
            place = {0: 0}
            while near:
                k = min(near, key=lambda k: (near[k][0], place[near[k][1]], k))
                length, parent = near.pop(k)
                rows.append((*key, points[parent][0], points[k][0], length))
                place[k] = len(joined)
                joined.append(k)
                for j, (d, _) in near.items():
                    new = dist(points[k][1:], points[j][1:])
                    if new < d:
                        near[j] = (new, k)
        return pd.DataFrame(rows, columns=[*frame, "a", "b", "distance"])

    kind = nodes.schema[node].dataType.simpleString()
    types = ", ".join(f"{f} {nodes.schema[f].dataType.simpleString()}" for f in frame)
    return whole_keys(nodes.select(*frame, node, x, y), frame, trees, f"{types}, a {kind}, b {kind}, distance double")


def medoid_by_sum(df: DataFrame, keys: list[str], id_col: str, vector: str) -> DataFrame:
    """Per group the member of the least total cosine distance (of equal ones the smallest id).

    With unit vectors the total distance of a member is n less its dot product with the
    sum of all, so no pairs are formed. Sums are rounded to 9 digits before they are compared.
    """
    flat = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    sums = flat.groupBy(*keys, "dim").agg(F.sum(F.col("x").cast("double")).alias("s"))
    total = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda p: p["s"]).alias("_sum"))
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    scored = df.join(total, keys).join(n, keys).withColumn("_d", F.round(F.col("_n") - dot(F.col(vector), F.col("_sum")), 9))
    return scored.groupBy(*keys).agg(F.min_by(id_col, F.struct("_d", id_col)).alias("medoid"), F.min("_d").alias("total_distance"))


def _blocks(rows: DataFrame, by: str) -> list[DataFrame]:
    """A table whole where it is small enough to broadcast, else in parts by hash that are."""
    if is_small(rows):
        return [rows]
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0]
    n = 2 * size // BROADCAST_BYTES + 1
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(n)) == k) for k in range(n)]


def nearest_prototype(items: DataFrame, prototypes: DataFrame, id_col: str, vector: str, label: str, prototype: str) -> DataFrame:
    """id, label, distance, second (distance of the next label), margin relative to it.

    ``prototypes`` is one row per label. Items meet all of them at once where these are
    measured and found small, else one block after another, of which the best two remain.
    """
    distance = F.round(1 - dot(F.col(vector), F.col(prototype)), 9)
    two = F.slice(F.sort_array(F.collect_list(F.struct("d", label))), 1, 2)

    def best(block: DataFrame) -> DataFrame:
        d = items.select(id_col, vector).crossJoin(F.broadcast(block)).select(id_col, label, distance.alias("d"))
        return d.groupBy(id_col).agg(two.alias("two"))

    found = [best(block) for block in _blocks(prototypes.select(label, prototype), label)]
    g = found[0]
    if len(found) > 1:
        for f in found[1:]:
            g = g.union(f)
        g = g.select(id_col, F.explode("two").alias("x")).select(id_col, "x.*").groupBy(id_col).agg(two.alias("two"))
    first, second = F.col("two")[0], F.get("two", F.lit(1))
    return g.select(id_col, first[label].alias(label), first["d"].alias("distance"), second["d"].alias("second"), ((second["d"] - first["d"]) / F.greatest(second["d"], F.lit(1e-8))).alias("margin"))


def vetoed(classified: DataFrame, others: DataFrame, id_col: str, vector: str, other: str) -> DataFrame:
    """Adds other_distance and veto: whether some vector of the ``others`` is at least as near as the class; others are met in blocks of bounded size."""
    d = F.round(1 - dot(F.col(vector), F.col(other)), 9)
    near = None
    for block in _blocks(others.select(other), other):
        part = classified.select(id_col, vector).crossJoin(F.broadcast(block)).groupBy(id_col).agg(F.min(d).alias("other_distance"))
        near = part if near is None else near.union(part)
    near = near.groupBy(id_col).agg(F.min("other_distance").alias("other_distance"))
    return classified.join(near, id_col, "left").withColumn("veto", F.coalesce(F.col("other_distance") <= F.col("distance"), F.lit(False)))


def holder(players: DataFrame, frame: list[str], distance: Column, team: str, player: str, *ties: str) -> DataFrame:
    """Per frame: the player nearest to the ball, its team and distance, and the nearest opponent's distance. Of equally
    near rows the smallest player counts, then ``ties`` (a player with two rows may have two teams)."""
    near = players.withColumn("_d", distance)
    first = near.groupBy(*frame).agg(F.min_by(F.struct(F.col(player).alias("player"), F.col(team).alias("team"), F.col("_d").alias("d")), F.struct("_d", player, *ties)).alias("h"))
    opp = near.join(first, frame).where(F.col(team) != F.col("h.team")).groupBy(*frame).agg(F.min("_d").alias("opponent_distance"))
    return first.select(*frame, F.col("h.player").alias("holder"), F.col("h.team").alias("holder_team"), F.col("h.d").alias("holder_distance")).join(opp, frame, "left")
