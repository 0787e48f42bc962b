"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``tau`` bits are found without comparing all pairs. The 64 bits are
put into m groups, correlated bits together. If two fingerprints differ in at most tau
bits, then for thresholds t_1..t_m that sum to tau - m + 1 some group differs in at most
its t_i (a group with -1 needn't be looked at). The thresholds are unequal: a dynamic
programme picks those of the fewest expected candidates, m included. Each fingerprint is
filed under its value of every group, and looked up under all values within t_i bits.
What meets in a value is verified on all 64 bits.

``similar_documents`` takes the same search as a filter: documents whose fingerprints are
within some bits, over links of others, form a group, in which the pairs within these bits are
linked if their sets of word shingles are as alike as is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered_rows, text_or_empty
from .components import connected_components
from .tokens import _texts

BITS = 64
SHINGLE = 4
SEED = 42
#: Rows of one bucket that are compared in one place; a larger bucket is cut into blocks of half this size.
BUCKET_ROWS = 8192
#: A look-up costs about as much as so many verified candidates.
PROBE_COST = 40.0
#: The largest longs, so many, stand for fingerprints that no row with an id has.
NOBODY = 1 << 50
#: Rows of one group whose shingles are compared in one place; a larger group is cut into blocks of half this size.
GROUP_ROWS = 1024
#: Bits of the maps of shingles that rule most unlike pairs out.
MAP_BITS = 4096


def fingerprint_of(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included; no words: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    h = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    n = len(starts)
    ends = ends[size - 1 :].tolist()
    for at in range(0, n, 4096):
        values = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : at + 4096], ends[at : at + 4096], strict=True)], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(x, size) for x in _texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ the plan


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(values), 65536):
                x = np.unpackbits(values[at : at + 65536], axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(x)
        if n:
            rows = np.append(total.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], names=["cell", "n"])

    cells = prints.select("fp").mapInArrow(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at most
    flat = np.zeros(BITS * BITS + 1)
    for row in cells:
        flat[row.cell] = row.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size: each starts with the least correlated free bit and takes its most correlated ones."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = -(-len(free) // (m - k))
        group = [min(free, key=lambda b: (correlation[b, free].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def expected_candidates(n: int, together: np.ndarray, group: list[int], t_max: int) -> list[float]:
    """Pairs expected to differ in at most t bits of the group, for t = 0..t_max.

    Two fingerprints agree in a bit of frequency p with p^2 + (1-p)^2; a bit that follows
    an earlier one of the group agrees given that the earlier one does, at the pair rate
    read from the counts of both set. Beyond t = 0, the odds of single bits to differ give
    the elementary symmetric sums.
    """
    p = np.diag(together) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    chance = agree[group[0]]
    for k, b in enumerate(group[1:], 1):
        rates = []
        for a in group[:k]:
            both = together[a, b] / max(n, 1)
            cells = np.array([both, p[a] - both, p[b] - both, 1 - p[a] - p[b] + both])
            rates.append((cells**2).sum() / agree[a])
        chance *= min(1.0, max([agree[b], *rates]))
    odds = (1 - agree[group]) / np.maximum(agree[group], 1e-9)
    sums = np.zeros(t_max + 1)
    sums[0] = 1
    for odd in odds:
        for t in range(t_max, 0, -1):
            sums[t] += sums[t - 1] * odd
    pairs = n * (n - 1) / 2
    return [float(pairs * min(1.0, chance * sums[: t + 1].sum())) for t in range(t_max + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 (which costs nothing) that sum to ``total`` at the least cost; costs[i][t]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (value, chosen) in best.items():
            for t in range(-1, len(cost)):
                c = value + (cost[t] if t >= 0 else 0.0)
                if used + t not in after or c < after[used + t][0]:
                    after[used + t] = (c, [*chosen, t])
        best = after
    return best[total]


def make_plan(n: int, together: np.ndarray, tau: int, max_groups: int = 6) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group to look at, by the least expected work.

    Thresholds go up to 3, or as far as ``max_groups`` groups need for tau.
    """
    plans = []
    top = min(tau, max(3, -(-(tau - max_groups + 1) // max_groups)))
    for m in range(2, max_groups + 1):
        groups = group_bits(n, together, m)
        costs = []
        for group in groups:
            pairs = expected_candidates(n, together, group, top)
            probes = [sum(comb(len(group), j) for j in range(1, t + 1)) / 2 + 1 for t in range(len(pairs))]
            costs.append([c + PROBE_COST * n * q for c, q in zip(pairs, probes, strict=True)])
        if -m <= tau - m + 1 <= m * top:
            cost, chosen = allocate(costs, tau - m + 1)
            plans.append((cost, m, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


# ------------------------------------------------------- probing and verifying


def _gather(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits of each fingerprint as a small number."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def bucket_rows(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, look_up, fp): each fingerprint under its own values, and under those to look up.

    Of two values that differ in a mask only the one whose lowest differing bit is 0 looks
    the other up, so each pair meets once per mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 20_000):
                raw = whole.column(0).slice(at, 20_000).to_numpy().astype(np.int64)
                fp = raw.view(np.uint64)
                for i, (group, threshold) in enumerate(plan):
                    tag = np.uint64(i) << np.uint64(58)
                    value = _gather(fp, group)
                    for t in range(threshold + 1):
                        for flips in combinations(range(len(group)), t):
                            mask = np.uint64(sum(1 << f for f in flips))
                            own = np.ones(len(fp), bool) if not t else (value >> np.uint64(flips[0])) & np.uint64(1) == 0
                            keys = ((value[own] ^ mask) | tag).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), t > 0)), pa.array(raw[own])], names=["bucket", "look_up", "fp"])

    return prints.select("fp").mapInArrow(run, "bucket long, look_up boolean, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per node: (node, smallest node of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


class _Links:
    """Collects verified pairs and shrinks them to a forest whenever there are many."""

    def __init__(self, limit: int = 1_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n, self.limit = 0, limit

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.n += len(a)
            if self.n > self.limit:
                self.parts = [self.take()]
                self.n = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _forest(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def _verify(bucket: np.ndarray, look_up: np.ndarray, fp: np.ndarray, tau: int, links: _Links) -> None:
    """All pairs of equal bucket (rows sorted by it) but those of two look-ups, in steps of distance."""
    bits = fp.view(np.uint64)
    alive = np.flatnonzero(bucket[:-1] == bucket[1:])
    step = 1
    while len(alive):
        for at in range(0, len(alive), 2_000_000):
            left = alive[at : at + 2_000_000]
            right = left + step
            near = (np.bitwise_count(bits[left] ^ bits[right]) <= tau) & ~(look_up[left] & look_up[right])
            links.add(fp[left[near]], fp[right[near]])
        step += 1
        alive = alive[alive + step < len(bucket)]
        alive = alive[bucket[alive] == bucket[alive + step]]


def near_links(prints: DataFrame, tau: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints whose components are those of all pairs within tau bits.

    A bucket of at most BUCKET_ROWS rows is compared in one task. A larger one is cut into
    blocks by a hash, and every pair of blocks is compared in a task of its own, so no task
    holds more than BUCKET_ROWS rows of it on average and no pair is lost. Tasks give
    back forests, never all pairs of a group.
    """
    n, together = bit_statistics(prints)
    plan = make_plan(n, together, tau)
    rows = bucket_rows(prints, plan)
    rows = materialize(rows, "buckets")
    cut = _in_cells(rows, "bucket", "fp", BUCKET_ROWS).select("bucket", "cell", "look_up", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        kept: list[np.ndarray] = []
        for batch in batches:
            table = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if kept:
                table = [np.concatenate(x) for x in zip(kept, table, strict=True)]
            same = (table[0] == table[0][-1]) & (table[1] == table[1][-1])
            first = int(np.argmax(same))  # the last bucket may go on in the next batch
            kept = [x[first:] for x in table]
            _verify_cells([x[:first] for x in table], tau, links)
        if kept:
            _verify_cells(kept, tau, links)
        a, b = links.take()
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], names=["a", "b"])

    return cut.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(run, "a long, b long")


def _verify_cells(table: list[np.ndarray], tau: int, links: _Links) -> None:
    bucket, cell, look_up, fp = table
    if len(bucket) < 2:
        return
    change = (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])
    _verify(np.concatenate([[0], np.cumsum(change)]), look_up.astype(bool), fp, tau, links)


def _in_cells(rows: DataFrame, group: str, by: str, most: int) -> DataFrame:
    """Adds cell: 0 in groups of at most ``most`` rows; rows of a larger one are copied to every pair of their block and another."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > most).select(group, F.ceil(F.col("_n") / (most // 2)).cast("int").alias("_blocks"))
    mine = F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    cell = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(others, lambda o: F.greatest(o, mine) * F.col("_blocks") + F.least(o, mine)))
    return rows.join(large, group, "left").withColumn("cell", F.explode(cell)).drop("_blocks")


def near_duplicates(docs: DataFrame, tau: int = 4, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most tau bits, the
    document itself included. Null and empty texts have fingerprint zero and are linked
    like any other. Rows with equal doc_id are kept one by one (a row each, linked as
    documents of that id). Rows with a null doc_id link others as any row does, but are no
    component's smallest; where no id is reachable, component_id is null. Other columns
    are ignored. Empty table: no row.
    """
    prints = materialize(with_fingerprint(docs, size), "fingerprints")
    # one row per distinct fingerprint: copies fold before any search
    nobody = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64("fp"), F.lit(NOBODY))  # above all ids: a fingerprint of rows without ids
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("own_id")).select("fp", F.coalesce("own_id", nobody).alias("first_id")), "classes")
    links = near_links(classes.select("fp"), tau)
    a, b = (classes.select(F.col("fp").alias(x), F.col("first_id").alias(f"{x}_first")) for x in "ab")
    # equal ids of different fingerprints are one node already
    shared = prints.join(classes, "fp").where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    repeated = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    shared = shared.join(repeated, shared.a == repeated.doc_id, "left_semi")
    found = connected_components(links.join(a, "a").join(b, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b")).union(shared))
    component = classes.join(found, classes.first_id == found.node, "left").select("fp", F.coalesce("component", "first_id").alias("component_id"))
    component = component.select("fp", F.when(F.col("component_id") <= (1 << 63) - 1 - NOBODY, F.col("component_id")).alias("component_id"))
    return prints.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------- shingles beside bits


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted XXH64 values of the different word shingles; fewer words are one shingle, none no shingle."""
    import xxhash

    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.unique(np.array([h(b" ".join(words[k : k + size]), SEED) for k in range(len(words) - size + 1)], np.uint64))


def linked_pairs(nodes: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], tau: int, least: float) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs within tau bits whose sets have a Jaccard similarity of ``least``."""
    n = len(nodes)
    sizes = np.array([len(x) for x in sets])
    maps = np.zeros((n, MAP_BITS), bool)
    for k, x in enumerate(sets):
        maps[k, (x % np.uint64(MAP_BITS)).astype(np.int64)] = True
    hidden = sizes - maps.sum(1)  # shingles behind another one's bit
    maps = np.packbits(maps, axis=1).view(np.uint64)
    label = np.arange(n)
    links = []
    for i in range(n - 1):
        j = np.flatnonzero((np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= tau) & (label[i + 1 :] != label[i])) + i + 1
        for at in range(0, len(j), 4096):
            some = j[at : at + 4096]
            most = np.bitwise_count(maps[some] & maps[i]).sum(1, dtype=np.int64) + np.minimum(hidden[some], hidden[i])
            for k in some[most * (1 + least) >= least * (sizes[some] + sizes[i]) - 1e-6].tolist():
                if label[k] != label[i]:
                    common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if common >= least * (sizes[i] + sizes[k] - common) - 1e-9:
                        links.append((int(nodes[i]), int(nodes[k])))
                        label[label == label[k]] = label[i]
    return links


def similar_documents(docs: DataFrame, least: float = 0.8, shingle: int = 5, tau: int = 8, size: int = 2) -> DataFrame:
    """One row per document: doc (its doc_id, null as the least long), turn, first_doc, first_turn.

    Documents are linked whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``least`` or more and whose fingerprints over ``size``-word shingles are within ``tau`` bits;
    first_doc and first_turn name the smallest document that is reachable. Fingerprints over
    fewer words change less by an edit, so they lose few of the similar pairs.

    Rows of equal doc_id are documents of their own, told apart by turn in the order of their
    texts. Null and empty texts have no shingle and are linked with each other alone. Other
    columns are ignored. Empty table: no row.
    """
    import xxhash

    numbered = numbered_rows(docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(_texts(batch))
            fp = np.array([fingerprint_of(x, size) for x in texts], np.uint64).view(np.int64)
            same = np.array([xxhash.xxh3_64_intdigest(shingle_set(x, shingle).tobytes()) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(same)], names=["doc", "turn", "fp", "same"])

    prints = materialize(numbered.select("doc", "turn", "text").mapInArrow(measure, "doc long, turn int, fp long, same long"), "prints")
    # one row per set of shingles: copies fold before any search, and a class is known by its first document
    node = F.when(F.col("head.turn") == 0, F.col("head.doc")).otherwise(F.xxhash64("head.doc", "head.turn"))
    classes = prints.groupBy("fp", "same").agg(F.min(F.struct("doc", "turn")).alias("head")).select("fp", "same", "head", node.alias("node"))
    classes = materialize(classes, "classes")
    near = connected_components(near_links(classes.select("fp").distinct(), tau))
    grouped = classes.join(near, classes.fp == near.node, "left").select(classes.node, "fp", "head", F.coalesce("component", "fp").alias("group"))
    grouped = grouped.join(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "group", "left_semi")
    grouped = grouped.select("node", "fp", "group", F.col("head.doc").alias("doc"), F.col("head.turn").alias("turn"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, shingle).view(np.int64) for x in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sets, pa.list_(pa.int64()))], names=["group", "node", "fp", "shingles"])

    sets = numbered.join(grouped, ["doc", "turn"]).select("group", "node", "fp", "text").mapInArrow(with_sets, "group long, node long, fp long, shingles array<long>")
    cut = _in_cells(materialize(sets, "shingles"), "group", "node", GROUP_ROWS).select("group", "cell", "node", "fp", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> pa.RecordBatch:
            nodes, fp = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
            found = linked_pairs(nodes, fp.view(np.uint64), [r[4] for r in rows], tau, least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        rows: list[tuple] = []  # of one cell
        for batch in batches:
            shingles = batch.column(4)
            for k, head in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if rows and rows[0][:2] != head[:2]:
                    yield links(rows)
                    rows = []
                rows.append((*head, shingles[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        if rows:
            yield links(rows)

    found = connected_components(cut.repartition("group", "cell").sortWithinPartitions("group", "cell", "node").mapInArrow(compare, "a long, b long"))
    found = found.withColumnRenamed("node", "n")
    whole = classes.join(found, classes.node == found.n, "left").select("fp", "same", "head", F.coalesce("component", "node").alias("component"))
    firsts = whole.groupBy("component").agg(F.min("head").alias("first"))
    return prints.join(whole.join(firsts, "component").select("fp", "same", "first"), ["fp", "same"]).select(
        "doc", "turn", F.col("first.doc").alias("first_doc"), F.col("first.turn").alias("first_turn")
    )
