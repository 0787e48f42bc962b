"""Removal of repeated passages: every byte under a 100-byte string that also starts earlier.

Equal strings must meet, without one worker sorting everything. Each window of ``width``
bytes has a key: the least hash of its ``GRAM``-byte strings, which depends on its content
alone. A segment is a run of windows of one key; some thirty windows share one.

1. Segments are dealt by key as numbers (two 64-bit hashes: key and content). Those without
   another of their key can't repeat anything and end here. The first of every other content
   goes on with its key, the second together with the first, and all others are copies. Tasks
   fold copies before the shuffle, and a key of many contents is dealt in parts, so that no
   key's rows meet in one task.
2. What goes on is fetched as bytes: segments of a key with several contents are dealt by
   key, and second segments that follow each other, as the first ones do, make a run that is
   dealt with the run of the first ones. Each task puts what it gets in document order into
   blocks, builds the block's suffix array by two-stage sorting and marks every window that
   shares ``width`` bytes with an earlier one. Copies are removed once the suffix array has
   found the second segment of their content to repeat the first throughout; where it has
   not, the hashes were wrong, and all copies of that key go through suffix arrays.
3. A key of more than ``KEY_BYTES`` is cut into parts, each sorted like a key. The windows that
   no part has found to repeat are dealt anew by what is near their key's string, ever more
   of it (all but ``STEPS`` bytes), until the parts of a key have met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, materialize, numbered_rows
from .suffix_array import later_windows
from .tokens import _texts

WIDTH = 100
GRAM = 32
CHUNK = 1 << 20
FOLD_ROWS = 400_000
#: Contents of one key in a fold from which on the others are dealt in so many parts.
FOLD_KEY, FOLD_PARTS = 64, 32
#: Segment bytes of one suffix array, and of one key or part of a large key.
BLOCK_BYTES, KEY_BYTES = 2_000_000, 64_000
#: Bytes of a window that the keys of one round after another leave out, less one; the last is repeated.
STEPS = (24, 6, 1)
#: Bytes of a run from which on another begins.
RUN_BYTES = 100_000
#: Large keys up to which they are broadcast to their segments; beyond, a shuffle join.
BROADCAST_KEYS = 100_000
_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of B and of its inverse modulo 2^64, and a random number for each byte."""
    if not _tables:
        inverse = pow(int(_B), -1, 1 << 64)
        for name, base in (("up", int(_B)), ("down", inverse)):
            powers = np.ones(CHUNK + 1, np.uint64)
            powers[1:] = np.uint64(base)
            _tables[name] = np.cumprod(powers, dtype=np.uint64)
        _tables["byte"] = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
    return _tables["up"], _tables["down"], _tables["byte"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_keys(text: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every window start of at most CHUNK bytes: its key, and where the key's string stands (the leftmost)."""
    up, down, of_byte = _powers()
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(of_byte[text] * down[: len(text)], out=sums[1:])
    hashes = _mixed((sums[gram:] - sums[:-gram]) * up[: len(text) - gram + 1])
    low = np.uint64(CHUNK - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: -(span - have)], least[span - have :])
    at = (least & low).astype(np.int64)
    return hashes[at], at


def _segments(texts: list[bytes], begins: list[int], width: int) -> tuple[np.ndarray, ...]:
    """Of texts of at most CHUNK bytes together: text number, begin, windows, key, content hash, repeats itself."""
    import xxhash

    joined = b"".join(texts)
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes) - sizes
    if len(joined) < width:
        return (np.zeros(0, np.int64),) * 6
    keys, at = window_keys(np.frombuffer(joined, np.uint8), width)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(keys)]
    valid = np.arange(len(keys)) + width <= (starts + sizes)[owner]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(keys)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    moved = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
    again = moved[first + count - 1] != moved[first]
    h = xxhash.xxh3_64_intdigest
    content = np.array([h(joined[a:b]) for a, b in zip(first.tolist(), (first + count - 1 + width).tolist(), strict=True)], np.uint64)
    mine = owner[first]
    return mine, first - starts[mine] + np.array(begins)[mine], count, keys[first].view(np.int64), content.view(np.int64), again


def _pack(begin: np.ndarray, windows: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One long: begin (31 bits), windows (30), mark (2)."""
    return (begin.astype(np.int64) << 32) | (windows.astype(np.int64) << 2) | mark.astype(np.int64)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> 2) & ((1 << 30) - 1), place & 3


#: Marks of a segment: none, goes on in any case, is a copy.
PLAIN, WANTED, COPY = 0, 1, 2
_SEGMENT = "route long, key long, content long, doc long, turn int, place long"


def _fold(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Marks all but the first two of equal segments as copies, which are dealt by document; deals a key of many contents in parts."""
    key, content, doc, turn, place = rows
    order = np.lexsort((place >> 32, turn, doc, content, key))
    key, content, doc, turn, place = (x[order] for x in rows)
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
    copy = same.copy()
    copy[1:] &= same[:-1]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    contents = np.cumsum(~same)
    many = contents - np.repeat(contents[starts], np.diff(np.append(starts, len(key)))) >= FOLD_KEY
    mark = np.where(copy, COPY, np.where(many, WANTED, place & 3))
    part = _mixed((key ^ (content & (FOLD_PARTS - 1))).view(np.uint64)).view(np.int64)
    route = np.where(copy, _mixed(doc.view(np.uint64)).view(np.int64), np.where(many, part, key))
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (route, key, content, doc, turn.astype(np.int32), place & ~np.int64(3) | mark)], names=["route", "key", "content", "doc", "turn", "place"]
    )


def _find_segments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            docs, turns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts: list[bytes] = []
            begins: list[int] = []
            owners: list[int] = []

            def flush(texts=texts, begins=begins, owners=owners, docs=docs, turns=turns) -> int:
                mine, begin, count, key, content, again = _segments(texts, begins, width)
                if len(mine):
                    who = np.array(owners)[mine]
                    rows.append([key, content, docs[who], turns[who].astype(np.int64), _pack(begin, count, again)])
                texts.clear(), begins.clear(), owners.clear()
                return len(mine)

            size = 0
            for k, text in enumerate(_texts(batch)):
                for begin in range(0, max(len(text) - width + 1, 0), CHUNK - width):  # longer texts in overlapping parts
                    part = text[begin : begin + CHUNK - 1]
                    if size + len(part) > CHUNK - 1:
                        n += flush()
                        size = 0
                    texts.append(part), begins.append(begin), owners.append(k)
                    size += len(part)
            n += flush()
            if n >= FOLD_ROWS:
                yield _fold([np.concatenate(x) for x in zip(*rows, strict=True)])
                rows, n = [], 0
        if rows:
            yield _fold([np.concatenate(x) for x in zip(*rows, strict=True)])

    return run


FIRST, SECOND, MORE = 0, 1, 2
_COMPARED = "key long, content long, doc long, turn int, begin long, finish long, nth int, from_doc long, from_turn int, from_begin long"


def _compare_segments(width: int):
    """Over rows sorted by route, key, content and place: firsts of keys of several contents, seconds with the place of their first, and copies."""

    def emit(rows: list[np.ndarray], nth: int, firsts: list[np.ndarray] | None = None) -> pa.RecordBatch:
        begin, windows, _ = _unpack(rows[5])
        doc, turn, place = firsts or (rows[3], rows[4], rows[5])
        columns = [rows[1], rows[2], rows[3], rows[4].astype(np.int32), begin, begin + windows - 1 + width, np.full(len(begin), nth, np.int32), doc, turn.astype(np.int32), place >> 32]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _COMPARED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last content's first row and how many rows it has had; whether that row waits for another content of its key
        held: list[np.ndarray] | None = None
        held_n, waiting = 0, False
        for batch in batches:
            rows = [c.to_numpy().astype(np.int64) for c in batch.columns]
            copies = (rows[5] & 3) == COPY
            if copies.any():
                yield emit([x[copies] for x in rows], MORE)
                rows = [x[~copies] for x in rows]
            if not len(rows[0]):
                continue
            new_key = np.append(True, rows[1][1:] != rows[1][:-1])
            first = new_key | np.append(True, rows[2][1:] != rows[2][:-1])
            if held is not None:
                new_key[0] = rows[1][0] != held[1][0]
                first[0] = new_key[0] or rows[2][0] != held[2][0]
                if first[0] and waiting:
                    if not new_key[0]:
                        yield emit(held, FIRST)
                    waiting = False
            starts = np.flatnonzero(first)
            lead = int(starts[0]) if len(starts) else len(first)  # rows that go on with the held content
            sizes = np.diff(np.append(starts, len(first)))
            nth = np.concatenate([held_n + np.arange(lead), np.arange(len(first) - lead) - np.repeat(starts - lead, sizes)])
            source = np.repeat(starts, sizes)  # of the rows after the lead: where their first stands
            if lead:
                some = np.arange(lead)[nth[:lead] == 1]
                if len(some):
                    yield emit([x[some] for x in rows], SECOND, [held[k] for k in (3, 4, 5)])
            some = np.flatnonzero(nth == 1)
            some = some[some >= lead]
            if len(some):
                at = source[some - lead]
                yield emit([x[some] for x in rows], SECOND, [rows[k][at] for k in (3, 4, 5)])
            if (nth > 1).any():
                yield emit([x[nth > 1] for x in rows], MORE)
            # a first goes on with its key if another content of the key stands before or after it
            wanted = ((rows[5][starts] & 3) == WANTED) | ~new_key[starts] | np.append(~new_key[starts[1:]], False)[: len(starts)]
            if len(starts):
                done = [x[starts[wanted]] for x in rows]
                if len(done[0]):
                    yield emit(done, FIRST)
                held, held_n, waiting = [x[starts[-1:]] for x in rows], int(sizes[-1]), not wanted[-1]
            else:
                held_n += lead

    return run


def _merge_runs(width: int):
    """Seconds sorted by document and begin to runs: two rows of one key each, the firsts' bytes and the seconds'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            doc, turn, begin, finish, from_doc, from_turn, from_begin = (c.to_numpy().astype(np.int64) for c in batch.columns)
            new = np.ones(len(doc), bool)
            same = (np.diff(doc) == 0) & (np.diff(turn) == 0) & (np.diff(from_doc) == 0) & (np.diff(from_turn) == 0) & (np.diff(from_begin - begin) == 0)
            new[1:] = ~same | (begin[1:] != finish[:-1] - width + 1)
            chain = np.repeat(begin[new], np.diff(np.append(np.flatnonzero(new), len(doc))))
            part = (begin - chain) // RUN_BYTES
            new[1:] |= part[1:] != part[:-1]
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(doc)) - 1
            size = finish[b] - begin[a]
            key = _mixed(_mixed(doc[a].view(np.uint64)) ^ (turn[a].astype(np.uint64) << np.uint64(44)) ^ begin[a].view(np.uint64)).view(np.int64)
            columns = [
                np.concatenate(x)
                for x in ((key, key), (from_doc[a], doc[a]), (from_turn[a], turn[a]), (from_begin[a], begin[a]), (from_begin[a] + size, finish[b]), (np.full(len(a), FIRST), np.full(len(a), SECOND)))
            ]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc", "turn", "begin", "finish", "nth"])

    return run


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their segments to one row per segment with its bytes."""
    for batch in batches:
        rows: list[list] = [[] for _ in _CUT]
        size = 0
        for doc, turn, text, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch), batch.column(3).to_pylist(), strict=True):
            for s in segments:
                data = text[s["begin"] : s["finish"]]
                for column, value in zip(rows, (s["key"], s["part"], s["nth"], doc, turn, s["begin"], data), strict=True):
                    column.append(value)
                size += len(data)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _CUT.values(), strict=True)], names=list(_CUT))
                rows, size = [[] for _ in _CUT], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _CUT.values(), strict=True)], names=list(_CUT))


#: part: -1 for a key that is whole; nth: SECOND where the segment speaks for copies.
_CUT = {"key": pa.int64(), "part": pa.int32(), "nth": pa.int32(), "doc": pa.int64(), "turn": pa.int32(), "begin": pa.int64(), "data": pa.binary()}
REMOVED, LEFT, WRONG = 0, 1, 2
#: What sorting gives: byte ranges to remove, windows of large keys to deal anew, keys whose hashes were wrong.
_SORTED = {"kind": pa.int32(), "key": pa.int64(), "doc": pa.int64(), "turn": pa.int32(), "begin": pa.int64(), "finish": pa.int64(), "data": pa.binary()}
_SORTED_SCHEMA = "kind int, key long, doc long, turn int, begin long, finish long, data binary"


def _near_keys(data: bytes, width: int, step: int) -> np.ndarray:
    """For every window: a hash of all of it but ``step`` - 1 bytes, the same for equal windows and, mostly, for neighbours."""
    up, down, of_byte = _powers()
    text = np.frombuffer(data, np.uint8)
    _, at = window_keys(text, width)
    part = (at - np.arange(len(at))) // step * step  # where in the window its key's string stands, rounded down
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(of_byte[text] * down[: len(text)], out=sums[1:])
    begin = at - part
    core = (sums[begin + width - step + 1] - sums[begin]) * up[begin]
    return _mixed(core ^ _mixed(part.astype(np.uint64) + np.uint64(step << 32))).view(np.int64)


def _sort_segments(width: int, step: int, alone: bool):
    """Over segments sorted by key and part: what the suffix arrays of blocks of whole parts show. ``alone``: a key's only segment is looked at too."""

    def rows(kind: int, key, doc, turn, begin, finish, data=None) -> pa.RecordBatch:
        n = len(doc)
        columns = [np.full(n, kind, np.int32), key, doc, turn.astype(np.int32), begin, finish]
        arrays = [pa.array(c, k) for c, k in zip(columns, list(_SORTED.values())[:6], strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(data if data is not None else [None] * n, pa.binary())], names=list(_SORTED))

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, nth, doc, turn, begin = (table.column(k).to_numpy().astype(np.int64) for k in range(6))
        order = np.lexsort((begin, turn, doc))  # document order, so that a smaller position is an earlier window
        data = table.column(6).combine_chunks()
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        key, part, nth, doc, turn, begin = (x[order] for x in (key, part, nth, doc, turn, begin))
        sizes = np.diff(offsets)[order]
        starts = np.cumsum(sizes + 1) - sizes - 1
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.full(int(sizes.sum()) + len(sizes) - 1, 0xFF, np.uint8)  # UTF-8 has no byte over 0xf4; with one added none is zero
        text[np.repeat(starts, sizes) + inside] = np.frombuffer(data.buffers()[2], np.uint8)[np.repeat(offsets[:-1][order], sizes) + inside] + np.uint8(1)
        windows = np.maximum(sizes - width + 1, 0)
        edge = np.zeros(len(text) + 1, np.int8)
        edge[starts[windows > 0]] = 1
        edge[(starts + windows)[windows > 0]] = -1
        new = np.append(False, (np.diff(doc) != 0) | (np.diff(turn) != 0))
        place = np.repeat((np.cumsum(new) << 40) + begin - starts, sizes + 1)[: len(text)] + np.arange(len(text))  # the same bytes may be here twice, in two runs
        repeated = later_windows(text, np.cumsum(edge[:-1], dtype=np.int8).astype(bool), width, place)
        edge = np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        mine = np.searchsorted(starts, first, "right") - 1
        if len(mine):
            yield rows(REMOVED, key[mine], doc[mine], turn[mine], begin[mine] + first - starts[mine], begin[mine] + last - starts[mine] + width)
        sums = np.concatenate([[0], np.cumsum(repeated)])
        open_ = sums[starts + windows] - sums[starts] < windows
        wrong = np.flatnonzero(open_ & (nth == SECOND))
        if len(wrong):
            yield rows(WRONG, key[wrong], doc[wrong], turn[wrong], begin[wrong], begin[wrong] + sizes[wrong])
        left: list[tuple] = []
        for k in np.flatnonzero(open_ & (part >= 0)).tolist():
            left += _left(data[int(order[k])].as_py(), repeated[starts[k] : starts[k] + windows[k]], int(doc[k]), int(turn[k]), int(begin[k]), width, step)
        for at in range(0, len(left), 20_000):
            *numbers, cut = zip(*left[at : at + 20_000], strict=True)
            yield rows(LEFT, *(np.array(x, np.int64) for x in numbers), data=cut)

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole parts, about BLOCK_BYTES at a time."""
        key, part = (table.column(k).to_numpy() for k in range(2))
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        counts = np.diff(np.append(starts, len(key)))
        if not alone:
            keep = np.repeat((counts > 1) | (part[starts] >= 0), counts)
            if not keep.all():
                table = table.filter(pa.array(keep))
                starts, counts = (x[(counts > 1) | (part[starts] >= 0)] for x in (starts, counts))
                starts = np.cumsum(counts) - counts
        if not len(table):
            return
        size = np.concatenate([[0], np.cumsum(pc.binary_length(table.column(6)).to_numpy().astype(np.int64))])
        begin = 0
        for at in np.flatnonzero(np.diff(size[starts] // BLOCK_BYTES)) + 1:
            yield from block(table.slice(begin, int(starts[at]) - begin))
            begin = int(starts[at])
        yield from block(table.slice(begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.column(6).nbytes
            if size < BLOCK_BYTES:
                continue
            table = pa.Table.from_batches(held)
            key, part = (table.column(k).to_numpy() for k in range(2))
            change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            if len(change):  # the last part may go on in the next batch
                whole, rest = table.slice(0, int(change[-1]) + 1), table.slice(int(change[-1]) + 1)
                yield from blocks(whole)
                held = rest.combine_chunks().to_batches()
                size = rest.nbytes
        if held:
            yield from blocks(pa.Table.from_batches(held))

    return run


def _left(data: bytes, done: np.ndarray, doc: int, turn: int, begin: int, width: int, step: int) -> Iterator[tuple]:
    """A segment's windows that aren't done, as segments of the next round's keys."""
    keys = _near_keys(data, width, step)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (done[1:] != done[:-1])
    first = np.flatnonzero(new)
    for a, b in zip(first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True):
        if not done[a]:
            yield int(keys[a]), doc, turn, begin + a, begin + b - 1 + width, data[a : b - 1 + width]


def _with_part(segments: DataFrame, size, spread) -> DataFrame:
    """Adds part, by ``spread``: -1 for a key of at most KEY_BYTES, else parts of about so many bytes."""
    sizes = segments.groupBy("key").agg(F.sum(size).alias("size")).where(F.col("size") > KEY_BYTES)
    sizes = materialize(sizes.select("key", F.ceil(F.col("size") / KEY_BYTES).cast("int").alias("parts")), "large-keys")
    few = sizes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    segments = segments.join(F.broadcast(sizes) if few else sizes, "key", "left")
    return segments.withColumn("part", F.coalesce(F.pmod(spread, F.col("parts")).cast("int"), F.lit(-1)))


def _sorted(cut: DataFrame, width: int, step: int, alone: bool) -> DataFrame:
    dealt = cut.select(*_CUT).repartition("key", "part").sortWithinPartitions("key", "part")
    return materialize(dealt.mapInArrow(_sort_segments(width, step, alone), _SORTED_SCHEMA), "sorted")


def _sort_all(numbered: DataFrame, segments: DataFrame, width: int, runs: DataFrame | None = None) -> list[DataFrame]:
    """What sorting gives in every round, first of the segments by key and of runs, then of what is left of large keys."""
    columns = ["key", "part", "nth", "doc", "turn", "begin", "finish"]
    parted = _with_part(segments, F.col("finish") - F.col("begin"), F.col("content")).select(*columns)
    if runs is not None:
        parted = parted.union(runs.withColumn("part", F.lit(-1)).select(*columns))
    per_doc = parted.groupBy("doc", "turn").agg(F.collect_list(F.struct("key", "part", "nth", "begin", "finish")).alias("segments"))
    cut = numbered.join(per_doc, ["doc", "turn"]).select("doc", "turn", "text", "segments").mapInArrow(_cut_bytes, "key long, part int, nth int, doc long, turn int, begin long, data binary")
    rounds = [_sorted(cut, width, STEPS[0], True)]
    while rounds[-1].where(F.col("kind") == LEFT).limit(1).count():
        left = rounds[-1].where(F.col("kind") == LEFT).withColumn("nth", F.lit(FIRST))
        parted = _with_part(left, F.length("data"), F.xxhash64("doc", "turn", "begin"))
        rounds.append(_sorted(parted, width, STEPS[min(len(rounds), len(STEPS) - 1)], False))
    return rounds


def removals(numbered: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, turn, begin, finish): byte ranges whose union is what repeats something earlier."""
    compared = (
        numbered.mapInArrow(_find_segments(width), _SEGMENT)
        .repartition("route").sortWithinPartitions("route", "key", "content", "doc", "turn", "place")
        .mapInArrow(_compare_segments(width), _COMPARED)
    )
    compared = materialize(compared, "segments")
    seconds = compared.where(F.col("nth") == SECOND)
    runs = seconds.select("doc", "turn", "begin", "finish", "from_doc", "from_turn", "from_begin").repartition("doc", "turn").sortWithinPartitions("doc", "turn", "begin")
    runs = runs.mapInArrow(_merge_runs(width), "key long, doc long, turn int, begin long, finish long, nth int")
    copies = compared.where(F.col("nth") == MORE)
    rounds = _sort_all(numbered, compared.where(F.col("nth") == FIRST), width, runs)
    wrong = rounds[0].where(F.col("kind") == WRONG).select("doc", "turn", F.col("begin").alias("a"), F.col("finish").alias("b"))
    if wrong.limit(1).count():  # equal hashes of unequal segments: all segments of these keys are sorted
        keys = materialize(seconds.join(wrong, ["doc", "turn"]).where("begin >= a and finish <= b").select("key").distinct(), "wrong-keys")
        again = compared.join(keys, "key", "left_semi").withColumn("content", F.xxhash64("doc", "turn", "begin")).withColumn("nth", F.lit(FIRST))
        firsts = seconds.join(keys, "key", "left_semi").select(  # the first of a content needn't be among the rows above
            "key", "content", F.col("from_doc").alias("doc"), F.col("from_turn").alias("turn"), F.col("from_begin").alias("begin"), (F.col("from_begin") + F.col("finish") - F.col("begin")).alias("finish"), F.lit(FIRST).alias("nth")
        )
        rounds += _sort_all(numbered, again.select(*firsts.columns).union(firsts).dropDuplicates(["key", "doc", "turn", "begin"]), width)
        copies = copies.join(keys, "key", "left_anti")
    out = copies.select("doc", "turn", "begin", "finish")
    for r in rounds:
        out = out.union(r.where(F.col("kind") == REMOVED).select("doc", "turn", "begin", "finish"))
    return out


def _apply(as_text: bool):
    kept_type = pa.string() if as_text else pa.binary()
    names = ["doc_id", "turn", "n_bytes", "n_removed", "n_spans", "kept", "removed"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kept_type, pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                out: list[list] = [[] for _ in names]
                for doc, turn, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch), batch.column(3).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for r in sorted(ranges or [], key=lambda r: r["begin"]):
                        if merged and r["begin"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r["finish"])
                        else:
                            merged.append([r["begin"], r["finish"]])
                    parts, last = [], 0
                    for a, b in merged:
                        parts.append(text[last:a])
                        last = b
                    kept = b"".join([*parts, text[last:]])
                    removed = [{"begin": a, "finish": b} for a, b in merged]
                    row = (None if doc == NULL_ID else doc, turn, len(text), sum(b - a for a, b in merged), len(merged), kept.decode(errors="ignore") if as_text else kept, removed)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, turn, n_bytes, n_removed, n_spans, kept (bytes), removed (byte ranges).

    Null text counts as empty. A null doc_id comes before all others; rows with equal doc_id
    count as documents of their own in the order of their texts, and turn (0, 1, ...) tells
    them apart. Texts shorter than ``width`` bytes lose nothing. Other columns are ignored.
    Empty table: no row. Kept bytes may begin or end inside a character where only part of
    it repeats; with ``as_text``, kept is a string without such parts.
    """
    numbered = numbered_rows(docs)
    ranges = removals(numbered, width).groupBy("doc", "turn").agg(F.collect_list(F.struct("begin", "finish")).alias("ranges"))
    joined = numbered.join(ranges, ["doc", "turn"], "left").select("doc", "turn", "text", "ranges")
    kept = "string" if as_text else "binary"
    return joined.mapInArrow(_apply(as_text), f"doc_id long, turn int, n_bytes long, n_removed long, n_spans long, kept {kept}, removed array<struct<begin: long, finish: long>>")
