"""Phrase collocation mining: count-min sketches choose what is counted exactly, then phrases are scored and subsumed."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty

NO_LANG = "und"
MOST_WORDS = 5
#: Rows of a sketch, and the most cells of each (a byte per cell in a task, a bit in the merged sketch).
DEPTH, MOST_CELLS = 2, 1 << 25
#: A row has a cell for so many bytes of text, until it has MOST_CELLS.
BYTES_PER_CELL = 16
#: Cells that travel as one row of the merge.
BLOCK = 1 << 16
#: Words of texts that a task handles at once; a text is split into words by slices of so many bytes.
CHUNK_WORDS, SLICE = 1 << 19, 1 << 20
#: Words that a task remembers with their hashes.
MOST_KNOWN = 300_000
#: Tasks of a pass over the texts, for every core. As each hands on a sketch and a count of nearly every phrase, they don't grow with the texts.
TASKS_PER_CORE = 2
#: Phrases whose counts a task adds up over its texts before it hands them on.
MOST_HELD = 400_000
#: Every phrase that others consist of is copied so often, so that a frequent one isn't joined in one task.
SALTS = 16

_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_LOWER[0] + _BREAKS + b"\t", _LOWER[1] + b"." * len(_BREAKS) + b" ")
_END = b"."
_GAP = re.compile(b"[ \t" + re.escape(_BREAKS) + b"]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, with ``b"."`` at every end of a piece; no word holds a full stop."""
    return text.translate(_TABLE).replace(_END, b" . ").split()


class _Words:
    """Numbers and hashes of the words that a task has met; numbers are exact, 0 is the end of a piece."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {_END: 0}
        self.words: list[bytes] = [_END]
        self.hashes = array("Q", [0])

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.number
        for word in set(tokens).difference(known):
            known[word] = len(self.words)
            self.words.append(word)
            self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.hashes, np.uint64)[numbers]


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about SLICE bytes that begin and end between words."""
    at = 0
    while len(text) - at > SLICE and (gap := _GAP.search(text, at + SLICE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch], words: _Words) -> Iterator[tuple[str, np.ndarray]]:
    """Numbers of the words of many texts of one language (columns lang, text) at once.

    Only numbers wait, four bytes each, not the words. When there are too many words to
    remember, all that waits is handed on first, as its numbers mean nothing afterwards.
    """
    waiting: dict[str, array] = {}
    waits = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = waiting.setdefault(lang, array("i"))
            waits -= len(held)
            for some in _slices(text.as_buffer().to_pybytes()):
                held.frombytes(words.numbers(tokens_of(some)).tobytes())
            held.append(0)
            if len(held) >= CHUNK_WORDS:
                yield lang, np.frombuffer(waiting.pop(lang), np.int32)
            else:
                waits += len(held)
            full = len(words.words) > MOST_KNOWN
            if full or waits >= 2 * CHUNK_WORDS:
                yield from ((k, np.frombuffer(v, np.int32)) for k, v in waiting.items())
                waiting, waits = {}, 0
            if full:
                words.clear()
    yield from ((k, np.frombuffer(v, np.int32)) for k, v in waiting.items())


def _parts(tokens: list[bytes] | np.ndarray) -> Iterator[tuple[list[bytes] | np.ndarray, int]]:
    """A long list of words or their numbers in parts with the words that follow each, and how many of a part are its own."""
    for at in range(0, len(tokens), CHUNK_WORDS):
        part = tokens[at : at + CHUNK_WORDS + MOST_WORDS - 1]
        yield part, min(CHUNK_WORDS, len(tokens) - at)


def _phrase_keys(numbers: np.ndarray, hashes: np.ndarray, lang: str, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to MOST_WORDS words: hashes of the phrases that begin at every token, and where these are phrases of one piece."""
    import xxhash

    whole, seed = numbers > 0, np.uint64(xxhash.xxh3_64_intdigest(lang))
    key, good = np.full(len(numbers), seed), np.ones(len(numbers), bool)
    for n in range(1, MOST_WORDS + 1):
        m = len(numbers) - n + 1
        if m <= 0:
            return
        key = (key[:m] ^ hashes[n - 1 :]) * _MULTIPLIER
        key ^= key >> np.uint64(29)
        good = good[:m] & whole[n - 1 :]
        yield key[:own], good[:own]


def _cells(key: np.ndarray, row: int, cells: int) -> np.ndarray:
    h = (key ^ (key >> np.uint64(32))) * _MIXERS[row]
    return (h >> np.uint64(64 - int(cells).bit_length() + 1)).astype(np.uint32)


class Sketch:
    """Count-min sketch whose cells stop at ``most``: sums of such sketches reach ``most`` wherever the true sums do."""

    def __init__(self, cells: int, most: int, depth: int = DEPTH):
        self.cells, self.most = cells, most
        self.rows = np.zeros((depth, cells), np.uint8 if most < 256 else np.uint32)

    def add(self, keys: np.ndarray) -> None:
        for k, row in enumerate(self.rows):
            at = _cells(keys, k, self.cells)
            at.sort()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
            at, n = at[first], np.diff(first, append=len(at))
            row[at] = np.minimum(row[at] + n, self.most)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Numbered blocks that aren't all zero, compressed."""
        size, codec = min(BLOCK, self.cells), pa.Codec("zstd", 1)
        for k, block in enumerate(self.rows.reshape(-1, size)):
            if block.any():
                yield k, codec.compress(block.tobytes(), asbytes=True)


def _survivors(docs: DataFrame, least: int, cells: int) -> np.ndarray:
    """Bits of the merged sketch, one row of bytes per row of it: cells whose count reaches ``least``.

    Every task sketches its texts; the blocks of the sketches are added by Spark, each in
    the task that its number goes to. What comes to the driver is DEPTH * cells bits, 8 MB
    at most, whatever the number of documents.
    """
    spark, size = docs.sparkSession, min(BLOCK, cells)
    kind = np.uint8 if least < 256 else np.uint32

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Sketch(cells, least), _Words()
        for lang, whole in _chunks(batches, words):
            for numbers, n in _parts(whole):
                for key, good in _phrase_keys(numbers, words.hashed(numbers), lang, n):
                    own.add(key[good])
        for block, data in own.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd"), {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(codec.decompress(data, size * kind().itemsize, asbytes=True), kind)
                held = sums.setdefault(block, np.zeros(size, np.uint32))
                np.minimum(held + one, least, out=held)
        for block, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(held >= least).tobytes()], pa.binary())], names=["block", "bits"])

    parts = min(DEPTH * cells // size, shuffle_partitions(spark))
    merged = docs.mapInArrow(sketch, "block int, cells binary").repartition(parts, "block").mapInArrow(add, "block int, bits binary")
    bits = np.zeros((DEPTH * cells // size, size // 8), np.uint8)
    for row in merged.collect():
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(DEPTH, -1)


def _among(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where all rows of the merged sketch let a key pass."""
    passed = np.ones(len(key), bool)
    for k, row in enumerate(bits):
        at = _cells(key, k, 8 * len(row))
        passed &= (row[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return passed


def phrase_counts(docs: DataFrame, least: int = 100, cells: int | None = None) -> DataFrame:
    """lang, phrase (words joined by spaces), words (1 to 5), f: exact counts of all phrases that occur ``least`` times or more; words 0: all words of a language.

    The first pass over ``docs(lang, text)`` fills the sketch, the second one counts exactly
    the phrases that it lets pass, with their begins and ends. As a sketch only
    overestimates, no frequent phrase is missed; what passes without being frequent is
    dropped by its exact count. ``cells`` per row of the sketch follow the size of the texts
    up to MOST_CELLS; beyond that more phrases pass and are counted, with equal results.
    A task reads as many parts of the table as TASKS_PER_CORE asks for, so that the counts
    to be added up grow with the phrases, not with phrases times parts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"), text_or_empty().alias("text"))
    if cells is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        cells = min(MOST_CELLS, max(1 << 12, 1 << (max(1, size // BYTES_PER_CELL) - 1).bit_length()))
    docs = docs.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(_survivors(docs, least, cells))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, held = shared.value, _Words(), _Held()
        for lang, whole in _chunks(batches, words):
            for numbers, n in _parts(whole):
                for counted in _count_part(lang, numbers, words, bits, n):
                    yield from held.add(counted)
        yield from held.rows()

    found = docs.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


class _Held:
    """Counts of a task, added up by language, size and phrase; handed on beyond MOST_HELD phrases."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], dict[str, int]] = {}

    def add(self, counted: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Add rows of one language and size."""
        own = self.counts.setdefault((counted["lang"][0].as_py(), counted["words"][0].as_py()), {})
        for phrase, n in zip(counted["phrase"].to_pylist(), counted["f"].to_pylist(), strict=True):
            own[phrase] = own.get(phrase, 0) + n
        if sum(map(len, self.counts.values())) > MOST_HELD:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, n), own in self.counts.items():
            phrases, counts = list(own), list(own.values())
            for k in range(0, len(phrases), 100_000):
                yield _rows(lang, phrases[k : k + 100_000], n, counts[k : k + 100_000])
        self.counts = {}


def _count_part(lang: str, numbers: np.ndarray, words: _Words, bits: np.ndarray, own: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that pass, by exact numbers of words; a phrase passes only if its own begin and end of one word less do."""
    hashes = words.hashed(numbers)
    yield _rows(lang, [""], 0, [int((numbers[:own] > 0).sum())])
    code, alive, spelled = numbers, np.zeros(0, bool), []
    for n, (key, good) in enumerate(_phrase_keys(numbers, hashes, lang, len(numbers)), 1):
        if n > 1:
            good = good & alive[: len(good)] & alive[1 : len(good) + 1]
        at = np.flatnonzero(good)
        at = at[_among(key[at], bits)]
        if not len(at):
            return
        pair = code[at] if n == 1 else code[at].astype(np.int64) << 32 | numbers[at + n - 1]
        names, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        heads = code[at[first]]
        tails = [words.words[k] for k in numbers[at[first] + n - 1].tolist()]
        spelled = tails if n == 1 else [spelled[h] + b" " + t for h, t in zip(heads.tolist(), tails, strict=True)]
        counts = np.bincount(inverse[at < own], minlength=len(names))
        seen = np.flatnonzero(counts)
        for k in range(0, len(seen), 100_000):
            some = seen[k : k + 100_000]
            yield _rows(lang, [spelled[x].decode() for x in some.tolist()], n, counts[some])
        code, alive = np.zeros(len(numbers), np.int32), np.zeros(len(numbers), bool)
        code[at], alive[at] = inverse, True


def _rows(lang: str, phrases: list[str], n: int, counts) -> pa.RecordBatch:
    many = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * many), pa.array(phrases), pa.array([n] * many, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "f"])


def _span(words: Column, begin: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def score_phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every counted phrase of two words or more, at the cut of the lowest score (ties: the first)."""
    split = F.split("phrase", " ")
    phrases = counts.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), split.alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(_span(F.col("w"), 1, F.col("k")), _span(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")))).alias("side", "part"))
    salt = F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).cast("int")
    parts = counts.where(f"words between 1 and {MOST_WORDS - 1}").select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sides = sides.withColumn("salt", salt)
    known = sides.join(parts, (sides.lang == parts.of) & (sides.part == parts.part) & (sides.salt == parts.salt))
    both = known.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))  # a row per language, joined by Spark as it finds best
    both = both.join(totals, "lang")
    whole = lambda c: c.cast("decimal(19,0)")
    scored = both.withColumn("up", whole(F.col("a") * 1000) * whole(F.col("n"))).withColumn("down", whole(F.col("l")) * whole(F.col("r"))).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def not_subsumed(counts: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase of those phrases that stand in no longer counted phrase of ``share`` percent of their count or more."""
    w, size = F.col("w"), F.size("w")
    longer = counts.where("words >= 3").select("lang", F.split("phrase", " ").alias("w"), "f")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: _span(w, at, m))))
    inside = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    phrases = counts.where("words >= 2").select("lang", "phrase", "f")
    return phrases.join(inside, ["lang", "phrase"], "left").where(f"above is null or 100 * above < {share} * f").select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100, cells: int | None = None) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A phrase is two to five words of one piece of a text; pieces end at ``.,;:!?`` and line
    ends. a counts the phrase, n all words, l and r the two parts at the cut whose score
    1000 * a * n / (l * r), rounded down, is least. Phrases inside a longer one of nearly
    the same count go. Order: score and a descending, then the phrase's bytes.

    A null language is "und". Null and empty texts have no words; repeated rows count each.
    Other columns are ignored. Empty table: no row.
    """
    counts = materialize(phrase_counts(docs, least, cells), "phrase-counts")
    kept = score_phrases(counts).join(not_subsumed(counts, share), ["lang", "phrase"], "left_semi")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the best of every salt first, so that no task sorts a whole language
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return salted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_COUNTED = " UNION ALL ".join(
    f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase, {n} AS words, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n}) GROUP BY 1, 2 HAVING count(*) >= 100"
    for n in range(1, MOST_WORDS + 1)
)
#: The contract's query in DuckDB.
COLLOCATIONS_SQL = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1
), counted AS MATERIALIZED ({_COUNTED}
), cuts AS (
  SELECT lang, phrase, f, words, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM counted WHERE words >= 2
), sides AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, (1000::HUGEINT * c.f * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score, t.n
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
  SELECT lang, f, words, w, unnest(range(2, words)) AS m FROM (SELECT lang, f, words, string_split(phrase, ' ') AS w FROM counted WHERE words >= 3)
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS above FROM (SELECT lang, f, w, m, unnest(range(1, words - m + 2)) AS i FROM spans) GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.above IS NULL OR 100 * i.above < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000
"""
