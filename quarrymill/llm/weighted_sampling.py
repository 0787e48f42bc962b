"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Terms are the pairs of neighbouring words (a single word by itself, if it is alone),
weighted by how often they occur. A term that occurs n times has the units (term, 0) to
(term, n - 1), which are spread over ``BINS`` bins by their hashes; its weight in a bin is
the number of its units there, so a frequent term weighs in every bin what it weighs in
the text. In a bin every term with weight w draws, from the hash of term and bin, two
gamma(2, 1) values r and c and a uniform b; with t = floor(ln w / r + b) its sample value
is ln c - r (t - b) - r. The least value among terms is equally likely to fall on any unit
of weight, and two documents pick the same (term, t) with the probability of the
generalised Jaccard similarity of the bin's weights. Each bin keeps its least sample, so
one draw per term and bin fills the whole signature. The likeness of two signatures is the
share of equal bins among those filled in either.

Over a table the words become rows, and terms, bins and signatures are grouped counts and
minima inside a document's partition, so none of these groupings shuffles anything.
``signature`` is the same as an expression, for a column of few or short texts.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_or_empty

BINS = 64
#: 16 hex digits a bin: 2 of the bin, 6 of the value, 8 of the sample's identity.
SLOT = 16
#: Ranges of neighbours per shuffle partition, ids that are drawn per range for its bound (all that the driver holds), and the fewest rows of a range.
RANGES, DRAWN, RANGE_ROWS = 16, 4, 50
#: Tasks per shuffle partition: the words of a task's texts take some fifty times the texts' memory.
TASKS = 8
_LEAST_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _uniform(h: Column, shift: int) -> Column:
    """In (0, 1), from 20 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 20) - 1)) + 0.5) / float(1 << 20)


def _unit_bin(term: Column, i: Column) -> Column:
    """The bin of a term's unit i, from 0 on; the first one's is in the term's own bits."""
    return F.shiftrightunsigned(F.when(i == 0, term).otherwise(F.xxhash64(term, i)), 58)


def _sample(term: Column, at: Column, weight: Column | None) -> Column:
    """One long: bin ``at`` (6 bits), quantised sample value (25), identity of term and t (32). No weight: 1."""

    def draw(h: Column) -> Column:
        # 60 bits give three uniforms, a second hash the other two
        def valued(g: Column, r: Column, t: Column) -> Column:
            return _slot(at, F.ln(-F.ln(_uniform(g, 0) * _uniform(g, 20))) - r * (t - _uniform(h, 40)) - r, h, t)

        if weight is None:  # ln 1 = 0, so t = 0 whatever r and b
            return _let(F.xxhash64(h, F.lit(1)), lambda g: _let(-F.ln(_uniform(h, 0) * _uniform(h, 20)), lambda r: valued(g, r, F.lit(0).cast("long"))))
        return _let(F.xxhash64(h, F.lit(1)), lambda g: _let(-F.ln(_uniform(h, 0) * _uniform(h, 20)), lambda r: _let(F.floor(F.ln(weight) / r + _uniform(h, 40)), lambda t: valued(g, r, t))))

    return _let(F.xxhash64(term, at), draw)


def _slot(at: Column, value: Column, h: Column, t: Column) -> Column:
    return F.shiftleft(at, 57) + F.shiftleft(_rank(value), 32) + F.shiftrightunsigned(F.xxhash64(h, t), 32)


def _rank(value: Column) -> Column:
    """The value's order in 25 bits: values lie between -60 and 4 whatever the weight up to e^30."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << 25) - 1), F.floor((value + 60) * float(1 << 19)))).cast("long")


def words_of(text: Column) -> Column:
    """Runs of anything but white space, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[ \t-\r]+"), "")


def terms_of(text: Column) -> Column:
    """Sorted hashes of the word pairs of a text, repeats included."""
    words = words_of(text)
    pairs = _let(words, lambda w: F.when(F.size(w) < 2, F.transform(w, lambda x: F.xxhash64(x))).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))))
    return F.sort_array(pairs)


def signatures(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and sig: the signature of the text of each row.

    ``keys`` tell the rows apart. Where ``rows`` are dealt by some of them, nothing is shuffled.
    """
    words = rows.select(*keys, words_of(F.col(text)).alias("words"))
    words = words.withColumn("words", F.when(F.size("words") == 0, F.array(F.lit(""))).otherwise(F.col("words")))  # a row for every text
    n = F.greatest(F.size("words") - 1, F.lit(1))
    pairs = words.select(*keys, F.inline(F.arrays_zip(F.slice("words", F.lit(1), n).alias("a"), F.slice("words", F.lit(2), n).alias("b"))).alias("a", "b"))
    terms = pairs.select(*keys, F.when(F.col("a") != "", F.xxhash64("a", "b")).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    units = terms.select(*keys, "term", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    weights = units.select(*keys, "term", _unit_bin(F.col("term"), F.col("i")).alias("bin")).groupBy(*keys, "term", "bin").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hashed = weights.select(*keys, "bin", "weight", F.when(F.col("term").isNotNull(), F.xxhash64("term", "bin")).alias("h"))
    drawn = hashed.withColumn("g", F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(1)))).withColumn("r", -F.ln(_uniform(F.col("h"), 0) * _uniform(F.col("h"), 20)))
    drawn = drawn.withColumn("t", F.floor(F.ln("weight") / F.col("r") + _uniform(F.col("h"), 40)))
    value = F.ln(-F.ln(_uniform(F.col("g"), 0) * _uniform(F.col("g"), 20))) - F.col("r") * (F.col("t") - _uniform(F.col("h"), 40)) - F.col("r")
    least = drawn.select(*keys, "bin", _slot(F.col("bin"), value, F.col("h"), F.col("t")).alias("slot")).groupBy(*keys, "bin").agg(F.min("slot").alias("slot"))
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("slot")).alias("sig"))


def signature(text: Column) -> Column:
    """Array of longs, at most one per bin, sorted by bin; empty for a text without words."""

    def same(s: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i) == x, F.lit(False))

    def once(s: Column) -> Column:
        alone = F.filter(s, lambda x, i: ~same(s, x, i - 1) & ~same(s, x, i + 1))
        return F.transform(alone, lambda x: _let(F.shiftrightunsigned(x, 58), lambda at: _sample(x, at, None)))

    def runs(s: Column, body) -> Column:
        """``body`` of value and length of every run of equal values."""
        last = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~same(s, F.get(s, i), i + 1))
        return _let(last, lambda e: F.transform(e, lambda i, k: body(F.get(s, i), i - F.when(k == 0, F.lit(-1)).otherwise(F.get(e, k - 1)))))

    def of_units(term: Column, n: Column) -> Column:
        bins = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _unit_bin(term, i)))
        return _let(bins, lambda b: runs(b, lambda at, units: _sample(term, at, units.cast("double"))))

    def samples(s: Column) -> Column:
        again = F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1))
        repeated = _let(again, lambda p: F.when(F.size(p) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(runs(p, of_units))))
        return F.concat(once(s), repeated)

    def least(p: Column) -> Column:
        return F.filter(p, lambda x, k: (k == 0) | (F.shiftrightunsigned(x, 57) != F.shiftrightunsigned(F.get(p, k - 1), 57)))

    return _let(terms_of(text), lambda s: F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(_let(F.sort_array(samples(s)), least)))


def as_text(sig: Column) -> Column:
    """The signature in hex, 16 digits a filled bin."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), SLOT, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among bins filled in either; two empty signatures are alike (1), an empty and a filled one not (0)."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftrightunsigned(x, 57)), F.transform(b, lambda x: F.shiftrightunsigned(x, 57))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds are no larger than the id, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = int(np.sqrt(len(bounds))) + 1
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    table = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    part = F.size(F.filter(F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<bigint>"), lambda b: b <= doc_id)) - 1
    return F.when(part < 0, 0).otherwise(part * step + F.size(F.filter(F.get(table, part), lambda b: b <= doc_id)))


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and range, and the number of ranges: neighbouring doc_ids in ranges of near-equal size, none of them empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = F.coalesce("doc_id", F.lit(_LEAST_ID))
    total = rows.count()
    n = min(RANGES * shuffle_partitions(docs.sparkSession), total // RANGE_ROWS + 1)
    ids = rows.select(known.alias("id"))
    drawn = ids if total <= DRAWN * n else ids.sample(DRAWN * n / total, 1)
    drawn = np.sort(np.array(drawn.toPandas()["id"], np.int64))  # eight bytes for each of DRAWN * n rows
    # the least drawn id is no bound, so it is in range 0 as every bound is in its own
    bounds = sorted({int(drawn[k * len(drawn) // n]) for k in range(1, n)} - {int(drawn[0])}) if len(drawn) else []
    return rows.withColumn("range", _range_of(known, bounds)), len(bounds) + 1


def _beside_next(docs: DataFrame) -> DataFrame:
    """range, place (from 0 in its range), doc_id, text, next_text, head_sig (of the first document of the next range)."""
    rows, n = _ranges(docs)
    near = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), F.asc("text"))
    led = rows.repartition(TASKS * shuffle_partitions(docs.sparkSession), "range").select("range", (F.row_number().over(near) - 1).alias("place"), "doc_id", "text", F.lead("text").over(near).alias("l_text"))
    heads = rows.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head"))  # one row a range
    heads = heads.select(F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.col("head.text").alias("head_text"), signature(F.col("head.text")).alias("head_sig"))
    joined = led.join(heads, "range")
    return joined.select("range", "place", "doc_id", "text", F.coalesce("l_text", "head_text").alias("next_text"), "head_sig")


def edited_text(text: Column, other: Column) -> Column:
    """The last quarter (rounded down) of the code points replaced by as many first ones of the other text."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text, edited, sig, edited_sig, next_sig.

    The next document is the one that follows by doc_id; the last one's is the first. Neighbours
    meet inside ranges of doc_ids; only each range's first document crosses to the range before.

    Null text counts as empty. Rows with equal doc_id are documents of their own, in the
    order of their texts, and stand in one range whatever their number; a null doc_id comes
    first. Other columns are ignored. Empty table: no row.
    """
    both = _beside_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    texts = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited"))])
    sigs = signatures(both.select("range", "place", F.inline(texts)), ["range", "place", "side"], "text")
    # one row per range with the signatures in order, so that they come back to their documents without a shuffle
    ordered = sigs.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("place", "side", "sig"))).alias("all"))
    at = lambda k: F.get("all", k)["sig"]
    return both.join(ordered, "range").select(
        "doc_id", "text", "edited", at(2 * F.col("place")).alias("sig"), at(2 * F.col("place") + 1).alias("edited_sig"), F.coalesce(at(2 * F.col("place") + 2), "head_sig").alias("next_sig"),
    )
