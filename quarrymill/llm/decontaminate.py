"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised on their UTF-8 bytes: A-Z become lower case, letters, digits and all
bytes of non-ASCII characters are word bytes, anything else separates. The benchmark's words
are numbered and a word is two symbols to the automaton, whatever its length, so each text is
scanned once, and an end offset halved is the word index, which the original's word spans map
back to original offsets.

An automaton takes some fifty bytes a node and has up to 26 nodes per word of the benchmark.
A benchmark of more than ``BLOCK_BYTES`` has several, of which a worker holds one at a time:
it scans what it has read of the documents with each in turn.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import text_or_empty
from .tokens import _texts

WINDOW = 13
#: UTF-8 bytes of normalised benchmark text for one automaton, and its words (about four million nodes, 200 MB).
BLOCK_BYTES, BLOCK_WORDS = 1_000_000, 150_000
#: Distinct words of one automaton (pairs of 256 symbols), and words of an item that stay together.
NUMBERS, PIECE_WORDS = 1 << 16, 20_000
#: Bytes of documents that are scanned with each of several automata in turn.
GROUP_BYTES = 64_000_000

_table = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _table[_b] = _b
for _b in range(0x41, 0x5B):
    _table[_b] = _b + 32
NORMAL = bytes(_table)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_automata: dict[str, object] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code point spans, in the original text, of its words."""
    raw = text.encode()
    ends = [m.span() for m in _WORD.finditer(raw.translate(NORMAL))]
    return [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in ends]


class WindowAutomaton:
    """Finds the windows of items in a text; values are (words in the window, item ids)."""

    ABSENT = "\0\0"

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set[str]] = defaultdict(set)
        for item_id, text in items:
            for window in windows_of(words_of(text), size):
                owners[window].add(item_id)
        self.symbols: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            words = window.split()
            for w in words:
                if w not in self.symbols:  # symbols of first and second place differ, so matches begin and end with words
                    high, low = divmod(len(self.symbols), 256)
                    self.symbols[w] = chr(1 + high) + chr(257 + low)
            self.automaton.add_word("".join([self.symbols[w] for w in words]), (len(words), tuple(ids)))
        self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open runs of hit word indexes, and the items that occur."""
        if self.empty or not words:
            return [], set()
        symbol, absent = self.symbols.get, self.ABSENT
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (n, ids) in self.automaton.iter("".join([symbol(w, absent) for w in words])):
            seen = (end + 1) // 2
            items.update(ids)
            runs.append((seen - n, seen))
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs in order, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _automaton(key: str, packed: bytes, size: int) -> WindowAutomaton:
    if key not in _automata:
        _automata.clear()
        _automata[key] = WindowAutomaton(pickle.loads(packed), size)
    return _automata[key]


def _pieces(benchmark: DataFrame, size: int) -> Iterator[tuple[str, list[bytes]]]:
    """Item ids with words; a long item comes in pieces that share all but one word of a window."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    for row in rows.toLocalIterator():
        words = words_of(row.text.encode())
        if words:
            for at in range(0, max(1, len(words) - size + 1), PIECE_WORDS):
                yield row.i, words[at : at + PIECE_WORDS + size - 1]


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks for one automaton each; the driver holds one block at a time."""
    block: list[tuple[str, bytes]] = []
    numbers: set[bytes] = set()
    n_bytes = n_words = 0
    for item_id, words in _pieces(benchmark, size):
        text = b" ".join(words)
        if block and (n_bytes + len(text) > BLOCK_BYTES or n_words + len(words) > BLOCK_WORDS or len(numbers) + len(set(words) - numbers) > NUMBERS):
            yield block
            block, numbers, n_bytes, n_words = [], set(), 0, 0
        block.append((item_id, text))
        numbers.update(words)
        n_bytes, n_words = n_bytes + len(text), n_words + len(words)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, spans: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array of item ids).

    With ``spans``, also spans: code point ranges of the hit passages in the original text.
    ``carry`` names columns of docs to hand through in a struct named carried.
    A null text has no words; a null item text is no item; a null item_id reads "null".
    Rows with equal doc_id are judged one by one, equal item ids count once. Empty
    benchmark: nothing is hit. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    carried = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), carried.alias("carried"))
    schema = _schema(docs, spans)
    blocks = []  # keys and broadcasts of bounded size; their bytes are not kept here
    for block in _blocks(benchmark, size):
        data = pickle.dumps(block)
        blocks.append((hashlib.sha256(data).hexdigest() + f"-{size}", sc.broadcast(data)))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]

    def judge(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [[0] * len(b) for b in batches]
        runs, items = ([[kind() for _ in range(len(b))] for b in batches] for kind in (list, set))
        for key, packed in blocks or [("", None)]:
            finder = _automaton(key, packed.value if packed else pickle.dumps([]), size)
            for batch, n, r, i in zip(batches, sizes, runs, items, strict=True):
                for k, text in enumerate(_texts(batch)):
                    words = words_of(text)
                    more, found = finder.scan(words)
                    n[k] = len(words)
                    r[k] += more
                    i[k] |= found
        for batch, n, r, i in zip(batches, sizes, runs, items, strict=True):
            r = [merged(x) for x in r]
            out = [n, [sum(b - a for a, b in x) for x in r], [sorted(x) for x in i]]
            if spans:
                out.append([_code_points(text, x) for text, x in zip(_texts(batch), r, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if len(blocks) <= 1 or sum(b.nbytes for b in held) >= GROUP_BYTES:
                yield from judge(held)
                held = []
        yield from judge(held)

    found = docs.mapInArrow(run, schema)
    return found if carry else found.drop("carried")


def _code_points(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    where = word_spans(text.decode()) if runs else []
    return [{"begin": where[a][0], "end": where[b - 1][1]} for a, b in runs]


def _schema(docs: DataFrame, spans: bool) -> StructType:
    hit = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
    out = StructType([docs.schema["doc_id"], docs.schema["carried"], StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))])
    return out.add("spans", ArrayType(hit)) if spans else out


def is_contaminated():
    """The contract's rule: some word is hit and hit words are at least a twentieth."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
