"""Token ids with a public tokenizer file, and the Arrow token files made from them.

Encoding: none of the tokens of a vocabulary with word ends crosses ASCII white space and
its normaliser never looks across it, so a text's ids are the ids of its words put together.
Words repeat, so each Python worker keeps a bounded memo from word to ids. Texts of any
other vocabulary are encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, shuffle_partitions, text_or_empty

TOKENIZER = "word_bpe_49k.json"
#: Words of each of the memo's two generations, and the longest word that it keeps.
MEMO_WORDS = 400_000
MEMO_WORD_BYTES = 64
#: Unknown words that are encoded as one string.
JOINED = 256
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes.

    The memo has two generations of at most MEMO_WORDS words: when the young one is full it
    becomes the old one, and words looked up there move back.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.ends_word = np.zeros(self.vocabulary_size, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        rules = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        # words stand for themselves where the vocabulary marks word ends and white space is dropped
        self.by_words = rules["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"]
        if self.by_words:
            # the same model for words that are normalised and parted already
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            parts = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
            self.latin = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": parts, "added_tokens": []}))

    @classmethod
    def get(cls, tokenizer: str) -> WordEncoder:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = cls(tokenizer)
        return _encoders[tokenizer]

    @staticmethod
    def _latin_form(word: str) -> tuple[str, int]:
        """A word of Latin letters, maybe with one mark after it, as normalised pre-tokens parted by spaces, and their number; else 0."""
        stem = word if word.isalpha() else word[:-1]
        if not stem.isalpha() or stem is not word and word[-1] not in ".,;:!?":
            return "", 0
        if not stem.isascii():
            if max(stem) >= "\u0250":
                return "", 0
            stem = unicodedata.normalize("NFC", stem)
        lower = stem.lower()
        if not lower.isalpha():
            return "", 0
        return (lower, 1) if word.isalpha() else (f"{lower} {word[-1]}", 2)

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Latin words go to the tokenizer many at a time and are parted at word-end tokens."""
        out: list[bytes] = [b""] * len(words)
        texts = [w.decode() for w in words]
        forms = [self._latin_form(t) for t in texts]
        plain = [k for k, (_, n) in enumerate(forms) if n]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        single = [k for k, (_, n) in enumerate(forms) if not n]
        for group, encoded in zip(groups, self.latin.encode_batch_fast([" ".join([forms[k][0] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            last = np.cumsum([forms[k][1] for k in group])
            if len(ends) != last[-1]:
                single += group
                continue
            stops, data, begin = (4 * ends[last - 1]).tolist(), ids.tobytes(), 0
            for k, stop in zip(group, stops, strict=True):
                out[k] = data[begin:stop]
                begin = stop
        if single:
            for k, encoded in zip(single, self.tokenizer.encode_batch_fast([texts[k] for k in single], add_special_tokens=False), strict=True):
                out[k] = np.array(encoded.ids, "<u4").tobytes()
        return out

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text; texts are taken a few megabytes at a time."""
        if not self.by_words:
            for text in texts:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        waiting: list[list[bytes]] = []
        size = 0
        for text in texts:
            if b"<|" not in text:  # the names of special tokens keep their case
                text = text.lower()
            waiting.append(text.split())
            size += len(text)
            if size > 2_000_000:
                yield from self._encode_split(waiting)
                waiting, size = [], 0
        yield from self._encode_split(waiting)

    def _encode_split(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        words = set().union(*texts)
        young, old = self.young, self.old
        unknown = []
        now: dict[bytes, bytes] = {}
        for w in words:
            ids = young.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    unknown.append(w)
                    continue
                young[w] = ids
            now[w] = ids
        now.update(zip(unknown, self._encode_words(unknown), strict=True))
        young.update((w, now[w]) for w in unknown if len(w) <= MEMO_WORD_BYTES)
        if len(young) > MEMO_WORDS:
            self.old, self.young = young, {}
        for text in texts:
            yield b"".join([now[w] for w in text])


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    for value in column:
        yield value.as_py()


# ---------------------------------------------------------------- token files


def _shard_name(shard: int) -> str:
    return f"tokens-{shard:06d}.arrow"


class ShardWriter:
    """One Arrow stream file of equal-length sequences, written batch by batch.

    Columns: ``input_ids`` (uint16 where the vocabulary allows, else uint32) and ``mask``
    (boolean, false for padding), both fixed-size lists of ``seq_len``. It is written under a temporary name and renamed when complete,
    so a lost or repeated task never leaves half a file.
    """

    def __init__(self, folder: str, shard: int, seq_len: int, batch_rows: int, vocabulary_size: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{_shard_name(shard)}"
        self.temporary = f"{self.final}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
        self.seq_len, self.batch = seq_len, seq_len * batch_rows
        self.kind = np.uint16 if vocabulary_size <= 1 << 16 else np.uint32
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(self.kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = 0

    def _write(self, ids: np.ndarray) -> None:
        room = -len(ids) % self.seq_len
        mask = np.arange(len(ids) + room) < len(ids)
        ids = np.concatenate([ids, np.zeros(room, self.kind)]) if room else ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> int:
        """Append ids; returns where in the shard they begin."""
        begin = self.total
        self.waiting.append(ids.astype(self.kind))
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= self.batch:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.batch * self.batch
            for k in range(0, whole, self.batch):
                self._write(joined[k : k + self.batch])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole
        return begin

    def close(self) -> None:
        if self.n_waiting:
            self._write(np.concatenate(self.waiting))
        self.writer.close()
        self.sink.close()
        self.fs.move(self.temporary, self.final)


class ShardReader:
    """Random access to a shard: memory-mapped without copies where the store is local.

    On another store batches are read as they are asked for, of which the last ``KEPT`` are
    held; going back beyond them reads the stream from its begin again.
    """

    KEPT = 16

    def __init__(self, folder: str, shard: int, mapped: bool | None = None):
        from pyarrow import fs

        self.system, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{_shard_name(shard)}"
        self.whole: list[pa.RecordBatch] | None = None
        self.held: OrderedDict[int, pa.RecordBatch] = OrderedDict()
        self._begin()
        if isinstance(self.system, fs.LocalFileSystem) if mapped is None else mapped:
            self.source = pa.memory_map(self.path)
            self.whole = pa.ipc.open_stream(self.source).read_all().to_batches()
        self.seq_len = self.stream.schema.field("input_ids").type.list_size
        self.per_batch = len(self.batch(0)) * self.seq_len

    def _begin(self) -> None:
        self.stream, self.next = pa.ipc.open_stream(self.system.open_input_file(self.path)), 0

    def batch(self, k: int) -> pa.RecordBatch:
        if self.whole is not None:
            return self.whole[k]
        if k not in self.held and k < self.next:
            self._begin()
        while k not in self.held:
            self.held[self.next] = self.stream.read_next_batch()
            self.next += 1
            if len(self.held) > self.KEPT:
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the k-th sequence, both views of the file's bytes."""
        batch, row = divmod(k * self.seq_len, self.per_batch)
        part = slice(row, row + self.seq_len)
        return self._ids(batch)[part], self.batch(batch).column("mask").flatten()[part]

    def _ids(self, batch: int) -> np.ndarray:
        return self.batch(batch).column("input_ids").flatten().to_numpy(zero_copy_only=True)

    def pieces(self, begin: int, length: int) -> Iterator[np.ndarray]:
        """Views of ids begin..begin+length of the shard, without padding."""
        while length > 0:
            batch, at = divmod(begin, self.per_batch)
            view = self._ids(batch)[at : at + length]
            yield view
            begin, length = begin + len(view), length - len(view)


def write_token_files(
    docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, end_id: int = 2, seq_len: int = 2048,
    batch_rows: int = 64, partitions: int | None = None,
) -> tuple[str, DataFrame]:
    """Write all token ids of ``docs(doc_id, text)`` in ascending doc_id order.

    Each task writes one shard; the shards in number order hold the whole stream. Returns
    the folder and the index: doc_id, shard, shard_start (ids before it in its shard),
    n_tokens (with the end id), start (ids of all documents before it).

    Null text counts as empty (its only id is the end id). A null doc_id sorts first;
    rows with equal doc_id are ordered by text and each keeps its own entry. Other columns
    are ignored. An empty table gives no shard and an empty index.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange(partitions or shuffle_partitions(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
    )
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, writer = TaskContext.get().partitionId(), WordEncoder.get(tokenizer), None
        for batch in batches:
            if not len(batch):
                continue
            writer = writer or ShardWriter(folder, shard, seq_len, batch_rows, encoder.vocabulary_size)
            starts, sizes = [], []
            for data in encoder.encode_all(_texts(batch)):
                ids = np.frombuffer(data + end, "<u4")
                starts.append(writer.add(ids))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shard] * len(batch), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "shard", "shard_start", "n_tokens"],
            )
        if writer:
            writer.close()

    index = materialize(ordered.mapInArrow(write, "doc_id long, shard int, shard_start long, n_tokens long"), "token-index")
    # one row per shard, so as many as tasks wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return folder, index.join(bases, "shard").select("doc_id", "shard", "shard_start", "n_tokens", (F.col("base") + F.col("shard_start")).alias("start"))


def read_token_files(folder: str, index: DataFrame) -> DataFrame:
    """Each document's ids read back from the files: the index columns plus ``ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: OrderedDict[int, ShardReader] = OrderedDict()
        for batch in batches:
            rows = batch.to_pydict()
            sums = []
            for shard, begin, length in zip(rows["shard"], rows["shard_start"], rows["n_tokens"], strict=True):
                if shard not in open_shards:
                    open_shards[shard] = ShardReader(folder, shard)
                    if len(open_shards) > 4:
                        open_shards.popitem(last=False)
                open_shards.move_to_end(shard)
                crc = 0
                for view in open_shards[shard].pieces(begin, length):
                    crc = zlib.crc32(view.astype("<u4"), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    return index.mapInArrow(read, index.schema.simpleString()[7:-1].replace(":", " ") + ", ids_crc32 long")


# ---------------------------------------------------------------- token counts


def with_token_count(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """n_tokens (int) of each text without special ids; null text counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(tokenizer)
        for batch in batches:
            sizes = pa.array([len(x) // 4 for x in encoder.encode_all(_texts(batch))], pa.int64())
            yield pa.RecordBatch.from_arrays([sizes], names=["n_tokens"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Exact histogram: n_tokens, n_docs; one row per distinct encoded length.

    Every row counts as a document: null texts as empty ones, repeated rows and ids each for
    themselves. Other columns are ignored; an empty table gives no row. The histogram is
    written out, so texts are encoded once however often it is read.
    """
    return materialize(with_token_count(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")


def context_limits(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """Suffix sums over the histogram: one row per distinct length taken as the context limit.

    n_tokens (the limit), n_docs (of exactly that length), docs_longer, tokens_longer (of
    the longer documents), truncated_total (sum of min(length, limit)), lost_tokens, total
    (all tokens), quantile (share of documents no longer than the limit). Between two
    lengths all sums are linear in the limit, so these rows answer every limit exactly: see
    ``totals_at``. Sums run inside blocks of ``block`` lengths and then over the blocks, so
    no task sees the whole histogram. An empty table gives no row.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("total"))
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "total",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_after")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_after")).alias("tokens_longer"),
    )
    lost = F.col("tokens_longer") - F.col("docs_longer") * F.col("n_tokens")
    return longer.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", (F.col("total") - lost).alias("truncated_total"), lost.alias("lost_tokens"), "total",
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def totals_at(limits: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_longer, truncated_total, lost_tokens, total."""
    longer = F.col("n_tokens") > limit
    docs = F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0))
    lost = F.coalesce(F.sum(F.when(longer, (F.col("n_tokens") - limit) * F.col("n_docs"))), F.lit(0))
    total = F.coalesce(F.max("total"), F.lit(0))
    return limits.agg(docs.alias("docs_longer"), (total - lost).alias("truncated_total"), lost.alias("lost_tokens"), total.alias("total"))


def length_quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents don't exceed."""
    return limits.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
