"""URL filters: rules in a sorted array of 64-bit digests, memory-mapped by tasks and probed by binary search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, write_bytes

BLOCK, ALLOW = "block", "allow"
#: (verdict, host, path) of the registered query.
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]
#: The most bytes of a rule file, which every executor gets a copy of.
MOST_BYTES = 1 << 30
#: Between host and path of a stored rule, so that no two rules have one string; hosts of URLs with it fit none.
_BETWEEN = b"\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


class DigestArray:
    """Different byte strings in the order of their digests; equal digests stand side by side and are told apart by the strings."""

    def __init__(self, digests: np.ndarray, ends: np.ndarray, strings: np.ndarray, digest: Callable[[bytes], int] = _digest):
        self.digests, self.ends, self.strings, self.digest = digests, ends, strings, digest

    @classmethod
    def of(cls, keys: list[bytes], digest: Callable[[bytes], int] = _digest) -> tuple[DigestArray, np.ndarray]:
        """The array, and the place in ``keys`` of each of its entries."""
        digests = np.array([digest(k) for k in keys], np.uint64)
        order = np.argsort(digests, kind="stable")
        strings = [keys[k] for k in order.tolist()]
        ends = np.cumsum([len(s) for s in strings], dtype=np.uint64)
        return cls(digests[order], ends, np.frombuffer(b"".join(strings), np.uint8), digest), order

    def __getitem__(self, k: int) -> bytes:
        return self.strings[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry of each key, -1 where it isn't stored."""
        wanted = np.array([self.digest(k) for k in keys], np.uint64)
        at, found = np.searchsorted(self.digests, wanted), np.full(len(keys), -1)
        open_ = np.flatnonzero(at < len(self.digests))
        while len(open_):
            open_ = open_[self.digests[at[open_]] == wanted[open_]]
            same = np.array([self[a] == keys[k] for a, k in zip(at[open_].tolist(), open_.tolist(), strict=True)], bool)
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]  # another string of this digest; the next entry may have it too
            at[open_] += 1
            open_ = open_[at[open_] < len(self.digests)]
        return found


class RuleFile:
    """Rules in one block of bytes: their hosts with the lengths of their paths, and the rules themselves."""

    KINDS = (np.uint64, np.uint64, np.uint8, np.uint64, np.uint32, np.uint64, np.uint64, np.uint8, np.uint32, np.uint8)

    def __init__(self, data: np.ndarray, digest: Callable[[bytes], int] = _digest):
        sizes = data[: 8 * len(self.KINDS)].view(np.uint64).tolist()
        parts, at = [], 8 * len(self.KINDS)
        for size, kind in zip(sizes, self.KINDS, strict=True):
            parts.append(data[at : at + size].view(kind))
            at += -(-size // 8) * 8
        self.hosts, self.length_ends, self.lengths = DigestArray(*parts[:3], digest), parts[3], parts[4]
        self.rules, self.sizes, self.blocks = DigestArray(*parts[5:8], digest), parts[8], parts[9]
        self.longest = int(np.diff(self.hosts.ends, prepend=np.uint64(0)).max(initial=0))

    @classmethod
    def pack(cls, rules: Iterable[tuple[str, str, str]], digest: Callable[[bytes], int] = _digest) -> bytes:
        """Rules (verdict, host, path) as bytes; hosts are lower-cased, of a repeated host and path the last counts."""
        known: dict[tuple[bytes, bytes], tuple[bool, int]] = {}
        for verdict, host, path in rules:
            if verdict not in (BLOCK, ALLOW) or not host or _BETWEEN.decode() in host:
                raise ValueError(f"not a rule: {(verdict, host, path)!r}")
            known[host.translate(str.maketrans(_UPPER, _LOWER)).encode(), path.encode()] = verdict == BLOCK, len(host) + len(path)
        lengths: dict[bytes, set[int]] = {}
        for host, path in known:
            lengths.setdefault(host, set()).add(len(path))
        hosts, order = DigestArray.of(list(lengths), digest)
        own = [sorted(lengths[k]) for k in np.array(list(lengths), object)[order]]
        entries = list(known.values())
        array, place = DigestArray.of([h + _BETWEEN + p for h, p in known], digest)
        sizes, blocks = np.array([x[1] for x in entries], np.uint32)[place], np.array([x[0] for x in entries], np.uint8)[place]
        flat = np.array([x for xs in own for x in xs], np.uint32)
        parts = [hosts.digests, hosts.ends, hosts.strings, np.cumsum([len(x) for x in own], dtype=np.uint64), flat, array.digests, array.ends, array.strings, sizes, blocks]
        data = [np.array([p.nbytes for p in parts], np.uint64).tobytes()]
        return b"".join(data + [p.tobytes() + bytes(-p.nbytes % 8) for p in parts])

    def _fitting_hosts(self, hosts: list[bytes]) -> list[list[tuple[bytes, list[int]]]]:
        """Of each host the stored ones that it is or lies under, with the lengths of their paths."""
        names, owner = [], []
        for k, host in enumerate(hosts):
            at = max(0, len(host) - self.longest)  # longer ends can't be stored
            if at:
                at = host.find(b".", at - 1) + 1 or len(host) + 1
            while at < len(host):
                names.append(host[at:])
                owner.append(k)
                at = host.find(b".", at) + 1 or len(host)
        found: list[list[tuple[bytes, list[int]]]] = [[] for _ in hosts]
        entries = self.hosts.find(names)
        for k in np.flatnonzero(entries >= 0).tolist():
            e = int(entries[k])
            begin = int(self.length_ends[e - 1]) if e else 0
            found[owner[k]].append((names[k], self.lengths[begin : int(self.length_ends[e])].tolist()))
        return found

    def best(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """The longest rule (in characters; then of the longer host) that fits each URL, -1 where none does."""
        places = {h: k for k, h in enumerate(dict.fromkeys(hosts))}
        fitting = self._fitting_hosts(list(places))
        keys, row, host_size = [], [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for name, lengths in fitting[places[host]]:
                for n in lengths:
                    if n <= len(path):
                        keys.append(name + _BETWEEN + path[:n])
                        row.append(k)
                        host_size.append(len(name))
        entries = self.rules.find(keys)
        hit = np.flatnonzero(entries >= 0)
        owner, entry = np.array(row, np.int64)[hit], entries[hit]
        order = np.lexsort((np.array(host_size, np.int64)[hit], self.sizes[entry], owner))
        best = np.full(len(hosts), -1)
        best[owner[order]] = entry[order]  # of one row the last stays
        return best

    def text(self, k: int) -> str:
        host, _, path = self.rules[k].partition(_BETWEEN)
        return (host + path).decode()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) behind the first ``://``, and the path up to query or fragment; both empty without one."""
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, cut, k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per page: the key column, host, path, rule (host and path in one, else null), verdict.

    A rule (verdict, host, path) fits its host and all hosts under it where the path begins
    as the rule's. The longest that fits decides, of two of one length that of the longer
    host. The array lists what is blocked or excepted, so where no rule is found the method
    itself allows (``default``).

    The rules are packed on the driver (they are configuration, of MOST_BYTES at most) and
    written to the shared folder; Spark hands every executor one copy of the file, which all
    its tasks map into memory. A digest that is found counts only where the stored string is
    equal too. A null URL or one without ``://`` has an empty host and path, which no rule
    fits. Rows with null or repeated keys are judged each; other columns are ignored. Without
    rules, or without rows, there is nothing to find.
    """
    spark = pages.sparkSession
    name = _hand_out(spark, RuleFile.pack(rules))
    host, path = host_and_path(F.col(url))
    cut = pages.select(F.col(key), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        table = RuleFile(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        texts: dict[int, str | None] = {-1: None}
        for batch in batches:
            hosts, paths = (batch.column(k).cast(pa.binary()).to_pylist() for k in (1, 2))
            best = table.best(hosts, paths).tolist()
            for k in set(best).difference(texts):
                texts[k] = table.text(k)
            verdicts = [default if k < 0 else BLOCK if table.blocks[k] else ALLOW for k in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([texts[k] for k in best], pa.string()), pa.array(verdicts, pa.string())], names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return cut.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _hand_out(spark: SparkSession, data: bytes) -> str:
    """The name under which every executor finds a file of these bytes."""
    if len(data) > MOST_BYTES:
        raise ValueError(f"rules take {len(data)} bytes, more than {MOST_BYTES}")
    path = fresh_path(spark, "url-rules")
    write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
#: The contract's query in DuckDB.
URL_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(verdict, h, p) AS (VALUES {_VALUES})
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC) = 1
"""
