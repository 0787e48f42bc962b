"""Stages that run only where their result is stale, and that are taken up again after a failure."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .scratch import drop
from .tables import read_version, write_versions


@dataclass(frozen=True)
class Stage:
    """``make(spark, *inputs)`` gives the rows; an input is the path of files (handed on as it is) or an earlier stage's
    name (handed on as its rows). ``version`` stands for the code and its parameters, ``problems`` lists what is wrong
    with written rows."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"
    problems: Callable[[DataFrame], list[str]] | None = None


class Rejected(ValueError):
    """Written rows that a stage's validator found wrong."""


def file_state(spark: SparkSession, path: str, times: bool = True) -> str:
    """A digest of the names, lengths and (with ``times``) modification times of all files below a path; no file is
    opened. Digests of files are added up, so neither the order nor the number of files matters for the memory."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise FileNotFoundError(path)
    base = len(system.makeQualified(at).toString())
    found, total, count = system.listFiles(at, True), 0, 0
    while found.hasNext():
        file = found.next()
        line = f"{file.getPath().toString()[base:]}\n{file.getLen()}\n{file.getModificationTime() if times else ''}"
        total, count = total + int.from_bytes(hashlib.sha256(line.encode()).digest()), count + 1
    return f"{total % 2**256:064x}-{count}"


def _entry(spark: SparkSession, folder: str):
    """The ledger's row of a stage, or None before its first result."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger/CURRENT")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return read_version(spark, f"{folder}/ledger")["entry"].first()


def _whole(spark: SparkSession, folder: str, entry) -> bool:
    try:
        return file_state(spark, f"{folder}/{entry.rows}", times=False) == entry.state
    except FileNotFoundError:
        return False


def run_stages(spark: SparkSession, root: str, stages: list[Stage]) -> dict[str, tuple[str, DataFrame]]:
    """Per stage "written" or "current", and its rows, read from below ``root``.

    A stage is current if its ledger names the state of the files of its inputs, the results of
    the stages before, and its version as they are now, and its own files are all there with
    their lengths. Else it runs; its rows are written to a new folder, validated, and entered
    in the ledger by one rename, after which the former rows are deleted. What fails before
    that leaves the ledger as it was: the next call passes over the stages that were done and
    starts at the one that failed. Stages of one name, or an input that is neither a path nor
    an earlier stage, raise. One call at a time may work on a root,
    and a call that writes a stage anew takes away the rows that an earlier call handed out.
    """
    if len({s.name for s in stages}) < len(stages):
        raise ValueError("stages share a name")
    done: dict[str, tuple[str, DataFrame]] = {}
    signatures: dict[str, str] = {}
    for stage in stages:
        folder = f"{root}/{stage.name}"
        states = [signatures[i] if i in signatures else file_state(spark, i) for i in stage.inputs]
        signature = hashlib.sha256("\n".join([stage.name, stage.version, *stage.inputs, *states]).encode()).hexdigest()
        entry, status = _entry(spark, folder), "current"
        if entry is None or entry.signature != signature or not _whole(spark, folder, entry):
            status, rows = "written", f"rows-{uuid.uuid4().hex}"
            stage.make(spark, *[done[i][1] if i in done else i for i in stage.inputs]).write.parquet(f"{folder}/{rows}")
            if stage.problems and (found := stage.problems(spark.read.parquet(f"{folder}/{rows}"))):
                drop(spark, f"{folder}/{rows}")
                raise Rejected(f"{stage.name}: {'; '.join(found)}")
            former = entry
            made = [(signature, rows, file_state(spark, f"{folder}/{rows}", times=False))]
            write_versions({"entry": spark.createDataFrame(made, "signature string, rows string, state string")}, f"{folder}/ledger")
            entry = _entry(spark, folder)
            if former is not None:
                drop(spark, f"{folder}/{former.rows}")
        # the folder's name is part of what later stages see, so rows that were made anew make them stale
        signatures[stage.name] = f"{signature}-{entry.rows}"
        done[stage.name] = (status, spark.read.parquet(f"{folder}/{entry.rows}"))
    return done
