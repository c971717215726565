"""Stages that can be taken up again: each result is a generation in a shared folder, found through one pointer.

A generation is a folder of Parquet files. Its pointer, `current.json`, holds the run's identity, the number of stages
done and each file's SHA-256, and replaces the one before in one rename, after the files are whole. The generation
before goes last. So a run that ends at any point leaves one whole generation.

One run writes at a time. Before it reads or makes anything a run takes a lease, a file of the next number that only one
can create, and a second run is refused while it stands. A run that died leaves its lease; it may be taken over once it
is stale or on request, with a higher number. The number is a fence: it stands in the pointer, and a run doesn't swap the pointer
once a higher one is out, so a writer that was only slow can't undo its successor's work.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.shared import drop_path

VERSION = 1
Stage = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]


class Interrupted(RuntimeError):
    """The run was asked to stop after a stage."""


class Refused(RuntimeError):
    """Another run writes here, or has taken over."""


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, there = _file_system(spark, path)
    if not files.exists(there):
        return None
    stream = files.open(there)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def _leases(spark: SparkSession, root: str) -> dict[int, float]:
    """Numbers of the leases that stand, with the seconds since each was taken or renewed."""
    files, there = _file_system(spark, root)
    if not files.exists(there):
        return {}
    found = [(str(s.getPath().getName()), s.getModificationTime() / 1000) for s in files.listStatus(there)]
    return {int(m[1]): time.time() - at for name, at in found if (m := re.fullmatch(r"writer-(\d+)\.json", name))}


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file unless it is there; false if it is, or if another one's text stands in it in the end."""
    files, there = _file_system(spark, path)
    files.mkdirs(there.getParent())
    try:
        stream = files.create(there, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return _read_text(spark, path) == text


@dataclass
class Lease:
    """The right to write under `root`, until it is given back or a higher number is out."""

    spark: SparkSession
    root: str
    number: int
    text: str

    @property
    def path(self) -> str:
        return f"{self.root}/writer-{self.number}.json"

    def check(self) -> None:
        current = _read_text(self.spark, f"{self.root}/current.json")
        highest = max([*_leases(self.spark, self.root), json.loads(current).get("fence", 0) if current else 0], default=0)
        if highest > self.number or _read_text(self.spark, self.path) != self.text:
            raise Refused(f"writer {self.number} was taken over")

    def renew(self) -> None:
        """Show that the run lives, so that its lease doesn't become stale."""
        self.check()
        files, there = _file_system(self.spark, self.path)
        files.setTimes(there, int(time.time() * 1000), -1)

    def give_back(self) -> None:
        if _read_text(self.spark, self.path) == self.text:
            drop_path(self.spark, self.path)


def take_lease(spark: SparkSession, root: str, stale_after: float = 3600.0, take_over: bool = False) -> Lease:
    """The next lease of `root`; refused while another stands that isn't stale, unless it is to be taken over."""
    standing = _leases(spark, root)
    if standing and not take_over and min(standing.values()) < stale_after:
        raise Refused(f"writer {max(standing)} works on {root}")
    current = _read_text(spark, f"{root}/current.json")
    number = 1 + max([*standing, json.loads(current).get("fence", 0) if current else 0], default=0)
    lease = Lease(spark, root, number, json.dumps({"owner": uuid.uuid4().hex, "number": number}))
    if not _write_new(spark, lease.path, lease.text):
        raise Refused(f"writer {number} works on {root}")
    for old in standing:
        drop_path(spark, f"{root}/writer-{old}.json")
    return lease


def _swap_text(spark: SparkSession, path: str, text: str) -> None:
    """The text appears whole under its name, in place of what was there."""
    files, there = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(there, True)
    stream.write(bytearray(text.encode()))
    stream.hsync()
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = files.makeQualified(there)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(whole, files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each data file of a folder by its name, computed where the files are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    rows = found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256")).collect()
    return {r["name"]: r["sha256"] for r in rows}


def verified(spark: SparkSession, root: str, pointer: dict) -> str:
    """The folder of a pointer's generation; an error unless it has exactly the files it should."""
    name = pointer["directory"]
    if "/" in name or not name.startswith("generation-"):
        raise ValueError(f"not a generation: {name}")
    have, want = file_digests(spark, f"{root}/{name}"), pointer["files"]
    if have != want:
        wrong = sorted(k for k in have.keys() | want.keys() if have.get(k) != want.get(k))
        raise ValueError(f"files differ from the pointer's: {wrong[:5]}")
    return f"{root}/{name}"


def run_stages(spark: SparkSession, root: str, stages: list[Stage], identity: dict, resume: bool = False, stop_after: int | None = None, stale_after: float = 3600.0, take_over: bool = False) -> DataFrame:
    """The last stage's result. A stage takes the session and the result before it, the first one None.

    With `resume` the run goes on behind the last stage done: the pointer must be there, of this version, with this
    identity and as many stages, and its files as they were written. Without it nothing may be there. `stop_after`
    ends the run after so many stages, as an interruption would. A second run on `root` is refused; see `take_lease`. A
    lease counts as stale if no stage ended for `stale_after` seconds.
    """
    lease = take_lease(spark, root, stale_after, take_over)
    try:
        return _run(spark, root, stages, identity, resume, stop_after, lease)
    finally:
        lease.give_back()


def _run(spark: SparkSession, root: str, stages: list[Stage], identity: dict, resume: bool, stop_after: int | None, lease: Lease) -> DataFrame:
    text, current = _read_text(spark, f"{root}/current.json"), f"{root}/current.json"
    if text is None and resume:
        raise FileNotFoundError(current)
    if text is not None and not resume:
        raise FileExistsError(current)
    done, result, last = 0, None, None
    if text is not None:
        last = json.loads(text)
        if last.get("version") != VERSION:
            raise ValueError("another version's pointer")
        if last["identity"] != identity:
            raise ValueError("the run's identity differs")
        if last["total"] != len(stages) or not 0 < last["done"] <= len(stages):
            raise ValueError("the stages differ")
        done = last["done"]
        result = spark.read.schema(last["schema"]).parquet(verified(spark, root, last))
    for k in range(done, len(stages)):
        made = stages[k][1](spark, result)
        name = f"generation-{uuid.uuid4().hex}"
        made.write.parquet(f"{root}/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        pointer = {"version": VERSION, "identity": identity, "directory": name, "done": k + 1, "total": len(stages), "stage": stages[k][0], "schema": schema, "fence": lease.number, "files": file_digests(spark, f"{root}/{name}")}
        lease.renew()
        _swap_text(spark, current, json.dumps(pointer, sort_keys=True))
        if last is not None:
            drop_path(spark, f"{root}/{last['directory']}")
        last, result = pointer, spark.read.schema(schema).parquet(f"{root}/{name}")
        if stop_after == k + 1:
            raise Interrupted(stages[k][0])
    return result
