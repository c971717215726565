"""Work tables in the folder that all machines share.

``spark.checkpoint.dir`` names that folder. It is read from the session; only where it is unset
on one machine, as in local tests, a temporary folder takes its place.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Lists that `work_tables` fills, the innermost last.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for work tables, from ``spark.checkpoint.dir`` where it is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _LOCAL[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, as `--py-files` would."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="quern-")) / package.name), "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._quern_shipped = True


#: Rows that travel to a Python worker at once. Texts of documents take some 3 kB each, some a hundred times that.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Send the package to the workers, and set the session's Arrow batches to so few rows that workers' memory doesn't depend on long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the work tables that were made within, once the caller has read them; the list it gets names them.

    Paths that the caller takes off the list stay.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for path in made:
            drop_path(spark, path)


#: With it, Spark deletes a finished write's shuffle files at once and not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: its lineage ends there.

    The table outlives lost executors. Its schema is given on reading, so an empty table keeps
    its columns. The shuffle files that led to it go when it is written.
    """
    spark = df.sparkSession
    return cut_to(df, new_path(spark, name))


def cut_to(df: DataFrame, path: str) -> DataFrame:
    """As `cut`, at a path of the caller's."""
    spark, schema = df.sparkSession, df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table that no plan reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def sized(df: DataFrame, most_rows: int = 200_000, other: str | None = None) -> DataFrame:
    """`df`, a work table of slim rows, to be broadcast if it has so many rows at most; else joins shuffle it, by the hint `other` if given."""
    if df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df)
    return df.hint(other) if other else df
