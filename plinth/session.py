"""Session settings, table reading and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches. A cluster brings its own."""
    b = (
        SparkSession.builder.master(master).appName("plinth").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver's program was started, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_plinth_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="plinth-"), "plinth_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("plinth", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._plinth_shipped = True  # type: ignore[attr-defined]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes the shuffle files of a query with its end; counts for queries planned while it is set.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two collections of the driver's garbage, with which Spark removes what nothing refers to any more.
GARBAGE_S = 5.0


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, was)


#: Size up to which Spark broadcasts a side of a join unasked: by its estimate, and by what its stages wrote.
_UNASKED = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def unasked_none(spark: SparkSession) -> Iterator[None]:
    """Only sides marked for it (see `small`) are broadcast by joins planned while it is set. Spark counts the rows before an
    explode or a UDF, not what comes of them, so a side it takes for 10 MB may fill the driver's heap."""
    was = {k: spark.conf.get(k, None) for k in _UNASKED}
    try:
        for k in _UNASKED:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _collected(spark: SparkSession) -> None:
    """Plans, task records and checkpoints of earlier steps go from the driver's heap and the disk."""
    sc = spark.sparkContext
    if time.monotonic() - getattr(sc, "_plinth_collected", 0.0) >= GARBAGE_S:
        sc._jvm.System.gc()
        sc._plinth_collected = time.monotonic()  # type: ignore[attr-defined]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names in spark.checkpoint.dir. Where that is
    unset, a temporary folder serves a single machine; on a cluster it is an error. The shuffle files it took go at once.
    Spark removes a checkpoint with its last reference if the cluster sets spark.cleaner.referenceTracking.cleanCheckpoints,
    as `session` does."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "plinth-checkpoints"))
    with _freeing(spark):
        out = df.select("*").checkpoint(eager=True)
    _collected(spark)
    return out


def empty(df: DataFrame) -> bool:
    """Whether a table has no row; leaves no shuffle files."""
    with _freeing(df.sparkSession):
        return df.select("*").isEmpty()


def within(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most `rows` rows; reads no more than that many."""
    with _freeing(df.sparkSession):
        return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int, bytes_each: int | None = None) -> DataFrame:
    """A broadcast hint only behind a check of the size: at most `rows` rows and, where `bytes_each` is given, no row longer
    than that. Beyond the bound the plan stays Spark's to choose."""
    if not within(df, rows):
        return df
    if bytes_each is not None and not empty(df.where(F.length(F.to_json(F.struct(*df.columns))) > bytes_each)):
        return df
    return F.broadcast(df)
