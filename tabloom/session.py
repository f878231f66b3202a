"""Session settings and lineage cutting."""

from __future__ import annotations

import contextvars
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE with skew-join splitting, Arrow.

    Shuffle partitions stay at the cluster's own setting; AQE coalesces small ones and splits hot ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites of every column expression are not recorded: wide field lists build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared checkpoint folder; a private one is made only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.path.join(tempfile.gettempdir(), "tabloom-checkpoints")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and continue from there.

    Used where a stage is read more than once: it avoids recomputing the stage and survives lost executors.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder for files, under the shared checkpoint folder."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as columns to a new shared folder and continue from there: later steps read only the columns they ask for."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


#: Shuffle files go with the query that made them; without it they stay until the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("made", default=None)


def settled(df: DataFrame, name: str) -> DataFrame:
    """As `cut_lineage`, but as packed columns; inside a `step` the rows go when it ends."""
    if any(odd in kind for _, kind in df.dtypes for odd in ("void", "interval")):
        # these have no place in a column file
        return cut_lineage(df)
    place = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    _places[out] = place
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of rows that `settled` wrote and nothing reads any more; other frames are left alone."""
    for df in frames:
        if place := _places.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def step(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of `make()`, written. What `settled` wrote on the way goes, and so do the shuffle files of these queries."""
    before = spark.conf.get(_SWEEP, None)
    inside: list[DataFrame] = []
    out = None
    token = _made.set(inside)
    spark.conf.set(_SWEEP, "true")
    try:
        out = settled(make(), name)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
        _made.reset(token)
        discard(*[df for df in inside if df is not out])
    if (made := _made.get()) is not None:
        made.append(out)
    return out
