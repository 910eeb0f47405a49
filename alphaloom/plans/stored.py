"""Tables written once to a folder that all executors share, so that several branches of a plan read them instead of computing them again."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[tuple[SparkSession, str]] = []
_passing: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("_passing", default=_written)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where it is unset, a folder of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="alphaloom-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted at the end of the passing() around it, or else when the driver ends."""
    path = f"{shared_dir(spark)}/alphaloom/{uuid.uuid4().hex}"
    _passing.get().append((spark, path))
    return path


def on_executors(spark: SparkSession) -> None:
    """Python workers find this package even if it is not installed and they start in another folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and a lost executor costs no recomputation of it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a stored table up to which it is broadcast, of some 100 bytes each.
BROADCAST_ROWS = 200_000


def few(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing() -> Iterator[None]:
    """Tables that this thread stores within are deleted at its end, also if that is an error: nothing that is read later may stem from them. Those stored before stay."""
    own: list[tuple[SparkSession, str]] = []
    before = _passing.set(own)
    try:
        yield
    finally:
        _passing.reset(before)
        for spark, path in own:
            drop(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans it
            return
