"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "clientela", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Long plans build about twice as fast without the call site of every column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder below the shared one that the cluster names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get(CHECKPOINT_DIR, None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="clientela-"))
        else:
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


class _Open(threading.local):
    """The tables settled within each open ``freed`` block of this thread, the innermost last."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_OPEN = _Open()


def _note(path: str) -> None:
    if _OPEN.blocks:
        _OPEN.blocks[-1].append(path)


def _settled(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder, once, and read on from there.

    Used where a result is read several times, or where its partition layout is itself data
    (see ``operators.ordering``). Survives the loss of executors; later passes read only the
    columns they need, and know the table's size.
    """
    path = scratch_folder(df.sparkSession, "table")
    _note(path)
    return _settled(df, path)


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """Settle ``df`` in buckets of ``key``: joins and groups by it read the table without a shuffle.

    There are as many buckets as a shuffle has partitions. The table's name is gone at once, its
    files go with those of ``settle``.
    """
    spark = df.sparkSession
    path, name = scratch_folder(spark, "table"), f"settled_{uuid.uuid4().hex}"
    _note(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread settles inside, at the end: for work whose result is not a
    lazy DataFrame."""
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        for path in _OPEN.blocks.pop():
            _delete(spark, path)


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Settle what ``make`` returns, and delete the tables that were settled on the way to it."""
    path = scratch_folder(spark, "table")
    _note(path)
    with freed(spark):
        return _settled(make(), path)


def release(spark: SparkSession) -> None:
    """Delete what this session has settled. Tables read from there are gone afterwards."""
    _delete(spark, scratch_root(spark))
