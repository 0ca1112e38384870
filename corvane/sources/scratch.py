"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []  # paths written inside each open `intermediates` block


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. One is made here only for a local master; on a cluster its absence is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted with the block of `intermediates` around it, or at the driver's end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    else:
        fs, p = _path(spark, path)
        fs.deleteOnExit(p)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Writes a result that several later steps read, which cuts its lineage there and survives lost executors."""
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was settled inside; results to keep must be written outside the folder of the block first."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            fs, p = _path(spark, path)
            fs.delete(p, True)


def settle_last(spark: SparkSession, make) -> DataFrame:
    """Settles the result of `make()` and deletes what was settled on the way to it."""
    path = new_path(spark, "settled")  # belongs to the block around this one, if there is one
    with intermediates(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
