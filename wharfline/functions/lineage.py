"""Cutting the lineage of iterations, and tables that several parts of a plan read."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, a new temporary one in local mode (tests), an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context, path = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return df.checkpoint()


_written: weakref.WeakSet[DataFrame] = weakref.WeakSet()  # what saved() gave and is still held
FEW = 10_000  # rows of aggregates that may be broadcast


def _folder(spark: SparkSession) -> str:
    """This application's folder for saved tables; deleted when Python ends, as plans may read it until then."""
    path = f"{shared_dir(spark)}/saved-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        atexit.register(_delete, folder, conf)
    return path


_folders: set[str] = set()


def _delete(folder: Any, conf: Any) -> None:
    try:
        folder.getFileSystem(conf).delete(folder, True)
    except (Py4JError, OSError):  # the JVM has gone before
        pass


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: for what several parts of a plan read. A table that is saved already stays as it is."""
    if df in _written:
        return df
    schema, path = df.schema, f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(schema).parquet(path)
    _written.add(table)
    return table


def free(spark: SparkSession) -> None:
    """What only plans that were written needed is garbage; collecting it lets Spark delete their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, few: int = FEW) -> DataFrame:
    """An aggregate, written and counted: to be broadcast in joins if it has no more than ``few`` rows, else left to Spark."""
    table = saved(df)
    return F.broadcast(table) if table.limit(few + 1).count() <= few else table
