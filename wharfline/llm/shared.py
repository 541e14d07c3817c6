"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a new temporary one in local mode (tests), an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_collected: list[list[str]] = []  # of the scopes that are open


@contextlib.contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Adds to ``paths`` the tables that materialise() writes meanwhile."""
    _collected.append(paths)
    try:
        yield
    finally:
        _collected.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that materialise() wrote, when all that reads them has run, and empty the list."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors.

    What only the written plan needed is garbage now; collecting it lets Spark delete its shuffle files.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _collected:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    _paths[table] = path
    return table


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def path_of(table: DataFrame) -> str:
    """The folder of a table that materialise() gave."""
    return _paths[table]


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a generator of columns: ``rows`` yields dicts of column name to list or array, in the schema's order."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = None
        for columns in rows(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)
        del columns
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """At the end of a task: gives what it has freed back to the system, as the Python worker may go on with another stage's tasks."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A non-null integer column as int64."""
    return np.asarray(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False), dtype=np.int64)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` with a number in the order of ``key``, by a distributed sort of its distinct values; null for null."""
    kind = rows.schema[key].dataType
    order = rows.select(F.col(key).alias("key")).filter("key is not null").distinct().orderBy("key").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    numbers = rows.sparkSession.createDataFrame(order, StructType([StructField("key", kind), StructField(number, LongType())]))
    return rows.join(materialise(numbers, "numbers"), F.col(key) == F.col("key"), "left").select(*[rows[c] for c in rows.columns], number)


def bounded_sample(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, each drawn by itself, whatever its values; every row if there are no more than that."""
    n = df.count()
    return df if n <= most else df.filter(F.rand(7) < most / n)


def csr_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated slices [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def slices(starts: np.ndarray, total: int) -> list[tuple[int, int]]:
    """(start, end) of consecutive slices that reach to ``total``; none for no starts."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), total], strict=False))


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links a[i]-b[i] connect: (node, smallest node of its component), without the centres."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
