"""Stored results: parquet folders, and versions that say which folders make up a table.

A version is a small JSON file, numbered one on from the version it was made from, whose creation is atomic: of two writers
that start from the same version one publishes, the other gets ``Conflict``. Writers write their folders first, so a reader
sees a whole version or the one before. Parts that a version doesn't change are shared with the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import free

PART = "_stored_bucket"


class Conflict(Exception):
    """Another writer has published a version in between."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, str]  # name to folder
    facts: dict[str, Any] = field(default_factory=dict)
    schema: str | None = None  # of tables whose parts have one schema


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text, unless it is there already; atomic with a rename that doesn't overwrite, on local disks with a link."""
    jvm = spark._jvm
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = jvm.java.nio.file.Path.of
            jvm.java.nio.file.Files.createLink(local(fs.makeQualified(target).toUri()), local(fs.makeQualified(draft).toUri()))
        else:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions of a stored table, oldest first; none if there is no such table."""
    fs, folder = _fs(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
    return [_version(spark, path, n) for n in numbers]


def _version(spark: SparkSession, path: str, number: int) -> Version:
    fs, file = _fs(spark, f"{path}/versions/{number:012}.json")
    with_text = fs.open(file)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8")))
    finally:
        with_text.close()


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version, or none."""
    fs, folder = _fs(spark, f"{path}/versions")
    if not fs.exists(folder):
        return None
    numbers = [int(n.removesuffix(".json")) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json")]
    return _version(spark, path, max(numbers)) if numbers else None


def publish(spark: SparkSession, path: str, base: Version | None, parts: Mapping[str, str], *, facts: Mapping[str, Any] | None = None, schema: str | None = None) -> Version:
    """The version after ``base`` (none: the first) with these parts; ``Conflict`` if there is one already."""
    made = Version((base.number if base else 0) + 1, dict(parts), dict(facts or {}), schema)
    if not _create(spark, f"{path}/versions/{made.number:012}.json", json.dumps(made.__dict__)):
        raise Conflict(f"version {made.number} of {path} exists")
    return made


def new_folder(path: str) -> str:
    return f"{path}/data/{uuid.uuid4().hex}"


def read(spark: SparkSession, version: Version, names: Iterable[str] | None = None) -> DataFrame:
    """The rows of all, or of these, parts of a table whose parts have one schema."""
    folders = [version.parts[n] for n in (version.parts if names is None else names) if n in version.parts]
    return spark.read.schema(version.schema).parquet(*folders) if folders else spark.createDataFrame([], version.schema)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The part of a row; equal keys, null or not, share one."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> dict[str, str]:
    """Write rows dealt by their keys; (bucket, folder) of the buckets that have rows."""
    folder = new_folder(path)
    rows.withColumn(PART, bucket_of(keys, buckets)).repartition(F.col(PART)).write.partitionBy(PART).parquet(folder)
    free(rows.sparkSession)
    fs, place = _fs(rows.sparkSession, folder)
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return {n.removeprefix(f"{PART}="): f"{folder}/{n}" for n in names if n.startswith(f"{PART}=")}


def rebuild(spark: SparkSession, path: str, derive: Callable[[DataFrame], DataFrame], source: DataFrame, *, changed: DataFrame | None = None, key: str = "call_id", buckets: int = 64, tries: int = 5) -> tuple[Version, list[str]]:
    """JR-13, LC-05: a table derived from ``source`` key by key, stored by buckets of the key; and the buckets that were written.

    Without ``changed`` or without a stored version all is derived; else only the buckets of the changed keys (at most
    ``buckets`` numbers come to the driver), from what ``source`` now has of them. Nothing changed, nothing is written. A
    writer that was overtaken begins again from the newer version.
    """
    for _ in range(tries):
        base = current(spark, path)
        touched = None
        rows = source
        if base is not None and changed is not None:
            if base.facts["buckets"] != buckets or base.facts["key"] != key:
                raise ValueError("the stored table has other buckets")
            touched = sorted(str(r.bucket) for r in changed.select(bucket_of([key], buckets).alias("bucket")).distinct().collect())
            if not touched:
                return base, []
            rows = source.filter(bucket_of([key], buckets).isin(*map(int, touched)))
        out = derive(rows)
        written = write_buckets(out, path, [key], buckets)
        kept = {} if touched is None else {n: p for n, p in base.parts.items() if n not in touched}
        try:
            made = publish(spark, path, base, kept | written, facts={"buckets": buckets, "key": key}, schema=_ddl(out))
            return made, sorted(written) if touched is None else touched
        except Conflict:
            continue
    raise Conflict(f"{path} changes too often")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def replacing(keys: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """How new rows meet stored ones of their keys: they take their place."""

    def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
        other = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        kept = stored.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        return kept.unionByName(new)

    return merge


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], *, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, newest: Sequence[Column] = (), buckets: int = 64, tries: int = 5) -> tuple[Version, list[str]]:
    """DQ-UPS, TM-16, JR-12: merge rows into a stored table by their keys; and the buckets that were written.

    merge(stored, new) decides (default: new rows replace stored ones of equal keys); it sees only the buckets that new rows
    fall in, whole. Of new rows with equal keys the greatest by ``newest``, then by all columns, counts. The same rows once
    more change nothing.
    """
    first = [c.alias(f"_newest_{i}") for i, c in enumerate(newest)]
    greatest = F.max(F.struct(*first, *[c for c in new.columns if c not in keys], F.lit(0).alias("_row")))
    one = new.groupBy(*keys).agg(greatest.alias("_row")).select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in new.columns])  # dealt by its keys, as what it meets
    merge = merge or replacing(keys)
    for _ in range(tries):
        base = current(spark, path)
        if base is not None and (base.facts["buckets"], base.facts["keys"]) != (buckets, list(keys)):
            raise ValueError("the stored table has other keys or buckets")
        touched = sorted(str(r.bucket) for r in new.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect())  # numbers up to ``buckets``; equal keys share one
        if base is not None and not touched:
            return base, []
        stored = read(spark, base, touched) if base is not None else spark.createDataFrame([], one.schema)
        written = write_buckets(merge(stored, one), path, keys, buckets)
        kept = {n: p for n, p in base.parts.items() if n not in touched} if base is not None else {}
        try:
            return publish(spark, path, base, kept | written, facts={"buckets": buckets, "keys": list(keys)}, schema=_ddl(one)), touched
        except Conflict:
            continue
    raise Conflict(f"{path} changes too often")


def append_run(spark: SparkSession, path: str, rows: DataFrame, run: str, *, tries: int = 5) -> Version:
    """KF-11, KF-12, KF-18, KF-20: add the rows of a run, under its id in ``run_id``, to a history; a run that is there already stays as it is."""
    named = rows.withColumn("run_id", F.lit(run))
    folder = None
    for _ in range(tries):
        base = current(spark, path)
        if base is not None and run in base.parts:
            return base
        if folder is None:
            folder = new_folder(path)
            named.write.parquet(folder)
        try:
            return publish(spark, path, base, (base.parts if base else {}) | {run: folder}, schema=_ddl(named))
        except Conflict:
            continue
    raise Conflict(f"{path} changes too often")


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """All runs of a history, or none if nothing was stored."""
    base = current(spark, path)
    return None if base is None else read(spark, base)


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> list[str]:
    """Forget all but the newest ``keep`` versions and delete the folders that only they had; the folders deleted.

    Folders of writers that haven't published yet stay. A reader of a forgotten version may fail: keep as many as readers last.
    """
    if keep < 1:
        raise ValueError("the newest version is always kept")
    every = versions(spark, path)
    old, kept = every[:-keep], {folder for v in every[-keep:] for folder in v.parts.values()}
    gone = sorted({folder for v in old for folder in v.parts.values()} - kept)
    for v in old:
        fs, file = _fs(spark, f"{path}/versions/{v.number:012}.json")
        fs.delete(file, False)
    for folder in gone:
        fs, place = _fs(spark, folder)
        fs.delete(place, True)
    return gone
