"""Datasets as batches of files: idempotent intake, appends, exclusions, newest wins, lineage, scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES = 15


def new_groups(groups: DataFrame, batches: DataFrame) -> DataFrame:
    """LC-01: groups (tenant, checksum) that no committed batch of the tenant has."""
    return groups.join(batches.filter("status = 'COMMITTED'").select("tenant", "checksum"), ["tenant", "checksum"], "left_anti")


def append_files(active: DataFrame, added: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """LC-02: the active files of each tenant and the new ones by checksum, marked REJECTED beyond ``most``; active ones come first."""
    every = active.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    one = every.withColumn("_n", F.row_number().over(Window.partitionBy("tenant", "checksum").orderBy("_new", "file"))).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("tenant").orderBy("_new", "file"))
    return one.withColumn("intake", F.when(place <= most, "ACCEPTED").otherwise("REJECTED")).drop("_n", "_new")


def replace_tenant(df: DataFrame, path: str) -> None:
    """LC-03: write by tenant, replacing only the tenants that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").parquet(path)


def activate_latest(batches: DataFrame) -> DataFrame:
    """LC-04: the newest committed batch of each tenant is active, older ones are SUPERSEDED."""
    newest = batches.filter("status = 'COMMITTED'").groupBy("tenant").agg(F.max(F.struct("created_at", "batch_id")).alias("_newest"))
    joined = batches.join(newest, "tenant", "left")
    active = (F.col("status") == "COMMITTED") & F.col("created_at").eqNullSafe(F.col("_newest.created_at")) & F.col("batch_id").eqNullSafe(F.col("_newest.batch_id"))
    joined = joined.withColumn("is_active", F.coalesce(active, F.lit(False)))
    return joined.withColumn("status", F.when((F.col("status") == "COMMITTED") & ~F.col("is_active"), "SUPERSEDED").otherwise(F.col("status"))).drop("_newest")


def apply_exclusions(staging: DataFrame, decisions: DataFrame, key: str = "record_reference") -> DataFrame:
    """LC-05: staged rows that no decision excludes."""
    return staging.join(decisions.select(key).distinct(), key, "left_anti")


def active_dataset(batches: DataFrame, files: DataFrame) -> DataFrame:
    """LC-06: the active batch of each tenant with how many of its files are governed and skipped."""
    counts = files.groupBy("batch_id").agg(F.count_if(F.col("status") != "SKIPPED").alias("n_governed"), F.count_if(F.col("status") == "SKIPPED").alias("n_skipped"))
    return batches.filter("is_active").join(counts, "batch_id", "left").na.fill(0, ["n_governed", "n_skipped"])


def lineage(references: DataFrame, staging: DataFrame, column: str = "record_reference") -> DataFrame:
    """LC-07: file, sheet, row and values of references ``file:sheet:row``; the file's name may have colons."""
    parts = r"^(.*):([^:]*):(\d+)$"
    split = references.withColumns({"file": F.regexp_extract(column, parts, 1), "sheet": F.regexp_extract(column, parts, 2), "row_number": F.nullif(F.regexp_extract(column, parts, 3), F.lit("")).cast("int")})
    return split.join(staging.select("file", "sheet", "row_number", "values"), ["file", "sheet", "row_number"], "left")


def apply_scope(df: DataFrame, *, tenant: str = "*", port: str = "*", terminal: str = "*") -> DataFrame:
    """SC-01: rows of a tenant, port and terminal; ``*`` is all, and rows without a port or terminal stay visible."""
    for column, value, open_ in (("tenant", tenant, False), ("port", port, True), ("terminal", terminal, True)):
        if value != "*":
            fits = F.col(column) == value
            df = df.filter(fits | F.col(column).isNull() if open_ else fits)
    return df


def search_calls(calls: DataFrame, *, text: str = "", sort: str = "call_id", descending: bool = False, skip: int = 0, limit: int | None = None, columns: Sequence[str] = ("vcn", "vessel_name", "vessel_type")) -> DataFrame:
    """DB-08: calls with ``text`` in one of the columns, in order, a page of them if ``limit`` is given."""
    if text:
        fits = F.lit(False)
        for c in columns:
            fits |= F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        calls = calls.filter(fits)
    if limit is None:
        return calls
    return calls.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), "call_id").offset(skip).limit(limit)
