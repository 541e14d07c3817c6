"""Landing: file manifests, header rows in sheets of cells, raw evidence, normalised rows, validation of staged rows.

A cell is a row (file, sheet, row_number, column_number, value). An alias is a row (target, token, column): under a target
table, the header token that means a canonical column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved, small
from ..functions.names import header_token, is_blank
from ..functions.time import parse_local

HEADER_ROWS, HEADER_COLUMNS = 50, 512


def _sha256(spark: SparkSession, file: str) -> str:
    """Of a file of any length, in a store of any kind, read as a stream by the driver's JVM: a digest can't be taken in parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """ING-01: (file, checksum, n_bytes, group_checksum) of 1 to 15 files, a few of them read at once, none held in memory."""
    if not 1 <= len(paths) <= 15:
        raise ValueError(f"1 to 15 files are taken, not {len(paths)}")
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length").collect()  # listed only
    with ThreadPoolExecutor(4) as readers:
        sums = list(readers.map(lambda f: _sha256(spark, f.path), files))
    group = hashlib.sha256("".join(sorted(sums)).encode()).hexdigest()
    return spark.createDataFrame([(f.path, s, f.length, group) for f, s in zip(files, sums, strict=True)], "file string, checksum string, n_bytes long, group_checksum string")


def detect_headers(cells: DataFrame, aliases: DataFrame, required: Mapping[str, Sequence[str]], least: Mapping[str, int] | None = None) -> DataFrame:
    """ING-02: (file, sheet, header_row, target, score): of the first 50 rows of a sheet the one that knows most columns of a target.

    All required columns must be there, and at least ``least`` columns. A sheet that bears a target's name is only taken for
    that target. The earliest of equally good rows wins; a row that fits two targets equally well fits none.
    """
    spark = cells.sparkSession
    head = cells.filter((F.col("row_number") <= HEADER_ROWS) & (F.col("column_number") <= HEADER_COLUMNS) & ~is_blank("value")).withColumn("token", header_token("value"))
    need = spark.createDataFrame([(t, c) for t, cs in required.items() for c in cs], "target string, column string")
    counts = spark.createDataFrame([(t, len(cs), (least or {}).get(t, len(cs))) for t, cs in required.items()], "target string, n_required int, least int")
    known = head.join(aliases, "token").join(need.withColumn("_r", F.lit(1)), ["target", "column"], "left")
    scored = known.groupBy("file", "sheet", "row_number", "target").agg(F.countDistinct("column").alias("score"), F.countDistinct(F.when(F.col("_r") == 1, F.col("column"))).alias("n_found"))
    good = scored.join(counts, "target").filter("n_found = n_required and score >= least").withColumn("_named", F.col("sheet") == F.col("target"))
    sheet = Window.partitionBy("file", "sheet")
    bound = good.withColumn("_any", F.max("_named").over(sheet)).filter("_named or not _any")
    own_name = bound.join(counts.select(F.col("target").alias("sheet"), F.lit(True).alias("_reserved")), "sheet", "left").filter("_reserved is null or _named")
    best = own_name.withColumn("_max", F.max("score").over(sheet)).filter("score = _max")
    tied = best.withColumns({"_n": F.row_number().over(sheet.orderBy("row_number")), "_targets": F.size(F.collect_set("target").over(sheet))})
    return small(tied.filter("_n = 1 and _targets = 1").select("file", "sheet", F.col("row_number").alias("header_row"), "target", "score"))  # joined with all cells


def missing_columns(cells: DataFrame, aliases: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """ING-13: (file, sheet, missing): required columns that no row of an exactly named sheet has."""
    spark = cells.sparkSession
    need = spark.createDataFrame([(t, c) for t, cs in required.items() for c in cs], "sheet string, column string")
    sheets = cells.select("file", "sheet").distinct().join(need, "sheet")
    known = aliases.select("token", F.col("target").alias("sheet"), "column")
    have = cells.filter(F.col("row_number") <= HEADER_ROWS).withColumn("token", header_token("value")).join(known, ["token", "sheet"]).select("file", "sheet", "column")
    return sheets.join(have, ["file", "sheet", "column"], "left_anti").groupBy("file", "sheet").agg(F.array_sort(F.collect_set("column")).alias("missing"))


def group_state(headers: DataFrame, rows: DataFrame, calls: str) -> DataFrame:
    """ING-13 in one row: files with a governed sheet, rows of the ``calls`` target, and whether the group has both and is accepted."""
    governed = headers.agg(F.countDistinct("file").alias("n_governed"))
    known = rows.agg(F.count_if(F.col("target") == calls).alias("n_call_rows"))
    return governed.crossJoin(F.broadcast(known)).withColumn("is_accepted", (F.col("n_governed") > 0) & (F.col("n_call_rows") > 0))  # a row each


def name_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """ING-04: (file, sheet, target, column_number, header, unique_header): repeated headers get ``__duplicate_n`` from the second on."""
    row = cells.join(headers.select("file", "sheet", F.col("header_row").alias("row_number"), "target"), ["file", "sheet", "row_number"]).filter(~is_blank("value"))
    n = F.row_number().over(Window.partitionBy("file", "sheet", F.lower(F.trim("value"))).orderBy("column_number"))
    return row.select("file", "sheet", "target", "column_number", F.trim("value").alias("header"), F.when(n > 1, F.concat(F.trim("value"), F.lit("__duplicate_"), n.cast("string"))).otherwise(F.trim("value")).alias("unique_header"))


def raw_cells(cells: DataFrame, headers: DataFrame, columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """ING-05: (file, sheet, target, row_number, header, column, value) below the header: the evidence, one row for each cell.

    Rows go that are blank, that have no value in a known column, and footnotes: single values below a blank row.
    """
    below = cells.join(headers.select("file", "sheet", "header_row"), ["file", "sheet"]).filter("row_number > header_row").drop("header_row")
    tokens = small(columns.withColumn("token", header_token("unique_header")).join(aliases, ["target", "token"], "left").select("file", "sheet", "target", "column_number", F.col("unique_header").alias("header"), "column"))
    filled = below.filter(~is_blank("value")).join(tokens, ["file", "sheet", "column_number"])
    found, place = filled.select("file", "sheet", "target", "row_number", "column_number", "header", "column", "value"), ["file", "sheet", "row_number"]
    odd = small(filled.groupBy(*place).agg(F.count("*").alias("n"), F.count("column").alias("n_known")).filter("n = 1 or n_known = 0"))  # cells aren't dealt to rows for the few that go
    if odd.isEmpty():
        return found
    after = filled.select("file", "sheet", (F.col("row_number") + 1).alias("row_number")).join(odd, place, "left_semi").distinct()
    first = filled.groupBy("file", "sheet").agg(F.min("row_number").alias("row_number"))
    notes = odd.filter("n_known > 0").select(*place).join(after.unionByName(first), place, "left_anti")
    return found.join(small(odd.filter("n_known = 0").select(*place).unionByName(notes)), place, "left_anti")


def source_value(value: Column, is_datetime: Column) -> Column:
    """ING-06: numbers in date columns as dates of the 1900 system, else the trimmed text."""
    number = F.trim(value).rlike(r"^\d+(\.\d+)?$")
    date = F.timestamp_add("SECOND", F.round(F.trim(value).try_cast("double") * 86400).cast("long"), F.lit("1899-12-30").cast("timestamp_ntz"))
    return F.when(is_datetime & number, F.date_format(date, "yyyy-MM-dd HH:mm:ss")).otherwise(F.trim(value))


def normalise_rows(raw: DataFrame) -> DataFrame:
    """ING-07: (file, sheet, target, row_number, values): the first value of each column; others that differ as ``column__source_n``, from 2."""
    cell = F.struct(F.coalesce("column", "header").alias("name"), "value", "column_number")
    rows = raw.groupBy("file", "sheet", "target", "row_number").agg(F.sort_array(F.collect_list(cell)).alias("_c"))
    before = lambda c, i: F.get(F.col(c), i - 1)
    one = F.filter("_c", lambda x, i: (i == 0) | ~(x["name"].eqNullSafe(before("_c", i)["name"]) & x["value"].eqNullSafe(before("_c", i)["value"])))
    placed = rows.withColumn("_c", F.sort_array(F.transform(one, lambda x: F.struct(x["name"].alias("name"), x["column_number"].alias("column_number"), x["value"].alias("value")))))
    nth = lambda x, i: i + 2 - F.array_position(F.transform("_c", lambda y: y["name"]), x["name"])
    key = lambda x, i: F.when((i == 0) | ~x["name"].eqNullSafe(before("_c", i)["name"]), x["name"]).otherwise(F.concat(x["name"], F.lit("__source_"), nth(x, i).cast("string")))
    entries = F.transform("_c", lambda x, i: F.struct(key(x, i).alias("key"), x["value"].alias("value")))
    return placed.select("file", "sheet", "target", "row_number", F.map_from_entries(F.sort_array(entries)).alias("values"))


def canonical_event_name(rows: DataFrame, dictionary: DataFrame, aliases: DataFrame, *, name: str = "name", movement: str = "movement") -> DataFrame:
    """ING-08: ``rows`` with event_name: an upper-case name as it is, else by dictionary (token, event_name), else by alias, else itself.

    aliases: (token, scope, target, ordinal): the lowest ordinal whose scope is null or the movement; ``{MOVEMENT}`` in a
    target stands for the movement and fits only ARRIVAL, SHIFTING and SAILING; FIELD_ALIAS targets don't count.
    """
    keyed = rows.withColumns({"_id": F.monotonically_increasing_id(), "_t": header_token(name), "_m": F.upper(F.trim(F.coalesce(movement, F.lit(""))))})
    keys = keyed.select("_t", "_m").distinct()
    fits = keys.join(aliases.filter("target <> 'FIELD_ALIAS'"), F.col("_t") == F.col("token")).filter((F.col("scope").isNull() | (F.upper("scope") == F.col("_m"))) & (~F.col("target").contains("{MOVEMENT}") | F.col("_m").isin("ARRIVAL", "SHIFTING", "SAILING")))
    by_alias = fits.groupBy("_t", "_m").agg(F.min_by("target", "ordinal").alias("_target")).withColumn("_target", F.replace("_target", F.lit("{MOVEMENT}"), F.col("_m")))
    by_word = dictionary.groupBy(F.col("token").alias("_t")).agg(F.min("event_name").alias("_word"))
    joined = keyed.join(by_alias, ["_t", "_m"], "left").join(by_word, "_t", "left")
    own = F.when(F.col(name).rlike(r"^[A-Z0-9_]+$"), F.col(name))
    return joined.withColumn("event_name", F.coalesce(own, "_word", "_target", name)).drop("_id", "_t", "_m", "_word", "_target")


def validate_staging(staging: DataFrame, datetimes: Sequence[str], zone: str = "Africa/Johannesburg") -> DataFrame:
    """ING-09 to ING-11: errors by column, fingerprint, and INVALID (a time can't be read) before DUPLICATE (of an earlier valid row of its table) before VALID."""
    bad = lambda c: ~is_blank(F.try_element_at("values", F.lit(c))) & parse_local(F.try_element_at("values", F.lit(c)), F.lit(zone)).isNull()
    errors = F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in datetimes])) if datetimes else F.array().cast("array<string>")
    print_ = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("values")))).cast("binary"), 256)
    rows = saved(staging).withColumns({"errors": errors, "fingerprint": print_}).withColumn("_bad", F.size("errors") > 0)
    place = F.struct("file", "sheet", "row_number")
    good = rows.filter("not _bad").withColumn("_h", F.xxhash64("target", "fingerprint"))
    maybe = small(good.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"))  # of rows that occur once, only hashes are dealt
    again = small(good.join(maybe, "_h", "left_semi").groupBy("target", "fingerprint").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    status = F.when(F.col("_bad"), "INVALID").when(F.col("_first") < place, "DUPLICATE").otherwise("VALID")
    return rows.join(again, ["target", "fingerprint"], "left").withColumn("validation_status", status).select(*staging.columns, "errors", "fingerprint", "validation_status")


def file_status(files: DataFrame, validated: DataFrame) -> DataFrame:
    """ING-12: VALIDATED, VALIDATED_WITH_ISSUES, or SKIPPED for a file without a governed sheet."""
    got = validated.groupBy("file").agg(F.max(F.col("validation_status") == "INVALID").alias("_bad"))
    status = F.when(F.col("_bad").isNull(), "SKIPPED").when(F.col("_bad"), "VALIDATED_WITH_ISSUES").otherwise("VALIDATED")
    return files.join(got, "file", "left").withColumn("file_status", status).drop("_bad")


def dry_run(validated: DataFrame) -> DataFrame:
    """ING-14: what a commit would take, by table and status; nothing is written."""
    return validated.groupBy("target", "validation_status").agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"))
