"""Results against expected ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(actual: DataFrame, expected: DataFrame, tolerance: float = 0.02, excluded: DataFrame | None = None) -> DataFrame:
    """RC-01: (key, metric, actual, expected, result): PASS within the tolerance, FAIL, UNAVAILABLE without an actual value, EXCLUDED where stated.

    actual and expected: (key, metric, value); rows of ``expected`` without a value aren't compared.
    """
    rows = expected.filter("value is not null").select("key", "metric", F.col("value").alias("expected")).join(actual.select("key", "metric", F.col("value").alias("actual")), ["key", "metric"], "left")
    if excluded is not None:
        rows = rows.join(excluded.select("key", "metric", F.lit(True).alias("_x")).distinct(), ["key", "metric"], "left")
    else:
        rows = rows.withColumn("_x", F.lit(None).cast("boolean"))
    result = F.when(F.col("_x"), "EXCLUDED").when(F.col("actual").isNull(), "UNAVAILABLE").when(F.round(F.abs(F.col("actual") - F.col("expected")), 6) <= tolerance, "PASS").otherwise("FAIL")
    return rows.select("key", "metric", "actual", "expected", result.alias("result"))


def melt(wide: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """(key, metric, value) from a column for each metric."""
    return wide.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in columns.items()])).alias("x")).select("key", "x.*")


def result_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric", "result").agg(F.count("*").alias("n"))


def compare_totals(frames: Mapping[str, DataFrame], key: str = "call_id") -> DataFrame:
    """RC-02: distinct keys of each frame, and whether all are equal."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        one = frame.agg(F.countDistinct(key).alias("n")).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.union(one)
    ends = out.agg((F.min("n") == F.max("n")).alias("is_equal"))
    return out.crossJoin(F.broadcast(ends))  # one row


def compare_filtered(sets: Mapping[str, Mapping[str, DataFrame]], key: str = "call_id") -> DataFrame:
    """RC-02 for several filter sets: name of the set, source, distinct keys, and whether the sources of the set agree."""
    out: DataFrame | None = None
    for name, frames in sets.items():
        one = compare_totals(frames, key).select(F.lit(name).alias("filter_set"), "source", "n", "is_equal")
        out = one if out is None else out.union(one)
    return out


def compare_masked(calls: DataFrame, filters: Mapping[str, Column], sources: Mapping[str, DataFrame], key: str = "call_id") -> DataFrame:
    """RC-02 for several filter sets in one pass: what ``compare_filtered`` gives for sources that are filtered by call.

    A call has a bit for each filter it passes and one for each source that has it; one grouping by call brings them
    together, one aggregate counts all combinations. Up to 62 filters and 62 sources.
    """
    if max(len(filters), len(sources)) > 62:
        raise ValueError("at most 62 filters and sources")
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    rows = calls.select(F.col(key), mask.alias("_fits"), none.alias("_has"))
    for i, frame in enumerate(sources.values()):
        rows = rows.unionByName(frame.select(F.col(key), none.alias("_fits"), F.lit(1 << i).cast("long").alias("_has")))
    known = rows.groupBy(key).agg(F.bit_or("_fits").alias("_fits"), F.bit_or("_has").alias("_has"))
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    pairs = [(f, s) for f in range(len(filters)) for s in range(len(sources))]
    counts = known.agg(*[F.count_if(bit("_fits", f) & bit("_has", s)).alias(f"n_{f}_{s}") for f, s in pairs])
    sets = [F.struct(F.lit(name).alias("filter_set"), F.array(*[F.struct(F.lit(source).alias("source"), F.col(f"n_{f}_{s}").alias("n")) for s, source in enumerate(sources)]).alias("of")) for f, name in enumerate(filters)]
    each = counts.select(F.inline(F.array(*sets)))
    equal = F.array_min("of.n") == F.array_max("of.n")
    return each.select("filter_set", equal.alias("is_equal"), F.inline("of")).select("filter_set", "source", "n", "is_equal")


def disposition_counts(staging: DataFrame, by: Sequence[str] = ("target", "validation_status")) -> DataFrame:
    """RC-03: staged rows by table and status."""
    return staging.groupBy(*by).agg(F.count("*").alias("n"))
