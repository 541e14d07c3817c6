"""Outlier rules over lead times, event pairs and services; one record for each rule and call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.time import hours_between
from . import stats
from .events import event_map


def pair_values(points: DataFrame, pairs: Sequence[tuple]) -> DataFrame:
    """OL-EV: (rule, call_id, value) hours between the events of each (rule, start, end, ...)."""
    names = sorted({n for p in pairs for n in p[1:3]})
    wide = event_map(points.filter(F.col("event_name").isin(*names)), names)
    return wide.select("call_id", F.inline(F.array(*[F.struct(F.lit(p[0]).alias("rule"), hours_between(p[1], p[2]).alias("value")) for p in pairs]))).filter("value is not null").select("rule", "call_id", "value")


def pair_outliers(points: DataFrame, pairs: Sequence[tuple]) -> DataFrame:
    """The HIGH and SD rules of the pair table (rule, start, end, kind, parameter), each parameter in one pass."""
    values = saved(pair_values(points, pairs))
    found = []
    for kind, parameter in sorted({(p[3], p[4]) for p in pairs}):
        rules = [p[0] for p in pairs if (p[3], p[4]) == (kind, parameter)]
        rows = values.filter(F.col("rule").isin(*rules))
        found.append(stats.above_percentile(rows, ["rule"], "value", parameter) if kind == "HIGH" else stats.above_deviations(rows, ["rule"], "value", parameter))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _record(out, "Time-based Outlier")


def _record(rows: DataFrame, category: str) -> DataFrame:
    return rows.select("rule", "call_id", F.round("value", 4).alias("value"), F.round("threshold", 4).alias("threshold"), "severity", F.lit(category).alias("category"))


def pilot_outliers(timings: DataFrame) -> DataFrame:
    """OUT-V2-002 and 007: pilot services late by over 3 deviations, or earlier than the linear P30; with the service's id."""
    rows = timings.filter("kind = 'PILOT' and delay_hours is not null")
    values = lambda r, rule: r.select(F.lit(rule).alias("rule"), "call_id", "service_id", F.col("delay_hours").alias("value"))
    late = stats.above_deviations(values(rows, "OUT-V2-002"), ["rule"], "value", 3.0)
    early = stats.below_percentile(values(rows.filter("delay_hours < 0"), "OUT-V2-007"), ["rule"], "value", 0.3)
    both = late.unionByName(early)
    return both.select("rule", "call_id", "service_id", F.round("value", 4).alias("value"), F.round("threshold", 4).alias("threshold"), "severity", F.lit("Time-based Outlier").alias("category"))


def tug_before_pilot(points: DataFrame, tugs: Sequence[str] = ("TUG_1_SERVICE_START_ARRIVAL", "TUG_2_SERVICE_START_ARRIVAL"), pilot: str = "PILOT_ON_BOARD_ARRIVAL") -> DataFrame:
    """OUT-V2-004: a tug starts before the pilot is on board; of several such tugs the last one's hours."""
    wide = event_map(points.filter(F.col("event_name").isin(*tugs, pilot)), [*tugs, pilot])
    early = F.coalesce(*[F.when(F.col(t) < F.col(pilot), F.col(t)) for t in reversed(tugs)])
    rows = wide.withColumn("tug", early).filter("tug is not null").select(F.lit("OUT-V2-004").alias("rule"), "call_id", hours_between("tug", pilot).alias("value"), F.lit(0.0).alias("threshold"), F.lit("HIGH").alias("severity"))
    return _record(rows, "Sequence Outlier")


def repeated_shifts(events: DataFrame, name: str = "SHIFT_PILOT_ON_BOARD") -> DataFrame:
    """OUT-V2-028: calls with more than one shift."""
    rows = events.filter(F.col("event_name") == name).groupBy("call_id").agg(F.count("*").cast("double").alias("value")).filter("value > 1")
    return _record(rows.select(F.lit("OUT-V2-028").alias("rule"), "call_id", "value", F.lit(1.0).alias("threshold"), F.lit("MEDIUM").alias("severity")), "Operational Performance Outlier")


def sailing_variance(points: DataFrame) -> DataFrame:
    """OUT-V2-034: size of ATD - ETD above the linear P90."""
    wide = event_map(points.filter("event_name in ('ETD', 'ATD')"), ["ETD", "ATD"]).select(F.lit("OUT-V2-034").alias("rule"), "call_id", F.abs(hours_between("ETD", "ATD")).alias("value")).filter("value is not null")
    return _record(stats.above_percentile(wide, ["rule"], "value", 0.9), "Operational Performance Outlier")


def from_issues(issues: DataFrame) -> DataFrame:
    """OUT-V2-031 and 032: open issues as sequence or data-quality outliers, by their rule."""
    sequence = F.col("rule_id").contains("SEQUENCE") | F.col("rule_id").isin("DQ-006", "DQ-SCHEDULE-ORDER")
    rows = issues.filter("status <> 'RESOLVED'").groupBy("call_id", F.when(sequence, "OUT-V2-031").otherwise("OUT-V2-032").alias("rule")).agg(F.count("*").cast("double").alias("value"), F.max(F.when(F.col("severity") == "CRITICAL", 1).otherwise(0)).alias("c"))
    category = F.when(F.col("rule") == "OUT-V2-031", "Sequence Outlier").otherwise("Data Quality Outlier")
    return rows.select("rule", "call_id", "value", F.lit(0.0).alias("threshold"), F.when(F.col("c") == 1, "CRITICAL").otherwise("HIGH").alias("severity"), category.alias("category"))


#: The categories that an outlier may have.
CATEGORIES = ("Time-based Outlier", "Sequence Outlier", "Operational Performance Outlier", "Data Quality Outlier")


def deduplicate(found: DataFrame, ordinal: Sequence[str] = ("value",)) -> DataFrame:
    """OL-DED: of the records of a rule and call the last one in order of ``ordinal``; records of unknown categories go."""
    order = Window.partitionBy("rule", "call_id").orderBy(*[F.desc(c) for c in ordinal], F.desc("value"), F.desc("severity"))
    return found.filter(F.col("category").isin(*CATEGORIES)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def keep_exclusions(found: DataFrame, previous: DataFrame) -> DataFrame:
    """OL-KEEP, OL-TOG: exclusion flag and rationale of earlier decisions (rule, call_id, is_excluded, rationale)."""
    joined = found.join(previous.select("rule", "call_id", "is_excluded", "rationale"), ["rule", "call_id"], "left")
    return joined.withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))


def with_aliases(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """OL-ALIAS: the records of a rule again under its aliases (alias, rule)."""
    again = found.join(F.broadcast(aliases), "rule").drop("rule").withColumnRenamed("alias", "rule")  # the registry has a few rows
    return found.unionByName(again)


def listing(found: DataFrame, calls: DataFrame, *, category: str | None = None, severity: str | None = None, is_excluded: bool | None = None, vcn: str = "") -> DataFrame:
    """OL-LIST: outliers with their call's VCN and vessel, by category, severity, exclusion and part of the VCN."""
    rows = found.join(calls.select("call_id", "vcn", "vessel_name"), "call_id", "left")
    for column, value in (("category", category), ("severity", severity), ("is_excluded", is_excluded)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.filter(F.col("vcn").ilike(f"%{vcn}%")) if vcn else rows


LEGACY, LEGACY_METRIC = "OPERATIONAL_OUTLIER", "Turnaround"


def presented(found: DataFrame, calls: DataFrame, lead_times: DataFrame, *, category: str | None = None, severity: str | None = None, is_excluded: bool | None = None, vcn: str | None = None) -> DataFrame:
    """OL-LIST: outliers of known calls with VCN and vessel, severity by its text from Z to A, then the greatest divergence first.

    found: (rule, call_id, metric, value, threshold, severity, category, is_excluded, source_ids). Old records of turnarounds
    are presented as time-based ones (and found under that category); those without a rule are marked, have stated texts where
    theirs are missing, and without sources those of the call's turnarounds, newest first, each once.
    lead_times: (call_id, metric, calculated_at, source_ids). ``vcn`` is compared whole.
    """
    old = (F.col("category") == LEGACY) & (F.col("metric") == LEGACY_METRIC)
    rows = found.withColumns({"is_legacy": F.coalesce(old & F.col("rule").isNull(), F.lit(False)), "category": F.when(old, "Time-based Outlier").otherwise(F.col("category")), "divergence": F.round(F.col("value") - F.col("threshold"), 4)})
    for column, value in (("category", category), ("severity", severity), ("is_excluded", is_excluded)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    rows = rows.join(calls.select("call_id", "vcn", "vessel_name"), "call_id")
    if vcn is not None:
        rows = rows.filter(F.col("vcn") == vcn)
    own = lead_times.filter(F.col("metric") == LEGACY_METRIC).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("calculated_at", "source_ids")), asc=False).alias("_l"))  # a call's stored turnarounds
    rows = rows.join(own.select("call_id", F.array_distinct(F.flatten(F.transform("_l", lambda x: x["source_ids"]))).alias("_sources")), "call_id", "left")
    none = F.array().cast("array<string>")
    sources = F.when(F.size(F.coalesce("source_ids", none)) > 0, F.col("source_ids")).when(F.col("is_legacy"), F.coalesce("_sources", none)).otherwise(none)
    said = lambda text: F.when(F.col("is_legacy"), text)
    out = rows.select(
        "rule", "call_id", "vcn", "vessel_name", "category", "metric", "value", "threshold", "divergence", "severity", "is_excluded", sources.alias("source_ids"), "is_legacy",
        said("Vessel turnaround time exceeded the historical outlier threshold.").alias("issue"), said("Historical threshold").alias("threshold_label"), said("Unavailable / Legacy record").alias("leg"),
    )
    return out.orderBy(F.desc("severity"), F.desc("divergence"), "rule", "call_id")


def digest(found: DataFrame) -> DataFrame:
    """DB-10: by category and severity, records and calls, worst first."""
    rank = F.when(F.col("severity") == "CRITICAL", 1).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 3).otherwise(4)
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("call_id").alias("n_calls")).withColumn("severity_rank", rank).orderBy("severity_rank", F.desc("n"))
