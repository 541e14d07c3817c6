"""Lead times: a row for every definition and call, available or not; execution delays; the custom builder; contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.time import hours_between
from .stats import with_quantiles


def lead_times(calls: DataFrame, points: DataFrame, definitions: DataFrame, *, blocked: DataFrame | None = None) -> DataFrame:
    """TM-11, TM-15, TM-16: (call_id, metric, hours, status, reason, source_ids), one row for each pair of call and definition.

    points: (call_id, event_name, utc, event_id). blocked (call_id, metric): pairs that stay unavailable whatever the events
    say (TM-14). The instants are gathered into one map for each call, so that the registry costs no join for each side.
    """
    at = points.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("event_name", F.struct("utc", "event_id")))).alias("at"))
    rows = calls.select("call_id").distinct().join(at, "call_id", "left").crossJoin(F.broadcast(definitions))  # the registry has a few rows
    if blocked is not None:
        rows = rows.join(blocked.select("call_id", "metric", F.lit(True).alias("blocked")).distinct(), ["call_id", "metric"], "left")
    else:
        rows = rows.withColumn("blocked", F.lit(None).cast("boolean"))
    rows = rows.withColumns({"a": F.try_element_at("at", F.col("start_event")), "z": F.try_element_at("at", F.col("end_event"))})
    hours = hours_between("a.utc", "z.utc")
    usable = F.col("computable") & F.col("blocked").isNull()
    reason = (
        F.when(~F.col("computable"), "NO_SOURCE_DATA")
        .when(F.col("blocked"), "BLOCKED_BY_SOURCE")
        .when(F.col("a").isNull() & F.col("z").isNull(), "MISSING_BOTH")
        .when(F.col("a").isNull(), "MISSING_START")
        .when(F.col("z").isNull(), "MISSING_END")
    )
    status = F.when(~F.col("computable"), "NO_SOURCE_DATA").when(reason.isNull(), "AVAILABLE").otherwise("UNAVAILABLE")
    return rows.select("call_id", "metric", F.when(usable, hours).alias("hours"), status.alias("status"), reason.alias("reason"), F.array_compact(F.array("a.event_id", "z.event_id")).alias("source_ids"))


def execution_delays(services: DataFrame, movement: str) -> DataFrame:
    """TM-13: (call_id, service_id, hours) of the pilotage of one movement.

    The first scheduled one of that movement; without any, of calls with several pilotages, the first (Arrival) or last (else).
    """
    pilot = services.filter(F.lower("service_type").contains("pilot")).withColumn("_hit", F.lower("movement") == movement.lower())
    order = F.struct(F.col("scheduled").isNull(), "scheduled", "service_id")
    mine = F.min(F.when(F.col("_hit"), F.struct(order.alias("o"), "service_id", "scheduled", "served")))
    end = F.min if movement.lower() == "arrival" else F.max
    other = end(F.struct(order.alias("o"), "service_id", "scheduled", "served"))
    got = pilot.groupBy("call_id").agg(mine.alias("m"), other.alias("e"), F.count("*").alias("n"))
    pick = F.coalesce("m", F.when(F.col("n") > 1, F.col("e")))
    return got.select("call_id", pick.alias("p")).filter("p is not null").select("call_id", "p.service_id", hours_between("p.scheduled", "p.served").alias("hours"))


def all_metrics(calls: DataFrame, points: DataFrame, definitions: DataFrame, services: DataFrame, delays: Sequence[tuple[str, str]], *, blocked: DataFrame | None = None) -> DataFrame:
    """TM-10: the lead times and, as metrics of their own, the execution delays (name, movement): a row for each call and metric."""
    found = lead_times(calls, points, definitions, blocked=blocked)
    every = calls.select("call_id").distinct()
    for name, movement in delays:
        rows = every.join(execution_delays(services, movement), "call_id", "left")
        missing = F.col("hours").isNull()
        found = found.unionByName(rows.select("call_id", F.lit(name).alias("metric"), "hours", F.when(missing, "UNAVAILABLE").otherwise("AVAILABLE").alias("status"), F.when(F.col("service_id").isNull(), "MISSING_BOTH").when(missing, "MISSING_TIME").alias("reason"), F.array_compact(F.array("service_id")).alias("source_ids")))
    return found


def blocked_turnarounds(calls: DataFrame, column: str = "ata", metric: str = "Turnaround") -> DataFrame:
    """TM-14: (call_id, metric) of calls whose source row has a blank ATA: their turnaround stays unavailable whatever the events say."""
    return calls.filter(F.col(column).isNull()).select("call_id", F.lit(metric).alias("metric"))


def gate_turnaround(results: DataFrame, source: DataFrame, metric: str = "Turnaround") -> DataFrame:
    """TM-14: lead times, in which a turnaround whose call's newest source row (``canonical.source_times``) has a blank ATA is UNAVAILABLE, whatever the events say."""
    blank = source.filter("ata is null").select("call_id", F.lit(metric).alias("metric"), F.lit(True).alias("_blank"))
    rows = results.join(blank, ["call_id", "metric"], "left")
    gated = F.coalesce("_blank", F.lit(False))
    return rows.withColumns({"hours": F.when(~gated, F.col("hours")), "status": F.when(gated, "UNAVAILABLE").otherwise(F.col("status")), "reason": F.when(gated, "SOURCE_ATA_BLANK").otherwise(F.col("reason"))}).drop("_blank")


def custom_lead_time(events: DataFrame, start: str, end: str, *, pick: str = "first", n: int = 1, calls: DataFrame | None = None, include_quarantined: bool = False, scope: str | None = None) -> DataFrame:
    """TM-21: (call_id, occurrence, hours) between two events: their first, last or nth occurrences, or all, paired by position.

    calls: only these (the cohort). scope: only events of this movement (ARRIVAL, SAILING, SHIFTING). Occurrences count over live events in order of (occurrence_index, utc, event_id).
    """
    rows = events.filter(F.col("event_name").isin(start, end) & ~F.col("is_superseded") & F.col("utc").isNotNull())
    if not include_quarantined:
        rows = rows.filter("not is_quarantined")
    if scope is not None:
        rows = rows.filter(F.col("scope") == scope)
    if calls is not None:
        rows = rows.join(calls.select("call_id").distinct(), "call_id", "left_semi")
    order = Window.partitionBy("call_id", "event_name")
    by = [F.col("occurrence_index"), F.col("utc"), F.col("event_id")]
    rows = rows.withColumn("occurrence", F.row_number().over(order.orderBy(*[c.desc() for c in by] if pick == "last" else by)))
    if pick != "all":
        rows = rows.filter(F.col("occurrence") == (n if pick == "nth" else 1))
    side = lambda name: F.min(F.when(F.col("event_name") == name, F.col("utc")))
    paired = rows.groupBy("call_id", "occurrence").agg(side(start).alias("a"), side(end).alias("z"))
    return paired.filter("a is not null and z is not null").select("call_id", "occurrence", hours_between("a", "z").alias("hours"))


def builder_outliers(df: DataFrame, value: str = "hours") -> DataFrame:
    """TM-24: values above the linear P90, or negative."""
    df = saved(df)
    limit = with_quantiles(df.select(value), [], value, {"p90": (0.9, "linear")}).select("p90")
    return df.crossJoin(F.broadcast(limit)).filter((F.col(value) > F.col("p90")) | (F.col(value) < 0))  # one row


def contribution(results: DataFrame, total: str = "Turnaround") -> DataFrame:
    """TM-25: each available lead time as a percentage of its call's total, 2 decimals; null for a total of 0 or none."""
    whole = F.max(F.when((F.col("metric") == total) & (F.col("status") == "AVAILABLE"), F.col("hours"))).over(Window.partitionBy("call_id"))
    rows = results.withColumn("total_hours", whole).filter("status = 'AVAILABLE'")
    return rows.select("call_id", "metric", "hours", F.round(F.try_divide(F.col("hours"), F.nullif(F.col("total_hours"), F.lit(0.0))) * 100, 2).alias("share_pct"))


def concept_total(categories: list[str]) -> Column:
    """TM-06, TM-07: sum of the available hours of stages in the categories; null for none."""
    return F.round(F.sum(F.when(F.col("category").isin(*categories) & (F.col("status") == "AVAILABLE"), F.col("hours"))), 6)


WAITING, SERVICE = ["PASSIVE_WAIT", "HOLD", "WAITING"], ["ACTIVE_SERVICE", "SERVICE"]
