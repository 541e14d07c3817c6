"""Dashboard tables: population, throughput by unit, metric cards, delay summary, wide call listing, snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import store
from .lifecycle import apply_scope
from .stats import with_quantiles

UNFILTERED = "unfiltered"
UNITS = ("TEU", "MT", "Units")


def population(
    calls: DataFrame, points: DataFrame, parts: DataFrame | None = None, *, tenant: str = "*", port: str = "*", terminal: str = "*", vessel_type: str | None = None, cargo_type: str | None = None,
    start: str | None = None, end: str | None = None, quality_status: str | None = None,
) -> DataFrame:
    """DB-01: calls by scope, type, cargo, date (the ATA's, else that the call was created) from ``start`` and before ``end``, and quality status."""
    rows = apply_scope(calls, tenant=tenant, port=port, terminal=terminal)
    for column, value in (("vessel_type", vessel_type), ("cargo_type", cargo_type)):
        if value:
            rows = rows.filter(F.col(column) == value)
    if start or end:
        at = F.coalesce("_ata", F.col("created_at").cast("timestamp_ntz")) if "created_at" in calls.columns else F.col("_ata")
        rows = rows.join(points.filter("event_name = 'ATA'").select("call_id", F.col("utc").alias("_ata")), "call_id", "left").withColumn("_at", at)
        if start:
            rows = rows.filter(F.col("_at").isNull() | (F.col("_at") >= F.lit(start).cast("timestamp_ntz")))
        if end:
            rows = rows.filter(F.col("_at").isNull() | (F.col("_at") < F.lit(end).cast("timestamp_ntz")))
        rows = rows.drop("_ata", "_at")
    if quality_status and parts is not None:
        rows = rows.join(parts.filter(F.col("quality_status") == quality_status).select("call_id"), "call_id", "left_semi")
    return rows


def throughput(calls: DataFrame, cargo: DataFrame) -> DataFrame:
    """DB-02: quantity and calls by cargo type and unit; units are never added up."""
    joined = cargo.join(calls.select("call_id", "cargo_type"), "call_id")
    return joined.groupBy("cargo_type", "unit").agg(F.round(F.sum("quantity"), 2).alias("quantity"), F.countDistinct("call_id").alias("n_calls"))


def cargo_breakdown(cargo: DataFrame) -> DataFrame:
    """DB-02: quantity and operations by the operations' own cargo type (General for none) and unit (Units for none)."""
    rows = cargo.groupBy(F.coalesce("cargo_type", F.lit("General")).alias("cargo_type"), F.coalesce("unit", F.lit("Units")).alias("unit"))
    return rows.agg(F.round(F.coalesce(F.sum("quantity"), F.lit(0.0)), 1).alias("quantity"), F.count("*").alias("n_operations"))


def breakdown_totals(breakdown: DataFrame) -> DataFrame:
    """DB-02: the total of each of ``UNITS`` from ``cargo_breakdown``; other units count by the operation's cargo type. 0 for none; never added up."""
    other = F.when(F.col("cargo_type") == "Container", "TEU").when(F.col("cargo_type").isin("Bulk", "Liquid Bulk", "Break Bulk"), "MT").otherwise("Units")
    got = breakdown.groupBy(F.when(F.col("unit").isin(*UNITS), F.col("unit")).otherwise(other).alias("unit")).agg(F.sum("quantity").alias("quantity"), F.sum("n_operations").alias("n_operations"))
    every = breakdown.sparkSession.createDataFrame([(u,) for u in UNITS], "unit string").join(got, "unit", "left")
    return every.select("unit", F.round(F.coalesce("quantity", F.lit(0.0)), 1).alias("quantity"), F.coalesce("n_operations", F.lit(0)).alias("n_operations"))


def unit_totals(calls: DataFrame, cargo: DataFrame) -> DataFrame:
    """DB-02: the total of each of ``UNITS``, each by itself; what has another unit counts by its cargo: containers as TEU, bulk kinds as MT, else Units."""
    joined = cargo.join(calls.select("call_id", "cargo_type"), "call_id")
    other = F.when(F.col("cargo_type") == "Container", "TEU").when(F.col("cargo_type").isin("Bulk", "Liquid Bulk", "Break Bulk"), "MT").otherwise("Units")
    unit = F.when(F.col("unit").isin(*UNITS), F.col("unit")).otherwise(other)
    got = joined.groupBy(unit.alias("unit")).agg(F.round(F.sum("quantity"), 2).alias("quantity"))
    return calls.sparkSession.createDataFrame([(u,) for u in UNITS], "unit string").join(got, "unit", "left")


def metric_cards(lead_times: DataFrame, metrics: list[str]) -> DataFrame:
    """DB-03: counts, mean, median, P90, range (2 decimals), early, late and on time of each metric."""
    rows = lead_times.filter(F.col("metric").isin(*metrics))
    rows = rows.select("metric", F.when(F.col("status") == "AVAILABLE", F.col("hours")).alias("h"))
    h = F.col("h")
    aggs = [(F.count("*") - F.count(h)).alias("n_missing"), F.avg(h).alias("mean"), F.min(h).alias("min"), F.max(h).alias("max"), F.count_if(h < 0).alias("n_early"), F.count_if(h > 0).alias("n_late"), F.count_if(h == 0).alias("n_on_time")]
    got = with_quantiles(rows, ["metric"], "h", {"median": (0.5, "linear"), "p90": (0.9, "linear")}, aggs)
    return got.select("metric", "n", "n_missing", *[F.round(c, 2).alias(c) for c in ("mean", "median", "p90", "min", "max")], "n_early", "n_late", "n_on_time")


def delay_summary(delays: DataFrame, top: int = 6) -> DataFrame:
    """DB-04: the ``top`` categories with hours, confirmed hours and share of all hours."""
    rows = delays.filter("hours > 0").groupBy("category").agg(F.count("*").alias("n"), F.sum("hours").alias("h"), F.sum(F.when(F.col("allocation") == "CONFIRMED", F.col("hours")).otherwise(0.0)).alias("c"))
    order = Window.orderBy(F.desc("h"), "category")  # a row for each category
    ranked = rows.withColumns({"rank": F.row_number().over(order), "_t": F.sum("h").over(Window.partitionBy())})
    return ranked.filter(F.col("rank") <= top).select("rank", "category", "n", F.round("h", 2).alias("hours"), F.round("c", 2).alias("confirmed_hours"), F.round(F.col("h") / F.col("_t") * 100, 1).alias("share_pct"))


def delay_totals(delays: DataFrame) -> DataFrame:
    """DB-04: all delays that aren't early: how many, hours, confirmed and inferred ones."""
    h = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("hours"))), F.lit(0.0)), 2)
    confirmed = F.col("allocation") == "CONFIRMED"
    return delays.filter("hours > 0").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("hours"), F.lit(0.0)), 2).alias("hours"), h(confirmed).alias("confirmed_hours"), h(~confirmed).alias("inferred_hours"))


def top_findings(bottlenecks: DataFrame, outliers: DataFrame, top: int = 5) -> DataFrame:
    """DB-04: the ``top`` bottlenecks by score and the ``top`` outliers, critical ones first, then the furthest beyond their threshold."""
    worst = F.when(F.col("severity") == "CRITICAL", 1).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 3).otherwise(4)
    first = bottlenecks.orderBy(F.desc("score"), "name").limit(top).select(F.lit("BOTTLENECK").alias("kind"), F.col("name"), F.lit(None).cast("bigint").alias("call_id"), F.col("score").alias("value"))
    second = outliers.orderBy(worst, F.desc(F.round(F.abs(F.col("value") - F.col("threshold")), 4)), "rule", "call_id").limit(top).select(F.lit("OUTLIER").alias("kind"), F.col("rule").alias("name"), "call_id", "value")
    return first.union(second)


def spotlight(found: DataFrame, codes: list[str]) -> DataFrame:
    """DB-05: chosen KPIs with their variance to target."""
    return found.filter(F.col("kpi").isin(*codes)).select("kpi", "name", "value", "target", F.round(F.col("value") - F.col("target"), 4).alias("variance"), "band", "status")


def call_listing(calls: DataFrame, lead_times: DataFrame, stages: DataFrame, parts: DataFrame, delays: DataFrame, metrics: list[str], points: DataFrame | None = None) -> DataFrame:
    """DB-07: each call with its durations, journey completeness, quality, delay hours and, from ``points``, its ATA, ATD and ETA."""
    wide = lead_times.filter("status = 'AVAILABLE'").groupBy("call_id").pivot("metric", metrics).agg(F.max("hours"))
    wide = wide.select("call_id", *[F.col(m).alias(m.lower().replace(" ", "_") + "_hours") for m in metrics])
    done = stages.filter("sequence < 100").groupBy("call_id").agg(F.round(F.avg((F.col("status") == "AVAILABLE").cast("double")) * 100, 1).alias("completeness_pct"))
    late = delays.filter("hours > 0").groupBy("call_id").agg(F.round(F.sum("hours"), 2).alias("delay_hours"))
    joined = calls.select("call_id", "vcn", "vessel_name", "vessel_type").join(wide, "call_id", "left").join(done, "call_id", "left").join(parts.select("call_id", "quality_status", "quality_score"), "call_id", "left").join(late, "call_id", "left")
    if points is not None:
        at = points.filter("event_name in ('ATA', 'ATD', 'ETA')").groupBy("call_id").pivot("event_name", ["ATA", "ATD", "ETA"]).agg(F.min("utc"))
        joined = joined.join(at.toDF("call_id", "ata", "atd", "eta"), "call_id", "left")
    return joined.withColumn("delay_hours", F.coalesce("delay_hours", F.lit(0.0)))


def duration_traces(lead_times: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """DB-07: for each call the trace of its durations: metric, hours, status, reason and source records of each of ``metrics``, in their order."""
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    rows = lead_times.filter(F.col("metric").isin(*metrics)).select("call_id", F.struct(place.alias("n"), "metric", "hours", "status", "reason", "source_ids").alias("_t"))
    return rows.groupBy("call_id").agg(F.transform(F.sort_array(F.collect_list("_t")), lambda t: t.dropFields("n")).alias("trace"))  # as many as metrics


def counters(listing: DataFrame, shifts: DataFrame, delays_by_movement: DataFrame) -> DataFrame:
    """DB-13: calls, quarantined ones, ones with a shift, and ones with an early arrival or sailing."""
    moved = shifts.filter("status = 'AVAILABLE'").select("call_id", F.lit(True).alias("_s")).distinct()
    early = delays_by_movement.filter("hours < 0").groupBy("call_id").agg(F.max(F.col("movement") == "Arrival").alias("_a"), F.max(F.col("movement") == "Sailing").alias("_z"))
    joined = listing.select("call_id", "quality_status").join(moved, "call_id", "left").join(early, "call_id", "left")
    return joined.agg(F.count("*").alias("n_calls"), F.count_if(F.col("quality_status") == "QUARANTINED").alias("n_quarantined"), F.count_if("_s").alias("n_shifted"), F.count_if("_a").alias("n_early_arrival"), F.count_if("_z").alias("n_early_sailing"))


SECTIONS = ("population", "throughput", "unit_totals", "metric_cards", "delay_totals", "delay_summary", "top_findings", "spotlight", "call_listing", "counters", "quality", "alerts", "journeys")


def write_snapshot(frames: Mapping[str, DataFrame], path: str, *, tenant: str, filters: str, version: int) -> None:
    """DB-06: each section under path/tenant/filters/version/section, and last a manifest row that makes the version count."""
    base = f"{path}/tenant={tenant}/filters={filters}/version={version}"
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{base}/{name}")
    spark = next(iter(frames.values())).sparkSession
    rows = spark.createDataFrame([(tenant, filters, version, sorted(frames))], "tenant string, filters string, version long, sections array<string>")
    rows.write.mode("append").parquet(f"{path}/manifest")


def active_snapshots(manifest: DataFrame) -> DataFrame:
    """DB-06: the newest version for each tenant and filters is the active one; the others are kept."""
    newest = manifest.groupBy("tenant", "filters").agg(F.max("version").alias("_v"))
    return manifest.join(newest, ["tenant", "filters"]).withColumn("is_active", F.col("version") == F.col("_v")).drop("_v")


def read_snapshot(spark: SparkSession, path: str, *, tenant: str, filters: str, sections: Sequence[str] = SECTIONS) -> dict[str, DataFrame | str]:
    """DB-06, DB-09: the sections of the active version; for one that it doesn't have, the reason. Other failures are errors."""
    active = active_snapshots(spark.read.parquet(f"{path}/manifest")).filter((F.col("tenant") == tenant) & (F.col("filters") == filters) & F.col("is_active")).first()  # one row
    if active is None:
        return dict.fromkeys(sections, "UNAVAILABLE: no snapshot")
    base = f"{path}/tenant={tenant}/filters={filters}/version={active.version}"
    return {name: spark.read.parquet(f"{base}/{name}") if name in active.sections else "UNAVAILABLE: not in the snapshot" for name in sections}


def read_through(
    spark: SparkSession, path: str, compute: Callable[[], Mapping[str, DataFrame]], *, tenant: str, filters: str = UNFILTERED, lineage: Mapping[str, str] | None = None, recompute: bool = False, worth: Callable[[Mapping[str, DataFrame]], bool] | None = None,
) -> tuple[dict[str, DataFrame], str, dict[str, str]]:
    """DB-06: a tenant's sections, how they were come by, and their lineage (batch and checksum by which they were computed).

    HIT: the active version, read. MISS: there was none (or ``recompute``), so they were computed and published as the next
    version, the active one from then on. SHARED: computed, but another reader published first, so its sections count. Only
    unfiltered sections are stored, and only if ``worth`` (default: always) says so; others are COMPUTED. A version counts
    when all its sections are written.
    """
    stamp = dict(lineage or {})
    place = f"{path}/tenant={tenant}"
    if filters != UNFILTERED:
        return dict(compute()), "COMPUTED", stamp
    base = store.current(spark, place)
    if base is not None and not recompute:
        return _sections(spark, base), "HIT", base.facts["lineage"]
    frames = dict(compute())
    if worth is not None and not worth(frames):
        return frames, "COMPUTED", stamp
    folder = store.new_folder(place)
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
    schemas = {name: frame.schema.json() for name, frame in frames.items()}
    try:
        made, state = store.publish(spark, place, base, {name: f"{folder}/{name}" for name in frames}, facts={"lineage": stamp, "schemas": schemas}), "MISS"
    except store.Conflict:
        made, state = store.current(spark, place), "SHARED"
    return _sections(spark, made), state, made.facts["lineage"]


def _sections(spark: SparkSession, version: store.Version) -> dict[str, DataFrame]:
    return {name: spark.read.schema(StructType.fromJson(json.loads(version.facts["schemas"][name]))).parquet(folder) for name, folder in version.parts.items()}


def section_states(spark: SparkSession, found: Mapping[str, DataFrame | str]) -> DataFrame:
    """DB-09: (section, status, reason)."""
    rows = [(name, "UNAVAILABLE" if isinstance(x, str) else "AVAILABLE", x if isinstance(x, str) else None) for name, x in found.items()]
    return spark.createDataFrame(rows, "section string, status string, reason string")
