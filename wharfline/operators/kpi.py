"""KPIs: a few wide frames, unpivoted to one row for each registered KPI, with bands, aliases, trends and scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import hours_between
from .events import event_map

FORMULA_VERSION = "2.1"
NAMES = (
    "ATA", "ATD", "ANCHORAGE_ARRIVAL", "PILOT_REQUEST_ARRIVAL", "PILOT_SCHEDULED_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "FIRST_LINE_TIED_ARRIVAL", "ALL_FAST_ARRIVAL",
    "CARGO_START", "CARGO_END", "LAST_LINE_UNTIED_SAILING", "BREAKWATER_OUT", "PORT_LIMIT_OUT",
)


def band(value: Column, target: Column, direction: Column, green: Column, amber: Column) -> Column:
    """KF-06: GREEN, AMBER, RED; GRAY for no value. Any direction but LOWER counts as higher is better; amber defaults to 1.2 or 0.8 times the target."""
    lower = F.when(value <= F.coalesce(green, target), "GREEN").when(value <= F.coalesce(amber, target * 1.2), "AMBER").otherwise("RED")
    higher = F.when(value >= F.coalesce(green, target), "GREEN").when(value >= F.coalesce(amber, target * 0.8), "AMBER").otherwise("RED")
    return F.when(value.isNull(), "GRAY").when(F.coalesce(direction, F.lit("LOWER")) == "LOWER", lower).otherwise(higher)


def population(calls: DataFrame, points: DataFrame, *, vessel_type: str | None = None, terminal: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """KF-02: calls that aren't merged into others and pass the filters; those without an ATA pass the period."""
    rows = calls.filter("not coalesce(is_merged, false)") if "is_merged" in calls.columns else calls
    if vessel_type:
        rows = rows.filter(F.col("vessel_type") == vessel_type)
    if terminal:
        rows = rows.filter(F.col("terminal") == terminal)
    if start or end:
        ata = points.filter("event_name = 'ATA'").select("call_id", F.col("utc").alias("_ata"))
        rows = rows.join(ata, "call_id", "left")
        if start:
            rows = rows.filter(F.col("_ata").isNull() | (F.col("_ata") >= F.lit(start).cast("timestamp_ntz")))
        if end:
            rows = rows.filter(F.col("_ata").isNull() | (F.col("_ata") <= F.lit(end).cast("timestamp_ntz")))
        rows = rows.drop("_ata")
    return rows


def _forward(a: Column | str, z: Column | str) -> Column:
    """KF-05: hours if the end isn't before the start."""
    a, z = (F.col(x) if isinstance(x, str) else x for x in (a, z))
    return F.when(z >= a, hours_between(a, z))


def _mean(h: Column) -> tuple[Column, Column, Column]:
    return F.avg(h), F.sum(h), F.count(h).cast("double")


def _spread(h: Column) -> tuple[Column, Column, Column]:
    return F.when(F.count(h) >= 2, F.stddev_samp(h)), F.lit(None).cast("double"), F.count(h).cast("double")


def _ratio(a: Column, b: Column, scale: float = 1.0) -> tuple[Column, Column, Column]:
    return F.try_divide(a, F.nullif(b, F.lit(0.0))) * scale, a, b


def _count(c: Column) -> tuple[Column, Column, Column]:
    return c.cast("double"), c.cast("double"), F.lit(None).cast("double")


def pair_shifts(events: DataFrame, start: str, end: str) -> DataFrame:
    """KF-14: starts and ends of a call by occurrence index, with the end not before the start."""
    side = lambda name: F.min(F.when(F.col("event_name") == name, F.col("utc")))
    got = events.filter(F.col("event_name").isin(start, end)).groupBy("call_id", "occurrence_index").agg(side(start).alias("a"), side(end).alias("z"))
    return got.filter("z >= a").select("call_id", "occurrence_index", hours_between("a", "z").alias("hours"))


def _rows(frame: DataFrame, measures: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """One aggregate pass, then a row (kpi, value, numerator, denominator) for each measure."""
    aggs = [c.alias(f"{k}_{part}") for k, cs in measures.items() for part, c in zip(("v", "n", "d"), cs, strict=True)]
    wide = frame.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), *[F.col(f"{k}_{p}").alias(name) for p, name in (("v", "value"), ("n", "numerator"), ("d", "denominator"))]) for k in measures])).alias("x")).select("x.*")


def measures(calls: DataFrame, points: DataFrame, cargo: DataFrame, shifts: DataFrame, *, unit: str | None = None) -> DataFrame:
    """KF-03 to KF-05 and the formulas: (kpi, value, numerator, denominator) of each computed KPI, in three aggregate passes.

    points: governed instants; shifts: from pair_shifts; unit: for the KPIs that need one, which have no value without it.
    """
    own = calls.select("call_id", "vessel_type").dropDuplicates(["call_id"])
    per_call = cargo.groupBy("call_id").agg(
        F.sum(F.when(F.col("unit") == unit, F.col("quantity"))).alias("unit_qty") if unit else F.lit(None).cast("double").alias("unit_qty"),
        F.sum(F.when(F.col("unit") == "TEU", F.col("quantity"))).alias("teu"),
        F.avg("resources").alias("resources"),
    )
    wide = own.join(event_map(points, NAMES), "call_id", "left").join(per_call, "call_id", "left")
    berth = _forward("ALL_FAST_ARRIVAL", "LAST_LINE_UNTIED_SAILING")
    work = _forward("CARGO_START", "CARGO_END")
    idle = F.when(berth.isNotNull() & work.isNotNull(), F.greatest(berth - work, F.lit(0.0)))
    boarding = _forward("ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL")
    inward = _forward("PILOT_ON_BOARD_ARRIVAL", "ALL_FAST_ARRIVAL")
    container = F.col("vessel_type").ilike("%container%")
    left = F.coalesce("BREAKWATER_OUT", "ATD")
    days = F.date_diff(F.max(F.to_date("ATD")), F.min(F.to_date("ATD"))) + 1
    by_call = _rows(
        wide,
        {
            "KPI-01": _count(F.count("ATA")),
            "KPI-02": _mean(F.when(F.col("unit_qty") != 0, F.col("unit_qty"))),
            "KPI-03": _mean(boarding),
            "KPI-04": _mean(_forward("ANCHORAGE_ARRIVAL", "FIRST_LINE_TIED_ARRIVAL")),
            "KPI-05": _spread(boarding),
            "KPI-07": _mean(inward),
            "KPI-12": _mean(_forward("PILOT_SCHEDULED_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL")),
            "KPI-13": _mean(inward),
            "KPI-15": _mean(berth),
            "KPI-16": _spread(inward),
            "KPI-17": _mean(idle),
            "KPI-18": _ratio(F.sum(idle), F.sum(F.when(idle.isNotNull(), berth)), 100.0),
            "KPI-25": _ratio(F.sum(F.when(container, F.col("teu"))), F.count_if(container).cast("double")),
            "KPI-27": _ratio(F.sum(F.when(berth.isNotNull(), F.col("unit_qty"))), F.sum(F.when(F.col("unit_qty").isNotNull(), berth)) / 24.0),
            "KPI-28": _mean(F.when(container, F.col("resources"))),
            "KPI-41": _mean(_forward("ANCHORAGE_ARRIVAL", left)),
            "KPI-42": _mean(berth),
            "KPI-43": _mean(_forward("LAST_LINE_UNTIED_SAILING", F.coalesce("BREAKWATER_OUT", "PORT_LIMIT_OUT"))),
            "KPI-45": _ratio(F.count("ATD").cast("double"), days.cast("double")),
            "KPI-54": _mean(_forward("PILOT_REQUEST_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL")),
        },
    )
    teu = F.when(F.col("unit") == "TEU", F.col("quantity"))
    tokens = F.transform(F.split(F.lower("operation"), "[/,]"), F.trim)
    handled = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in ("load", "discharge", "unload", "transshipment", "transhipment")]))
    crane_hours = F.sum(F.when(F.col("unit") == "TEU", F.col("working_hours") * F.col("resources")))
    by_cargo = _rows(
        cargo.join(own.select("call_id"), "call_id", "left_semi"),
        {
            "KPI-21": _ratio(F.sum(teu), crane_hours),
            "KPI-23": _count(F.sum(F.when(F.col("unit") == "MT", F.col("quantity")))),
            "KPI-24": _count(F.sum(F.when(handled, teu))),
            "KPI-29": _ratio(F.sum("downtime_hours"), F.sum(F.col("working_hours") + F.col("downtime_hours")), 100.0),
            "KPI-30": _ratio(F.sum(teu), crane_hours),
        },
    )
    by_shift = _rows(shifts.join(own.select("call_id"), "call_id", "left_semi"), {"KPI-19": _count(F.count("*")), "KPI-20": _mean(F.col("hours"))})
    return by_call.union(by_cargo).union(by_shift)


def results(measured: DataFrame, registry: DataFrame) -> DataFrame:
    """KF-07 to KF-10: every registered KPI with value, status, reason, band and formula version.

    A KPI without source data has no value even as an alias; an alias has its primary's value under its own limits.
    """
    named = registry.withColumn("of", F.coalesce("alias_of", "kpi"))
    rows = named.join(measured.withColumnRenamed("kpi", "of"), "of", "left")
    value = F.when(F.col("computed"), F.round("value", 4))
    status = F.when(~F.col("computed"), "NO_SOURCE_DATA").when(value.isNull(), "UNAVAILABLE").when(F.col("alias_of").isNotNull(), "ALIAS").otherwise("COMPUTED")
    reason = F.when(~F.col("computed"), "NO_SOURCE_DATA").when(value.isNull(), "NO_ELIGIBLE_DATA")
    keep = lambda c: F.when(F.col("computed"), F.round(c, 4)).alias(c)
    return rows.select("kpi", "name", "category", "unit", value.alias("value"), keep("numerator"), keep("denominator"), "target", band(value, F.col("target"), F.col("direction"), F.col("green"), F.col("amber")).alias("band"), status.alias("status"), reason.alias("reason"), F.lit(FORMULA_VERSION).alias("formula_version"))


def status_counts(found: DataFrame, *, categories: Sequence[str] = (), bands: Sequence[str] = ()) -> DataFrame:
    """KF-10, KF-21: results by category and status, of some categories and bands only if they are given."""
    if categories:
        found = found.filter(F.col("category").isin(*categories))
    if bands:
        found = found.filter(F.col("band").isin(*bands))
    return found.groupBy("category", "status").agg(F.count("*").alias("n"))


def with_required_systems(found: DataFrame, systems: DataFrame) -> DataFrame:
    """KF-07: results, those without source data with the systems (kpi, required_systems) that would have it; empty for the others."""
    joined = found.join(F.broadcast(systems), "kpi", "left")  # the registry
    none = F.array().cast("array<string>")
    return joined.withColumn("required_systems", F.when(F.col("status") == "NO_SOURCE_DATA", F.coalesce("required_systems", none)).otherwise(none))


def catalogue(registry: DataFrame, found: DataFrame, *, category: str | None = None, availability: str | None = None, is_primary: bool | None = None) -> DataFrame:
    """KF-21: the registered KPIs by number, each with its availability (COMPUTED or NO_SOURCE_DATA), whether it is primary, and the status of its result; filtered by any of these."""
    rows = registry.select("kpi", "name", "category", "unit", "target", "direction", F.when(F.col("computed"), "COMPUTED").otherwise("NO_SOURCE_DATA").alias("availability"), F.col("alias_of").isNull().alias("is_primary"), "alias_of")
    for column, value in (("category", category), ("availability", availability), ("is_primary", is_primary)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.join(found.select("kpi", F.col("status").alias("result_status")), "kpi", "left").orderBy("kpi")


def availability_counts(listed: DataFrame) -> DataFrame:
    """KF-21: how many of the listed KPIs there are of each availability and result status."""
    return listed.groupBy("availability", "result_status").agg(F.count("*").alias("n"))


def scorecard_results(newest: DataFrame, registry: DataFrame, *, aliases: bool = False) -> DataFrame:
    """KF-15: the newest result of each KPI, by category and number, also where there is none; aliases only if wanted."""
    named = registry if aliases else registry.filter("alias_of is null")
    results_ = newest.filter("position = 1").select("kpi", "calculated_at", "value", "band", "status")
    return named.select("category", "kpi", "name", "unit", "target").join(results_, "kpi", "left").orderBy("category", "kpi")


def trend(history: DataFrame, n: int = 6) -> DataFrame:
    """KF-11, KF-12: the last n values of each KPI, oldest first, with delta, change, 3-point mean and direction at 0.01.

    history: (kpi, direction, calculated_at, value).
    """
    recent = history.filter("value is not null").withColumn("_n", F.row_number().over(Window.partitionBy("kpi").orderBy(F.desc("calculated_at")))).filter(F.col("_n") <= n)
    w = Window.partitionBy("kpi").orderBy("calculated_at")
    before = F.lag("value").over(w)
    delta = F.col("value") - before
    better = F.when(F.col("direction") == "LOWER", delta < 0).otherwise(delta > 0)
    way = F.when(delta.isNull() | (F.abs(delta) <= 0.01), "STABLE").when(better, "IMPROVING").otherwise("DETERIORATING")
    return recent.select("kpi", "calculated_at", F.round("value", 4).alias("value"), F.round(delta, 4).alias("delta"), F.round(F.try_divide(delta, F.nullif(F.abs(before), F.lit(0.0))) * 100, 2).alias("change_pct"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("mean3"), way.alias("trend"))


def latest(history: DataFrame, n: int = 1) -> DataFrame:
    """KF-15, KF-20: the newest n results of each KPI; aliases, which repeat their primary, are left out."""
    rows = history.filter("alias_of is null") if "alias_of" in history.columns else history
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("kpi").orderBy(F.desc("calculated_at")))).filter(F.col("position") <= n)


def scorecard(newest: DataFrame, registry: DataFrame) -> DataFrame:
    """KF-15: the newest results by category: how many KPIs have one, and how many there are, aliases left out."""
    named = registry.filter("alias_of is null").select("kpi", "category").join(newest.filter("position = 1").select("kpi", "value"), "kpi", "left")
    return named.groupBy("category").agg(F.count("value").alias("n_with_result"), F.count("*").alias("n_kpis"))


def statistics_listing(stored: DataFrame, *, metric: str | None = None, cohort: str = "all") -> DataFrame:
    """KF-18: of stored statistics (metric, cohort, calculated_at, ...) the newest of each metric and cohort."""
    rows = stored.filter(F.col("cohort") == cohort)
    if metric is not None:
        rows = rows.filter(F.col("metric") == metric)
    newest = rows.groupBy("metric", "cohort").agg(F.max("calculated_at").alias("calculated_at"))
    return rows.join(newest, ["metric", "cohort", "calculated_at"])


def trailing_windows(points: DataFrame, names: tuple[str, str], days: int = 30, n: int = 6) -> DataFrame:
    """KF-13: the mean hours between two events in each of the last n windows of ``days``, by the call's ATA."""
    wide = event_map(points, ("ATA", *names))
    dated = wide.crossJoin(F.broadcast(wide.agg(F.max("ATA").alias("last"))))  # one row
    back = F.floor(F.timestamp_diff("SECOND", F.col("ATA"), F.col("last")) / (86400 * days))
    return dated.withColumn("window", back).filter(F.col("window") < n).groupBy("window").agg(F.round(F.avg(_forward(*names)), 4).alias("value"), F.count("*").alias("n_calls"))


def service_performance(timings: DataFrame) -> DataFrame:
    """KF-16: by service type and leg, the mean delay, how many have none, records, calls, and the first and last record."""
    return timings.groupBy("service_type", "leg").agg(
        F.round(F.avg("delay_hours"), 4).alias("mean_delay_hours"), F.count_if(F.col("delay_hours").isNull()).alias("n_missing"), F.count("*").alias("n_records"), F.countDistinct("call_id").alias("n_calls"), F.min("service_id").alias("first_record"), F.max("service_id").alias("last_record")
    )


def service_records(timings: DataFrame) -> DataFrame:
    """KF-16: the records of each figure of ``service_performance``, a row each: a figure can have any number of them."""
    return timings.select("service_type", "leg", F.col("service_id").alias("record_id"), "call_id", F.col("delay_hours").isNull().alias("is_missing"))


def service_drill(timings: DataFrame, service_type: str, leg: str, status: str | None = None) -> DataFrame:
    """KF-16, KF-17: the records behind a figure of ``service_performance``."""
    rows = timings.filter((F.col("service_type") == service_type) & (F.col("leg") == leg))
    return rows if status is None else rows.filter(F.col("status") == status)


def with_benchmarks(found: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """KF-19: peer values (kpi, peer, peer_value) beside the results; ABSENT where there is none."""
    joined = found.join(benchmarks, "kpi", "left")
    return joined.withColumns({"peer_gap": F.round(F.col("value") - F.col("peer_value"), 4), "peer_status": F.when(F.col("peer_value").isNull(), "ABSENT").otherwise("PRESENT")})
