"""Service timings and delays: legs, frequency, overview, reconciliation, categories, Pareto, allocation, inferred causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_blank
from ..functions.time import hours_between, missing_inputs
from ..plans.registry import DELAY_CATEGORIES

LEGS = ("Arrival", "Sailing", "Shifting")


def leg(movement: Column) -> Column:
    """DL-01."""
    m = F.upper(F.trim(F.coalesce(movement, F.lit(""))))
    return F.when(m.isin("ARRIVAL", "INWARD"), "Arrival").when(m.isin("SAILING", "OUTWARD", "DEPARTURE"), "Sailing").when(m == "SHIFTING", "Shifting").otherwise("UNCLASSIFIED")


def service_kind(service_type: Column) -> Column:
    """DL-04: by keyword, in this order."""
    t = F.upper(F.coalesce(service_type, F.lit("")))
    return F.when(t.contains("PILOT"), "PILOT").when(t.contains("BERTH") | t.contains("MOOR"), "BERTH").when(t.contains("TUG") | t.contains("TOW"), "TUG").otherwise("OTHER")


def service_timings(services: DataFrame) -> DataFrame:
    """DL-02: planning, gap, signed delay and request-to-served hours of each service, its status and what is missing."""
    delay = hours_between("scheduled", "served")
    status = F.when(delay.isNull(), "UNAVAILABLE").when(delay < 0, "EARLY").when(delay == 0, "ON_TIME").otherwise("LATE")
    quality = F.when(F.col("scheduled") < F.col("requested"), "DQ_SCHEDULE_BEFORE_REQUEST").when(F.size(missing_inputs(submission="submission", requested="requested", scheduled="scheduled", served="served")) > 0, "INCOMPLETE").otherwise("OK")
    return services.select(
        "call_id", "service_id", leg(F.col("movement")).alias("leg"), service_kind(F.col("service_type")).alias("kind"), "service_type",
        hours_between("submission", "requested").alias("planning_hours"), hours_between("requested", "scheduled").alias("gap_hours"), delay.alias("delay_hours"), hours_between("requested", "served").alias("wait_hours"),
        status.alias("status"), quality.alias("dq_status"), missing_inputs(submission="submission", requested="requested", scheduled="scheduled", served="served").alias("missing"),
    )


def delay_frequency(timings: DataFrame) -> DataFrame:
    """DL-03: share of late services of each leg, three rows always; GREEN under 40, ORANGE to 60, RED above."""
    spark = timings.sparkSession
    got = timings.groupBy("leg").agg(F.count_if(F.col("status") == "LATE").alias("n_late"), F.count_if(F.col("status") != "UNAVAILABLE").alias("n_eligible"))
    legs = spark.createDataFrame([(x,) for x in LEGS], "leg string")
    rows = legs.join(got, "leg", "left").na.fill(0, ["n_late", "n_eligible"])
    share = F.try_divide(F.col("n_late") * 100.0, F.nullif(F.col("n_eligible"), F.lit(0)))
    band = F.when(share < 40, "GREEN").when(share <= 60, "ORANGE").when(share > 60, "RED")
    return rows.select("leg", "n_late", "n_eligible", F.round(share, 1).alias("late_pct"), band.alias("band"))


def delay_overview(timings: DataFrame) -> DataFrame:
    """DL-05: delays of each kind of service, late, on time and early; for tugs the wait from request to service as well."""
    of = lambda s: F.count_if(F.col("status") == s)
    got = timings.groupBy("kind").agg(F.round(F.avg("delay_hours"), 4).alias("mean_delay_hours"), of("LATE").alias("n_late"), of("ON_TIME").alias("n_on_time"), of("EARLY").alias("n_early"), F.round(F.avg("wait_hours"), 4).alias("_w"))
    return got.select("kind", "mean_delay_hours", "n_late", "n_on_time", "n_early", F.when(F.col("kind") == "TUG", F.col("_w")).alias("mean_wait_hours"))


def anchorage_wait(lead_times: DataFrame, metric: str = "Anchorage Wait") -> DataFrame:
    """DL-06: the mean anchorage wait and its number for all legs and for Arrival; other legs have none, with the reason."""
    got = lead_times.filter((F.col("metric") == metric) & (F.col("status") == "AVAILABLE") & F.col("hours").isNotNull()).agg(F.round(F.avg("hours"), 6).alias("m"), F.count("*").alias("c"))
    legs = lead_times.sparkSession.createDataFrame([("All", True), *((x, x == "Arrival") for x in LEGS)], "leg string, applies boolean")
    rows = legs.crossJoin(F.broadcast(got))  # one row
    has = F.col("applies") & (F.col("c") > 0)
    reason = F.when(~F.col("applies"), "OTHER_LEG").when(F.col("c") == 0, "NO_OBSERVATIONS")
    return rows.select("leg", F.when(has, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), F.when(has, F.col("m")).alias("average_hours"), F.when(F.col("applies"), F.col("c")).otherwise(0).alias("n"), reason.alias("reason"))


def late_vessels(timings: DataFrame) -> DataFrame:
    """DB-11: calls with a late service, by kind."""
    return timings.filter("status = 'LATE'").groupBy("kind").agg(F.countDistinct("call_id").alias("n_calls"))


def duration_ranges(points: DataFrame, calls: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """DL-07, DL-08: for each (label, start, end), the shortest and longest hours that aren't negative, and the vessels; null without any."""
    names = sorted({e for _, a, z in pairs for e in (a, z)})
    wide = points.filter(F.col("event_name").isin(*names)).groupBy("call_id").pivot("event_name", names).agg(F.min("utc"))
    long = wide.select("call_id", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), hours_between(a, z).alias("hours")) for label, a, z in pairs])).alias("x")).select("call_id", "x.*")
    named = long.filter("hours >= 0").join(calls.select("call_id", "vessel_name"), "call_id")
    got = named.groupBy("label").agg(F.min(F.struct("hours", "call_id", "vessel_name")).alias("a"), F.max(F.struct("hours", F.negative("call_id").alias("i"), "vessel_name")).alias("z"), F.count("*").alias("n"))
    labels = points.sparkSession.createDataFrame([(x,) for x, _, _ in pairs], "label string")
    return labels.join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.col("a.hours").alias("min_hours"), F.col("a.vessel_name").alias("min_vessel"), F.col("z.hours").alias("max_hours"), F.col("z.vessel_name").alias("max_vessel"))


def delay_category(source: Column, reason: Column) -> Column:
    """CAN-13: the first keyword rule that fits, else the source's own category, else Other."""
    s, r = F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    # Category by keywords in the reason and in the source category, in this order.
    rules = [
        ("Weather", ("weather", "swells", "wind", "fog", "storm"), ("weather",)),
        ("Tug", ("tug",), ()),
        ("Pilot", ("pilot",), ()),
        ("Berth Non-Availability", ("berth",), ()),
        ("Terminal Readiness", ("cargo", "terminal awaiting"), ()),
        ("Crane Downtime", ("crane",), ()),
        ("Equipment Breakdown", ("equipment", "breakdown"), ()),
        ("Mooring", ("mooring", "lines"), ()),
        ("Documentation", ("documentation", "customs", "paperwork"), ()),
        ("Vessel-Side", ("ship not ready",), ("vessel",)),
        ("Regulatory Clearance", ("clearance", "regulatory", "quarantine", "immigration"), ()),
        ("Port-Side", ("shift",), ("marine service",)),
    ]
    out = None
    for name, in_reason, in_source in rules:
        fits = F.lit(False)
        for k in in_reason:
            fits |= r.contains(k)
        for k in in_source:
            fits |= s.contains(k)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    for name in DELAY_CATEGORIES:
        out = out.when(s == name.lower(), name)
    return out.otherwise("Other")


def reconcile_delays(delays: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """CAN-08, CAN-09: recalculated hours, mismatch with the stated ones, the duration taken, flags, category, default allocation; ``attributes`` as they came, if there are any."""
    again = hours_between("scheduled", "served", 4)
    hours = F.coalesce("stated_hours", again, F.lit(0.0))
    mismatch = F.coalesce(F.round(F.abs(again - F.col("stated_hours")), 6) > tolerance, F.lit(False))
    confirmed = F.lower(F.coalesce("cause_status", F.lit(""))) == "confirmed"
    level = F.lower(F.coalesce("confidence_text", F.lit("")))
    return delays.select(
        "call_id", "delay_id", leg(F.col("movement")).alias("leg"), "reason", "source_category", "cause_status", "stated_hours", again.alias("recalculated_hours"), hours.alias("hours"), mismatch.alias("is_mismatch"),
        (hours < 0).alias("is_early"), ((hours > 0) & (is_blank("reason") | is_blank("source_category"))).alias("needs_review"), delay_category(F.col("source_category"), F.col("reason")).alias("category"),
        F.when(confirmed, "CONFIRMED").otherwise("INFERRED").alias("allocation"), F.when(level == "high", 1.0).when(level == "medium", 0.7).otherwise(0.5).alias("allocation_confidence"),
        *[c for c in ("attributes",) if c in delays.columns],
    )


def pareto(delays: DataFrame, key: str = "category", value: str = "hours") -> DataFrame:
    """DL-11: count and hours by key, most hours first, with the cumulative percentage to 1 decimal."""
    got = delays.filter(F.col(value) > 0).groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("_h"))
    order = Window.orderBy(F.desc("_h"), key)  # one row for each category
    running = F.sum("_h").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumns({"rank": F.row_number().over(order), "_r": running, "_t": F.sum("_h").over(Window.partitionBy())}).select("rank", key, "n", F.round("_h", 2).alias(value), F.round(F.col("_r") / F.col("_t") * 100, 1).alias("cumulative_pct"))


def stage_breakdown(delays: DataFrame, allocations: DataFrame | None = None) -> DataFrame:
    """DL-12: by leg, counts and hours, confirmed and inferred, mismatches, reviews; with ``allocations`` (delay_id, hours) also the hours that are and aren't allocated."""
    if allocations is not None:
        given = allocations.groupBy("delay_id").agg(F.sum("hours").alias("_given"))
        shared = delays.join(given, "delay_id", "left").groupBy("leg").agg(F.round(F.coalesce(F.sum("_given"), F.lit(0.0)), 2).alias("allocated_hours"), F.round(F.sum(F.greatest(F.col("hours") - F.coalesce("_given", F.lit(0.0)), F.lit(0.0))), 2).alias("unallocated_hours"))
        return stage_breakdown(delays).join(shared, "leg")
    h = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("hours"))), F.lit(0.0)), 2)
    confirmed = F.col("allocation") == "CONFIRMED"
    return delays.groupBy("leg").agg(F.count("*").alias("n"), F.round(F.sum("hours"), 2).alias("hours"), h(confirmed).alias("confirmed_hours"), h(~confirmed).alias("inferred_hours"), F.count_if("is_mismatch").alias("n_mismatch"), F.count_if("needs_review").alias("n_review"))


def delay_list(
    delays: DataFrame, allocations: DataFrame | None = None, *, legs: Sequence[str] = (), categories: Sequence[str] = (), search: str = "", mismatch: bool | None = None, review: bool | None = None,
    sort: str | None = None, descending: bool = False, skip: int = 0, limit: int | None = None,
) -> DataFrame:
    """DL-09, DL-10: filtered delays, a page of them if ``sort`` is given, with their allocations in order (category and hours), and the hours that are and aren't allocated."""
    rows = delays
    if legs:
        rows = rows.filter(F.col("leg").isin(*legs))
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    if mismatch is not None:
        rows = rows.filter(F.col("is_mismatch") == mismatch)
    if review is not None:
        rows = rows.filter(F.col("needs_review") == review)
    if search:
        fits = F.lit(False)
        for c in ("delay_id", "leg", "reason", "source_category", "category", "cause_status"):
            fits |= F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False))
        rows = rows.filter(fits)
    if sort is not None:
        rows = rows.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), "delay_id").offset(skip)
        rows = rows if limit is None else rows.limit(limit)
    none = F.array().cast("array<struct<category:string,hours:double>>")
    if allocations is None:
        return rows.withColumns({"allocations": none, "allocated_hours": F.lit(0.0), "unallocated_hours": F.col("hours")})
    sums = allocations.groupBy("delay_id").agg(F.round(F.sum("hours"), 4).alias("_h"), F.sort_array(F.collect_list(F.struct((~F.col("is_primary")).alias("second"), "category", "hours"))).alias("_a"))
    joined = rows.join(sums, "delay_id", "left")
    return joined.withColumns({"allocations": F.coalesce(F.transform("_a", lambda x: F.struct(x.category.alias("category"), x.hours.alias("hours"))), none), "allocated_hours": F.coalesce("_h", F.lit(0.0)), "unallocated_hours": F.round(F.col("hours") - F.coalesce("_h", F.lit(0.0)), 4)}).drop("_h", "_a")


def apply_allocations(delays: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DL-13: (accepted allocations, delays whose decision is refused). decisions: (delay_id, category, hours, is_primary, ordinal).

    A set replaces the old one if its hours don't exceed the delay's by more than 0.01; its primary is the first flagged, else the first.
    """
    w = Window.partitionBy("delay_id")
    rows = decisions.join(delays.select("delay_id", F.col("hours").alias("total")), "delay_id")
    ranked = rows.withColumns({"_sum": F.sum("hours").over(w), "_n": F.row_number().over(w.orderBy(F.desc("is_primary"), "ordinal"))})
    accepted = ranked.filter("_sum <= total + 0.01").withColumn("is_primary", F.col("_n") == 1).drop("_sum", "_n", "total")
    return accepted, ranked.filter("_sum > total + 0.01").select("delay_id").distinct()


def apply_reviews(delays: DataFrame, reviews: DataFrame) -> DataFrame:
    """DL-14: category and reason of reviewed delays (delay_id, category, reason) replaced, their review closed."""
    got = delays.join(reviews.select("delay_id", F.col("category").alias("_c"), F.col("reason").alias("_r")), "delay_id", "left")
    return got.withColumns({"category": F.coalesce("_c", "category"), "reason": F.coalesce("_r", "reason"), "needs_review": F.col("needs_review") & F.col("_c").isNull()}).drop("_c", "_r")


def review_allocations(delays: DataFrame, allocations: DataFrame, reviews: DataFrame) -> DataFrame:
    """DL-14: allocations after reviews (delay_id, category): the primary one takes the reviewed category, confirmed; a delay without any gets one of all its hours."""
    known = reviews.select("delay_id", F.col("category").alias("_c"))
    changed = allocations.join(known, "delay_id", "left").withColumn("category", F.when(F.col("is_primary") & F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col("category")))
    changed = changed.withColumn("allocation", F.when(F.col("is_primary") & F.col("_c").isNotNull(), "CONFIRMED").otherwise("INFERRED")).select("delay_id", "category", "hours", "is_primary", "allocation")
    fresh = delays.select("delay_id", "hours").join(known, "delay_id").join(allocations.filter("is_primary").select("delay_id"), "delay_id", "left_anti")
    return changed.unionByName(fresh.select("delay_id", F.col("_c").alias("category"), "hours", F.lit(True).alias("is_primary"), F.lit("CONFIRMED").alias("allocation")))


def infer_causes(delays: DataFrame, services: DataFrame) -> DataFrame:
    """DL-15: a likely cause of each delay that isn't confirmed, from the call's late services of its movement.

    The last late service (over 0.05 h, by service id) of each kind counts; tug before pilot before berth, over 0.1 h; else the stage.
    """
    rows = services.select("call_id", "service_id", F.lower("movement").alias("m"), F.lower("service_type").alias("t"), hours_between("scheduled", "served").alias("h")).filter("h > 0.05")
    kind = F.when(F.col("t").contains("pilot"), "pilot").when(F.col("t").contains("tug"), "tug").when(F.col("t").contains("berth"), "berth")
    last = rows.withColumn("kind", kind).filter("kind is not null").groupBy("call_id", "m").pivot("kind", ["tug", "pilot", "berth"]).agg(F.max_by("h", "service_id"))
    open_ = delays.filter(F.lower(F.coalesce("cause_status", F.lit(""))) != "confirmed").withColumn("m", F.lower("leg"))
    got = open_.join(last, ["call_id", "m"], "left")
    stage = F.col("m")
    category = F.when(F.col("tug") > 0.1, "Tug").when(F.col("pilot") > 0.1, "Pilot").when((F.col("berth") > 0.1) | (stage == "arrival"), "Berth Non-Availability").when(stage == "sailing", "Terminal Readiness").otherwise("Port-Side")
    confidence = F.when(F.col("tug") > 0.1, 0.75).when(F.col("pilot") > 0.1, 0.78).when(F.col("berth") > 0.1, 0.70).when(stage == "arrival", 0.60).when(stage == "sailing", 0.58).otherwise(0.50)
    return got.select("delay_id", "call_id", "leg", category.alias("inferred_category"), confidence.alias("confidence"), F.lit("INFERRED").alias("cause_status"), F.lit("PENDING_REVIEW").alias("review_status"))
