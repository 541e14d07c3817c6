"""Journeys: stages of each call, repeated shifts, time by category, handovers, deviations, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import hours_between

CATEGORIES = ("ACTIVE_SERVICE", "PASSIVE_WAIT", "HOLD", "DELAY", "UNCLASSIFIED")


def _graded(rows: DataFrame) -> DataFrame:
    hours = hours_between("start_utc", "end_utc")
    status = F.when(F.col("start_utc").isNull() | F.col("end_utc").isNull(), "MISSING").when(F.col("end_utc") < F.col("start_utc"), "DEVIATED").otherwise("AVAILABLE")
    reason = (
        F.when(F.col("start_utc").isNull() & F.col("end_utc").isNull(), "MISSING_BOTH")
        .when(F.col("start_utc").isNull(), "MISSING_START")
        .when(F.col("end_utc").isNull(), "MISSING_END")
        .when(F.col("end_utc") < F.col("start_utc"), "SEQUENCE_VIOLATION")
    )
    return rows.withColumns({"hours": hours, "status": status, "reason": reason})


def stage_occurrences(calls: DataFrame, points: DataFrame, stages: DataFrame) -> DataFrame:
    """JR-05: a row for every call and stage that isn't repeatable: AVAILABLE, MISSING with the side, or DEVIATED with negative hours."""
    at = points.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("event_name", "utc"))).alias("at"))
    rows = calls.select("call_id").distinct().join(at, "call_id", "left").crossJoin(F.broadcast(stages.filter("not repeatable")))  # the registry has a few rows
    placed = rows.withColumns({"start_utc": F.try_element_at("at", F.col("start_event")), "end_utc": F.try_element_at("at", F.col("end_event"))}).drop("at")
    return _graded(placed).withColumn("occurrence", F.lit(1))


def shift_occurrences(events: DataFrame, start: str, end: str) -> DataFrame:
    """JR-06: the n-th start of a call with its n-th end, in order of time; what has no partner is MISSING."""
    rows = events.filter(F.col("event_name").isin(start, end))
    ranked = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("call_id", "event_name").orderBy("utc", "event_id")))
    side = lambda name: F.min(F.when(F.col("event_name") == name, F.col("utc")))
    return _graded(ranked.groupBy("call_id", "occurrence").agg(side(start).alias("start_utc"), side(end).alias("end_utc")))


def decompose(stages: DataFrame, shifts: DataFrame) -> DataFrame:
    """JR-07, JR-08: hours of each call by category, with shifts carved out.

    A shift inside a main stage moves as much of itself as the stage's category still has to DELAY, the first such stage by
    sequence and shifts in order; a shift inside none is added to DELAY. Only available stages and shifts count.
    """
    main = stages.filter("status = 'AVAILABLE' and sequence < 100").select("call_id", "sequence", "category", "start_utc", "end_utc", "hours")
    moved = shifts.filter("status = 'AVAILABLE'").select("call_id", F.col("occurrence").alias("n"), F.col("start_utc").alias("s"), F.col("end_utc").alias("e"), F.col("hours").alias("shift_hours"))
    inside = moved.join(main, "call_id", "left").withColumn("hit", (F.col("s") >= F.col("start_utc")) & (F.col("e") <= F.col("end_utc")))
    home = inside.groupBy("call_id", "n", "shift_hours").agg(F.min(F.when(F.col("hit"), F.struct("sequence", "category"))).alias("h"))
    shifts_of = home.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("h.category", F.lit("")).alias("category"), "shift_hours"))).alias("shifts"))
    sums = main.groupBy("call_id").pivot("category", list(CATEGORIES)).agg(F.sum("hours"))
    joined = sums.join(shifts_of, "call_id", "full_outer").na.fill(0.0, list(CATEGORIES))
    whole = F.coalesce("shifts", F.array().cast("array<struct<n:int,category:string,shift_hours:double>>"))
    of = lambda c: F.filter(whole, lambda x: x.category == c)
    left = {c: F.aggregate(of(c), F.col(c), lambda rest, x: rest - F.least(x.shift_hours, rest)) for c in CATEGORIES if c != "DELAY"}
    carved = sum((F.col(c) - left[c] for c in left), F.lit(0.0))
    outside = F.aggregate(of(""), F.lit(0.0), lambda total, x: total + x.shift_hours)
    out = joined.select("call_id", *[F.round(left[c], 6).alias(c) for c in left], F.round(F.col("DELAY") + carved + outside, 6).alias("DELAY"))
    return out.select("call_id", *CATEGORIES, F.round(sum((F.col(c) for c in CATEGORIES), F.lit(0.0)), 6).alias("total"))


def category_share(hours: Column, total: Column) -> Column:
    """JR-18: percentage to 1 decimal as text, a dash without a total."""
    return F.when(total > 0, F.format_string("%.1f%%", F.round(hours / total * 100, 1))).otherwise("—")


def handovers(stages: DataFrame) -> DataFrame:
    """JR-11: consecutive main stages of a call and the wait from one's end to the next one's start, when both are available."""
    order = Window.partitionBy("call_id").orderBy("sequence")
    rows = stages.filter("sequence < 100").withColumns({"next_stage": F.lead("stage").over(order), "next_start": F.lead("start_utc").over(order), "next_status": F.lead("status").over(order)})
    wait = F.when((F.col("status") == "AVAILABLE") & (F.col("next_status") == "AVAILABLE"), hours_between("end_utc", "next_start"))
    return rows.filter("next_stage is not null").select("call_id", "stage", "next_stage", "actor_from", "actor_to", wait.alias("wait_hours"))


def journeys(stages: DataFrame) -> DataFrame:
    """JR-09, JR-10: counts by status, the deviations, and RECONSTRUCTED if any stage is there."""
    got = stages.groupBy("call_id").agg(
        F.count_if(F.col("status") != "MISSING").alias("n_covered"),
        F.count_if(F.col("status") == "MISSING").alias("n_missing"),
        F.count_if(F.col("status") == "DEVIATED").alias("n_deviated"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "DEVIATED", F.struct("sequence", "stage", "hours")))).alias("deviations"),
    )
    return got.withColumn("status", F.when(F.col("n_covered") > 0, "RECONSTRUCTED").otherwise("FAILED"))


def coverage(calls: DataFrame, journeys: DataFrame) -> DataFrame:
    """JR-15, JR-17: how many of the calls have a reconstructed journey."""
    joined = calls.select("call_id").join(journeys.select("call_id", "status"), "call_id", "left")
    return joined.agg(F.count_if(F.col("status") == "RECONSTRUCTED").alias("n_reconstructed"), F.count("*").alias("n_calls"))


def narrative(stages: DataFrame) -> DataFrame:
    """JR-16: a sentence for each stage in order, and the stages it rests on."""
    line = F.when(F.col("status") == "AVAILABLE", F.format_string("%s took %.2f hours.", "stage", "hours")).when(F.col("status") == "DEVIATED", F.format_string("%s is out of sequence by %.2f hours.", F.col("stage"), F.abs("hours")))
    said = stages.withColumn("line", line).filter("line is not null")
    got = said.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "line", "stage"))).alias("x"))
    return got.select("call_id", F.array_join("x.line", " ").alias("summary"), F.array_distinct("x.stage").alias("grounding"))


def next_version(current: DataFrame, history: DataFrame) -> DataFrame:
    """JR-12: history rows to append: each call's journey as JSON, numbered after its last version."""
    last = history.groupBy("call_id").agg(F.max("version").alias("v"))
    columns = [c for c in current.columns if c != "call_id"]
    return current.join(last, "call_id", "left").select("call_id", (F.coalesce("v", F.lit(0)) + 1).alias("version"), F.to_json(F.struct(*columns)).alias("snapshot"))


def visits(events: DataFrame, entity: str, at: str, order: str, *, minutes: int) -> DataFrame:
    """(entity, session, n_events, start_utc, end_utc, hours): runs of an entity's events with no gap over ``minutes``."""
    line = Window.partitionBy(entity).orderBy(at, order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(at).over(line), F.col(at)) > minutes * 60_000_000
    marked = events.filter(F.col(at).isNotNull()).withColumn("_new", F.coalesce(gap, F.lit(True)).cast("long")).withColumn("session", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    got = marked.groupBy(entity, "session").agg(F.count("*").alias("n_events"), F.min(at).alias("start_utc"), F.max(at).alias("end_utc"))
    return got.withColumn("hours", hours_between("start_utc", "end_utc"))
