"""Events of entities: occurrence numbers, the governing observation of a slot, instants, residual attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources in order of trust, and verification states.
SOURCES = ("AIS", "VTS", "Pilot System", "Berthing Log", "Tug System", "PMS", "TOS", "Arrival Notification", "Agent Portal", "Manual Log")
VERIFICATION = ("Verified", "Conflicting")


def occurrence_index(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """CAN-04: 1..n within (call_id, event_name) over rows with a time and a name."""
    slot = Window.partitionBy("call_id", "event_name").orderBy(*order)
    return events.filter("utc is not null and event_name is not null").withColumn("occurrence_index", F.row_number().over(slot))


def _rank(column: str, order: Sequence[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def canonical_observations(events: DataFrame, *, repeatable: Sequence[str] = (), sources: Sequence[str] = SOURCES, overrides: DataFrame | None = None) -> DataFrame:
    """JR-02, JR-03: the governing event of each (call_id, event_name), with all candidates and the reason.

    Order: verification, confidence (null counts as 0), source, earliest created, event id. An override
    (call_id, event_name, event_id) wins where its event is there. Repeatable events have no governing observation.
    """
    rows = events.filter(~F.col("event_name").isin(*repeatable)) if repeatable else events
    rows = rows.withColumns({"_v": _rank("verification_status", VERIFICATION), "_c": F.coalesce("confidence", F.lit(0.0)), "_s": _rank("source_system", sources)})
    if overrides is not None:
        rows = rows.join(overrides.select("call_id", "event_name", F.col("event_id").alias("_chosen")), ["call_id", "event_name"], "left").withColumn("_o", F.coalesce(F.col("_chosen") == F.col("event_id"), F.lit(False)))
    else:
        rows = rows.withColumn("_o", F.lit(False))
    slot = Window.partitionBy("call_id", "event_name")
    order = slot.orderBy(F.desc("_o"), "_v", F.desc("_c"), "_s", "created_at", "event_id")
    ranked = rows.withColumns({"_n": F.row_number().over(order), "n_candidates": F.count("*").over(slot), "candidates": F.sort_array(F.collect_list("event_id").over(slot)), "_v2": F.lead("_v").over(order), "_c2": F.lead("_c").over(order), "_s2": F.lead("_s").over(order)})
    reason = (
        F.when(F.col("_o"), "STEWARD_OVERRIDE")
        .when(F.col("n_candidates") == 1, "ONLY_OBSERVATION")
        .when(F.col("_v") < F.col("_v2"), "VERIFICATION")
        .when(F.col("_c") > F.col("_c2"), "CONFIDENCE")
        .when(F.col("_s") < F.col("_s2"), "SOURCE_PRIORITY")
        .otherwise("EARLIEST")
    )
    return ranked.filter("_n = 1").select("call_id", "event_name", "event_id", "utc", "n_candidates", "candidates", reason.alias("reason"))


def live(events: DataFrame) -> DataFrame:
    """Events that are neither superseded nor quarantined."""
    return events.filter("not is_superseded and not is_quarantined and utc is not null")


def instants(events: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """JR-04, TM-12: (call_id, event_name, utc, event_id, last_utc, last_id): the governing event if it is live, else the first live one.

    First and last are by (occurrence_index, utc, event_id).
    """
    order = F.struct("occurrence_index", "utc", "event_id")
    found = live(events).groupBy("call_id", "event_name").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    out = found.select("call_id", "event_name", F.col("a.utc").alias("utc"), F.col("a.event_id").alias("event_id"), F.col("z.utc").alias("last_utc"), F.col("z.event_id").alias("last_id"))
    if canonical is None:
        return out
    chosen = canonical.select("call_id", "event_name", F.col("event_id").alias("_id"), F.col("utc").alias("_utc")).join(live(events).select("call_id", "event_name", F.col("event_id").alias("_id")), ["call_id", "event_name", "_id"], "left_semi")
    joined = out.join(chosen, ["call_id", "event_name"], "left")
    return joined.select("call_id", "event_name", F.coalesce("_utc", "utc").alias("utc"), F.coalesce("_id", "event_id").alias("event_id"), "last_utc", "last_id")


def points(events: DataFrame, *, repeatable: Sequence[str] = (), sources: Sequence[str] = SOURCES) -> DataFrame:
    """JR-04, TM-12: what ``instants`` gives with the governing events of ``canonical_observations``, in one grouping without a sort."""
    rows = events.filter("utc is not null and event_name is not null")
    is_live = ~F.col("is_superseded") & ~F.col("is_quarantined")
    place = F.struct("occurrence_index", "utc", "event_id")
    trust = F.struct(_rank("verification_status", VERIFICATION).alias("v"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), _rank("source_system", sources).alias("s"), "created_at", "event_id", "utc", is_live.alias("live"))
    one = F.min(F.when(~F.col("event_name").isin(*repeatable), trust) if repeatable else trust)
    got = rows.groupBy("call_id", "event_name").agg(F.min(F.when(is_live, place)).alias("a"), F.max(F.when(is_live, place)).alias("z"), one.alias("k")).filter("a is not null")
    governs = F.coalesce(F.col("k.live"), F.lit(False))
    pick = lambda c: F.when(governs, F.col(f"k.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return got.select("call_id", "event_name", pick("utc"), pick("event_id"), F.col("z.utc").alias("last_utc"), F.col("z.event_id").alias("last_id"))


def event_map(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """KF-03: one row for each call with the instant of each named event."""
    return points.groupBy("call_id").pivot("event_name", list(names)).agg(F.min("utc"))


def movement_scope(movement: Column, name: Column) -> Column:
    """CAN-05: from the stated movement, else from the event's name."""
    m, n = F.upper(F.trim(F.coalesce(movement, F.lit("")))), F.upper(name)
    said = F.when(m == "INWARD", "ARRIVAL").when(m.isin("OUTWARD", "DEPARTURE", "SAILING"), "SAILING").when(m == "SHIFTING", "SHIFTING").otherwise("ARRIVAL")
    guess = F.when(n.contains("SAILING") | n.contains("DEPARTURE") | n.contains("OUT"), "SAILING").when(n.contains("SHIFT"), "SHIFTING").otherwise("ARRIVAL")
    return F.when(m != "", said).otherwise(guess)


def residual_attributes(values: Column, known: Sequence[str], source_name: Column) -> Column:
    """CAN-06: the map without known keys and blanks, and the event's source name."""
    rest = F.map_filter(values, lambda k, v: ~k.isin(*known) & v.isNotNull() & (F.trim(v) != ""))
    return F.map_concat(rest, F.create_map(F.lit("source_event_name"), source_name))


def apply_corrections(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """JR-13: a corrected event is superseded and a verified one with its new time is added, index + 1000. corrections: (event_id, utc)."""
    marked = events.join(corrections.select("event_id", F.lit(True).alias("_hit")).distinct(), "event_id", "left")
    old = marked.withColumn("is_superseded", F.col("is_superseded") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    new = events.drop("utc").join(corrections.select("event_id", "utc"), "event_id").withColumns(
        {"event_id": F.concat("event_id", F.lit("#corrected")), "occurrence_index": F.col("occurrence_index") + 1000, "verification_status": F.lit("Verified"), "confidence": F.lit(1.0), "is_superseded": F.lit(False), "is_quarantined": F.lit(False)}
    )
    return old.unionByName(new)


def timeline(events: DataFrame) -> DataFrame:
    """JR-14: position of each event in its call's timeline, events without a time last."""
    order = Window.partitionBy("call_id").orderBy(F.col("utc").asc_nulls_last(), "event_id")
    return events.withColumn("position", F.row_number().over(order))
