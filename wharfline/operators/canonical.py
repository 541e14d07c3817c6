"""Canonical tables from staged rows (file, sheet, row_number, target, values map, validation_status)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import parse_local
from .events import movement_scope, residual_attributes


EVENT_COLUMNS = ("VCN", "Event_ID", "Event_Name", "Event_Timestamp", "Timezone", "Source_System", "Verification_Status", "Confidence_Score", "Movement_Type")


def reference() -> Column:
    return F.concat_ws(":", "file", "sheet", F.col("row_number").cast("string"))


def text(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("values", F.lit(name))), F.lit(""))


def number(name: str) -> Column:
    return text(name).try_cast("double")


def usable(staging: DataFrame, target: str) -> DataFrame:
    return staging.filter((F.col("target") == target) & (F.col("validation_status") == "VALID"))


def vessel_calls(staging: DataFrame, numeric: Sequence[str], strings: Sequence[str], target: str = "VesselCalls") -> DataFrame:
    """CAN-01: a call for each VCN, from its first valid row: blanks null, numbers cast where they can be, name UNKNOWN by default."""
    rows = usable(staging, target).filter(text("VCN").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(text("VCN")).orderBy("file", "sheet", "row_number"))).filter("_n = 1")
    return rows.select(F.sha2(text("VCN").cast("binary"), 256).alias("call_id"), text("VCN").alias("vcn"), F.coalesce(text("Vessel_Name"), F.lit("UNKNOWN")).alias("vessel_name"), reference().alias("record_reference"), *[number(c).alias(c.lower()) for c in numeric], *[text(c).alias(c.lower()) for c in strings])


def newest_rows(staging: DataFrame, batches: DataFrame, target: str = "VesselCalls", key: str = "VCN") -> DataFrame:
    """TM-14, DQ-003, DQ-004: of each key the row (vcn, values, record_reference, batch_id) of its newest batch, and in that the last row.

    staging has a ``batch_id``; batches: (batch_id, created_at, status), of which only PROCESSING and COMMITTED ones count.
    Invalid and duplicate rows count too: it is what the source says last.
    """
    rows = staging.filter(F.col("target") == target).withColumn("vcn", text(key)).filter("vcn is not null")
    dated = rows.join(batches.filter("status in ('PROCESSING', 'COMMITTED')").select("batch_id", "created_at"), "batch_id")
    order = F.struct("created_at", "batch_id", "row_number", "file", "sheet")
    newest = dated.groupBy("vcn").agg(F.max_by(F.struct("values", "file", "sheet", "row_number", "batch_id"), order).alias("_r")).select("vcn", "_r.*")
    return newest.select("vcn", "values", reference().alias("record_reference"), "batch_id")


def source_times(newest: DataFrame, calls: DataFrame, columns: Sequence[str] = ("ETA", "ATA"), zone: str = "Africa/Johannesburg") -> DataFrame:
    """(call_id, record_reference, and for each column its text and, as ``<name>_utc``, its instant) of known calls' newest rows."""
    at = F.transform(F.array(*[text(c) for c in columns]), lambda x: parse_local(x, F.lit(zone)))
    rows = newest.join(calls.select("vcn", "call_id"), "vcn").select("call_id", "record_reference", *[text(c).alias(c.lower()) for c in columns], at.alias("_at"))
    return rows.select("call_id", "record_reference", *[c.lower() for c in columns], *[F.get("_at", F.lit(i)).alias(f"{c.lower()}_utc") for i, c in enumerate(columns)])


def resolve(children: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CAN-02: children (vcn, ...) with their call's id, and the orphans."""
    keys = calls.select("vcn", "call_id")
    return children.join(keys, "vcn"), children.join(keys, "vcn", "left_anti")


def unseen_names(events: DataFrame, known: DataFrame) -> DataFrame:
    """CAN-03: event names that aren't registered."""
    return events.select("event_name").distinct().join(known.select("event_name"), "event_name", "left_anti")


def events(staging: DataFrame, calls: DataFrame, zone: str = "Africa/Johannesburg", target: str = "Events") -> DataFrame:
    """CAN-02, CAN-04 to CAN-06: events of all valid rows with scope and residual attributes; those of no call are quarantined with a null call."""
    rows = usable(staging, target).select(
        text("VCN").alias("vcn"), F.coalesce(text("Event_ID"), reference()).alias("event_id"), text("Event_Name").alias("event_name"), _parsed(text("Event_Timestamp"), F.coalesce(text("Timezone"), F.lit(zone))).alias("utc"),
        text("Source_System").alias("source_system"), text("Verification_Status").alias("verification_status"), number("Confidence_Score").alias("confidence"), reference().alias("record_reference"), "file", "sheet", "row_number",
        movement_scope(text("Movement_Type"), F.coalesce(text("Event_Name"), F.lit(""))).alias("scope"), residual_attributes(F.col("values"), EVENT_COLUMNS, F.coalesce(text("Event_Name"), F.lit(""))).alias("attributes"),
    )
    joined = rows.filter("utc is not null and event_name is not null").join(calls.select("vcn", "call_id"), "vcn", "left")
    slot = Window.partitionBy("call_id", "vcn", "event_name").orderBy("file", "sheet", "row_number")
    return joined.withColumns({"occurrence_index": F.row_number().over(slot), "is_quarantined": F.col("call_id").isNull(), "is_superseded": F.lit(False)}).drop("file", "sheet", "row_number")


def _parsed(value: Column, zone: Column) -> Column:
    """``parse_local`` as a function of an array's element: its many formats would make a projection too large to compile."""
    return F.get(F.transform(F.array(F.struct(value.alias("v"), zone.alias("z"))), lambda x: parse_local(x.v, x.z)), F.lit(0))


def services(staging: DataFrame, calls: DataFrame, zone: str = "Africa/Johannesburg", target: str = "Services") -> tuple[DataFrame, DataFrame, DataFrame]:
    """CAN-07: requests, assignments and executions of each service row of a known call."""
    times = {"submission": "Submission_Time", "requested": "Requested_Time", "scheduled": "Scheduled_Time", "served": "Served_Time"}
    at = F.transform(F.array(*[text(c) for c in times.values()]), lambda x: parse_local(x, F.lit(zone)))  # one parser for all four
    rows = usable(staging, target).select(text("VCN").alias("vcn"), F.coalesce(text("Service_ID"), reference()).alias("service_id"), F.coalesce(text("Service_Type"), F.lit("Unknown")).alias("service_type"), text("Movement_Type").alias("movement"), text("Assigned_Resource").alias("resource"), at.alias("at"))
    known, _ = resolve(rows, calls)
    time = lambda c: F.get("at", F.lit(list(times).index(c))).alias(c)
    return known.select("call_id", "service_id", "service_type", "movement", time("submission"), time("requested")), known.select("service_id", time("scheduled"), "resource"), known.select("service_id", time("served"))


def berth_events(cargo: DataFrame, explicit: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """CAN-11: events from the timestamps of a call's first cargo row, where that event isn't there already. columns: column to event name."""
    first = cargo.withColumn("_n", F.row_number().over(Window.partitionBy("call_id").orderBy("cargo_id"))).filter("_n = 1")
    long = first.select("call_id", F.explode(F.array(*[F.struct(F.lit(name).alias("event_name"), F.col(c).alias("utc")) for c, name in columns.items()])).alias("x")).select("call_id", "x.*").filter("utc is not null")
    return long.join(explicit.select("call_id", "event_name"), ["call_id", "event_name"], "left_anti")


def with_last_quantity(calls: DataFrame, cargo: DataFrame, order: str = "cargo_id") -> DataFrame:
    """CAN-12: quantity and unit of each call from its last cargo row that has a quantity, else its own."""
    last = cargo.filter("quantity is not null").groupBy("call_id").agg(F.max_by(F.struct("quantity", "unit"), order).alias("q"))
    rows = calls if "quantity" in calls.columns else calls.withColumns({"quantity": F.lit(None).cast("double"), "quantity_unit": F.lit(None).cast("string")})
    joined = rows.join(last, "call_id", "left")
    return joined.withColumns({"quantity": F.coalesce("q.quantity", "quantity"), "quantity_unit": F.coalesce("q.unit", "quantity_unit")}).drop("q")


CARGO_COLUMNS = ("VCN", "Cargo_Operation_ID", "Operation_Type", "Cargo_Type", "Unit", "Planned_Quantity", "Actual_Quantity", "Working_Hours", "Resources_Deployed", "Downtime_Hours")
DELAY_COLUMNS = ("VCN", "Delay_ID", "Movement_Type", "Scheduled_Time", "Served_Time", "Delay_Hours", "Delay_Reason", "Delay_Category", "Cause_Status", "Confidence")


def envelope(values: Column, known: Sequence[str]) -> Column:
    """CAN-06: what a row says beyond the known columns, blanks left out."""
    return F.map_filter(values, lambda k, v: ~k.isin(*known) & v.isNotNull() & (F.trim(v) != ""))


def delays(staging: DataFrame, calls: DataFrame, zone: str = "Africa/Johannesburg", target: str = "Delays") -> DataFrame:
    """CAN-08: the delay rows of known calls as ``operators.delays.reconcile_delays`` takes them, with their residual attributes and source."""
    times = ("Scheduled_Time", "Served_Time")
    at = F.transform(F.array(*[text(c) for c in times]), lambda x: parse_local(x, F.lit(zone)))
    rows = usable(staging, target).select(
        text("VCN").alias("vcn"), F.coalesce(text("Delay_ID"), reference()).alias("delay_id"), text("Movement_Type").alias("movement"), at.alias("_at"), number("Delay_Hours").alias("stated_hours"), text("Delay_Reason").alias("reason"),
        text("Delay_Category").alias("source_category"), text("Cause_Status").alias("cause_status"), text("Confidence").alias("confidence_text"), envelope(F.col("values"), DELAY_COLUMNS).alias("attributes"), reference().alias("record_reference"),
    )
    rows = rows.withColumns({"scheduled": F.get("_at", F.lit(0)), "served": F.get("_at", F.lit(1))}).drop("_at")
    return resolve(rows, calls)[0]


def cargo_operations(staging: DataFrame, calls: DataFrame, target: str = "CargoOps") -> DataFrame:
    """CAN-06, CAN-10: cargo rows of known calls, numbers cast where they can be, with their residual attributes and source."""
    rows = usable(staging, target).select(text("Cargo_Type").alias("cargo_type"), envelope(F.col("values"), CARGO_COLUMNS).alias("attributes"), reference().alias("record_reference"), text("VCN").alias("vcn"), F.coalesce(text("Cargo_Operation_ID"), reference()).alias("cargo_id"), text("Operation_Type").alias("operation"), text("Unit").alias("unit"), number("Planned_Quantity").alias("planned"), number("Actual_Quantity").alias("quantity"), number("Working_Hours").alias("working_hours"), number("Resources_Deployed").alias("resources"), number("Downtime_Hours").alias("downtime_hours"))
    return resolve(rows, calls)[0]


