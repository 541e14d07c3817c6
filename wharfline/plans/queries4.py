"""Registered queries of what the others don't reach: landing, canonical tables, identity, listings, dashboards, sessions of the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import saved, shared_dir
from ..functions.time import delay_share, excel_serial
from ..operators import alerts, canonical, dashboard, delays, events, identity, journey, kpi, leadtime, lifecycle, outlier, quality, reconcile, stats
from ..sources import landing
from ..sources.tables import BINDINGS, bound, oracle, table
from . import registry
from .queries import _CALLS, _CARGO, _DECOMPOSED, _EVENTS, _LEAD, _LIVE, _POINTS, _SERVICES, _SHIFTS, _STAGES, _TIMINGS, _events, _hours, _lead_times, _points, _stages, _timings, _values, query
from .queries2 import _DB, _DELAYS, _FW_KPI, _HISTORY, _ISSUES, _METRICS, _PAIRS, _RANK, _SQL_PARTY, _batches, _bottlenecks, _delays, _history, _issues, _metrics, _party, _scored_keys
from .queries3 import _SPLIT

# ---------------------------------------------------------------- staged rows of workbooks

BINDINGS["staged_calls"] = """
    select concat(c_mktsegment, '.xlsx') as file, cast(c_custkey * 2 + x as int) as row_number, concat('V', cast(c_custkey as varchar(20))) as vcn,
        case when x = 0 and c_custkey % 9 = 0 then ' ' when x = 1 then concat(c_name, ' again') else c_name end as vessel_name, case when c_custkey % 7 = 0 then 'n/a' else cast(c_nationkey as varchar(20)) end as grt,
        case c_custkey % 11 when 0 then 'INVALID' when 1 then 'DUPLICATE' else 'VALID' end as validation_status
    from {customer} join (select 0 as x union all select 1 as x) t on x = 0 or c_custkey % 4 = 0"""
BINDINGS["staged_events"] = """
    select concat(o_orderpriority, '.xlsx') as file, cast(o_orderkey as int) as row_number, concat('V', cast(o_custkey * 2 as varchar(20))) as vcn,
        case o_orderkey % 5 when 0 then 'ATA' when 1 then 'ATD' when 2 then 'SHIFT_ALL_FAST' when 3 then 'SAILING_CLEARANCE' else 'Odd event' end as event_name,
        o_orderdate as local_time, case when o_orderkey % 3 = 0 then 'UTC' else '' end as zone, case o_orderkey % 4 when 0 then 'Inward' when 1 then 'OUTWARD' else '' end as movement, case when o_orderkey % 2 = 0 then o_orderstatus else ' ' end as remark
    from {orders}"""
BINDINGS["staged_services"] = """
    select 'Services.xlsx' as file, cast(l_orderkey * 10 + l_linenumber as int) as row_number, concat('V', cast(o_custkey as varchar(20))) as vcn, case when l_linenumber = 1 then '' else l_returnflag end as service_type,
        o_orderdate as submission, l_shipdate as served, l_linestatus as resource, l_quantity as quantity, l_linenumber as crew, l_orderkey % 6 as broken
    from {lineitem} join {orders} on l_orderkey = o_orderkey"""

_KNOWN_CALLS = f"""staged_calls as ({oracle('staged_calls')}), first_calls as (select *, row_number() over (partition by vcn order by file, row_number) as rn from staged_calls where validation_status = 'VALID'),
    known_calls as (select vcn, sha256(vcn) as call_id, coalesce(nullif(trim(vessel_name), ''), 'UNKNOWN') as vessel_name, try_cast(grt as double) as grt, concat(file, ':VesselCalls:', row_number) as record_reference from first_calls where rn = 1)"""


def _stage(rows: DataFrame, target: str, values: dict[str, str | F.Column], status: str | F.Column = "VALID") -> DataFrame:
    """Rows as staged ones: values become a map of text."""
    pairs = [x for name, c in values.items() for x in (F.lit(name), (F.col(c) if isinstance(c, str) else c).cast("string"))]
    return rows.select("file", F.lit(target).alias("sheet"), "row_number", F.lit(target).alias("target"), F.create_map(*pairs).alias("values"), (F.lit(status) if isinstance(status, str) else status).alias("validation_status"))


def _staged_calls(spark: SparkSession, d: str) -> DataFrame:
    return _stage(bound(spark, d, "staged_calls"), "VesselCalls", {"VCN": "vcn", "Vessel_Name": "vessel_name", "GRT": "grt"}, F.col("validation_status"))


def _known_calls(spark: SparkSession, d: str) -> DataFrame:
    return canonical.vessel_calls(_staged_calls(spark, d), ["GRT"], [])


@query("canonical_calls", f"with {_KNOWN_CALLS} select call_id, vcn, vessel_name, grt, record_reference from known_calls")
def canonical_calls(spark: SparkSession, d: str) -> DataFrame:
    return _known_calls(spark, d)


_STAGED_EVENTS = f"""{_KNOWN_CALLS}, staged_events as ({oracle('staged_events')}), made as (select e.*, k.call_id, case when zone = 'UTC' then local_time else local_time - interval 2 hour end as utc, row_number() over (partition by vcn, event_name order by file, row_number) as n,
        case movement when 'Inward' then 'ARRIVAL' when 'OUTWARD' then 'SAILING' else case when contains(upper(event_name), 'SAILING') or contains(upper(event_name), 'DEPARTURE') or contains(upper(event_name), 'OUT') then 'SAILING' when contains(upper(event_name), 'SHIFT') then 'SHIFTING' else 'ARRIVAL' end end as scope from staged_events e left join known_calls k using (vcn))"""


def _canonical_events(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "staged_events")
    staged = _stage(rows, "Events", {"VCN": "vcn", "Event_Name": "event_name", "Event_Timestamp": F.date_format("local_time", "yyyy-MM-dd HH:mm:ss"), "Timezone": "zone", "Movement_Type": "movement", "Remark": "remark"})
    return canonical.events(staged, _known_calls(spark, d))


@query("canonical_events", f"with {_STAGED_EVENTS} select event_name, scope, count(*) as n, count(*) filter (call_id is null) as n_orphans, max(n) as most, min(utc) as first_utc, max(utc) as last_utc from made group by event_name, scope")
def canonical_events(spark: SparkSession, d: str) -> DataFrame:
    got = _canonical_events(spark, d)
    return got.groupBy("event_name", "scope").agg(F.count("*").alias("n"), F.count_if("is_quarantined").alias("n_orphans"), F.max("occurrence_index").cast("long").alias("most"), F.min("utc").cast("timestamp_ntz").alias("first_utc"), F.max("utc").cast("timestamp_ntz").alias("last_utc"))


@query("residual_attributes", f"with {_STAGED_EVENTS} select concat(file, ':Events:', row_number) as record_reference, event_name as source_event_name, nullif(trim(remark), '') as remark from made")
def residual_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = _canonical_events(spark, d)
    return rows.select("record_reference", F.col("attributes")["source_event_name"].alias("source_event_name"), F.try_element_at("attributes", F.lit("Remark")).alias("remark"))


@query("unseen_event_names", f"with {_STAGED_EVENTS} select distinct event_name from made where event_name not in ('ATA', 'ATD', 'SHIFT_ALL_FAST')")
def unseen_event_names(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("ATA",), ("ATD",), ("SHIFT_ALL_FAST",)], "event_name string")
    return canonical.unseen_names(_canonical_events(spark, d), known)


_WORDS, _EVENT_ALIASES = [("oddevent", "ODD_EVENT")], [("sailingclearance", None, "{MOVEMENT}_CLEARANCE", 2), ("sailingclearance", "ARRIVAL", "CLEARED", 1), ("oddevent", None, "FIELD_ALIAS", 1)]


@query("event_names", f"with staged_events as ({oracle('staged_events')}), m as (select case o_name when 'Sailing clearance' then case mv when 'ARRIVAL' then 'CLEARED' when 'SAILING' then 'SAILING_CLEARANCE' else 'Sailing clearance' end when 'Odd event' then 'ODD_EVENT' else o_name end as event_name from (select case event_name when 'SAILING_CLEARANCE' then 'Sailing clearance' else event_name end as o_name, case movement when 'Inward' then 'ARRIVAL' when 'OUTWARD' then 'SAILING' else '' end as mv from staged_events)) select event_name, count(*) as n from m group by event_name")
def event_names(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "staged_events").select(F.when(F.col("event_name") == "SAILING_CLEARANCE", "Sailing clearance").otherwise(F.col("event_name")).alias("name"), F.when(F.col("movement") == "Inward", "ARRIVAL").when(F.col("movement") == "OUTWARD", "SAILING").otherwise("").alias("movement"))
    got = landing.canonical_event_name(rows, spark.createDataFrame(_WORDS, "token string, event_name string"), spark.createDataFrame(_EVENT_ALIASES, "token string, scope string, target string, ordinal int"))
    return got.groupBy("event_name").agg(F.count("*").alias("n"))


def _staged_services(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _stage(bound(spark, d, "staged_services"), "Services", {"VCN": "vcn", "Service_Type": "service_type", "Submission_Time": at("submission"), "Requested_Time": at("submission"), "Scheduled_Time": F.lit("12:30"), "Served_Time": at("served"), "Assigned_Resource": "resource"})


@query("split_services", f"with {_KNOWN_CALLS}, s as (select *, coalesce(nullif(service_type, ''), 'Unknown') as kind, submission - interval 2 hour as asked, served - interval 2 hour as done from ({oracle('staged_services')}) join known_calls using (vcn)) select 'request' as part, kind as key, count(*) as n, min(asked) as first_utc, max(asked) as last_utc from s group by kind union all select 'assignment', resource, count(*), cast(null as timestamp), cast(null as timestamp) from s group by resource union all select 'execution', 'all', count(*), min(done), max(done) from s")
def split_services(spark: SparkSession, d: str) -> DataFrame:
    """CAN-07: a bare time of day is no schedule."""
    parts = zip(("request", "assignment", "execution"), canonical.services(saved(_staged_services(spark, d)), _known_calls(spark, d)), ("service_type", "resource", None), ("requested", "scheduled", "served"), strict=True)
    out = None
    for name, rows, key, at in parts:
        one = rows.groupBy((F.col(key) if key else F.lit("all")).alias("key")).agg(F.count("*").alias("n"), F.min(at).cast("timestamp_ntz").alias("first_utc"), F.max(at).cast("timestamp_ntz").alias("last_utc")).select(F.lit(name).alias("part"), "key", "n", "first_utc", "last_utc")
        out = one if out is None else out.union(one)
    return out


@query("canonical_cargo", f"with {_KNOWN_CALLS}, s as ({oracle('staged_services')}) select concat(file, ':CargoOps:', row_number) as cargo_id, call_id, resource as unit, case when broken = 0 then null else cast(quantity as double) end as quantity, cast(crew as double) as resources, cast(null as double) as planned from s join known_calls using (vcn)")
def canonical_cargo(spark: SparkSession, d: str) -> DataFrame:
    staged = _stage(bound(spark, d, "staged_services"), "CargoOps", {"VCN": "vcn", "Unit": "resource", "Actual_Quantity": F.when(F.col("broken") == 0, "broken").otherwise(F.col("quantity").cast("string")), "Resources_Deployed": "crew", "Planned_Quantity": F.lit(" ")})
    return canonical.cargo_operations(staged, _known_calls(spark, d)).select("cargo_id", "call_id", "unit", "quantity", "resources", "planned")


@query("berth_events", f"with {_LIVE}, {_SERVICES}, f as (select call_id, service_id, scheduled, served, row_number() over (partition by call_id order by service_id) as n from services), long as (select call_id, 'FIRST_LINE_TIED_ARRIVAL' as event_name, scheduled as utc from f where n = 1 union all select call_id, 'ALL_FAST_ARRIVAL', served from f where n = 1) select * from long l where utc is not null and not exists (select 1 from live v where v.call_id = l.call_id and v.event_name = l.event_name)")
def berth_events(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "services").withColumnRenamed("service_id", "cargo_id")
    return canonical.berth_events(rows, events.live(_events(spark, d)), {"scheduled": "FIRST_LINE_TIED_ARRIVAL", "served": "ALL_FAST_ARRIVAL"})


@query("staged_dispositions", f"with c as ({oracle('staged_calls')}) select 'VesselCalls' as target, validation_status, count(*) as n from c where vcn not in (select vcn from c where vessel_name = ' ') or vessel_name <> ' ' group by validation_status")
def staged_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """LC-05, RC-03: rows with a blank name are excluded; what is left by table and status."""
    rows = _staged_calls(spark, d).withColumn("record_reference", canonical.reference())
    decisions = rows.filter(F.col("values")["Vessel_Name"] == " ").select("record_reference")
    return reconcile.disposition_counts(lifecycle.apply_exclusions(rows, decisions))


@query("mandatory_fields", f"with c as ({oracle('staged_calls')}) select rule_id, count(*) as n from (select 'DQ-MANDATORY' as rule_id from c where trim(vessel_name) = '' union all select 'DQ-DUPLICATE' from c where validation_status = 'DUPLICATE' union all select 'DQ-TIMESTAMP' from c where validation_status = 'INVALID') group by rule_id")
def mandatory_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _staged_calls(spark, d).withColumns({"call_id": F.lit(None).cast("long"), "record_reference": canonical.reference()})
    return quality.staging_issues(rows, ["VCN", "Vessel_Name"]).groupBy("rule_id").agg(F.count("*").alias("n"))


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a sheet whose header repeats a column and names another one twice; a name differs in every third row. Balances are numbers in a date column."""
    c = table(spark, d, "customer")
    rows = c.select(F.concat("c_mktsegment", F.lit(".xlsx")).alias("file"), (F.col("c_custkey") + 2).cast("int").alias("row_number"), F.posexplode(F.array(F.concat(F.lit("V"), "c_custkey"), F.concat(F.lit("V"), F.col("c_custkey") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)), "c_name", F.lower("c_name"), (F.col("c_custkey") % 50000).cast("string"))).alias("column_number", "value"))
    head = c.select(F.concat("c_mktsegment", F.lit(".xlsx")).alias("file")).distinct().select("file", F.lit(1).alias("row_number"), F.posexplode(F.array(*[F.lit(x) for x in ("V.C.N.", "VCN", "Note", "note", "ETA")])).alias("column_number", "value"))
    return rows.unionByName(head).withColumn("sheet", F.lit("Sheet1"))


_SHEET_ALIASES, _SHEET_NEED = [("Calls", "vcn", "VCN"), ("Calls", "eta", "ETA")], {"Calls": ["VCN", "ETA"]}


@query("repeated_headers", "select concat(c_mktsegment, '.xlsx') as file, cast(c_custkey + 2 as int) as row_number, concat('V', c_custkey) as vcn, case when c_custkey % 3 = 0 then concat('V', c_custkey + 1) end as other_vcn, lower(c_name) as second_note, case when c_custkey % 50000 >= 0 then strftime(timestamp '1899-12-30' + interval 1 day * (c_custkey % 50000), '%Y-%m-%d %H:%M:%S') end as eta from customer")
def repeated_headers(spark: SparkSession, d: str) -> DataFrame:
    """ING-02 to ING-07: repeated headers, differing values of one column, date serials."""
    cells, aliases = _sheet(spark, d), spark.createDataFrame(_SHEET_ALIASES, "target string, token string, column string")
    headers = landing.detect_headers(cells, aliases, _SHEET_NEED)
    raw = landing.raw_cells(cells, headers, landing.name_columns(cells, headers), aliases)
    raw = raw.withColumn("value", landing.source_value(F.col("value"), F.coalesce(F.col("column") == "ETA", F.lit(False))))
    got, v = landing.normalise_rows(raw), lambda name: F.try_element_at("values", F.lit(name))
    return got.select("file", "row_number", v("VCN").alias("vcn"), v("VCN__source_2").alias("other_vcn"), v("note__duplicate_2").alias("second_note"), v("ETA").alias("eta"))


@query("missing_columns", "select distinct concat(c_mktsegment, '.xlsx') as file, 'ATA|IMO' as missing from customer")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    cells, aliases = _sheet(spark, d).withColumn("sheet", F.lit("Calls")), spark.createDataFrame(_SHEET_ALIASES, "target string, token string, column string")
    return landing.missing_columns(cells, aliases, {"Calls": ["VCN", "ATA", "IMO"]}).select("file", F.array_join("missing", "|").alias("missing"))


@query("governed_groups", "select count(distinct c_mktsegment) as n_governed, count(*) as n_call_rows, true as is_accepted from customer")
def governed_groups(spark: SparkSession, d: str) -> DataFrame:
    """ING-13: a group is accepted with a governed sheet and a row of a call."""
    cells, aliases = _sheet(spark, d), spark.createDataFrame(_SHEET_ALIASES, "target string, token string, column string")
    headers = landing.detect_headers(cells, aliases, _SHEET_NEED)
    raw = landing.raw_cells(cells, headers, landing.name_columns(cells, headers), aliases)
    return landing.group_state(headers, landing.normalise_rows(raw), "Calls")


@query("date_serials", "select o_orderkey, case when o_orderkey % 60000 >= 60 then timestamp '1899-12-30' else timestamp '1899-12-31' end + interval 1 day * (o_orderkey % 60000) + interval 6 hour as at from orders")
def date_serials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", excel_serial(F.col("o_orderkey") % 60000 + F.lit(0.25)).alias("at"))


# ---------------------------------------------------------------- lifecycle, identity


@query("replaced_tenants", f"with {_DB} select tenant, count(*) as n, count(distinct version) as n_versions from (select tenant, 1 as version from batches where tenant <> 'BUILDING' union all select tenant, 2 from batches where tenant = 'BUILDING' and status = 'COMMITTED') group by tenant")
def replaced_tenants(spark: SparkSession, d: str) -> DataFrame:
    """LC-03: all tenants are written, then one of them again."""
    path = f"{shared_dir(spark)}/tenants-{uuid.uuid4().hex}"
    rows = _batches(spark, d).select("tenant", "batch_id", "status")
    lifecycle.replace_tenant(rows.withColumn("version", F.lit(1)), path)
    lifecycle.replace_tenant(rows.filter("tenant = 'BUILDING' and status = 'COMMITTED'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy(F.col("tenant").cast("string").alias("tenant")).agg(F.count("*").alias("n"), F.countDistinct("version").alias("n_versions"))


@query("active_datasets", f"with {_DB}, a as (select tenant, arg_max(batch_id, struct_pack(c := created_at, b := batch_id)) as batch_id from batches where status = 'COMMITTED' group by tenant), f as (select o_orderkey, cast(o_orderkey as varchar) as batch_id, l_linestatus from lineitem join orders on l_orderkey = o_orderkey) select a.tenant, a.batch_id, count(f.batch_id) filter (l_linestatus <> 'O') as n_governed, count(f.batch_id) filter (l_linestatus = 'O') as n_skipped from a left join f using (batch_id) group by all")
def active_datasets(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("batch_id"), F.when(F.col("l_linestatus") == "O", "SKIPPED").otherwise("VALIDATED").alias("status"))
    return lifecycle.active_dataset(lifecycle.activate_latest(_batches(spark, d)), files).select("tenant", "batch_id", "n_governed", "n_skipped")


_PAIR_SQL = f"{_SQL_PARTY}, pr as (select distinct x.call_id as a, y.call_id as b from party x join party y on x.call_id < y.call_id and (x.vcn = y.vcn or x.imo = y.imo)), ps as (select a, b, x.vessel_name = y.vessel_name as sn, x.vcn as xv, y.vcn as yv, x.imo as xi, y.imo as yi, x.grt = y.grt as sg from pr join party x on x.call_id = a join party y on y.call_id = b)"


@query("duplicate_calls", f"with {_PAIR_SQL} select distinct case when sn then 'DQ-001' else 'DQ-002' end as rule_id, b as call_id, concat('call:', b) as record_reference, case when sn then 'RESOLVED' else 'OPEN' end as status from ps where xv = yv and not coalesce(xi <> yi, false)")
def duplicate_calls(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_calls(_scored_keys(spark, d)).select("rule_id", "call_id", "record_reference", "status")


@query("match_evidence", f"with {_PAIR_SQL}, e as (select 'name' as attribute, case when sn then 'AGREED' else 'AGREED' end as outcome from ps union all select 'vcn', case when xv is null or yv is null then 'MISSING' when xv = yv then 'AGREED' else 'DISAGREED' end from ps union all select 'imo', case when xi is null or yi is null then 'MISSING' when xi = yi then 'AGREED' else 'DISAGREED' end from ps union all select 'type', 'AGREED' from ps union all select 'flag', 'AGREED' from ps union all select 'dimensions', 'AGREED' from ps) select attribute, outcome, count(*) as n from e group by all")
def match_evidence(spark: SparkSession, d: str) -> DataFrame:
    return identity.evidence_rows(_scored_keys(spark, d)).groupBy("attribute", "outcome").agg(F.count("*").alias("n"))


_MERGED = f"{_SQL_PARTY}, pr as (select x.call_id as a, y.call_id as b from party x join party y on x.call_id < y.call_id and (x.vcn = y.vcn or x.imo = y.imo) and not coalesce(x.vcn <> y.vcn, false) and not coalesce(x.imo <> y.imo, false)), mg as (select distinct a, b from pr)"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return identity.survivors(identity.merge_groups_by_key(_party(spark, d)), _party(spark, d), ["vcn", "imo", "vessel_type", "flag", "grt"])


@query("unmerged_population", f"with {_MERGED} select count(*) as n_total, (select count(*) from mg where b % 4 <> 3) as n_merged, count(*) - (select count(*) from mg where b % 4 <> 3) as n_consolidated from party")
def unmerged_population(spark: SparkSession, d: str) -> DataFrame:
    """Merges of every other second call are taken back."""
    groups = _groups(spark, d)
    back = groups.filter("call_id <> survivor_id and call_id % 4 = 3").select("call_id")
    return identity.population(identity.apply_merges(_party(spark, d), identity.unmerge(groups, back)))


@query("decision_history", f"with {_MERGED}, dec as (select b as call_id, a as survivor_id, 'MERGE' as action, 1 as decided from mg union all select b, a, 'UNMERGE', 2 from mg where b % 4 = 3) select d.call_id, survivor_id, action, x.vessel_name as call_id_name, y.vessel_name as survivor_id_name, cast(row_number() over (partition by survivor_id order by decided desc, d.call_id, action) as int) as position from dec d join party x on x.call_id = d.call_id join party y on y.call_id = survivor_id")
def decision_history(spark: SparkSession, d: str) -> DataFrame:
    moved = _groups(spark, d).filter("call_id <> survivor_id")
    made = moved.select("call_id", "survivor_id", F.lit("MERGE").alias("action"), F.lit(1).alias("decided_at"))
    back = moved.filter("call_id % 4 = 3").select("call_id", "survivor_id", F.lit("UNMERGE").alias("action"), F.lit(2).alias("decided_at"))
    return identity.decision_history(made.union(back), _party(spark, d)).drop("decided_at")


@query("steward_queue", f"with {_PAIR_SQL} select a, b, x.vessel_name as name_a, y.vessel_name as name_b from ps join party x on x.call_id = a join party y on y.call_id = b where coalesce(xv <> yv, false) or coalesce(xi <> yi, false)")
def steward_queue(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that a conflict keeps apart are put before a steward."""
    rows = _scored_keys(spark, d).withColumn("disposition", F.when(F.col("is_conflict"), "STEWARD_REVIEW").otherwise(F.col("disposition")))
    return identity.queue(rows, _party(spark, d)).drop("score")


# ---------------------------------------------------------------- journeys, lead times, delays


@query("journey_deviations", f"with {_CALLS}, {_POINTS}, {_STAGES} select call_id, stage, sequence, hours from stage_rows where status = 'DEVIATED'")
def journey_deviations(spark: SparkSession, d: str) -> DataFrame:
    return journey.journeys(_stages(spark, d)).select("call_id", F.inline("deviations")).select("call_id", "stage", "sequence", "hours")


@query("category_shares", f"with {_CALLS}, {_POINTS}, {_STAGES}, {_SHIFTS}, {_DECOMPOSED}, t as (select *, round({' + '.join(journey.CATEGORIES)}, 6) as total from decomposed) select call_id, case when total > 0 then printf('%.1f%%', round(PASSIVE_WAIT / total * 100, 1)) else '—' end as waiting, case when total > 0 then printf('%.1f%%', round(DELAY / total * 100, 1)) else '—' end as delay from t")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    got = journey.decompose(_stages(spark, d), journey.shift_occurrences(events.live(_events(spark, d)), *registry.REPEATABLE))
    share = lambda c: journey.category_share(F.col(c), F.col("total"))
    return got.select("call_id", share("PASSIVE_WAIT").alias("waiting"), share("DELAY").alias("delay"))


@query("late_shares", f"with {_TIMINGS} select leg, round(count(*) filter (status = 'LATE') / count(*) filter (status <> 'UNAVAILABLE'), 4) as late_share from timings group by leg")
def late_shares(spark: SparkSession, d: str) -> DataFrame:
    got = _timings(spark, d).groupBy("leg").agg(F.count_if(F.col("status") == "LATE").alias("a"), F.count_if(F.col("status") != "UNAVAILABLE").alias("b"))
    return got.select("leg", delay_share("a", "b").alias("late_share"))


@query("all_metrics", f"with {_CALLS}, {_POINTS}, {_SERVICES}, {_METRICS}, g as (select call_id from calls where call_id % 6 = 0) select m.call_id, metric, case when metric = 'Turnaround' and g.call_id is not null then null else hours end as hours, case when metric = 'Turnaround' and g.call_id is not null then 'UNAVAILABLE' else status end as status, case when metric = 'Turnaround' and g.call_id is not null then 'BLOCKED_BY_SOURCE' else reason end as reason from metric_rows m left join g using (call_id)")
def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    """TM-10, TM-14: twenty metrics; the source has no ATA for every sixth call."""
    calls = bound(spark, d, "calls")
    gate = leadtime.blocked_turnarounds(calls.withColumn("ata", F.when(F.col("call_id") % 6 != 0, "there")))
    return leadtime.all_metrics(calls, _points(spark, d), registry.lead_times(spark), bound(spark, d, "services"), registry.EXECUTION_DELAYS, blocked=gate).drop("source_ids")


_SCOPED = f"""{_EVENTS}, {_CALLS}, sc as (select * from (select *, case when event_name like '%SAILING%' or event_name like '%DEPARTURE%' or event_name like '%OUT%' then 'SAILING' when event_name like '%SHIFT%' then 'SHIFTING' else 'ARRIVAL' end as scope from events) where not is_superseded and scope = 'ARRIVAL' and call_id in (select call_id from calls where vessel_type = 'Bulk')),
    so as (select call_id, event_name, utc, row_number() over (partition by call_id, event_name order by occurrence_index, utc, event_id) as n from sc where event_name in ('ANCHORAGE_ARRIVAL', 'CARGO_END')), sh as (select a.call_id, {_hours('a.utc', 'z.utc')} as hours from so a join so z on a.call_id = z.call_id and a.n = z.n and a.event_name = 'ANCHORAGE_ARRIVAL' and z.event_name = 'CARGO_END' where a.n = 1)"""


def _scoped_custom(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("scope", events.movement_scope(F.lit(""), F.col("event_name")))
    cohort = bound(spark, d, "calls").filter("vessel_type = 'Bulk'")
    return leadtime.custom_lead_time(rows, "ANCHORAGE_ARRIVAL", "CARGO_END", calls=cohort, include_quarantined=True, scope="ARRIVAL")


@query("custom_lead_time_scoped", f"with {_SCOPED} select call_id, hours from sh")
def custom_lead_time_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _scoped_custom(spark, d).select("call_id", "hours")


@query("custom_statistics", f"with {_SCOPED} select count(hours) as n, round(avg(hours), 4) as mean, round(quantile_cont(hours, 0.5), 4) as median, round(quantile_cont(hours, 0.9), 4) as p90, round(stddev_samp(hours), 4) as sd from sh")
def custom_statistics(spark: SparkSession, d: str) -> DataFrame:
    got = stats.duration_stats(_scoped_custom(spark, d).withColumn("all", F.lit("all")), ["all"], "hours")
    return got.select("n", "mean", "median", "p90", "sd")


@query("anchorage_wait", f"with {_CALLS}, {_POINTS}, {_LEAD}, w as (select round(avg(hours), 6) as m, count(hours) as c from lead_rows where metric = 'Anchorage Wait' and status = 'AVAILABLE') select leg, case when ok then 'AVAILABLE' else 'UNAVAILABLE' end as status, case when ok then m end as average_hours, case when ok then c else 0 end as n, case when not ok then 'OTHER_LEG' end as reason from w, (values ('All', true), ('Arrival', true), ('Sailing', false), ('Shifting', false)) as t(leg, ok)")
def anchorage_wait(spark: SparkSession, d: str) -> DataFrame:
    return delays.anchorage_wait(_lead_times(spark, d))


@query("delay_page", f"with {_DELAYS} select delay_id, hours from delays where leg = 'Arrival' order by hours desc, delay_id limit 25 offset 50")
def delay_page(spark: SparkSession, d: str) -> DataFrame:
    return delays.delay_list(_delays(spark, d), legs=["Arrival"], sort="hours", descending=True, skip=50, limit=25).select("delay_id", "hours")


def _accepted(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    late = rows.filter("hours > 0")
    one = late.select("delay_id", "category", (F.col("hours") * 0.6).alias("hours"), F.lit(False).alias("is_primary"), F.lit(1).alias("ordinal"))
    two = late.select("delay_id", F.lit("Other").alias("category"), F.when(F.col("is_mismatch"), F.col("hours") * 0.6).otherwise(F.col("hours") * 0.4).alias("hours"), (F.col("allocation") == "CONFIRMED").alias("is_primary"), F.lit(2).alias("ordinal"))
    return delays.apply_allocations(rows, one.union(two))[0]


_ACCEPTED = f"{_DELAYS}, {_SPLIT}, acc as (select w.delay_id, w.category, w.hours, d.hours as total, sum(w.hours) over (partition by w.delay_id) as h, row_number() over (partition by w.delay_id order by is_primary desc, ordinal) = 1 as is_primary from with_share w join delays d using (delay_id)), accepted as (select * from acc where h <= total + 0.01)"


@query("delay_allocation_detail", f"with {_ACCEPTED}, g as (select delay_id, round(sum(hours), 4) as h, string_agg(concat(category, '=', printf('%.2f', hours)), '|' order by not is_primary, category, hours) as a from accepted group by delay_id) select delay_id, coalesce(a, '') as allocations, coalesce(h, 0) as allocated_hours, round(hours - coalesce(h, 0), 4) as unallocated_hours from delays left join g using (delay_id) where leg = 'Sailing'")
def delay_allocation_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = _delays(spark, d)
    got = delays.delay_list(rows, _accepted(spark, d, rows), legs=["Sailing"])
    text = F.array_join(F.transform("allocations", lambda x: F.format_string("%s=%.2f", x.category, x.hours)), "|")
    return got.select("delay_id", text.alias("allocations"), "allocated_hours", "unallocated_hours")


@query("delay_stage_allocations", f"with {_ACCEPTED}, g as (select delay_id, sum(hours) as h from accepted group by delay_id) select leg, count(*) as n, round(coalesce(sum(h), 0), 1) as allocated_hours, round(sum(greatest(hours - coalesce(h, 0), 0)), 1) as unallocated_hours from delays left join g using (delay_id) group by leg")
def delay_stage_allocations(spark: SparkSession, d: str) -> DataFrame:
    rows = _delays(spark, d)
    got = delays.stage_breakdown(rows, _accepted(spark, d, rows))
    return got.select("leg", "n", F.round("allocated_hours", 1).alias("allocated_hours"), F.round("unallocated_hours", 1).alias("unallocated_hours"))


@query("reviewed_allocations", f"with {_ACCEPTED}, rv as (select delay_id from delays where needs_review and leg = 'Arrival'), c as (select case when is_primary and delay_id in (select delay_id from rv) then 'Mooring' else category end as category, case when is_primary and delay_id in (select delay_id from rv) then 'CONFIRMED' else 'INFERRED' end as allocation, hours from accepted union all select 'Mooring', 'CONFIRMED', hours from delays where delay_id in (select delay_id from rv) and delay_id not in (select delay_id from accepted where is_primary)) select category, allocation, count(*) as n, round(sum(hours), 1) as hours from c group by all")
def reviewed_allocations(spark: SparkSession, d: str) -> DataFrame:
    rows = _delays(spark, d)
    reviews = rows.filter("needs_review and leg = 'Arrival'").select("delay_id", F.lit("Mooring").alias("category"))
    got = delays.review_allocations(rows, _accepted(spark, d, rows), reviews)
    return got.groupBy("category", "allocation").agg(F.count("*").alias("n"), F.round(F.sum("hours"), 1).alias("hours"))


# ---------------------------------------------------------------- KPIs, outliers, criticality


@query("kpi_filtered", f"with all_calls as ({oracle('calls')}), calls as (select * from all_calls where vessel_type = 'Bulk'), {_FW_KPI} select kpi, value from kpis where kpi in ('KPI-01', 'KPI-03', 'KPI-15', 'KPI-41', 'KPI-54')")
def kpi_filtered(spark: SparkSession, d: str) -> DataFrame:
    """KF-02: one vessel type; calls merged into others don't count."""
    calls, points = bound(spark, d, "calls").withColumn("is_merged", F.lit(False)), _points(spark, d)
    again = calls.withColumns({"call_id": F.col("call_id") + F.lit(1 << 40), "is_merged": F.lit(True)})
    shifts = kpi.pair_shifts(events.live(_events(spark, d)), *registry.REPEATABLE)
    measured = kpi.measures(kpi.population(calls.unionByName(again), points, vessel_type="Bulk"), points, bound(spark, d, "cargo"), shifts, unit="TEU")
    return kpi.results(measured, registry.kpis(spark)).filter("kpi in ('KPI-01', 'KPI-03', 'KPI-15', 'KPI-41', 'KPI-54')").select("kpi", "value")


@query("scorecard", f"with {_HISTORY.format(lineitem='lineitem')}, reg as (select * from {_values(registry.KPIS)} as t(kpi, name, category, unit, target, direction, green, amber, computed, alias_of)) select category, count(*) filter (kpi in (select kpi from history where value is not null)) as n_with_result, count(*) as n_kpis from reg where alias_of is null group by category")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return kpi.scorecard(kpi.latest(_history(spark, d)), registry.kpis(spark))


@query("statistics_listing", f"with {_HISTORY.format(lineitem='lineitem')}, s as (select kpi as metric, case when calculated_at < timestamp '1995-01-01' then 'early' else 'all' end as cohort, calculated_at, value from history) select metric, cohort, calculated_at, round(value, 4) as value from s where cohort = 'all' qualify row_number() over (partition by metric order by calculated_at desc) = 1")
def statistics_listing(spark: SparkSession, d: str) -> DataFrame:
    stored = _history(spark, d).select(F.col("kpi").alias("metric"), F.when(F.col("calculated_at") < F.lit("1995-01-01").cast("timestamp_ntz"), "early").otherwise("all").alias("cohort"), "calculated_at", "value")
    return kpi.statistics_listing(stored).select("metric", "cohort", "calculated_at", F.round("value", 4).alias("value"))


@query("outlier_listing", f"with {_CALLS}, {_POINTS}, {_PAIRS} select rule, p.call_id, value, severity, vcn, vessel_name from pair_out p join calls using (call_id) where severity = 'CRITICAL' and vcn ilike '%v1%'")
def outlier_listing(spark: SparkSession, d: str) -> DataFrame:
    found = outlier.pair_outliers(_points(spark, d), registry.OUTLIER_PAIRS)
    return outlier.listing(found, bound(spark, d, "calls"), severity="CRITICAL", vcn="v1").select("rule", "call_id", "value", "severity", "vcn", "vessel_name")


@query("outlier_digest", f"with {_POINTS}, {_PAIRS} select category, severity, count(*) as n, count(distinct call_id) as n_calls, case severity when 'CRITICAL' then 1 else 2 end as severity_rank from pair_out group by category, severity")
def outlier_digest(spark: SparkSession, d: str) -> DataFrame:
    return outlier.digest(outlier.pair_outliers(_points(spark, d), registry.OUTLIER_PAIRS))


# ---------------------------------------------------------------- listings, dashboards, reconciliation


@query("dq_overall", f"with {_ISSUES}, c as ({oracle('staged_calls')}) select (select count(*) from issues) as n_issues, (select count(*) from issues) as n_open, cast(0 as bigint) as n_resolved, (select count(*) from issues where rule_id like '%SEQUENCE%' or rule_id = 'DQ-006') as n_sequence, (select count(*) from parts where quality_status = 'QUARANTINED') as n_quarantined, (select count(*) from c where validation_status = 'VALID') as n_valid, (select count(*) from c where validation_status = 'INVALID') as n_invalid, (select count(*) from c where validation_status = 'DUPLICATE') as n_duplicate")
def dq_overall(spark: SparkSession, d: str) -> DataFrame:
    issues = _issues(spark, d)
    return quality.overall(issues, quality.partition(bound(spark, d, "calls"), issues), _staged_calls(spark, d))


@query("dq_listing_filtered", f"with {_ISSUES} select 'incomplete' as kind, count(*) as n from issues where rule_id like '%-MISSING' or rule_id = 'DQ-003' union all select 'chronology', count(*) from issues where rule_id in ('DQ-004', 'DQ-006', 'DQ-SEQUENCE-VIOLATION', 'DQ-SCHEDULE-ORDER') union all select 'tug sailing', count(*) from issues where record_reference in (select concat('service:', service_id) from services where service_type = 'Tug' and movement = 'Sailing')")
def dq_listing_filtered(spark: SparkSession, d: str) -> DataFrame:
    issues, services = _issues(spark, d), bound(spark, d, "services")
    count = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    sets = [("incomplete", quality.listing(issues, incomplete=True)), ("chronology", quality.listing(issues, chronology=True)), ("tug sailing", quality.listing(issues, services=services, service_type="Tug", movement="Sailing"))]
    out = [count(*x) for x in sets]
    return out[0].union(out[1]).union(out[2])


_CASES = [("C1", "DQ-003"), ("C2", "DQ-007"), ("C3", "DQ-999")]


@query("verified_cases", f"with {_ISSUES}, e as (select c.case_id, c.rule_id, concat('call:', call_id) as record_reference from calls, {_values(_CASES)} as c(case_id, rule_id) where call_id % 10 = 0) select case_id, case when i.rule_id is null then 'FAIL' else 'PASS' end as result, count(*) as n from e left join (select distinct rule_id, record_reference from issues) i using (rule_id, record_reference) group by all")
def verified_cases(spark: SparkSession, d: str) -> DataFrame:
    """RC-03: for every tenth call, three issues are expected."""
    expected = bound(spark, d, "calls").filter("call_id % 10 = 0").select(F.concat(F.lit("call:"), F.col("call_id").cast("string")).alias("record_reference")).crossJoin(F.broadcast(spark.createDataFrame(_CASES, "case_id string, rule_id string")))  # three rows
    return quality.verify_cases(expected, _issues(spark, d)).groupBy("case_id", "result").agg(F.count("*").alias("n"))


@query("alert_listing", f"with {_DELAYS}, a as (select delay_id as alert_id, scheduled as created_at, category from delays join (select delay_id, scheduled from raw_delays) using (delay_id) where hours >= 1 and category in ('Tug', 'Pilot')), c as (select delay_id as alert_id, count(*) as n from delays where needs_review or hours > 100 group by delay_id) select alert_id, created_at, coalesce(n, 0) as n_actions from a left join c using (alert_id) order by created_at desc, alert_id limit 100")
def alert_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = _delays(spark, d).join(bound(spark, d, "delays").select("delay_id", F.col("scheduled").alias("created_at")), "delay_id")
    found = rows.filter("hours >= 1 and category in ('Tug', 'Pilot')").select(F.col("delay_id").alias("alert_id"), "created_at")
    return alerts.listing(found, rows.filter("needs_review or hours > 100").select(F.col("delay_id").alias("alert_id")))


@query("dashboard_scope", f"with {_CALLS}, {_POINTS}, a as (select call_id, utc from points where event_name = 'ATA') select call_id from calls left join a using (call_id) where tenant = 'BUILDING' and (terminal = 'T1' or terminal is null) and coalesce(utc, timestamp '1995-06-01') >= timestamp '1995-01-01' and coalesce(utc, timestamp '1995-06-01') < timestamp '1997-01-01'")
def dashboard_scope(spark: SparkSession, d: str) -> DataFrame:
    """DB-01: scope and dates; a call without an ATA has the date that it was created."""
    calls = bound(spark, d, "calls").withColumn("created_at", F.lit("1995-06-01").cast("timestamp_ntz"))
    return dashboard.population(calls, _points(spark, d), tenant="BUILDING", terminal="T1", start="1995-01-01", end="1997-01-01").select("call_id")


_BOXES = "select call_id, quantity, case when operation = 'Lashing' then 'boxes' else unit end as unit from cargo"


@query("unit_totals", f"with {_CALLS}, {_CARGO}, k as ({_BOXES}), j as (select quantity, unit, case cargo_type when 'Containers' then 'Container' when 'Breakbulk' then 'Break Bulk' else cargo_type end as cargo_type from k join calls using (call_id)) select case when unit in ('TEU', 'MT', 'Units') then unit when cargo_type = 'Container' then 'TEU' when cargo_type = 'Break Bulk' then 'MT' else 'Units' end as unit, round(sum(quantity), 2) as quantity from j group by 1")
def unit_totals(spark: SparkSession, d: str) -> DataFrame:
    calls = bound(spark, d, "calls").withColumn("cargo_type", F.when(F.col("cargo_type") == "Containers", "Container").when(F.col("cargo_type") == "Breakbulk", "Break Bulk").otherwise(F.col("cargo_type")))
    cargo = bound(spark, d, "cargo").withColumn("unit", F.when(F.col("operation") == "Lashing", "boxes").otherwise(F.col("unit")))
    return dashboard.unit_totals(calls, cargo)


@query("delay_totals", f"with {_DELAYS} select count(*) as n, round(sum(hours), 2) as hours, round(sum(hours) filter (allocation = 'CONFIRMED'), 2) as confirmed_hours, round(sum(hours) filter (allocation <> 'CONFIRMED'), 2) as inferred_hours from delays where hours > 0")
def delay_totals(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.delay_totals(_delays(spark, d))


@query("top_findings", f"with {_CALLS}, {_POINTS}, {_LEAD}, {_DELAYS}, {_RANK}, {_PAIRS}, b as (select 'BOTTLENECK' as kind, name, cast(null as bigint) as call_id, score as value from ranked_b order by score desc, name limit 5), o as (select 'OUTLIER' as kind, rule as name, call_id, value from pair_out order by case severity when 'CRITICAL' then 1 else 2 end, round(abs(value - threshold), 4) desc, rule, call_id limit 5) select * from b union all select * from o")
def top_findings(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.top_findings(_bottlenecks(spark, d), outlier.pair_outliers(_points(spark, d), registry.OUTLIER_PAIRS))


@query("snapshot_sections", f"with {_CALLS}, {_DELAYS} select 'population' as section, 'AVAILABLE' as status, count(*) as n from calls where vessel_type = 'Bulk' union all select 'delay_totals', 'AVAILABLE', 1 union all select 'alerts', 'UNAVAILABLE', null")
def snapshot_sections(spark: SparkSession, d: str) -> DataFrame:
    """DB-06, DB-09: two versions of a snapshot are written, the newer one is read; a section that it lacks has a reason."""
    path, calls = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", bound(spark, d, "calls")
    totals = dashboard.delay_totals(_delays(spark, d))
    dashboard.write_snapshot({"population": calls, "delay_totals": totals}, path, tenant="all", filters="bulk", version=1)
    dashboard.write_snapshot({"population": calls.filter("vessel_type = 'Bulk'"), "delay_totals": totals}, path, tenant="all", filters="bulk", version=2)
    found = dashboard.read_snapshot(spark, path, tenant="all", filters="bulk", sections=["population", "delay_totals", "alerts"])
    states = dashboard.section_states(spark, found)
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, x in found.items() if not isinstance(x, str)]
    return states.join(counts[0].union(counts[1]), "section", "left").select("section", "status", "n")


@query("call_page", f"with {_CALLS} select call_id, vessel_name from calls where vessel_type ilike '%container%' order by vessel_name desc nulls last, call_id limit 30 offset 20")
def call_page(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.search_calls(bound(spark, d, "calls"), text="container", sort="vessel_name", descending=True, skip=20, limit=30).select("call_id", "vessel_name")


_SETS = [("all", "true"), ("containers", "vessel_type = 'Container'"), ("bulk", "vessel_type = 'Bulk'"), ("container cargo", "cargo_type = 'Containers'"), ("coal", "cargo_type = 'Coal'"), ("tenant", "tenant = 'BUILDING'"), ("bulk coal", "vessel_type = 'Bulk' and cargo_type = 'Coal'")]


@query("filtered_totals", f"with {_CALLS}, s as (" + " union all ".join(f"select '{n}' as filter_set, count(*) as n from calls where {w}" for n, w in _SETS) + "), f as (select unnest(['dashboard', 'listing', 'lead_times']) as source) select filter_set, source, n, true as is_equal from s, f")
def filtered_totals(spark: SparkSession, d: str) -> DataFrame:
    """RC-02: under seven filter sets, calls by the dashboard, by the listing and by lead times."""
    calls = bound(spark, d, "calls")
    sources = {"dashboard": dashboard.population(calls, _points(spark, d)), "listing": lifecycle.search_calls(calls), "lead_times": _lead_times(spark, d)}
    return reconcile.compare_masked(calls, {name: F.expr(where) for name, where in _SETS}, sources)


# ---------------------------------------------------------------- the stream of events, as a table

_SESSIONS = """ordered as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events), marked as (select *, sum(case when before is null or ts > before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from ordered)"""


@query("user_journeys", f"with {_SESSIONS} select user_id, cast(session as bigint) as session, count(*) as n_events, min(ts) as start_utc, max(ts) as end_utc, round(date_diff('microsecond', min(ts), max(ts)) / 3.6e9, 6) as hours from marked group by user_id, session")
def user_journeys(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each user: events with gaps of up to half an hour between them."""
    return journey.visits(table(spark, d, "events"), "user_id", "ts", "event_id", minutes=30)


@query("user_lead_times", "with o as (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events), p as (select user_id, n, min(ts) filter (event_type = 'view') as a, min(ts) filter (event_type = 'purchase') as z from o where event_type in ('view', 'purchase') group by user_id, n) select user_id as call_id, cast(n as bigint) as occurrence, round(date_diff('microsecond', a, z) / 3.6e9, 6) as hours from p where a is not null and z is not null")
def user_lead_times(spark: SparkSession, d: str) -> DataFrame:
    """The custom builder over the event stream: from a user's n-th view to the n-th purchase."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.col("event_type").alias("event_name"), F.col("ts").alias("utc"), "event_id", F.col("event_id").alias("occurrence_index"), F.lit(False).alias("is_superseded"), F.lit(False).alias("is_quarantined"))
    got = leadtime.custom_lead_time(rows, "view", "purchase", pick="all")
    return got.withColumn("occurrence", F.col("occurrence").cast("long"))
