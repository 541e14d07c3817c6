"""Registered queries over stored results (snapshots, rebuilt tables, upserts, runs), merges from a decision log, newest source rows, staged delays and names without a key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import store
from ..functions.lineage import free, saved, shared_dir
from ..operators import canonical, dashboard, delays, events, identity, kpi, leadtime, outlier, quality, stats
from ..sources import landing
from ..sources.tables import BINDINGS, bound, oracle, table
from . import registry
from .queries import _CALLS, _CARGO, _LEAD, _POINTS, _TIMINGS, _events, _hours, _joined, _lead_times, _points, _timings, _values, query
from .queries2 import _FW_KPI, _ISSUES, _SQL_PARTY, UNIT, _issues, _kpis, _party
from .queries4 import _KNOWN_CALLS, _known_calls, _stage


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- names without a key, copies, pages

BINDINGS["namesakes"] = """
    select c_custkey * 2 as call_id, upper(substr(md5(cast(c_custkey as varchar(20))), 1, 18)) as vessel_name, cast(null as varchar(20)) as vcn, cast(null as varchar(20)) as imo, false as is_merged from {customer}
    union all select c_custkey * 2 + 1, concat(substr(upper(substr(md5(cast(c_custkey as varchar(20))), 1, 18)), 1, 7), '-', substr(upper(substr(md5(cast(c_custkey as varchar(20))), 1, 18)), 9)), null, null, false from {customer} where c_custkey % 3 = 0
    union all select -1 - c_custkey, case when c_custkey % 2 = 0 then 'Unknown' else ' ' end, null, null, false from {customer}"""


@query("identity_candidate_pairs", "select c_custkey * 2 as a, c_custkey * 2 + 1 as b from customer where c_custkey % 3 = 0")
def identity_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """ID-03 over all calls: names of 18 random characters, of which one in three comes again with one replaced; blank and default names meet no one."""
    return identity.candidate_pairs(bound(spark, d, "namesakes"))


@query("identity_representatives", f"with {_SQL_PARTY} select call_id, min(call_id) over (partition by vessel_type, flag, imo) as representative from party")
def identity_representatives(spark: SparkSession, d: str) -> DataFrame:
    return identity.representatives(_party(spark, d), ["vessel_type", "flag", "imo"])


@query("leadtime_page_total", f"with {_CALLS}, {_POINTS}, {_LEAD}, r as (select call_id, metric, hours from lead_rows where metric = 'Turnaround' and status = 'AVAILABLE') select *, (select count(*) from r) as total from r order by hours desc, call_id limit 20 offset 10")
def leadtime_page_total(spark: SparkSession, d: str) -> DataFrame:
    rows = _lead_times(spark, d).filter("metric = 'Turnaround' and status = 'AVAILABLE'").select("call_id", "metric", "hours")
    return stats.page(rows, [F.desc("hours"), "call_id"], 10, 20, total=True)


# ---------------------------------------------------------------- read-through snapshots, partial rebuilds, upserts


@query(
    "snapshot_read_through",
    f"with {_CALLS} select 1 as step, 'MISS' as state, 'B1' as batch_id, count(*) as n_calls from calls union all select 2, 'HIT', 'B1', count(*) from calls union all select 3, 'COMPUTED', 'B2', count(*) from calls where vessel_type = 'Bulk' union all select 4, 'MISS', 'B3', count(*) from calls union all select 5, 'HIT', 'B3', count(*) from calls",
)
def snapshot_read_through(spark: SparkSession, d: str) -> DataFrame:
    """DB-06: nothing stored, so computed and published; then read; filtered sections are computed; a new batch publishes anew; then that is read."""
    path, calls = _place(spark, "snapshots"), bound(spark, d, "calls")
    out = None
    for step, (batch, filters, again) in enumerate([("B1", dashboard.UNFILTERED, False), ("B2", dashboard.UNFILTERED, False), ("B2", "bulk", False), ("B3", dashboard.UNFILTERED, True), ("B4", dashboard.UNFILTERED, False)], 1):
        chosen = calls if filters == dashboard.UNFILTERED else calls.filter("vessel_type = 'Bulk'")
        sections, state, lineage = dashboard.read_through(spark, path, lambda c=chosen: {"population": c}, tenant="all", filters=filters, lineage={"batch_id": batch}, recompute=again)
        one = sections["population"].agg(F.count("*").alias("n_calls")).select(F.lit(step).alias("step"), F.lit(state).alias("state"), F.lit(lineage["batch_id"]).alias("batch_id"), "n_calls")
        out = one if out is None else out.union(one)
    return out


_CORRECTED = f"""raw as ({oracle('events')}), corrected as (select event_id from raw where call_id % 500 = 7 and event_name in ('ATA', 'ATD')),
    raw_events as (select * replace (is_superseded or event_id in (select event_id from corrected) as is_superseded) from raw union all select * replace (event_id || '#corrected' as event_id, utc + interval 3 hour as utc, 'Verified' as verification_status, 1.0 as confidence, false as is_superseded, false as is_quarantined) from raw where event_id in (select event_id from corrected))"""
_FIRST_LIVE = "select call_id, event_name, min(utc) as first_utc, max(utc) as last_utc, count(*) as n from raw_events where not is_superseded and not is_quarantined and utc is not null group by call_id, event_name"


def _spans(rows: DataFrame) -> DataFrame:
    return events.live(rows).groupBy("call_id", "event_name").agg(F.min("utc").alias("first_utc"), F.max("utc").alias("last_utc"), F.count("*").alias("n"))


@query("rebuilt_after_corrections", f"with {_CORRECTED} {_FIRST_LIVE}")
def rebuilt_after_corrections(spark: SparkSession, d: str) -> DataFrame:
    """JR-13: a table by call is built, some calls' events are corrected, and only those calls' buckets are rebuilt."""
    path, rows = _place(spark, "rebuilt"), _events(spark, d)
    store.rebuild(spark, path, _spans, rows)
    chosen = rows.filter("call_id % 500 = 7 and event_name in ('ATA', 'ATD')")
    corrected = events.apply_corrections(rows, chosen.select("event_id", (F.col("utc") + F.expr("interval 3 hours")).alias("utc")))
    version, _ = store.rebuild(spark, path, _spans, corrected, changed=chosen.select("call_id"))
    return store.read(spark, version)


@query("rebuilt_after_exclusions", f"with raw_events as (select * from ({oracle('events')}) where not (call_id % 400 = 3 and source_system = 'Radio')) {_FIRST_LIVE}")
def rebuilt_after_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """LC-05: rows are excluded by decisions, and the buckets of their calls rebuilt from what is left."""
    path, rows = _place(spark, "rebuilt"), _events(spark, d)
    store.rebuild(spark, path, _spans, rows)
    decisions = rows.filter("call_id % 400 = 3 and source_system = 'Radio'")
    left = rows.join(decisions.select("event_id"), "event_id", "left_anti")
    version, _ = store.rebuild(spark, path, _spans, left, changed=decisions.select("call_id"))
    return store.read(spark, version)


@query("stored_issues", f"with {_ISSUES} select rule_id, status, count(*) as n from (select distinct rule_id, record_reference, case when rule_id = 'DQ-004' then 'RESOLVED' else 'OPEN' end as status from issues union all select distinct rule_id, record_reference, 'OPEN' from issues where rule_id = 'DQ-004') group by all")
def stored_issues(spark: SparkSession, d: str) -> DataFrame:
    """DQ-UPS: issues are stored twice, the second time to no effect; then some are resolved, and a third run opens those anew."""
    path, keys = _place(spark, "issues"), ["rule_id", "record_reference"]
    found, merge = saved(_issues(spark, d)), lambda stored, new: quality.merge_issues(new, stored)
    free(spark)
    for _ in range(2):
        version, _ = store.upsert(spark, path, found, keys, merge=merge)
    resolved = store.read(spark, version).filter("rule_id = 'DQ-004'").withColumn("status", F.lit("RESOLVED"))
    store.upsert(spark, path, resolved, keys)
    version, _ = store.upsert(spark, path, found, keys, merge=merge)
    return store.read(spark, version).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("stored_lead_times", f"with {_CALLS}, {_POINTS}, {_LEAD} select call_id, metric, case when call_id % 5 = 0 then hours + 1 else hours end as hours from lead_rows where metric in ('Turnaround', 'Anchorage Wait')")
def stored_lead_times(spark: SparkSession, d: str) -> DataFrame:
    """TM-16: lead times by call and metric, stored; a second run has other hours for some calls, whose rows take the place of the first."""
    path, rows = _place(spark, "lead-times"), _lead_times(spark, d).filter("metric in ('Turnaround', 'Anchorage Wait')").select("call_id", "metric", "hours")
    store.upsert(spark, path, rows, ["call_id", "metric"], buckets=16)
    again = rows.filter("call_id % 5 = 0").withColumn("hours", F.col("hours") + 1)
    version, _ = store.upsert(spark, path, again, ["call_id", "metric"], buckets=16)
    return store.read(spark, version)


# ---------------------------------------------------------------- merges from a decision log

#: Calls 2 c + 1 go into 2 c; of every other customer, 2 c goes on into the next customer's call; every 12th first merge is taken back; every 60th call is merged once more after that.
BINDINGS["decisions"] = """
    select c_custkey * 10 as seq, concat('M', cast(c_custkey as varchar(20))) as decision_id, 'MERGE' as action, c_custkey * 2 + 1 as call_id, c_custkey * 2 as survivor_id, cast(null as varchar(21)) as undoes from {customer} where c_custkey % 4 < 3
    union all select 100000000 + c_custkey, concat('N', cast(c_custkey as varchar(20))), 'MERGE', c_custkey * 2, c_custkey * 2 + 2, null from {customer} where c_custkey % 6 = 0
    union all select 200000000 + c_custkey, concat('U', cast(c_custkey as varchar(20))), 'UNMERGE', c_custkey * 2 + 1, c_custkey * 2, concat('M', cast(c_custkey as varchar(20))) from {customer} where c_custkey % 12 = 0
    union all select 300000000 + c_custkey, concat('R', cast(c_custkey as varchar(20))), 'MERGE', c_custkey * 2 + 1, c_custkey * 2 + 4, null from {customer} where c_custkey % 60 = 0"""
_STANDING = f"""decisions as ({oracle('decisions')}), standing as (select call_id, arg_min(survivor_id, seq) as survivor_id, min(seq) as seq from decisions m where action = 'MERGE' and not exists (select 1 from decisions u where u.action = 'UNMERGE' and u.undoes = m.decision_id and u.seq > m.seq) group by call_id),
    merged as (select a.call_id, coalesce(b.survivor_id, a.survivor_id) as survivor_id from standing a left join standing b on b.call_id = a.survivor_id and b.seq > a.seq)"""


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    return identity.replay(bound(spark, d, "decisions"))


@query("replayed_children", f"with {_STANDING}, ch as (select o_orderkey, o_custkey * 2 + o_orderkey % 2 as call_id from orders) select coalesce(m.survivor_id, ch.call_id) as call_id, count(*) as n_children, count(*) filter (m.survivor_id is not null) as n_taken_over from ch left join merged m on m.call_id = ch.call_id group by 1")
def replayed_children(spark: SparkSession, d: str) -> DataFrame:
    """ID-10, ID-11: orders under the calls that all decisions leave them with."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2 + F.col("o_orderkey") % 2).alias("call_id"))
    owned = identity.with_owner(rows, _replayed(spark, d))
    return owned.groupBy("call_id").agg(F.count("*").alias("n_children"), F.count_if(F.col("own_id") != F.col("call_id")).alias("n_taken_over"))


@query("replayed_calls", f"with {_SQL_PARTY}, {_STANDING}, e as (select p.*, m.survivor_id from party p left join merged m using (call_id)) select coalesce(survivor_id, call_id) as call_id, count(*) as n_members, max(grt) as grt, cast(null as bigint) as merged_into from e group by 1 union all select call_id, 1, grt, survivor_id from e where survivor_id is not null")
def replayed_calls(spark: SparkSession, d: str) -> DataFrame:
    return identity.replayed_calls(_party(spark, d), _replayed(spark, d), ["grt"], ["vessel_name"]).select("call_id", "n_members", "grt", "merged_into")


# ---------------------------------------------------------------- the newest source row of a call

BINDINGS["source_rows"] = """
    select concat('B', cast(o_orderkey % 13 as varchar(20))) as batch_id, 'VesselCalls.xlsx' as file, cast(o_orderkey as int) as row_number, concat('V', cast(o_custkey as varchar(20))) as vcn, o_orderdate as eta,
        case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then o_orderdate - interval '1' day else o_orderdate + interval '1' day end as ata
    from {orders}"""
BINDINGS["source_batches"] = "select concat('B', cast(r as varchar(20))) as batch_id, r * 37 % 13 as created_at, case r % 4 when 0 then 'FAILED' when 1 then 'PROCESSING' else 'COMMITTED' end as status from (select distinct o_orderkey % 13 as r from {orders}) t"
_SOURCE = f"""{_CALLS}, source_rows as ({oracle('source_rows')}), batches as ({oracle('source_batches')}), dated as (select s.*, b.created_at, row_number() over (partition by vcn order by b.created_at desc, s.batch_id desc, s.row_number desc) as rn from source_rows s join batches b using (batch_id) where b.status <> 'FAILED'),
    newest as (select c.call_id, d.eta, d.ata from dated d join calls c using (vcn) where rn = 1)"""


def _source(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = bound(spark, d, "source_rows")
    staged = _stage(rows, "VesselCalls", {"VCN": "vcn", "ETA": at("eta"), "ATA": F.coalesce(at("ata"), F.lit(" "))}).withColumn("batch_id", F.concat(F.lit("B"), (F.col("row_number") % 13).cast("string")))
    newest = canonical.newest_rows(staged, bound(spark, d, "source_batches"))
    return canonical.source_times(newest, bound(spark, d, "calls"))


@query("source_row_issues", f"with {_SOURCE} select 'DQ-003' as rule_id, call_id, concat('call:', call_id) as record_reference from newest where ata is null union all select 'DQ-004', call_id, concat('call:', call_id) from newest where eta > ata")
def source_row_issues(spark: SparkSession, d: str) -> DataFrame:
    """DQ-003, DQ-004 by what the source said last of each call."""
    return quality.source_row_issues(_source(spark, d)).select("rule_id", "call_id", "record_reference")


@query("gated_turnarounds", f"with {_SOURCE}, {_POINTS}, {_LEAD} select call_id, metric, case when metric = 'Turnaround' and b.call_id is not null then null else hours end as hours, case when metric = 'Turnaround' and b.call_id is not null then 'UNAVAILABLE' else status end as status, case when metric = 'Turnaround' and b.call_id is not null then 'SOURCE_ATA_BLANK' else reason end as reason from lead_rows l left join (select call_id from newest where ata is null) b using (call_id)")
def gated_turnarounds(spark: SparkSession, d: str) -> DataFrame:
    """TM-14: a call with a blank ATA in its newest row has no turnaround, though it has the events."""
    return leadtime.gate_turnaround(_lead_times(spark, d), _source(spark, d)).select("call_id", "metric", "hours", "status", "reason")


# ---------------------------------------------------------------- stored runs

_OWN = "call_id in (select call_id from calls)"
_BULK_FW = _FW_KPI.replace(_CARGO, f"cargo as (select * from ({oracle('cargo')}) where {_OWN})").replace("from live where event_name in ('SHIFT_PILOT", f"from live where {_OWN} and event_name in ('SHIFT_PILOT")
_BULK_KPI = f"with all_calls as ({oracle('calls')}), calls as (select * from all_calls where vessel_type = 'Bulk'), {_BULK_FW} select kpi, value from kpis"
_ALL_KPI = f"with {_CALLS}, {_FW_KPI} select kpi, value from kpis"


def _kpi_run(spark: SparkSession, d: str, points: DataFrame, where: str) -> DataFrame:
    shifts = kpi.pair_shifts(events.live(_events(spark, d)), *registry.REPEATABLE)
    measured = kpi.measures(kpi.population(bound(spark, d, "calls").filter(where), points), points, bound(spark, d, "cargo"), shifts, unit=UNIT)
    return kpi.results(measured, registry.kpis(spark)).join(F.broadcast(registry.kpis(spark).select("kpi", "direction", "alias_of")), "kpi")


@query(
    "kpi_trend_of_runs",
    f"""with one as ({_BULK_KPI}), two as ({_ALL_KPI}), reg as (select * from {_values([(k[0], k[5]) for k in registry.KPIS])} as t(kpi, direction)), h as (select kpi, timestamp '2026-01-01' as calculated_at, value from one where value is not null union all select kpi, timestamp '2026-02-01', value from two where value is not null),
    t as (select kpi, calculated_at, value, value - lag(value) over w as delta, lag(value) over w as before from h window w as (partition by kpi order by calculated_at))
    select kpi, calculated_at, round(value, 4) as value, round(delta, 4) as delta, round(delta / nullif(abs(before), 0) * 100, 2) as change_pct, case when delta is null or abs(delta) <= 0.01 then 'STABLE' when (direction = 'LOWER' and delta < 0) or (direction <> 'LOWER' and delta > 0) then 'IMPROVING' else 'DETERIORATING' end as trend from t join reg using (kpi)""",
)
def kpi_trend_of_runs(spark: SparkSession, d: str) -> DataFrame:
    """KF-11, KF-12: the results of two runs are stored, one of them twice to no effect, and the trend reads what is stored."""
    path, points = _place(spark, "kpi-runs"), _points(spark, d)
    for run, at, where in (("r1", "2026-01-01", "vessel_type = 'Bulk'"), ("r2", "2026-02-01", "true"), ("r1", "2026-01-01", "false")):
        store.append_run(spark, path, _kpi_run(spark, d, points, where).withColumn("calculated_at", F.lit(at).cast("timestamp_ntz")), run)
    found = kpi.trend(store.history(spark, path))
    return found.select("kpi", "calculated_at", "value", "delta", "change_pct", "trend")


@query("statistics_of_runs", f"with {_CALLS}, {_POINTS}, {_LEAD} select metric, 'bulk' as cohort, 'r2' as run_id, count(hours) as n, round(median(hours), 4) as median from lead_rows join calls using (call_id) where vessel_type = 'Bulk' and status = 'AVAILABLE' group by metric")
def statistics_of_runs(spark: SparkSession, d: str) -> DataFrame:
    """KF-18: statistics of two runs are stored; the listing takes the newest of the cohort."""
    path, rows = _place(spark, "statistics-runs"), _lead_times(spark, d).filter("status = 'AVAILABLE'").join(bound(spark, d, "calls").select("call_id", "vessel_type"), "call_id")
    for run, cohort, where in (("r1", "bulk", "call_id % 2 = 0"), ("r2", "bulk", "true"), ("r3", "tankers", "true")):
        kind = "Bulk" if cohort == "bulk" else "Tanker"
        one = stats.with_quantiles(rows.filter(where).filter(F.col("vessel_type") == kind), ["metric"], "hours", {"median": (0.5, "linear")})
        store.append_run(spark, path, one.select("metric", F.lit(cohort).alias("cohort"), F.lit(run).alias("calculated_at"), "n", F.round("median", 4).alias("median")), run)
    return kpi.statistics_listing(store.history(spark, path), cohort="bulk").select("metric", "cohort", "run_id", "n", "median")


# ---------------------------------------------------------------- staged delays and cargo

_DELAY_ALIASES = [("Delays", t, c) for t, c in (("vcn", "VCN"), ("delayid", "Delay_ID"), ("movementtype", "Movement_Type"), ("scheduledtime", "Scheduled_Time"), ("servedtime", "Served_Time"), ("delayhours", "Delay_Hours"), ("delayreason", "Delay_Reason"), ("delaycategory", "Delay_Category"), ("causestatus", "Cause_Status"), ("confidence", "Confidence"))]
BINDINGS["delay_sheet"] = """
    select concat(o_orderpriority, '.xlsx') as file, cast(o_orderkey + 2 as int) as row_number, concat('V', cast(o_custkey as varchar(20))) as vcn, concat('D', cast(o_orderkey as varchar(20))) as delay_id, case o_orderstatus when 'F' then 'Arrival' when 'O' then 'Sailing' else 'Shifting' end as movement,
        o_orderdate as scheduled, case when o_orderkey % 19 = 0 then null else o_orderdate + interval '1' hour * (o_orderkey % 9) - interval '1' hour * (o_custkey % 4) end as served,
        case when o_orderkey % 3 = 0 then null when o_orderkey % 10 = 1 then 2.5 else cast(o_orderkey % 9 - o_custkey % 4 as double) end as stated, case o_orderkey % 6 when 0 then 'High winds' when 1 then 'Tug late' when 2 then '' when 3 then 'Crane fault' when 4 then 'Berth occupied' else 'Something' end as reason,
        case o_custkey % 3 when 0 then 'Marine Service' when 1 then '' else 'Documentation' end as category, case o_orderkey % 2 when 0 then 'Confirmed' else 'Reported' end as cause, case o_orderkey % 4 when 0 then 'High' when 1 then 'Medium' else '' end as confidence, o_orderpriority as remark
    from {orders}"""


def _delay_cells(spark: SparkSession, d: str) -> DataFrame:
    """The delays as cells of a workbook for each priority, the header in row 1."""
    at = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    columns = {"V.C.N.": "vcn", "Delay ID": "delay_id", "Movement Type": "movement", "Scheduled Time": at("scheduled"), "Served Time": at("served"), "Delay Hours": F.coalesce(F.col("stated").cast("string"), F.lit("")), "Delay Reason": "reason", "Delay Category": "category", "Cause Status": "cause", "Confidence": "confidence", "Remark": "remark"}
    rows = bound(spark, d, "delay_sheet")
    body = rows.select("file", F.lit("Delays").alias("sheet"), "row_number", F.posexplode(F.array(*[F.col(c) if isinstance(c, str) else c for c in columns.values()])).alias("column_number", "value"))
    head = rows.select("file").distinct().select("file", F.lit("Delays").alias("sheet"), F.lit(1).alias("row_number"), F.posexplode(F.array(*[F.lit(x) for x in columns])).alias("column_number", "value"))
    return body.unionByName(head)


def _staged_delays(spark: SparkSession, d: str) -> DataFrame:
    cells, aliases = _delay_cells(spark, d), spark.createDataFrame(_DELAY_ALIASES, "target string, token string, column string")
    headers = landing.detect_headers(cells, aliases, {"Delays": ["VCN", "Scheduled_Time", "Served_Time"]})
    raw = landing.raw_cells(cells, headers, landing.name_columns(cells, headers), aliases)
    return landing.validate_staging(landing.normalise_rows(raw), ["Scheduled_Time", "Served_Time"])


_DELAY_ROWS = f"""{_KNOWN_CALLS}, sheet as ({oracle('delay_sheet')}), dl as (select s.*, k.call_id, nullif(s.reason, '') as why, nullif(s.category, '') as cat from sheet s join known_calls k using (vcn)),
    dr as (select *, {_hours('scheduled', 'served', 4)} as again from dl), dh as (select *, coalesce(stated, again, 0.0) as hours from dr)"""
_KEYWORDS = "case when lower(coalesce(why, '')) like '%wind%' then 'Weather' when lower(coalesce(why, '')) like '%tug%' then 'Tug' when lower(coalesce(why, '')) like '%berth%' then 'Berth Non-Availability' when lower(coalesce(why, '')) like '%crane%' then 'Crane Downtime' when cat = 'Marine Service' then 'Port-Side' when cat = 'Documentation' then 'Documentation' else 'Other' end"


@query("delays_from_cells", f"with {_DELAY_ROWS} select delay_id, call_id, movement as leg, again as recalculated_hours, hours, coalesce(round(abs(again - stated), 6) > 0.02, false) as is_mismatch, hours < 0 as is_early, hours > 0 and (why is null or cat is null) as needs_review, {_KEYWORDS} as category, case when cause = 'Confirmed' then 'CONFIRMED' else 'INFERRED' end as allocation, case confidence when 'High' then 1.0 when 'Medium' then 0.7 else 0.5 end as allocation_confidence, remark from dh")
def delays_from_cells(spark: SparkSession, d: str) -> DataFrame:
    """CAN-06, CAN-08, CAN-09: from the cells of workbooks to reconciled delays, with what the sheet says besides."""
    found = delays.reconcile_delays(canonical.delays(_staged_delays(spark, d), _known_calls(spark, d))).withColumn("remark", F.try_element_at("attributes", F.lit("Remark")))
    return found.select("delay_id", "call_id", "leg", "recalculated_hours", "hours", "is_mismatch", "is_early", "needs_review", "category", "allocation", "allocation_confidence", "remark")


@query("cargo_attributes", f"with {_KNOWN_CALLS}, s as ({oracle('staged_services')}) select concat(file, ':CargoOps:', row_number) as cargo_id, resource as cargo_type, concat(file, ':CargoOps:', row_number) as record_reference, nullif(service_type, '') as shift from s join known_calls using (vcn)")
def cargo_attributes(spark: SparkSession, d: str) -> DataFrame:
    """CAN-06: what cargo rows say beyond the known columns."""
    staged = _stage(bound(spark, d, "staged_services"), "CargoOps", {"VCN": "vcn", "Cargo_Type": "resource", "Shift": "service_type", "Actual_Quantity": "quantity"})
    rows = canonical.cargo_operations(staged, _known_calls(spark, d))
    return rows.select("cargo_id", "cargo_type", "record_reference", F.try_element_at("attributes", F.lit("Shift")).alias("shift"))


# ---------------------------------------------------------------- listings and figures in full

_SYSTEMS = _values([(k, ",".join(v)) for k, v in registry.REQUIRED_SYSTEMS.items()])
_REG = f"reg as (select * from {_values(registry.KPIS)} as t(kpi, name, category, unit, target, direction, green, amber, computed, alias_of))"


@query("kpi_required_systems", f"with {_CALLS}, {_FW_KPI}, sys as (select * from {_SYSTEMS} as t(kpi, systems)) select kpi, status, case when status = 'NO_SOURCE_DATA' then coalesce(systems, '') else '' end as required_systems from kpis left join sys using (kpi)")
def kpi_required_systems(spark: SparkSession, d: str) -> DataFrame:
    found = kpi.with_required_systems(_kpis(spark, d), registry.required_systems(spark))
    return found.select("kpi", "status", F.array_join("required_systems", ",").alias("required_systems"))


@query("kpi_catalogue", f"with {_CALLS}, {_FW_KPI}, c as (select r.kpi, r.category, case when computed then 'COMPUTED' else 'NO_SOURCE_DATA' end as availability, alias_of is null as is_primary, k.status as result_status from reg r left join kpis k using (kpi)) select * from c where availability = 'COMPUTED' and is_primary")
def kpi_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """KF-21: primary KPIs that have source data, with the status of their results."""
    return kpi.catalogue(registry.kpis(spark), _kpis(spark, d), availability="COMPUTED", is_primary=True).select("kpi", "category", "availability", "is_primary", "result_status")


@query("kpi_availability", f"with {_CALLS}, {_FW_KPI} select case when computed then 'COMPUTED' else 'NO_SOURCE_DATA' end as availability, k.status as result_status, count(*) as n from reg r left join kpis k using (kpi) group by all")
def kpi_availability(spark: SparkSession, d: str) -> DataFrame:
    return kpi.availability_counts(kpi.catalogue(registry.kpis(spark), _kpis(spark, d)))


@query("scorecard_results", f"with {_CALLS}, {_FW_KPI} select r.category, r.kpi, r.name, k.value, k.band, k.status, timestamp '2026-03-01' as calculated_at from reg r left join kpis k using (kpi) where alias_of is null")
def scorecard_results(spark: SparkSession, d: str) -> DataFrame:
    """KF-15: the newest of stored results by category; an older run is stored after the newer one."""
    path, found = _place(spark, "scorecard"), saved(_kpis(spark, d))
    for run, at, value in (("new", "2026-03-01", F.col("value")), ("old", "2026-02-01", F.lit(-1.0))):
        store.append_run(spark, path, found.withColumns({"value": value, "calculated_at": F.lit(at).cast("timestamp_ntz")}), run)
    return kpi.scorecard_results(kpi.latest(store.history(spark, path)), registry.kpis(spark)).select("category", "kpi", "name", "value", "band", "status", "calculated_at")


@query("service_records", f"with {_TIMINGS} select service_type, leg, service_id as record_id, call_id, delay_hours is null as is_missing from timings")
def service_records(spark: SparkSession, d: str) -> DataFrame:
    return kpi.service_records(_timings(spark, d))


_OPERATIONS = f"{_KNOWN_CALLS}, ops as (select case when broken = 1 then null when resource = 'F' then 'Container' else 'Bulk' end as cargo_type, case broken when 2 then null when 3 then 'Pallets' when 4 then 'TEU' else 'MT' end as unit, cast(quantity as double) as quantity from ({oracle('staged_services')}) join known_calls using (vcn))"
_BREAKDOWN = f"{_OPERATIONS}, br as (select coalesce(cargo_type, 'General') as cargo_type, coalesce(unit, 'Units') as unit, round(coalesce(sum(quantity), 0), 1) as quantity, count(*) as n_operations from ops group by 1, 2)"


def _operations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("broken") == 1, None).when(F.col("resource") == "F", "Container").otherwise("Bulk")
    unit = F.when(F.col("broken") == 2, " ").when(F.col("broken") == 3, "Pallets").when(F.col("broken") == 4, "TEU").otherwise("MT")
    staged = _stage(bound(spark, d, "staged_services"), "CargoOps", {"VCN": "vcn", "Cargo_Type": kind, "Unit": unit, "Actual_Quantity": "quantity"})
    return canonical.cargo_operations(staged, _known_calls(spark, d))


@query("cargo_breakdown", f"with {_BREAKDOWN} select * from br")
def cargo_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.cargo_breakdown(_operations(spark, d))


@query("breakdown_totals", f"with {_BREAKDOWN} select unit, round(sum(quantity), 1) as quantity, sum(n_operations) as n_operations from (select case when unit in ('TEU', 'MT', 'Units') then unit when cargo_type = 'Container' then 'TEU' when cargo_type = 'Bulk' then 'MT' else 'Units' end as unit, quantity, n_operations from br) group by unit")
def breakdown_totals(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.breakdown_totals(dashboard.cargo_breakdown(_operations(spark, d)))


@query("duration_traces", f"with {_CALLS}, {_POINTS}, {_LEAD} select call_id, metric, hours, status, reason, source_ids from lead_rows where metric in ('Turnaround', 'Anchorage Wait', 'Berth Stay')")
def duration_traces(spark: SparkSession, d: str) -> DataFrame:
    rows = dashboard.duration_traces(_lead_times(spark, d), ["Turnaround", "Anchorage Wait", "Berth Stay"])
    return rows.select("call_id", F.inline("trace")).withColumn("source_ids", _joined("source_ids"))


_OLD = f"""{_CALLS}, {_POINTS}, {_LEAD}, f as (select case when call_id % 3 = 0 then null else 'R' end as rule, call_id, 'Turnaround' as metric, hours as value, 100.0 as threshold, case when hours > 300 then 'CRITICAL' when hours > 150 then 'HIGH' else 'MEDIUM' end as severity, case when call_id % 2 = 0 then 'OPERATIONAL_OUTLIER' else 'Sequence Outlier' end as category, source_ids from lead_rows where metric = 'Turnaround' and status = 'AVAILABLE' and hours > 100)"""


@query("outliers_presented", f"with {_OLD} select coalesce(rule, '') as rule, call_id, vcn, category, round(value - threshold, 4) as divergence, severity, is_legacy, case when is_legacy then source_ids else '' end as source_ids, case when is_legacy then 'Historical threshold' end as threshold_label, row_number() over (order by severity desc, round(value - threshold, 4) desc, rule nulls first, call_id) as position from (select *, category = 'OPERATIONAL_OUTLIER' and rule is null as is_legacy from f where category = 'OPERATIONAL_OUTLIER') join calls using (call_id)".replace("call_id, vcn, category,", "call_id, vcn, 'Time-based Outlier' as category,"))
def outliers_presented(spark: SparkSession, d: str) -> DataFrame:
    """OL-LIST: old turnaround outliers, some without a rule, in the order of the listing, with the sources of the call's turnaround."""
    lead = saved(_lead_times(spark, d).filter("metric = 'Turnaround' and status = 'AVAILABLE'").withColumn("calculated_at", F.lit(1)))
    old = lead.filter("hours > 100").select(F.when(F.col("call_id") % 3 != 0, "R").alias("rule"), "call_id", "metric", F.col("hours").alias("value"), F.lit(100.0).alias("threshold"), F.when(F.col("hours") > 300, "CRITICAL").when(F.col("hours") > 150, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(F.col("call_id") % 2 == 0, outlier.LEGACY).otherwise("Sequence Outlier").alias("category"), F.lit(False).alias("is_excluded"), F.array().cast("array<string>").alias("source_ids"))
    rows = outlier.presented(old, bound(spark, d, "calls"), lead, category="Time-based Outlier")
    number = F.row_number().over(Window.orderBy(F.desc("severity"), F.desc("divergence"), F.col("rule").asc_nulls_first(), "call_id"))  # a listing is one ordered list
    return rows.select(F.coalesce("rule", F.lit("")).alias("rule"), "call_id", "vcn", "category", "divergence", "severity", "is_legacy", _joined("source_ids").alias("source_ids"), "threshold_label", number.cast("long").alias("position"))


@query("file_manifest")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """ING-01: checksums of the files of the star schema. SQL has no view of the files; a test holds it against hashlib."""
    return landing.file_manifest(spark, [f"{d}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")])
