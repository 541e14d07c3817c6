"""Registered queries of operators that take decisions: corrections, allocations, reviews, exclusions, merges, earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, canonical, dashboard, delays, events, identity, journey, kpi, lifecycle, outlier, quality
from ..sources.tables import bound
from . import registry
from .queries import _CALLS, _CARGO, _EVENTS, _POINTS, _STAGES, _TIMINGS, _events, _points, _stages, _timings, _values, query
from .queries2 import _DB, _DELAYS, _ISSUES, _KPI, _PAIRS, _SQL_PARTY, _batches, _delays, _issues, _kpis, _party


@query("corrected_events", f"with {_EVENTS}, c as (select * from events where event_name = 'ATA' and verification_status = 'Conflicting') select event_name, count(*) as n, count(*) filter (s) as n_superseded, max(i) as max_index from (select event_name, is_superseded or event_id in (select event_id from c) as s, occurrence_index as i from events union all select event_name, false, occurrence_index + 1000 from c) group by event_name")
def corrected_events(spark: SparkSession, d: str) -> DataFrame:
    """Conflicting arrivals are set to the time their record was made."""
    ev = _events(spark, d)
    fixes = ev.filter("event_name = 'ATA' and verification_status = 'Conflicting'").select("event_id", F.col("created_at").alias("utc"))
    got = events.apply_corrections(ev, fixes.distinct())
    return got.groupBy("event_name").agg(F.count("*").alias("n"), F.count_if("is_superseded").alias("n_superseded"), F.max("occurrence_index").cast("long").alias("max_index"))


_SPLIT = "with_share as (select delay_id, category, hours * 0.6 as hours, false as is_primary, 1 as ordinal from delays where hours > 0 union all select delay_id, 'Other', case when is_mismatch then hours * 0.6 else hours * 0.4 end, allocation = 'CONFIRMED', 2 from delays where hours > 0)"


@query("delay_allocations", f"with {_DELAYS}, {_SPLIT}, s as (select w.*, d.hours as total, sum(w.hours) over (partition by delay_id) as h, row_number() over (partition by delay_id order by is_primary desc, ordinal) as n from with_share w join delays d using (delay_id)) select category, count(*) as n, count(*) filter (n = 1) as n_primary, round(sum(hours), 2) as hours from s where h <= total + 0.01 group by category")
def delay_allocations(spark: SparkSession, d: str) -> DataFrame:
    """Each delay in two parts; mismatched ones claim too much and are refused."""
    rows = _delays(spark, d)
    late = rows.filter("hours > 0")
    one = late.select("delay_id", "category", (F.col("hours") * 0.6).alias("hours"), F.lit(False).alias("is_primary"), F.lit(1).alias("ordinal"))
    two = late.select("delay_id", F.lit("Other").alias("category"), F.when(F.col("is_mismatch"), F.col("hours") * 0.6).otherwise(F.col("hours") * 0.4).alias("hours"), (F.col("allocation") == "CONFIRMED").alias("is_primary"), F.lit(2).alias("ordinal"))
    accepted, _ = delays.apply_allocations(rows, one.union(two))
    return accepted.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"), F.round(F.sum("hours"), 2).alias("hours"))


@query("delay_reviews", f"with {_DELAYS} select case when needs_review and leg = 'Arrival' then 'Mooring' else category end as category, count(*) as n, count(*) filter (needs_review and leg <> 'Arrival') as n_review from delays group by 1")
def delay_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals under review are put down to mooring."""
    rows = _delays(spark, d)
    reviews = rows.filter("needs_review and leg = 'Arrival'").select("delay_id", F.lit("Mooring").alias("category"), F.lit("Lines parted").alias("reason"))
    return delays.apply_reviews(rows, reviews).groupBy("category").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"))


@query("suppressed_alerts", f"with {_DELAYS}, a as (select delay_id from delays where needs_review) select count(*) as n_alerts from a where delay_id not in (select delay_id from delays where needs_review and leg in ('Arrival', 'Sailing'))")
def suppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of arrivals are new, of sailings acknowledged, of shiftings resolved."""
    rows = _delays(spark, d).filter("needs_review")
    found = rows.select(F.lit("MISSING_DELAY_REASON").alias("rule"), F.lit("delay").alias("entity_type"), F.col("delay_id").alias("entity_id"))
    status = F.when(F.col("leg") == "Arrival", "NEW").when(F.col("leg") == "Sailing", "ACKNOWLEDGED").otherwise("RESOLVED")
    return alerts.suppress(found, rows.select(F.lit("MISSING_DELAY_REASON").alias("rule"), F.lit("delay").alias("entity_type"), F.col("delay_id").alias("entity_id"), status.alias("status"))).agg(F.count("*").alias("n_alerts"))


@query("merged_issues", f"with {_ISSUES}, old as (select rule_id, record_reference, case severity when 'CRITICAL' then 'RESOLVED' else 'OPEN' end as status from issues where rule_id <> 'DQ-007') select rule_id, status, count(*) as n from (select rule_id, status from old union all select distinct_new.rule_id, 'OPEN' from (select distinct rule_id, record_reference from issues) distinct_new where not exists (select 1 from old where status = 'OPEN' and old.rule_id = distinct_new.rule_id and old.record_reference = distinct_new.record_reference)) group by 1, 2")
def merged_issues(spark: SparkSession, d: str) -> DataFrame:
    """A second run of the rules: open issues stay single, resolved ones come again."""
    new = _issues(spark, d)
    old = new.filter("rule_id <> 'DQ-007'").withColumn("status", F.when(F.col("severity") == "CRITICAL", "RESOLVED").otherwise("OPEN"))
    return quality.merge_issues(new, old).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("kept_exclusions", f"with {_POINTS}, {_PAIRS}, k as (select rule, severity = 'CRITICAL' as x from pair_out) select rule, x as is_excluded, count(*) as n from k group by 1, 2")
def kept_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Critical outliers were excluded before."""
    found = outlier.pair_outliers(_points(spark, d), registry.OUTLIER_PAIRS)
    previous = found.filter("severity = 'CRITICAL'").select("rule", "call_id", F.lit(True).alias("is_excluded"), F.lit("seen").alias("rationale"))
    return outlier.keep_exclusions(found, previous).groupBy("rule", "is_excluded").agg(F.count("*").alias("n"))


_PEERS = [("KPI-03", "North", 4.0), ("KPI-03", "South", 6.5), ("KPI-15", "North", 20.0)]


@query("kpi_benchmarks", f"with {_KPI}, peers as (select * from {_values(_PEERS)} as t(kpi, peer, peer_value)) select kpi, value, peer, peer_value, round(value - peer_value, 4) as peer_gap, case when peer is null then 'ABSENT' else 'PRESENT' end as peer_status from kpis left join peers using (kpi)")
def kpi_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    peers = spark.createDataFrame(_PEERS, "kpi string, peer string, peer_value double")
    return kpi.with_benchmarks(_kpis(spark, d), peers).select("kpi", "value", "peer", "peer_value", "peer_gap", "peer_status")


@query("service_drill", f"with {_TIMINGS} select call_id, service_id, service_type, leg, delay_hours from timings where service_type = 'Pilotage' and leg = 'Arrival' and status = 'LATE'")
def service_drill(spark: SparkSession, d: str) -> DataFrame:
    return kpi.service_drill(_timings(spark, d), "Pilotage", "Arrival", "LATE").select("call_id", "service_id", "service_type", "leg", "delay_hours")


@query("dashboard_population", f"with {_ISSUES} select call_id, vessel_type from calls join parts using (call_id) where vessel_type = 'Bulk' and quality_status = 'FLAGGED'")
def dashboard_population(spark: SparkSession, d: str) -> DataFrame:
    calls = bound(spark, d, "calls")
    parts = quality.partition(calls, _issues(spark, d))
    return dashboard.population(calls, _points(spark, d), parts, vessel_type="Bulk", quality_status="FLAGGED").select("call_id", "vessel_type")


@query("last_quantities", f"with {_CALLS}, {_CARGO} select c.call_id, arg_max(quantity, cargo_id) as quantity, arg_max(unit, cargo_id) as quantity_unit from calls c left join cargo using (call_id) group by c.call_id")
def last_quantities(spark: SparkSession, d: str) -> DataFrame:
    return canonical.with_last_quantity(bound(spark, d, "calls"), bound(spark, d, "cargo")).select("call_id", "quantity", "quantity_unit")


@query("movement_scopes", f"with {_EVENTS} select scope, event_name, count(*) as n from (select event_name, case source_system when 'AIS' then 'ARRIVAL' when 'VTS' then 'SAILING' when 'Manual Log' then 'SHIFTING' else case when event_name like '%SAILING%' or event_name like '%DEPARTURE%' or event_name like '%OUT%' then 'SAILING' when event_name like '%SHIFT%' then 'SHIFTING' else 'ARRIVAL' end end as scope from events) group by 1, 2")
def movement_scopes(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("source_system") == "AIS", "Inward").when(F.col("source_system") == "VTS", "Departure").when(F.col("source_system") == "Manual Log", "Shifting").otherwise("")
    return _events(spark, d).groupBy(events.movement_scope(said, F.col("event_name")).alias("scope"), "event_name").agg(F.count("*").alias("n"))


@query("orphan_events", f"with {_EVENTS}, {_CALLS} select event_name, count(*) as n from events where call_id not in (select call_id from calls where terminal is not null) group by event_name")
def orphan_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of calls that aren't among those with a terminal."""
    known = bound(spark, d, "calls").filter("terminal is not null").select(F.col("call_id").alias("vcn"), "call_id")
    _, orphans = canonical.resolve(_events(spark, d).withColumnRenamed("call_id", "vcn"), known)
    return orphans.groupBy("event_name").agg(F.count("*").alias("n"))


@query("dataset_files", f"with {_DB}, n as (select *, row_number() over (partition by tenant, checksum order by case status when 'COMMITTED' then 0 else 1 end, batch_id) as k from batches where status <> 'FAILED'), p as (select *, row_number() over (partition by tenant order by case status when 'COMMITTED' then 0 else 1 end, batch_id) as i from n where k = 1) select tenant, case when i <= 15 then 'ACCEPTED' else 'REJECTED' end as intake, count(*) as n from p group by 1, 2")
def dataset_files(spark: SparkSession, d: str) -> DataFrame:
    """Committed files are active, pending ones are appended."""
    rows = _batches(spark, d).select("tenant", F.col("batch_id").alias("file"), "checksum", "status")
    got = lifecycle.append_files(rows.filter("status = 'COMMITTED'").drop("status"), rows.filter("status = 'PENDING'").drop("status"))
    return got.groupBy("tenant", "intake").agg(F.count("*").alias("n"))


@query("journey_versions", f"with {_CALLS}, {_POINTS}, {_STAGES}, j as (select call_id, count(*) filter (status <> 'MISSING') as n from stage_rows group by call_id) select call_id, case when vessel_type = 'Bulk' then 4 else 1 end as version from j join calls using (call_id)")
def journey_versions(spark: SparkSession, d: str) -> DataFrame:
    """Bulk calls have three versions already."""
    history = bound(spark, d, "calls").filter("vessel_type = 'Bulk'").select("call_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version"))
    return journey.next_version(journey.journeys(_stages(spark, d)), history).select("call_id", "version")


@query("consolidated_calls", f"with {_SQL_PARTY}, pr as (select x.call_id as a, y.call_id as b from party x join party y on x.call_id < y.call_id and (x.vcn = y.vcn or x.imo = y.imo) and not coalesce(x.vcn <> y.vcn, false) and not coalesce(x.imo <> y.imo, false)), m as (select distinct a, b from pr) select a as survivor_id, cast(2 as bigint) as n_members, greatest(x.grt, y.grt) as grt, x.vessel_type from m join party x on x.call_id = a join party y on y.call_id = b")
def consolidated_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = _party(spark, d)
    groups = identity.survivors(identity.merge_groups_by_key(_party(spark, d)), rows, ["vcn", "imo", "vessel_type", "flag", "grt"])
    return identity.consolidate(groups, rows, ["grt"], ["vessel_type"]).select("survivor_id", "n_members", "grt", "vessel_type")
