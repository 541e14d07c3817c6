"""Registered queries for branches that the other queries' data don't reach: aliases with a value, fallbacks, weights, overrides, skipped files, second choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import name_similarity
from ..operators import bottleneck, delays, events, identity, kpi, outlier, quality
from ..sources import landing
from ..sources.tables import BINDINGS, bound, oracle, table
from . import registry
from .queries import _CALLS, _EVENTS, _LEAD, _POINTS, _TIMINGS, _events, _lead_times, _points, _timings, _values, query
from .queries2 import _DELAYS, _FW_KPI, _ISSUES, _STAGED, UNIT, _delays, _issues, _validated


@query(
    "kpi_alias_values",
    f"""with {_CALLS}, {_FW_KPI}, a as (select * from {_values([("KPI-90", "KPI-03", 0.0, 0.0, "LOWER"), ("KPI-91", "KPI-03", 1000.0, 2000.0, "LOWER"), ("KPI-92", "KPI-45", 0.0, 0.0, "HIGHER")])} as t(kpi, of, green, amber, direction))
    select a.kpi, value, 'ALIAS' as status, case when direction = 'LOWER' then case when value <= green then 'GREEN' when value <= amber then 'AMBER' else 'RED' end else case when value >= green then 'GREEN' when value >= amber then 'AMBER' else 'RED' end end as band from a join kpis on kpis.kpi = a.of where value is not null""",
)
def kpi_alias_values(spark: SparkSession, d: str) -> DataFrame:
    """KF-08: aliases of KPIs that have a value show it under limits of their own."""
    rows = [("KPI-90", "KPI-03", 0.0, 0.0, "LOWER"), ("KPI-91", "KPI-03", 1000.0, 2000.0, "LOWER"), ("KPI-92", "KPI-45", 0.0, 0.0, "HIGHER")]
    more = spark.createDataFrame([(k, k, "Aliases", "hours", green, way, green, amber, True, of) for k, of, green, amber, way in rows], registry.KPI_SCHEMA)
    points = _points(spark, d)
    shifts = kpi.pair_shifts(events.live(_events(spark, d)), *registry.REPEATABLE)
    measured = kpi.measures(kpi.population(bound(spark, d, "calls"), points), points, bound(spark, d, "cargo"), shifts, unit=UNIT)
    return kpi.results(measured, more).filter("value is not null").select("kpi", "value", "status", "band")


@query("kpi_of_period", f"with all_calls as ({oracle('calls')}), all_points as (with {_POINTS} select * from points), calls as (select c.* from all_calls c left join all_points a on a.call_id = c.call_id and a.event_name = 'ATA' where a.utc is null or a.utc between timestamp '1995-01-01' and timestamp '1996-12-31'), {_FW_KPI} select kpi, value from kpis where kpi in ('KPI-01', 'KPI-03', 'KPI-15', 'KPI-41')")
def kpi_of_period(spark: SparkSession, d: str) -> DataFrame:
    """KF-02: calls by their ATA; those without one pass."""
    points = _points(spark, d)
    shifts = kpi.pair_shifts(events.live(_events(spark, d)), *registry.REPEATABLE)
    chosen = kpi.population(bound(spark, d, "calls"), points, start="1995-01-01", end="1996-12-31")
    measured = kpi.measures(chosen, points, bound(spark, d, "cargo"), shifts, unit=UNIT)
    return kpi.results(measured, registry.kpis(spark)).filter("kpi in ('KPI-01', 'KPI-03', 'KPI-15', 'KPI-41')").select("kpi", "value")


@query("bottleneck_fallback", f"with {_TIMINGS}, {_DELAYS} select 'Tug Availability / Shortage' as name, count(*) as n, round(sum(delay_hours), 4) as hours, 0.5 as target from timings where kind = 'TUG' and status = 'LATE' union all select 'Pilot Availability / Shortage', count(*), round(sum(hours), 4), 0.5 from delays where category = 'Pilot' and hours > 0 having count(*) > 0")
def bottleneck_fallback(spark: SparkSession, d: str) -> DataFrame:
    """BN-02: without stated tug delays, the late tug services stand for them; pilots have stated ones."""
    targets = spark.createDataFrame(registry.BOTTLENECK_STAGES, "metric string, target double")
    found = bottleneck.candidates(_lead_times(spark, d).limit(0), _delays(spark, d).filter("category <> 'Tug'"), _timings(spark, d), targets)
    return found.filter("name like 'Tug%' or name like 'Pilot%'").groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("hours"), 4).alias("hours"), F.max("target").alias("target"))


@query(
    "criticality_weighted",
    f"""with {_CALLS}, {_POINTS}, {_LEAD}, k as (select *, row_number() over (partition by metric order by hours) as r, count(*) over (partition by metric) as n from lead_rows where hours is not null),
    m as (select metric, avg(hours) as mean, coalesce(stddev_samp(hours), 0) as sd, max(hours) filter (r = floor(n / 2) + 1) as median, max(hours) filter (r = greatest(1, ceil(round(n * 0.9, 9)))) as p90 from k group by metric),
    c as (select *, case when mean > 0 then sd / mean else 0 end as cv, case when median > 0 then p90 / median else 1 end as tr from m),
    l as (select *, case when mean >= 36 then 5 when mean >= 18 then 4 when mean >= 6 then 3 when mean >= 2 then 2 else 1 end as a, case when cv >= 1.2 then 5 when cv >= 0.8 then 4 when cv >= 0.5 then 3 when cv >= 0.2 then 2 else 1 end as b, case when tr >= 3.5 then 5 when tr >= 2.5 then 4 when tr >= 1.8 then 3 when tr >= 1.3 then 2 else 1 end as t from c)
    select metric, round((a * 3 + b * 1 + t * 0.5) / 4.5, 2) as score from l""",
)
def criticality_weighted(spark: SparkSession, d: str) -> DataFrame:
    """CR-01: durations count three times, tails half."""
    return bottleneck.criticality(_lead_times(spark, d).filter("hours is not null"), weights=(3.0, 1.0, 0.5)).select("metric", "score")


_OVERRIDES = "overrides as (select call_id, event_name, max(event_id) as event_id from events where call_id % 5 = 0 and event_name not in ('SHIFT_PILOT_ON_BOARD', 'SHIFT_ALL_FAST') group by call_id, event_name)"


@query("overridden_observations", f"with {_EVENTS}, {_OVERRIDES} select call_id, event_name, event_id, 'STEWARD_OVERRIDE' as reason from overrides")
def overridden_observations(spark: SparkSession, d: str) -> DataFrame:
    """JR-03: a steward's choice governs whatever the other observations say."""
    rows = _events(spark, d)
    plain = rows.filter(~F.col("event_name").isin(*registry.REPEATABLE) & (F.col("call_id") % 5 == 0))
    chosen = plain.groupBy("call_id", "event_name").agg(F.max("event_id").alias("event_id"))
    return events.canonical_observations(rows, repeatable=registry.REPEATABLE, overrides=chosen).filter("reason = 'STEWARD_OVERRIDE'").select("call_id", "event_name", "event_id", "reason")


@query("file_status_skipped", f"with {_STAGED} select file, case when bool_or(bad) then 'VALIDATED_WITH_ISSUES' else 'VALIDATED' end as file_status from validated group by file union all select concat(r_name, '.xlsx'), 'SKIPPED' from region")
def file_status_skipped(spark: SparkSession, d: str) -> DataFrame:
    """ING-12: files without a governed sheet are skipped."""
    rows = _validated(spark, d)
    files = rows.select("file").distinct().union(table(spark, d, "region").select(F.concat("r_name", F.lit(".xlsx"))))
    return landing.file_status(files, rows).select("file", "file_status")


@query("second_tug_before_pilot", f"with {_POINTS} select p.call_id, round(case when two.utc < p.utc then date_diff('microsecond', two.utc, p.utc) else date_diff('microsecond', one.utc, p.utc) end / 3.6e9, 4) as value from points p left join points one on one.call_id = p.call_id and one.event_name = 'TUG_SERVICE_START_ARRIVAL' left join points two on two.call_id = p.call_id and two.event_name = 'CARGO_START' where p.event_name = 'PILOT_ON_BOARD_ARRIVAL' and (one.utc < p.utc or two.utc < p.utc)")
def second_tug_before_pilot(spark: SparkSession, d: str) -> DataFrame:
    """OL-004: of two tugs that start before the pilot is on board the second one's hours; the start of cargo work plays the second tug."""
    return outlier.tug_before_pilot(_points(spark, d), ["TUG_SERVICE_START_ARRIVAL", "CARGO_START"]).select("call_id", "value")


@query("name_similarities", "select c_custkey as id, 0.9444 as similarity from customer union all select c_custkey + 1000000000, 0.0 from customer union all select c_custkey + 2000000000, 0.99 from customer")
def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    """ID-02: names of 18 characters of which one is another (17 of 18 match on both sides), a blank one, and ones that differ in punctuation."""
    name = F.upper(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 18))
    rows = table(spark, d, "customer").select("c_custkey", name.alias("a"))
    other = F.concat(F.substring("a", 1, 7), F.lit("~"), F.substring("a", 9, 10))
    kinds = [(0, F.concat(F.substring("a", 1, 7), F.lit("Z"), F.substring("a", 9, 10))), (1_000_000_000, F.lit(" ")), (2_000_000_000, None)]
    each = [rows.select((F.col("c_custkey") + add).alias("id"), F.col("a") if b is not None else other.alias("a"), (b if b is not None else F.concat(F.substring("a", 1, 7), F.lit("--"), F.substring("a", 9, 10))).alias("b")) for add, b in kinds]
    return each[0].union(each[1]).union(each[2]).select("id", name_similarity("a", "b").alias("similarity"))


@query("rekeyed_events", f"with {_EVENTS}, g as (select call_id, call_id - 1 as survivor_id from (select distinct call_id from events) where call_id % 3 = 1), m as (select e.event_id, coalesce(g.survivor_id, e.call_id) as call_id, e.event_name, e.occurrence_index, case when g.call_id is null then 0 else 1 end as moved from events e left join g using (call_id)), r as (select *, row_number() over (partition by call_id, event_name, occurrence_index order by moved, event_id) as n from m) select call_id, event_name, count(*) as n, count(*) filter (moved = 1) as n_moved from r where moved = 0 or n = 1 group by call_id, event_name")
def rekeyed_events(spark: SparkSession, d: str) -> DataFrame:
    """ID-10: events of merged calls under their survivor, but for slots that it has."""
    rows = _events(spark, d).withColumn("own", F.col("call_id"))
    groups = rows.select("call_id").distinct().filter("call_id % 3 = 1").select("call_id", (F.col("call_id") - 1).alias("survivor_id"))
    got = identity.rekey_events(rows, groups)
    return got.groupBy("call_id", "event_name").agg(F.count("*").alias("n"), F.count_if(F.col("own") != F.col("call_id")).alias("n_moved"))


@query("dq_listing_of_file", f"with {_ISSUES} select rule_id, count(*) as n from issues where record_reference like 'service:%' and rule_id like '%SCHEDULE%' group by rule_id")
def dq_listing_of_file(spark: SparkSession, d: str) -> DataFrame:
    """DQ-LIST: the issues of records of one source, and of those the ones whose rule has a word."""
    return quality.listing(_issues(spark, d), file="service", search="schedule").groupBy("rule_id").agg(F.count("*").alias("n"))


# Every keyword of the delay categories, the source's own categories, and words that mean nothing.
_REASONS = ["Heavy swells", "WIND over 40 kn", "fog", "storm warning", "bad weather", "tug broke down", "pilot delayed", "no berth", "cargo not ready", "terminal awaiting orders", "crane", "equipment", "breakdown of gear", "mooring gang late", "lines parted", "documentation", "customs hold", "paperwork", "ship not ready", "clearance", "regulatory", "quarantine", "immigration", "shift change", "unknown", ""]
_SOURCES = ["", "Weather", "vessel", "Marine Service", "Crane Downtime", "external/uncontrollable", "Nothing"]
BINDINGS["stated_reasons"] = f"""
    select o_orderkey, case o_orderkey % {len(_REASONS)} {' '.join(f"when {i} then '{r}'" for i, r in enumerate(_REASONS))} end as reason, case o_custkey % {len(_SOURCES)} {' '.join(f"when {i} then '{s}'" for i, s in enumerate(_SOURCES))} end as source from {{orders}}"""


@query(
    "delay_categories",
    f"""with s as (select *, lower(reason) as r, lower(source) as q from ({oracle('stated_reasons')})), c as (select *, case when regexp_matches(r, 'weather|swells|wind|fog|storm') or contains(q, 'weather') then 'Weather' when contains(r, 'tug') then 'Tug' when contains(r, 'pilot') then 'Pilot' when contains(r, 'berth') then 'Berth Non-Availability'
        when regexp_matches(r, 'cargo|terminal awaiting') then 'Terminal Readiness' when contains(r, 'crane') then 'Crane Downtime' when regexp_matches(r, 'equipment|breakdown') then 'Equipment Breakdown' when regexp_matches(r, 'mooring|lines') then 'Mooring' when regexp_matches(r, 'documentation|customs|paperwork') then 'Documentation'
        when contains(r, 'ship not ready') or contains(q, 'vessel') then 'Vessel-Side' when regexp_matches(r, 'clearance|regulatory|quarantine|immigration') then 'Regulatory Clearance' when contains(r, 'shift') or contains(q, 'marine service') then 'Port-Side' when q = 'crane downtime' then 'Crane Downtime' when q = 'external/uncontrollable' then 'External/Uncontrollable' else 'Other' end as category from s)
    select reason, source, category, count(*) as n from c group by all""",
)
def delay_categories(spark: SparkSession, d: str) -> DataFrame:
    """CAN-13: every keyword in a reason, with every kind of source category."""
    rows = bound(spark, d, "stated_reasons")
    return rows.groupBy("reason", "source", delays.delay_category(F.col("source"), F.col("reason")).alias("category")).agg(F.count("*").alias("n"))
