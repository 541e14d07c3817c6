"""More registered queries: KPIs, outliers, bottlenecks, delays, quality, identity, landing, lifecycle, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.names import normalise_name
from ..functions.time import signed_hours_text
from ..operators import alerts, bottleneck, dashboard, delays, events, identity, journey, kpi, leadtime, lifecycle, outlier, quality, reconcile, stats
from ..sources import landing
from ..sources.tables import bound, oracle, table
from . import registry
from .queries import _CALLS, _CARGO, _EVENTS, _LEAD, _LIVE, _POINTS, _SERVICES, _STAGES, _TIMINGS, _events, _hours, _lead_times, _ordered, _points, _stages, _timings, _values, query

UNIT = "TEU"

_METRICS = f"""{_LEAD}, pil as (select * from services where service_type = 'Pilotage'), pm as (select movement, call_id, arg_min(service_id, struct_pack(n := scheduled is null, s := scheduled, i := service_id)) as service_id from pil where movement in ('Arrival', 'Sailing') group by all),
    pe as (select call_id, arg_min(service_id, struct_pack(n := scheduled is null, s := scheduled, i := service_id)) as first_id, arg_max(service_id, struct_pack(n := scheduled is null, s := scheduled, i := service_id)) as last_id, count(*) as n from pil group by call_id),
    pk as (select 'Arrival' as movement union all select 'Sailing'), pr as (select k.movement, c.call_id, coalesce(m.service_id, case when e.n > 1 then case k.movement when 'Arrival' then e.first_id else e.last_id end end) as service_id from calls c cross join pk k left join pe e on e.call_id = c.call_id left join pm m on m.call_id = c.call_id and m.movement = k.movement),
    px as (select r.call_id, r.movement || ' Execution Delay' as metric, r.service_id, (select max({_hours('scheduled', 'served')}) from pil p where p.service_id = r.service_id and p.call_id = r.call_id) as hours from pr r),
    metric_rows as (select * from lead_rows union all select call_id, metric, hours, case when hours is null then 'UNAVAILABLE' else 'AVAILABLE' end, case when service_id is null then 'MISSING_BOTH' when hours is null then 'MISSING_TIME' end, coalesce(service_id, '') from px)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return leadtime.all_metrics(bound(spark, d, "calls"), _points(spark, d), registry.lead_times(spark), bound(spark, d, "services"), registry.EXECUTION_DELAYS)


# ---------------------------------------------------------------- delays

_CATEGORY = """case when lower(coalesce(source_category, '')) like '%weather%' or lower(reason) like '%wind%' then 'Weather' when lower(reason) like '%tug%' then 'Tug' when lower(reason) like '%pilot%' then 'Pilot' when lower(reason) like '%berth%' then 'Berth Non-Availability'
        when lower(reason) like '%cargo%' then 'Terminal Readiness' when lower(reason) like '%crane%' then 'Crane Downtime' when lower(reason) like '%equipment%' then 'Equipment Breakdown' when lower(reason) like '%lines%' then 'Mooring' when lower(reason) like '%customs%' then 'Documentation'
        when lower(coalesce(source_category, '')) like '%vessel%' then 'Vessel-Side' when lower(reason) like '%shift%' or lower(coalesce(source_category, '')) like '%marine service%' then 'Port-Side' when source_category = 'Documentation' then 'Documentation' else 'Other' end"""
_DELAYS = f"""raw_delays as ({oracle('delays')}), again as (select *, {_hours('scheduled', 'served', 4)} as recalculated_hours from raw_delays),
    delays as (select call_id, delay_id, movement as leg, reason, source_category, cause_status, stated_hours, recalculated_hours, coalesce(stated_hours, recalculated_hours, 0) as hours, coalesce(round(abs(recalculated_hours - stated_hours), 6) > 0.02, false) as is_mismatch,
        coalesce(stated_hours, recalculated_hours, 0) < 0 as is_early, coalesce(stated_hours, recalculated_hours, 0) > 0 and (trim(reason) = '' or source_category is null) as needs_review, {_CATEGORY} as category,
        case cause_status when 'Confirmed' then 'CONFIRMED' else 'INFERRED' end as allocation, case confidence_text when 'High' then 1.0 when 'Medium' then 0.7 else 0.5 end as allocation_confidence from again)"""


def _delays(spark: SparkSession, d: str) -> DataFrame:
    return delays.reconcile_delays(bound(spark, d, "delays"))


@query("delay_reconciliation", f"with {_DELAYS} select call_id, delay_id, leg, stated_hours, recalculated_hours, hours, is_mismatch, is_early, needs_review, category, allocation, allocation_confidence from delays")
def delay_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return _delays(spark, d).drop("reason", "source_category", "cause_status")


@query("delay_pareto", f"with {_DELAYS}, g as (select category, count(*) as n, sum(hours) as h from delays where hours > 0 group by category) select cast(row_number() over w as int) as rank, category, n, round(h, 2) as hours, round(sum(h) over w / sum(h) over () * 100, 1) as cumulative_pct from g window w as (order by h desc, category)")
def delay_pareto(spark: SparkSession, d: str) -> DataFrame:
    return delays.pareto(_delays(spark, d))


@query(
    "delay_stage_breakdown",
    f"""with {_DELAYS} select leg, count(*) as n, round(sum(hours), 2) as hours, round(coalesce(sum(hours) filter (allocation = 'CONFIRMED'), 0), 2) as confirmed_hours, round(coalesce(sum(hours) filter (allocation <> 'CONFIRMED'), 0), 2) as inferred_hours,
    count(*) filter (is_mismatch) as n_mismatch, count(*) filter (needs_review) as n_review from delays group by leg""",
)
def delay_stage_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return delays.stage_breakdown(_delays(spark, d))


@query("delay_search", f"with {_DELAYS} select delay_id, call_id, leg, category, hours from delays where leg in ('Arrival', 'Sailing') and is_mismatch and (reason ilike '%crane%' or category ilike '%crane%')")
def delay_search(spark: SparkSession, d: str) -> DataFrame:
    return delays.delay_list(_delays(spark, d), legs=["Arrival", "Sailing"], search="crane", mismatch=True).select("delay_id", "call_id", "leg", "category", "hours")


@query(
    "inferred_causes",
    f"""with {_DELAYS}, {_SERVICES}, h as (select call_id, movement, service_type, service_id, {_hours('scheduled', 'served')} as h from services), l as (select call_id, movement, arg_max(h, service_id) filter (service_type = 'Tug') as tug, arg_max(h, service_id) filter (service_type = 'Pilotage') as pilot, arg_max(h, service_id) filter (service_type = 'Berthing') as berth from h where h > 0.05 group by all)
    select delay_id, d.call_id, leg, case when tug > 0.1 then 'Tug' when pilot > 0.1 then 'Pilot' when berth > 0.1 or leg = 'Arrival' then 'Berth Non-Availability' when leg = 'Sailing' then 'Terminal Readiness' else 'Port-Side' end as inferred_category,
    case when tug > 0.1 then 0.75 when pilot > 0.1 then 0.78 when berth > 0.1 then 0.70 when leg = 'Arrival' then 0.60 when leg = 'Sailing' then 0.58 else 0.50 end as confidence from delays d left join l on l.call_id = d.call_id and l.movement = d.leg where cause_status <> 'Confirmed'""",
)
def inferred_causes(spark: SparkSession, d: str) -> DataFrame:
    return delays.infer_causes(_delays(spark, d), bound(spark, d, "services")).select("delay_id", "call_id", "leg", "inferred_category", "confidence")


_RANGES = [("Pilotage", "PILOT_ON_BOARD_ARRIVAL", "PILOT_DISEMBARK_ARRIVAL"), ("Berthing", "FIRST_LINE_TIED_ARRIVAL", "ALL_FAST_ARRIVAL"), ("Tug", "TUG_SERVICE_START_ARRIVAL", "ALL_FAST_ARRIVAL")]


@query(
    "service_duration_ranges",
    f"""with {_CALLS}, {_POINTS}, k as (select * from {_values(_RANGES)} as t(label, a, z)), r as (select label, x.call_id, vessel_name, {_hours('x.utc', 'y.utc')} as hours from k join points x on x.event_name = k.a join points y on y.event_name = k.z and y.call_id = x.call_id join calls c on c.call_id = x.call_id)
    select label, count(hours) as n, min(hours) as min_hours, arg_min(vessel_name, struct_pack(h := hours, c := call_id)) as min_vessel, max(hours) as max_hours, arg_max(vessel_name, struct_pack(h := hours, c := -call_id)) as max_vessel from r where hours >= 0 group by label""",
)
def service_duration_ranges(spark: SparkSession, d: str) -> DataFrame:
    return delays.duration_ranges(_points(spark, d), bound(spark, d, "calls"), _RANGES)


# ---------------------------------------------------------------- KPIs

_WIDE = ", ".join(f"max(utc) filter (event_name = '{n}') as {n}" for n in kpi.NAMES)


def _fw(a: str, z: str) -> str:
    return f"case when {z} >= {a} then {_hours(a, z)} end"


_FW_KPI = f"""{_POINTS}, {_CARGO}, {_TIMINGS}, wide_events as (select call_id, {_WIDE} from points group by call_id),
    per_call as (select call_id, sum(quantity) filter (unit = 'TEU') as teu, avg(resources) as res from cargo group by call_id),
    w as (select c.call_id, vessel_type ilike '%container%' as is_container, teu, res, ATA, ATD, {_fw('ANCHORAGE_ARRIVAL', 'PILOT_ON_BOARD_ARRIVAL')} as boarding, {_fw('ANCHORAGE_ARRIVAL', 'FIRST_LINE_TIED_ARRIVAL')} as berthing, {_fw('PILOT_ON_BOARD_ARRIVAL', 'ALL_FAST_ARRIVAL')} as inward,
        {_fw('PILOT_SCHEDULED_ARRIVAL', 'PILOT_ON_BOARD_ARRIVAL')} as pilot, {_fw('ALL_FAST_ARRIVAL', 'LAST_LINE_UNTIED_SAILING')} as berth, {_fw('CARGO_START', 'CARGO_END')} as work, {_fw('ANCHORAGE_ARRIVAL', 'coalesce(BREAKWATER_OUT, ATD)')} as turn, {_fw('LAST_LINE_UNTIED_SAILING', 'coalesce(BREAKWATER_OUT, PORT_LIMIT_OUT)')} as outward, {_fw('PILOT_REQUEST_ARRIVAL', 'PILOT_ON_BOARD_ARRIVAL')} as response
        from calls c left join wide_events using (call_id) left join per_call using (call_id)),
    idle as (select *, case when berth is not null and work is not null then greatest(berth - work, 0) end as idle_h from w),
    sh as (select call_id, occurrence_index, max(utc) filter (event_name = 'SHIFT_PILOT_ON_BOARD') as a, max(utc) filter (event_name = 'SHIFT_ALL_FAST') as z from live where event_name in ('SHIFT_PILOT_ON_BOARD', 'SHIFT_ALL_FAST') group by all), shp as (select {_hours('a', 'z')} as hours from sh where z >= a),
    measured as (
        select 'KPI-01' as kpi, cast(count(ATA) as double) as value from w union all select 'KPI-02', avg(teu) filter (teu <> 0) from w union all select 'KPI-03', avg(boarding) from w union all select 'KPI-04', avg(berthing) from w union all select 'KPI-05', stddev_samp(boarding) from w
        union all select 'KPI-07', avg(inward) from w union all select 'KPI-12', avg(pilot) from w union all select 'KPI-13', avg(inward) from w union all select 'KPI-15', avg(berth) from w union all select 'KPI-16', stddev_samp(inward) from w union all select 'KPI-17', avg(idle_h) from idle
        union all select 'KPI-18', sum(idle_h) / sum(berth) filter (idle_h is not null) * 100 from idle union all select 'KPI-19', cast(count(*) as double) from shp union all select 'KPI-20', avg(hours) from shp union all select 'KPI-21', sum(quantity) / sum(working_hours * resources) from cargo where unit = 'TEU'
        union all select 'KPI-23', sum(quantity) from cargo where unit = 'MT' union all select 'KPI-24', sum(quantity) from cargo where unit = 'TEU' and operation <> 'Lashing' union all select 'KPI-25', sum(teu) filter (is_container) / count(*) filter (is_container) from w
        union all select 'KPI-27', sum(teu) filter (berth is not null) / (sum(berth) filter (teu is not null) / 24) from w union all select 'KPI-28', avg(res) filter (is_container) from w union all select 'KPI-29', sum(downtime_hours) / sum(working_hours + downtime_hours) * 100 from cargo
        union all select 'KPI-30', sum(quantity) / sum(working_hours * resources) from cargo where unit = 'TEU' union all select 'KPI-41', avg(turn) from w union all select 'KPI-42', avg(berth) from w union all select 'KPI-43', avg(outward) from w
        union all select 'KPI-45', count(ATD) / (date_diff('day', min(ATD)::date, max(ATD)::date) + 1) from w union all select 'KPI-54', avg(response) from w),
    reg as (select * from {_values(registry.KPIS)} as t(kpi, name, category, unit, target, direction, green, amber, computed, alias_of)),
    res as (select r.*, case when computed then round(value, 4) end as v from reg r left join measured m on m.kpi = coalesce(r.alias_of, r.kpi)),
    kpis as (select kpi, name, category, unit, v as value, target, case when v is null then 'GRAY' when direction = 'LOWER' then case when v <= green then 'GREEN' when v <= amber then 'AMBER' else 'RED' end else case when v >= green then 'GREEN' when v >= amber then 'AMBER' else 'RED' end end as band,
        case when not computed then 'NO_SOURCE_DATA' when v is null then 'UNAVAILABLE' when alias_of is not null then 'ALIAS' else 'COMPUTED' end as status from res)"""


_KPI = f"{_CALLS}, {_FW_KPI}"


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    calls, points = bound(spark, d, "calls"), _points(spark, d)
    shifts = kpi.pair_shifts(events.live(_events(spark, d)), *registry.REPEATABLE)
    measured = kpi.measures(kpi.population(calls, points), points, bound(spark, d, "cargo"), shifts, unit=UNIT)
    return kpi.results(measured, registry.kpis(spark))


@query("kpi_results", f"with {_KPI} select kpi, name, category, unit, value, target, band, status from kpis")
def kpi_results(spark: SparkSession, d: str) -> DataFrame:
    return _kpis(spark, d).select("kpi", "name", "category", "unit", "value", "target", "band", "status")


@query("kpi_status_counts", f"with {_KPI} select category, status, count(*) as n from kpis group by category, status")
def kpi_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return kpi.status_counts(_kpis(spark, d))


@query("kpi_spotlight", f"with {_KPI} select kpi, name, value, target, round(value - target, 4) as variance, band, status from kpis where kpi in ('KPI-03', 'KPI-15', 'KPI-21', 'KPI-41')")
def kpi_spotlight(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.spotlight(_kpis(spark, d), ["KPI-03", "KPI-15", "KPI-21", "KPI-41"])


_HISTORY = """history as (select case l_returnflag when 'A' then 'KPI-03' when 'R' then 'KPI-15' else 'KPI-21' end as kpi, case l_returnflag when 'N' then 'HIGHER' else 'LOWER' end as direction, l_shipdate as calculated_at, avg(l_extendedprice) / 1000 as value from {lineitem} group by 1, 2, 3)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    """A daily measure of each return flag stands in for stored results."""
    return spark.sql(f"with {_HISTORY} select * from history", lineitem=table(spark, d, "lineitem"))


@query(
    "kpi_trend",
    f"""with {_HISTORY.format(lineitem='lineitem')}, r as (select *, row_number() over (partition by kpi order by calculated_at desc) as n from history), t as (select *, value - lag(value) over w as delta, lag(value) over w as before, avg(value) over (partition by kpi order by calculated_at rows between 2 preceding and current row) as m from r where n <= 6 window w as (partition by kpi order by calculated_at))
    select kpi, calculated_at, round(value, 4) as value, round(delta, 4) as delta, round(delta / nullif(abs(before), 0) * 100, 2) as change_pct, round(m, 4) as mean3, case when delta is null or abs(delta) <= 0.01 then 'STABLE' when (direction = 'LOWER' and delta < 0) or (direction <> 'LOWER' and delta > 0) then 'IMPROVING' else 'DETERIORATING' end as trend from t""",
)
def kpi_trend(spark: SparkSession, d: str) -> DataFrame:
    return kpi.trend(_history(spark, d))


@query("kpi_latest", f"with {_HISTORY.format(lineitem='lineitem')}, r as (select *, row_number() over (partition by kpi order by calculated_at desc) as n from history) select kpi, calculated_at, round(value, 4) as value, cast(n as int) as position from r where n <= 3")
def kpi_latest(spark: SparkSession, d: str) -> DataFrame:
    return kpi.latest(_history(spark, d), 3).select("kpi", "calculated_at", F.round("value", 4).alias("value"), "position")


@query(
    "kpi_trailing_windows",
    f"""with {_POINTS}, w as (select call_id, max(utc) filter (event_name = 'ATA') as ata, max(utc) filter (event_name = 'ANCHORAGE_ARRIVAL') as a, max(utc) filter (event_name = 'PILOT_ON_BOARD_ARRIVAL') as z from points group by call_id), l as (select max(ata) as last from w)
    select cast(floor(date_diff('microsecond', ata, last) / 1e6 / 7776000) as bigint) as "window", round(avg({_fw('a', 'z')}), 4) as value, count(*) as n_calls from w, l where ata is not null and date_diff('microsecond', ata, last) / 1e6 / 7776000 < 6 group by 1""",
)
def kpi_trailing_windows(spark: SparkSession, d: str) -> DataFrame:
    return kpi.trailing_windows(_points(spark, d), ("ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL"), days=90)


# ---------------------------------------------------------------- outliers, bottlenecks, criticality

_PAIRS = f"""pairs as (select * from {_values(registry.OUTLIER_PAIRS)} as t(rule, a, z, kind, parameter)), pv as (select rule, kind, parameter, x.call_id, {_hours('x.utc', 'y.utc')} as value from pairs p join points x on x.event_name = p.a join points y on y.event_name = p.z and y.call_id = x.call_id),
    hi as (select rule, quantile_cont(value, 0.9) as q90, quantile_cont(value, 0.95) as q95 from pv where kind = 'HIGH' and value >= 0 group by rule), sd as (select rule, avg(value) + 3 * stddev_samp(value) as t from pv where kind = 'SD' group by rule),
    po as (select v.rule, call_id, value, case when parameter = 0.95 then q95 else q90 end as threshold from pv v join hi using (rule) where value >= 0 union all select v.rule, call_id, value, t from pv v join sd using (rule)),
    pair_out as (select rule, call_id, round(value, 4) as value, round(threshold, 4) as threshold, case when threshold > 0 and value > 1.5 * threshold then 'CRITICAL' else 'HIGH' end as severity, 'Time-based Outlier' as category from po where value > threshold)"""


@query("pair_outliers", f"with {_POINTS}, {_PAIRS} select * from pair_out")
def pair_outliers(spark: SparkSession, d: str) -> DataFrame:
    return outlier.pair_outliers(_points(spark, d), registry.OUTLIER_PAIRS)


@query("outlier_aliases", f"with {_POINTS}, {_PAIRS}, al as (select * from {_values(registry.OUTLIER_ALIASES)} as t(alias, rule)) select coalesce(alias, p.rule) as rule, count(*) as n, count(distinct call_id) as n_calls from (select * from pair_out) p join (select alias, rule from al union all select null, rule from pairs) a on a.rule = p.rule group by 1")
def outlier_aliases(spark: SparkSession, d: str) -> DataFrame:
    found = outlier.pair_outliers(_points(spark, d), registry.OUTLIER_PAIRS)
    both = outlier.with_aliases(found, spark.createDataFrame(registry.OUTLIER_ALIASES, "alias string, rule string"))
    return both.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("call_id").alias("n_calls"))


_PILOT = f"""p as (select call_id, service_id, delay_hours as value from timings where kind = 'PILOT' and delay_hours is not null), t1 as (select avg(value) + 3 * stddev_samp(value) as t from p), t2 as (select quantile_cont(value, 0.3) as t from p where value < 0),
    pilot_out as (select 'OUT-V2-002' as rule, call_id, service_id, round(value, 4) as value, round(t, 4) as threshold, case when t > 0 and value > 1.5 * t then 'CRITICAL' else 'HIGH' end as severity from p, t1 where value > t union all select 'OUT-V2-007', call_id, service_id, round(value, 4), round(t, 4), 'MEDIUM' from p, t2 where value < t)"""


@query("pilot_outliers", f"with {_TIMINGS}, {_PILOT}, d as (select *, row_number() over (partition by rule, call_id order by service_id desc) as n from pilot_out) select rule, call_id, service_id, value, threshold, severity from d where n = 1")
def pilot_outliers(spark: SparkSession, d: str) -> DataFrame:
    return outlier.deduplicate(outlier.pilot_outliers(_timings(spark, d)), ["service_id"]).drop("category")


@query("tug_before_pilot", f"with {_POINTS} select 'OUT-V2-004' as rule, a.call_id, round({_hours('a.utc', 'z.utc')}, 4) as value from points a join points z using (call_id) where a.event_name = 'TUG_SERVICE_START_ARRIVAL' and z.event_name = 'PILOT_ON_BOARD_ARRIVAL' and a.utc < z.utc")
def tug_before_pilot(spark: SparkSession, d: str) -> DataFrame:
    return outlier.tug_before_pilot(_points(spark, d), ["TUG_SERVICE_START_ARRIVAL", "TUG_2_SERVICE_START_ARRIVAL"]).select("rule", "call_id", "value")


@query("repeated_shifts", f"with {_LIVE} select call_id, cast(count(*) as double) as value from live where event_name = 'SHIFT_PILOT_ON_BOARD' group by call_id having count(*) > 1")
def repeated_shifts(spark: SparkSession, d: str) -> DataFrame:
    return outlier.repeated_shifts(events.live(_events(spark, d))).select("call_id", "value")


@query("sailing_variance_outliers", f"with {_POINTS}, v as (select a.call_id, abs({_hours('a.utc', 'z.utc')}) as value from points a join points z using (call_id) where a.event_name = 'ETD' and z.event_name = 'ATD'), q as (select quantile_cont(value, 0.9) as t from v) select call_id, round(value, 4) as value, round(t, 4) as threshold, case when t > 0 and value > 1.5 * t then 'CRITICAL' else 'HIGH' end as severity from v, q where value > t")
def sailing_variance_outliers(spark: SparkSession, d: str) -> DataFrame:
    return outlier.sailing_variance(_points(spark, d)).select("call_id", "value", "threshold", "severity")


_RANK = f"""tg as (select * from {_values(registry.BOTTLENECK_STAGES)} as t(metric, target)), rs as (select * from {_values([r[:2] + r[3:] for r in bottleneck.RESOURCES])} as t(category, name, target)),
    cand as (select metric as name, 'PROCESS' as kind, hours, target from lead_rows join tg using (metric) where status = 'AVAILABLE' union all select name, 'RESOURCE', hours, target from delays join rs using (category) where hours > 0),
    k as (select *, row_number() over (partition by name order by hours) as r, count(*) over (partition by name) as n from cand), tot as (select coalesce(avg(hours), 50.0) as total from lead_rows where metric = 'Turnaround' and status = 'AVAILABLE'),
    m as (select name, kind, count(*) as n, avg(hours) as mean, median(hours) as median, max(hours) filter (r = greatest(1, ceil(round(n * 0.9, 9)))) as p90, coalesce(stddev_samp(hours), 0) as sd, avg(case when hours > target then 1.0 else 0.0 end) as breach_rate from k group by name, kind),
    c as (select *, case when mean > 0.0001 then sd / mean else 0 end as cv, case when median > 0.0001 then p90 / median else greatest(1.0, p90) end as tail_ratio, case when total > 0 then mean / total * 100 else 0 end as share from m, tot),
    s as (select *, least(100, round(mean / case kind when 'PROCESS' then 48.0 else 10.0 end * 100, 2)) as duration, least(100, round(n / 72.0 * 100, 2)) as frequency, least(100, round(cv / 1.5 * 100, 2)) as variability, least(100, round(greatest(0, tail_ratio - 1) / 2.5 * 100, 2)) as tail_risk, least(100, round(share, 2)) as contribution, least(100, round(breach_rate * 100, 2)) as breach from c),
    ranked_b as (select name, kind, n, round(mean, 4) as mean, round(median, 4) as median, round(p90, 4) as p90, round(sd, 4) as sd, round(cv, 4) as cv, round(tail_ratio, 4) as tail_ratio, round(breach_rate, 4) as breach_rate, round(duration * .15 + frequency * .2 + variability * .2 + tail_risk * .2 + contribution * .1 + breach * .15, 2) as score from s)"""


def _bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, saved(_lead_times(spark, d)), _delays(spark, d))


def _ranked(spark: SparkSession, d: str, found: DataFrame, delay_rows: DataFrame) -> DataFrame:
    total = found.filter("metric = 'Turnaround' and status = 'AVAILABLE'").agg(F.coalesce(F.avg("hours"), F.lit(50.0)).alias("total"))
    targets = spark.createDataFrame(registry.BOTTLENECK_STAGES, "metric string, target double")
    return bottleneck.rank(bottleneck.candidates(found, delay_rows, _timings(spark, d), targets), total_hours=total)


@query("bottlenecks", f"with {_CALLS}, {_POINTS}, {_LEAD}, {_DELAYS}, {_RANK} select cast(row_number() over (order by score desc, name) as int) as rank, * from ranked_b")
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return _bottlenecks(spark, d).drop(*bottleneck.WEIGHTS)


@query(
    "criticality",
    f"""with {_CALLS}, {_POINTS}, {_LEAD}, k as (select *, row_number() over (partition by metric order by hours) as r, count(*) over (partition by metric) as n from lead_rows where hours is not null),
    m as (select metric, avg(hours) as mean, coalesce(stddev_samp(hours), 0) as sd, max(hours) filter (r = floor(n / 2) + 1) as median, max(hours) filter (r = greatest(1, ceil(round(n * 0.9, 9)))) as p90 from k group by metric),
    c as (select *, case when mean > 0 then sd / mean else 0 end as cv, case when median > 0 then p90 / median else 1 end as tr from m),
    l as (select *, case when mean >= 36 then 5 when mean >= 18 then 4 when mean >= 6 then 3 when mean >= 2 then 2 else 1 end as duration_level, case when cv >= 1.2 then 5 when cv >= 0.8 then 4 when cv >= 0.5 then 3 when cv >= 0.2 then 2 else 1 end as variability_level, case when tr >= 3.5 then 5 when tr >= 2.5 then 4 when tr >= 1.8 then 3 when tr >= 1.3 then 2 else 1 end as tail_level from c),
    z as (select *, round((duration_level + variability_level + tail_level) / 3, 2) as score from l)
    select metric, round(mean, 4) as mean, round(cv, 4) as cv, round(tr, 4) as tail_ratio, duration_level, variability_level, tail_level, score, case when score >= 4 then 'CRITICAL' when score >= 3 then 'HIGH' when score >= 2 then 'MODERATE' else 'LOW' end as criticality from z""",
)
def criticality(spark: SparkSession, d: str) -> DataFrame:
    return bottleneck.criticality(_lead_times(spark, d).filter("hours is not null"))


# ---------------------------------------------------------------- data quality

_ISSUES = f"""{_CALLS}, {_LIVE}, {_SERVICES}, {_DELAYS}, fl as (select call_id, event_name, min(struct_pack(o := occurrence_index, u := utc, e := event_id)) as f from live group by all), edges as (select * from {_values(registry.SEQUENCE)} as t(a, z, rule)),
    ata2 as (select call_id, utc, row_number() over (partition by call_id order by occurrence_index, utc, event_id) as n from live where event_name = 'ATA'),
    issues as (
        select 'DQ-003' as rule_id, 'HIGH' as severity, call_id, concat('call:', call_id) as record_reference from calls where call_id not in (select call_id from events where event_name = 'ATA')
        union all select 'DQ-004', 'HIGH', a.call_id, concat('call:', a.call_id) from fl a join fl z using (call_id) where a.event_name = 'ETA' and z.event_name = 'ATA' and a.f.u > z.f.u
        union all select distinct 'DQ-005', 'HIGH', call_id, concat('call:', call_id) from live where event_name = 'PILOT_REQUEST_ARRIVAL' and call_id not in (select call_id from live where event_name = 'PILOT_SCHEDULED_ARRIVAL')
        union all select rule, 'CRITICAL', x.call_id, concat('event:', y.f.e) from edges join fl x on x.event_name = edges.a join fl y on y.event_name = edges.z and y.call_id = x.call_id where date_diff('second', x.f.u, y.f.u) < -300
        union all select distinct 'DQ-007', 'MEDIUM', call_id, concat('call:', call_id) from services where served > scheduled and call_id not in (select call_id from raw_delays where trim(reason) <> '')
        union all select 'DQ-010', 'HIGH', call_id, concat('call:', call_id) from ata2 where n <= 2 group by call_id having date_diff('second', min(utc), max(utc)) >= 18000
        union all select 'DQ-REQUESTED-MISSING', 'HIGH', call_id, concat('service:', service_id) from services where requested is null
        union all select 'DQ-SCHEDULED-MISSING', 'HIGH', call_id, concat('service:', service_id) from services where scheduled is null
        union all select 'DQ-SERVED-MISSING', 'HIGH', call_id, concat('service:', service_id) from services where scheduled is not null and served is null
        union all select 'DQ-SCHEDULE-ORDER', 'HIGH', call_id, concat('service:', service_id) from services where scheduled < requested),
    parts0 as (select c.call_id, count(*) filter (severity = 'CRITICAL') as n_critical, count(severity) as n_open from calls c left join issues using (call_id) group by c.call_id),
    parts as (select call_id, n_critical, n_open, case when n_critical > 0 then 'QUARANTINED' when n_open > 0 then 'FLAGGED' else 'CLEAN' end as quality_status, greatest(0, case when n_critical > 0 then 100 - 50 * n_critical - 10 * n_open when n_open > 0 then 100 - 15 * n_open else 100 end) as quality_score from parts0)"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    calls, ev, services = bound(spark, d, "calls"), _ordered(spark, d), bound(spark, d, "services")
    found = [quality.event_issues(calls, ev, registry.SEQUENCE), quality.service_issues(services, bound(spark, d, "delays")), quality.conflicting_arrivals(ev)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("dq_issues", f"with {_ISSUES} select rule_id, severity, call_id, record_reference from issues")
def dq_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).select("rule_id", "severity", "call_id", "record_reference")


@query("dq_partition", f"with {_ISSUES} select call_id, n_critical, n_open, quality_status, quality_score from parts")
def dq_partition(spark: SparkSession, d: str) -> DataFrame:
    return quality.partition(bound(spark, d, "calls"), _issues(spark, d))


@query("dq_cleanliness", f"with {_ISSUES} select count(*) filter (quality_status = 'CLEAN') as n_clean, count(*) filter (quality_status = 'FLAGGED') as n_flagged, count(*) filter (quality_status = 'QUARANTINED') as n_quarantined, round(avg(case when quality_status = 'CLEAN' then 1.0 else 0.0 end) * 100, 1) as clean_pct from parts")
def dq_cleanliness(spark: SparkSession, d: str) -> DataFrame:
    return quality.cleanliness(quality.partition(bound(spark, d, "calls"), _issues(spark, d)))


@query("dq_summary", f"with {_ISSUES} select severity, count(*) as n, count(*) as n_open, cast(0 as bigint) as n_resolved, count(distinct call_id) as n_calls from issues group by severity")
def dq_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(_issues(spark, d))


_TYPES = [("DQ-003", "COMPLETENESS"), ("DQ-004", "CONSISTENCY"), ("DQ-006", "SEQUENCE"), ("DQ-SERVED-MISSING", "COMPLETENESS")]


@query(
    "dq_dimension_scores",
    f"""with {_ISSUES}, ty as (select * from {_values(_TYPES)} as t(rule_id, dimension)), dm as (select * from {_values([(x,) for x in quality.DIMENSIONS])} as t(dimension)), p as (select coalesce(dimension, 'VALIDITY') as dimension, sum(case severity when 'CRITICAL' then 50 when 'HIGH' then 20 else 10 end) as p from issues left join ty using (rule_id) group by 1),
    s as (select dm.dimension, greatest(0, 100 - coalesce(p, 0)) as score from dm left join p using (dimension)) select dimension, cast(score as bigint) as score, round(avg(score) over (), 2) as overall from s""",
)
def dq_dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.dimension_scores(_issues(spark, d), spark.createDataFrame(_TYPES, "rule_id string, dimension string"))


@query("dq_listing", f"with {_ISSUES} select rule_id, severity, call_id, record_reference from issues where severity in ('CRITICAL', 'HIGH') and (record_reference ilike '%event:%' or rule_id ilike '%event:%')")
def dq_listing(spark: SparkSession, d: str) -> DataFrame:
    return quality.listing(_issues(spark, d), severities=["CRITICAL", "HIGH"], search="event:").select("rule_id", "severity", "call_id", "record_reference")


@query("dq_quarantine", f"with {_ISSUES} select count(*) as n_events, count(*) filter (is_quarantined or concat('event:', event_id) in (select record_reference from issues where severity = 'CRITICAL')) as n_quarantined from events")
def dq_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return quality.quarantine(_events(spark, d), _issues(spark, d)).agg(F.count("*").alias("n_events"), F.count_if("is_quarantined").alias("n_quarantined"))


@query("issue_outliers", f"with {_ISSUES} select call_id, case when rule_id like '%SEQUENCE%' or rule_id in ('DQ-006', 'DQ-SCHEDULE-ORDER') then 'OUT-V2-031' else 'OUT-V2-032' end as rule, cast(count(*) as double) as value, case when max(case severity when 'CRITICAL' then 1 else 0 end) = 1 then 'CRITICAL' else 'HIGH' end as severity from issues group by 1, 2")
def issue_outliers(spark: SparkSession, d: str) -> DataFrame:
    return outlier.from_issues(_issues(spark, d)).select("call_id", "rule", "value", "severity")


# ---------------------------------------------------------------- alerts, dashboards


@query(
    "alert_counts",
    f"""with {_ISSUES}, {_POINTS.replace(_LIVE + ', ', '')}, {_LEAD}, {_PAIRS}, {_RANK}, al as (
        select 'MISSING_DELAY_REASON' as rule, 'MEDIUM' as severity, 'delay' as t, delay_id as e from delays where needs_review union all select 'MISSING_DELAY_REASON', 'MEDIUM', 'call', cast(call_id as varchar) from issues where rule_id = 'DQ-007'
        union all select 'CRITICAL_BOTTLENECK', 'HIGH', 'b', name from ranked_b where score >= 65 union all select 'EXTREME_OUTLIER', severity, 'o', concat(rule, ':', call_id) from pair_out
        union all select 'RESOURCE_SHORTAGE', 'HIGH', 'delay', delay_id from delays where category in ('Tug', 'Pilot') and hours >= 1 union all select 'BERTH_CONFLICT', 'HIGH', 'delay', delay_id from delays where category = 'Berth Non-Availability' and hours >= 1),
    one as (select rule, t, e, min(severity) as severity from al group by all), g as (select rule, severity, count(*) as n, count(distinct e) as n_entities from one group by rule, severity) select rule, severity, n, n_entities, round(n / sum(n) over () * 100, 2) as share_pct from g""",
)
def alert_counts(spark: SparkSession, d: str) -> DataFrame:
    points, delay_rows = saved(_points(spark, d)), saved(_delays(spark, d))
    lead = saved(leadtime.lead_times(bound(spark, d, "calls"), points, registry.lead_times(spark)))
    found = alerts.evaluate(delay_rows, _issues(spark, d), _ranked(spark, d, lead, delay_rows), outlier.pair_outliers(points, registry.OUTLIER_PAIRS))
    return alerts.counts(found)


@query("throughput", f"with {_CALLS}, {_CARGO} select cargo_type, unit, round(sum(quantity), 2) as quantity, count(distinct call_id) as n_calls from cargo join calls using (call_id) group by cargo_type, unit")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.throughput(bound(spark, d, "calls"), bound(spark, d, "cargo"))


_CARDS = ["Turnaround", "Anchorage Wait", "Inward Movement", "Berth Stay", "Cargo Working", "Outward Movement", "Arrival Execution Delay", "Sailing Execution Delay"]


@query(
    "metric_cards",
    f"""with {_CALLS}, {_POINTS}, {_SERVICES}, {_METRICS} select metric, count(hours) as n, count(*) - count(hours) as n_missing, round(avg(hours), 2) as mean, round(quantile_cont(hours, 0.5), 2) as median, round(quantile_cont(hours, 0.9), 2) as p90, round(min(hours), 2) as "min", round(max(hours), 2) as "max",
    count(*) filter (hours < 0) as n_early, count(*) filter (hours > 0) as n_late, count(*) filter (hours = 0) as n_on_time from metric_rows where metric in ({', '.join(repr(c) for c in _CARDS)}) group by metric""",
)
def metric_cards(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.metric_cards(_metrics(spark, d), _CARDS)


@query("delay_summary", f"with {_DELAYS}, g as (select category, count(*) as n, sum(hours) as h, sum(case when allocation = 'CONFIRMED' then hours else 0 end) as c from delays where hours > 0 group by category), r as (select *, row_number() over (order by h desc, category) as k, sum(h) over () as t from g) select cast(k as int) as rank, category, n, round(h, 2) as hours, round(c, 2) as confirmed_hours, round(h / t * 100, 1) as share_pct from r where k <= 6")
def delay_summary(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.delay_summary(_delays(spark, d))


@query(
    "call_listing",
    f"""with {_ISSUES}, {_POINTS.replace(_LIVE + ', ', '')}, {_METRICS}, {_STAGES}, lt as (select call_id, {', '.join(f"max(hours) filter (metric = '{m}') as {m.lower().replace(' ', '_')}_hours" for m in _CARDS)} from metric_rows where status = 'AVAILABLE' group by call_id),
    cp as (select call_id, round(avg(case when status = 'AVAILABLE' then 1.0 else 0.0 end) * 100, 1) as completeness_pct from stage_rows where sequence < 100 group by call_id), dh as (select call_id, round(sum(hours), 2) as delay_hours from delays where hours > 0 group by call_id),
    seen_at as (select call_id, max(utc) filter (event_name = 'ATA') as ata, max(utc) filter (event_name = 'ATD') as atd, max(utc) filter (event_name = 'ETA') as eta from points group by call_id)
    select c.call_id, vcn, vessel_name, vessel_type, lt.* exclude (call_id), completeness_pct, quality_status, quality_score, coalesce(delay_hours, 0) as delay_hours, ata, atd, eta from calls c left join lt using (call_id) left join cp using (call_id) left join parts using (call_id) left join dh using (call_id) left join seen_at using (call_id)""",
)
def call_listing(spark: SparkSession, d: str) -> DataFrame:
    calls, points, delay_rows = bound(spark, d, "calls"), saved(_points(spark, d)), _delays(spark, d)
    stages = journey.stage_occurrences(calls, points, registry.stages(spark))
    metrics = leadtime.all_metrics(calls, points, registry.lead_times(spark), bound(spark, d, "services"), registry.EXECUTION_DELAYS)
    return dashboard.call_listing(calls, metrics, stages, quality.partition(calls, _issues(spark, d)), delay_rows, _CARDS, points)


@query("scoped_calls", f"with {_CALLS} select call_id, tenant, port, terminal from calls where tenant = 'BUILDING' and (terminal = 'T1' or terminal is null)")
def scoped_calls(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.apply_scope(bound(spark, d, "calls"), tenant="BUILDING", terminal="T1").select("call_id", "tenant", "port", "terminal")


@query("call_search", f"with {_CALLS} select call_id, vcn, vessel_name, vessel_type from calls where vessel_name ilike '%0012%' or vcn ilike '%0012%' or vessel_type ilike '%0012%'")
def call_search(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.search_calls(bound(spark, d, "calls"), text="0012").select("call_id", "vcn", "vessel_name", "vessel_type")


@query("leadtime_page", f"with {_CALLS}, {_POINTS}, {_LEAD} select call_id, metric, hours from lead_rows where metric = 'Turnaround' and status = 'AVAILABLE' order by hours desc, call_id limit 20 offset 10")
def leadtime_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _lead_times(spark, d).filter("metric = 'Turnaround' and status = 'AVAILABLE'").select("call_id", "metric", "hours")
    return stats.page(rows, [F.desc("hours"), "call_id"], 10, 20)


@query("event_timeline", f"with {_EVENTS} select call_id, event_id, utc, row_number() over (partition by call_id order by utc nulls last, event_id) as position from events")
def event_timeline(spark: SparkSession, d: str) -> DataFrame:
    return events.timeline(_events(spark, d)).select("call_id", "event_id", "utc", F.col("position").cast("long").alias("position"))


@query("signed_hours", f"with {_TIMINGS} select service_id, call_id, case when delay_hours is null then '—' else concat(case when delay_hours < 0 then '-' else '' end, cast(floor(abs(delay_hours)) as bigint), 'h ', cast(round((abs(delay_hours) - floor(abs(delay_hours))) * 60) as bigint), 'm (', case when delay_hours < 0 then '-' else '+' end, printf('%.2f', abs(delay_hours)), 'h)') end as text from timings")
def signed_hours(spark: SparkSession, d: str) -> DataFrame:
    return _timings(spark, d).select("service_id", "call_id", signed_hours_text("delay_hours").alias("text"))


# ---------------------------------------------------------------- reconciliation, lifecycle, landing, identity


@query(
    "expected_reconciliation",
    f"""with {_CALLS}, {_POINTS}, {_LEAD}, {_STAGES}, a as (select call_id, metric, hours from lead_rows where status = 'AVAILABLE' and metric in ('Anchorage Wait', 'Inward Movement')),
    e as (select call_id, stage as metric, hours from stage_rows where stage in ('Anchorage Wait', 'Inward Movement') and hours is not null), r as (select e.metric, case when a.hours is null then 'UNAVAILABLE' when round(abs(a.hours - e.hours), 6) <= 0.02 then 'PASS' else 'FAIL' end as result from e left join a using (call_id, metric)) select metric, result, count(*) as n from r group by metric, result""",
)
def expected_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Lead times against the journey stages of the same name, which come another way."""
    names = "('Anchorage Wait', 'Inward Movement')"
    actual = _lead_times(spark, d).filter(f"status = 'AVAILABLE' and metric in {names}").select(F.col("call_id").alias("key"), "metric", F.col("hours").alias("value"))
    expected = _stages(spark, d).filter(f"stage in {names}").select(F.col("call_id").alias("key"), F.col("stage").alias("metric"), F.col("hours").alias("value"))
    return reconcile.result_counts(reconcile.reconcile(actual, expected))


@query("population_totals", f"with {_CALLS}, {_POINTS}, {_LEAD}, {_STAGES}, t as (select 'calls' as source, count(distinct call_id) as n from calls union all select 'lead_times', count(distinct call_id) from lead_rows union all select 'journeys', count(distinct call_id) from stage_rows) select source, n, min(n) over () = max(n) over () as is_equal from t")
def population_totals(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.compare_totals({"calls": bound(spark, d, "calls"), "lead_times": _lead_times(spark, d), "journeys": _stages(spark, d)})


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the cells of workbooks, a file for each customer segment: header in row 3, one row for each order below, every date of a leap day misspelt."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("row_number", (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("o_orderkey")) + 3).cast("int"))
    when = F.when(F.dayofmonth("o_orderdate") == 29, "not-a-time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    values = [F.concat(F.lit("V"), F.col("o_custkey").cast("string")), F.upper("o_orderstatus"), when, F.col("o_orderpriority")]
    body = rows.select(F.concat("c_mktsegment", F.lit(".xlsx")).alias("file"), F.lit("Events").alias("sheet"), "row_number", F.posexplode(F.array(*values)).alias("column_number", "value"))
    head = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(".xlsx")).alias("file")).distinct().select("file", F.lit("Events").alias("sheet"), F.lit(3).alias("row_number"), F.posexplode(F.array(*[F.lit(x) for x in ("V.C.N.", "Event Name", "Event Timestamp", "Remark")])).alias("column_number", "value"))
    return body.unionByName(head)


_ALIASES = [("Events", "vcn", "VCN"), ("Events", "eventname", "Event_Name"), ("Events", "eventtimestamp", "Event_Timestamp")]
_REQUIRED = {"Events": ["VCN", "Event_Name", "Event_Timestamp"]}


def _validated(spark: SparkSession, d: str) -> DataFrame:
    cells, aliases = _cells(spark, d), spark.createDataFrame(_ALIASES, "target string, token string, column string")
    headers = landing.detect_headers(cells, aliases, _REQUIRED)
    raw = landing.raw_cells(cells, headers, landing.name_columns(cells, headers), aliases)
    return landing.validate_staging(landing.normalise_rows(raw), ["Event_Timestamp"])


_STAGED = """staged as (select concat(c_mktsegment, '.xlsx') as file, row_number() over (partition by c_mktsegment order by o_orderkey) + 3 as row_number, concat('V', o_custkey) as vcn, upper(o_orderstatus) as en, case when day(o_orderdate) = 29 then 'not-a-time' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as et, o_orderpriority as rem from orders join customer on o_custkey = c_custkey),
    checked as (select *, et = 'not-a-time' as bad, row_number() over (partition by vcn, en, et, rem, et = 'not-a-time' order by file, row_number) as seen from staged), validated as (select *, case when bad then 'INVALID' when seen > 1 then 'DUPLICATE' else 'VALID' end as validation_status from checked)"""


@query("staging_validation", f"with {_STAGED} select file, cast(row_number as bigint) as row_number, validation_status from validated")
def staging_validation(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("file", F.col("row_number").cast("long").alias("row_number"), "validation_status")


@query("dry_run", f"with {_STAGED} select 'Events' as target, validation_status, count(*) as n_rows, count(distinct file) as n_files from validated group by validation_status")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    return landing.dry_run(_validated(spark, d))


@query("file_status", f"with {_STAGED} select file, case when bool_or(bad) then 'VALIDATED_WITH_ISSUES' else 'VALIDATED' end as file_status from validated group by file")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _validated(spark, d)
    return landing.file_status(rows.select("file").distinct(), rows).select("file", "file_status")


@query("staging_issue_counts", f"with {_STAGED} select case validation_status when 'INVALID' then 'DQ-TIMESTAMP' else 'DQ-DUPLICATE' end as rule_id, count(*) as n from validated where validation_status <> 'VALID' group by 1")
def staging_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _validated(spark, d).withColumns({"call_id": F.lit(None).cast("long"), "record_reference": F.concat_ws(":", "file", "sheet", F.col("row_number").cast("string"))})
    return quality.staging_issues(rows, ["VCN", "Event_Name"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("lineage_drill", f"with {_STAGED} select concat(file, ':Events:', row_number) as record_reference, file, cast(row_number as int) as row_number, vcn from validated where validation_status = 'INVALID'")
def lineage_drill(spark: SparkSession, d: str) -> DataFrame:
    rows = _validated(spark, d)
    references = rows.filter("validation_status = 'INVALID'").select(F.concat_ws(":", "file", "sheet", F.col("row_number").cast("string")).alias("record_reference"))
    return lifecycle.lineage(references, rows).select("record_reference", "file", "row_number", F.col("values")["VCN"].alias("vcn"))


_BATCHES = "batches as (select c_mktsegment as tenant, cast(o_orderkey as varchar(20)) as batch_id, o_orderdate as created_at, case o_orderstatus when 'F' then 'COMMITTED' when 'O' then 'PENDING' else 'FAILED' end as status, concat(o_orderstatus, cast(o_orderkey % 97 as varchar(20))) as checksum from {orders} join {customer} on o_custkey = c_custkey)"


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"with {_BATCHES} select * from batches", orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


_DB = _BATCHES.format(orders="orders", customer="customer")


@query("active_batches", f"with {_DB}, r as (select *, row_number() over (partition by tenant, status order by created_at desc, batch_id desc) as n from batches) select tenant, batch_id, case when status = 'COMMITTED' and n > 1 then 'SUPERSEDED' else status end as status, status = 'COMMITTED' and n = 1 as is_active from r")
def active_batches(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.activate_latest(_batches(spark, d)).select("tenant", "batch_id", "status", "is_active")


@query("new_groups", f"with {_DB} select distinct tenant, checksum from batches b where status = 'PENDING' and not exists (select 1 from batches c where c.status = 'COMMITTED' and c.tenant = b.tenant and substr(c.checksum, 2) = substr(b.checksum, 2))")
def new_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _batches(spark, d).withColumn("short", F.expr("substr(checksum, 2)"))
    pending = rows.filter("status = 'PENDING'").select("tenant", F.col("short").alias("checksum"), F.col("checksum").alias("whole"))
    known = rows.select("tenant", "status", F.col("short").alias("checksum"))
    return lifecycle.new_groups(pending, known).select("tenant", F.col("whole").alias("checksum")).distinct()


_PARTY = """party as (select c_custkey * 2 as call_id, c_name as vessel_name, case when c_custkey % 3 = 0 then concat('V', cast(c_custkey as varchar(20))) end as vcn, c_phone_imo as imo, vessel_type, flag, cast(null as double) as loa, c_acctbal as grt, cast(null as int) as teu from base
    union all select c_custkey * 2 + 1, replace(c_name, '#', case when c_custkey % 2 = 0 then '-' else '.' end), case when c_custkey % 3 = 0 then concat('V', cast(c_custkey as varchar(20))) end, case when c_custkey % 10 = 0 then concat('X', cast(c_custkey as varchar(20))) else c_phone_imo end, vessel_type, flag, cast(null as double), c_acctbal, cast(null as int) from base where c_custkey % 4 < 3)"""
_BASE = "base as (select *, case when c_custkey % 5 = 0 then concat('I', cast(c_custkey as varchar(20))) end as c_phone_imo, c_mktsegment as vessel_type, cast(c_nationkey as varchar(20)) as flag from {customer})"


def _party(spark: SparkSession, d: str) -> DataFrame:
    """Customers, and three of four again with other punctuation."""
    return spark.sql(f"with {_BASE}, {_PARTY} select * from party", customer=table(spark, d, "customer")).withColumn("is_merged", F.lit(False))


_SQL_PARTY = f"{_BASE.format(customer='customer')}, {_PARTY}"


@query("normalised_names", f"with {_SQL_PARTY} select call_id, trim(regexp_replace(upper(trim(vessel_name)), '[^A-Z0-9]+', ' ', 'g')) as norm from party")
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    return _party(spark, d).select("call_id", normalise_name("vessel_name").alias("norm"))


def _scored_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _party(spark, d)
    pairs = identity._pairs(rows, "vcn").union(identity._pairs(rows, "imo")).distinct()
    return identity.score_pairs(pairs, rows)


@query(
    "identity_pairs",
    f"""with {_SQL_PARTY}, pr as (select distinct x.call_id as a, y.call_id as b from party x join party y on x.call_id < y.call_id and (x.vcn = y.vcn or x.imo = y.imo)),
    s as (select a, b, case when x.vessel_name = y.vessel_name then 1.0 else 0.99 end as sim, coalesce(x.vcn = y.vcn, false) as sv, coalesce(x.imo = y.imo, false) as si, coalesce(x.vcn <> y.vcn, false) or coalesce(x.imo <> y.imo, false) as conflict from pr join party x on x.call_id = a join party y on y.call_id = b),
    r as (select *, round(sim * .4 + case when sv then .25 else 0 end + case when si then .2 else 0 end + .05 + .05 + .05, 4) as raw from s)
    select a, b, sim as similarity, case when (sv or si) and not conflict then greatest(raw, 0.99) else raw end as score, conflict as is_conflict, case when conflict then 'BLOCKED_BY_CONFLICT' else 'AUTO_MERGE' end as disposition from r""",
)
def identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Calls that share a key: candidates by name are another query's."""
    return _scored_keys(spark, d).select("a", "b", "similarity", "score", "is_conflict", "disposition")


@query("identity_population", f"with {_SQL_PARTY}, pr as (select distinct y.call_id as b from party x join party y on x.call_id < y.call_id and (x.vcn = y.vcn or x.imo = y.imo) and not coalesce(x.vcn <> y.vcn, false) and not coalesce(x.imo <> y.imo, false)) select count(*) as n_total, (select count(*) from pr) as n_merged, count(*) - (select count(*) from pr) as n_consolidated from party")
def identity_population(spark: SparkSession, d: str) -> DataFrame:
    rows = _party(spark, d)
    groups = identity.merge_groups_by_key(rows)
    chosen = identity.survivors(groups, rows, ["vcn", "imo", "vessel_type", "flag", "grt"])
    return identity.population(identity.apply_merges(rows, chosen))


@query("identity_name_candidates")
def identity_name_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Classes by names alone cannot be said in SQL: the ratio of matching blocks. Tests hold them against all pairs."""
    return identity.name_classes(_party(spark, d))


@query("journey_counters", f"with {_ISSUES}, e as (select call_id, movement, {_hours('scheduled', 'served')} as hours from services where service_type = 'Pilotage'), sh as (select call_id, event_name, utc, row_number() over (partition by call_id, event_name order by utc, event_id) as n from live where event_name in ('SHIFT_PILOT_ON_BOARD', 'SHIFT_ALL_FAST')), sp as (select distinct a.call_id from sh a join sh z on a.call_id = z.call_id and a.n = z.n and a.event_name = 'SHIFT_PILOT_ON_BOARD' and z.event_name = 'SHIFT_ALL_FAST' and z.utc >= a.utc) select count(*) as n_calls, count(*) filter (quality_status = 'QUARANTINED') as n_quarantined, count(*) filter (call_id in (select call_id from sp)) as n_shifted, count(*) filter (call_id in (select call_id from e where hours < 0 and movement = 'Arrival')) as n_early_arrival, count(*) filter (call_id in (select call_id from e where hours < 0 and movement = 'Sailing')) as n_early_sailing from parts")
def journey_counters(spark: SparkSession, d: str) -> DataFrame:
    calls = bound(spark, d, "calls")
    shifts = journey.shift_occurrences(events.live(_events(spark, d)), *registry.REPEATABLE)
    early = _timings(spark, d).filter("kind = 'PILOT'").select("call_id", F.col("leg").alias("movement"), F.col("delay_hours").alias("hours"))
    return dashboard.counters(quality.partition(calls, _issues(spark, d)), shifts, early)


@query("duration_concepts", f"with {_TIMINGS} select service_id, call_id, round(delay_hours - 24.0, 6) as target_variance, case when delay_hours is not null then least(delay_hours, 0) end as early_delivery, case when delay_hours is not null then abs(least(delay_hours, 0)) end as early_hours from timings")
def duration_concepts(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.time import early_delivery, target_variance

    early, size = early_delivery("delay_hours")
    return _timings(spark, d).select("service_id", "call_id", target_variance("delay_hours", F.lit(24.0)).alias("target_variance"), early.alias("early_delivery"), size.alias("early_hours"))


