"""Registered queries: each applies operators to the whole bound tables. The SQL texts beside them say the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bottleneck, delays, events, journey, kpi, leadtime, outlier, quality, stats
from ..sources.tables import bound, oracle
from . import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


def _hours(a: str, z: str, digits: int = 6) -> str:
    return f"round(date_diff('microsecond', {a}, {z}) / 3.6e9, {digits})"


# Views that several SQL texts start from.
_CALLS = f"calls as ({oracle('calls')})"
_EVENTS = f"""raw_events as ({oracle('events')}),
    events as (select *, row_number() over (partition by call_id, event_name order by event_id) as occurrence_index from raw_events)"""
_LIVE = f"{_EVENTS}, live as (select * from events where not is_superseded and not is_quarantined)"
_CANONICAL = f"""{_LIVE}, ranked as (select *, case verification_status when 'Verified' then 1 when 'Conflicting' then 2 else 3 end as v, coalesce(confidence, 0) as c,
        case source_system when 'AIS' then 1 when 'VTS' then 2 when 'Manual Log' then 10 else 11 end as s from events where event_name not in ('SHIFT_PILOT_ON_BOARD', 'SHIFT_ALL_FAST')),
    numbered as (select *, row_number() over w as rn, count(*) over (partition by call_id, event_name) as n_candidates, lead(v) over w as v2, lead(c) over w as c2, lead(s) over w as s2
        from ranked window w as (partition by call_id, event_name order by v, c desc, s, created_at, event_id)),
    canonical as (select call_id, event_name, event_id, utc, n_candidates, case when n_candidates = 1 then 'ONLY_OBSERVATION' when v < v2 then 'VERIFICATION' when c > c2 then 'CONFIDENCE' when s < s2 then 'SOURCE_PRIORITY' else 'EARLIEST' end as reason
        from numbered where rn = 1)"""
_POINTS = f"""{_CANONICAL}, ends as (select call_id, event_name, arg_min(utc, struct_pack(o := occurrence_index, u := utc, e := event_id)) as utc, arg_min(event_id, struct_pack(o := occurrence_index, u := utc, e := event_id)) as event_id,
        arg_max(utc, struct_pack(o := occurrence_index, u := utc, e := event_id)) as last_utc from live group by all),
    points as (select f.call_id, f.event_name, coalesce(l.utc, f.utc) as utc, coalesce(l.event_id, f.event_id) as event_id, f.last_utc from ends f left join canonical k using (call_id, event_name) left join live l on l.event_id = k.event_id and l.call_id = k.call_id and l.event_name = k.event_name)"""
_SERVICES = f"services as ({oracle('services')})"
_TIMINGS = f"""{_SERVICES}, timings as (select call_id, service_id, movement as leg, service_type, case service_type when 'Pilotage' then 'PILOT' when 'Tug' then 'TUG' when 'Berthing' then 'BERTH' else 'OTHER' end as kind,
        {_hours('submission', 'requested')} as planning_hours, {_hours('requested', 'scheduled')} as gap_hours, {_hours('scheduled', 'served')} as delay_hours, {_hours('requested', 'served')} as wait_hours,
        case when scheduled is null or served is null then 'UNAVAILABLE' when served < scheduled then 'EARLY' when served = scheduled then 'ON_TIME' else 'LATE' end as status,
        case when scheduled < requested then 'DQ_SCHEDULE_BEFORE_REQUEST' when submission is null or requested is null or scheduled is null or served is null then 'INCOMPLETE' else 'OK' end as dq_status from services)"""
_CARGO = f"cargo as ({oracle('cargo')})"
_STAGES = f"""stages as (select * from {_values(registry.STAGES)} as t(stage, sequence, start_event, end_event, category, actor_from, actor_to, repeatable)),
    stage_rows as (select c.call_id, t.stage, t.sequence, t.category, t.actor_from, t.actor_to, a.utc as start_utc, z.utc as end_utc, {_hours('a.utc', 'z.utc')} as hours,
        case when a.utc is null or z.utc is null then 'MISSING' when z.utc < a.utc then 'DEVIATED' else 'AVAILABLE' end as status,
        case when a.utc is null and z.utc is null then 'MISSING_BOTH' when a.utc is null then 'MISSING_START' when z.utc is null then 'MISSING_END' when z.utc < a.utc then 'SEQUENCE_VIOLATION' end as reason
        from calls c cross join stages t left join points a on a.call_id = c.call_id and a.event_name = t.start_event left join points z on z.call_id = c.call_id and z.event_name = t.end_event where not t.repeatable)"""
_LEAD = f"""defs as (select * from {_values(registry.LEAD_TIMES)} as t(metric, start_event, end_event, computable)),
    lead_rows as (select c.call_id, d.metric, case when d.computable then {_hours('a.utc', 'z.utc')} end as hours,
        case when not d.computable then 'NO_SOURCE_DATA' when a.utc is null or z.utc is null then 'UNAVAILABLE' else 'AVAILABLE' end as status,
        case when not d.computable then 'NO_SOURCE_DATA' when a.utc is null and z.utc is null then 'MISSING_BOTH' when a.utc is null then 'MISSING_START' when z.utc is null then 'MISSING_END' end as reason,
        concat_ws('|', a.event_id, z.event_id) as source_ids
        from calls c cross join defs d left join points a on a.call_id = c.call_id and a.event_name = d.start_event left join points z on z.call_id = c.call_id and z.event_name = d.end_event)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events.occurrence_index(bound(spark, d, "events"), ["event_id"])


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """The events with their id in place of the occurrence number, which it orders alike: for what only compares places."""
    return bound(spark, d, "events").withColumn("occurrence_index", F.col("event_id"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return events.points(_ordered(spark, d), repeatable=registry.REPEATABLE)


def _lead_times(spark: SparkSession, d: str) -> DataFrame:
    return leadtime.lead_times(bound(spark, d, "calls"), _points(spark, d), registry.lead_times(spark))


def _timings(spark: SparkSession, d: str) -> DataFrame:
    return delays.service_timings(bound(spark, d, "services"))


def _stages(spark: SparkSession, d: str) -> DataFrame:
    return journey.stage_occurrences(bound(spark, d, "calls"), _points(spark, d), registry.stages(spark))


def _joined(c: str) -> F.Column:
    return F.array_join(c, "|")


@query("occurrence_index", f"with {_EVENTS} select call_id, event_name, event_id, occurrence_index from events")
def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("call_id", "event_name", "event_id", "occurrence_index")


@query("canonical_observation", f"with {_CANONICAL} select call_id, event_name, event_id, utc, n_candidates, reason from canonical")
def canonical_observation(spark: SparkSession, d: str) -> DataFrame:
    return events.canonical_observations(_events(spark, d), repeatable=registry.REPEATABLE).drop("candidates")


@query("event_instants", f"with {_POINTS} select call_id, event_name, utc, event_id, last_utc from points")
def event_instants(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).drop("last_id")


@query("lead_times", f"with {_CALLS}, {_POINTS}, {_LEAD} select call_id, metric, hours, status, reason, source_ids from lead_rows")
def lead_times(spark: SparkSession, d: str) -> DataFrame:
    return _lead_times(spark, d).withColumn("source_ids", _joined("source_ids"))


_Q = lambda q: f"quantile_cont(hours, {q})"


@query(
    "leadtime_stats",
    f"""with {_CALLS}, {_POINTS}, {_LEAD}, s as (select metric, count(hours) as n, count(*) - count(hours) as n_missing, avg(hours) as mean, {_Q(0.5)} as median,
        case when count(hours) > 0 then coalesce(stddev_samp(hours), 0) end as sd, min(hours) as lo, max(hours) as hi, {_Q(0.25)} as p25, {_Q(0.75)} as p75, {_Q(0.9)} as p90, {_Q(0.95)} as p95,
        arg_min(call_id, struct_pack(h := hours, c := call_id)) filter (hours is not null) as fastest, arg_max(call_id, struct_pack(h := hours, c := -call_id)) filter (hours is not null) as slowest from lead_rows group by metric)
    select metric, n, n_missing, round(mean, 4) as mean, round(median, 4) as median, round(sd, 4) as sd, round(lo, 4) as "min", round(hi, 4) as "max", round(p25, 4) as p25, round(p75, 4) as p75, round(p90, 4) as p90, round(p95, 4) as p95,
        round(case when abs(mean) >= 0.001 then sd / mean end, 4) as cv, round(case when median > 0 then p90 / median end, 4) as tail_ratio, coalesce(mean > 1.2 * median, false) as right_skew, n < 5 as small_sample, cast(fastest as varchar) as fastest, cast(slowest as varchar) as slowest from s""",
)
def leadtime_stats(spark: SparkSession, d: str) -> DataFrame:
    got = stats.duration_stats(_lead_times(spark, d), ["metric"], "hours", "call_id")
    return got.withColumns({"right_skew": F.coalesce("right_skew", F.lit(False)), "fastest": F.col("fastest").cast("string"), "slowest": F.col("slowest").cast("string")})


@query(
    "tukey_outliers",
    f"""with {_CALLS}, {_POINTS}, {_LEAD}, f as (select metric, {_Q(0.25)} as lo, {_Q(0.75)} as hi from lead_rows group by metric)
    select metric, call_id, hours, round(lo - 1.5 * (hi - lo), 4) as lower_fence, round(hi + 1.5 * (hi - lo), 4) as upper_fence from lead_rows join f using (metric) where hours < lo - 1.5 * (hi - lo) or hours > hi + 1.5 * (hi - lo)""",
)
def tukey_outliers(spark: SparkSession, d: str) -> DataFrame:
    got = stats.tukey_outliers(_lead_times(spark, d), ["metric"], "hours")
    return got.select("metric", "call_id", "hours", F.round("lower_fence", 4).alias("lower_fence"), F.round("upper_fence", 4).alias("upper_fence"))


_CUSTOM = f"""{_LIVE}, pos as (select call_id, event_name, utc, row_number() over (partition by call_id, event_name order by occurrence_index, utc, event_id) as up, row_number() over (partition by call_id, event_name order by occurrence_index desc, utc desc, event_id desc) as down
        from live where event_name in ('ANCHORAGE_ARRIVAL', 'CARGO_END'))"""


def _custom(side: str, where: str) -> str:
    return f"select a.call_id, cast(a.{side} as bigint) as occurrence, {_hours('a.utc', 'z.utc')} as hours from pos a join pos z on a.call_id = z.call_id and a.{side} = z.{side} and a.event_name = 'ANCHORAGE_ARRIVAL' and z.event_name = 'CARGO_END' where {where}"


for _pick, _side, _where in (("first", "up", "a.up = 1"), ("last", "down", "a.down = 1"), ("nth", "up", "a.up = 2"), ("all", "up", "true")):

    @query(f"custom_lead_time_{_pick}", f"with {_CUSTOM} {_custom(_side, _where)}")
    def custom(spark: SparkSession, d: str, pick: str = _pick) -> DataFrame:
        return leadtime.custom_lead_time(_events(spark, d), "ANCHORAGE_ARRIVAL", "CARGO_END", pick=pick, n=2).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("custom_outliers", f"with {_CUSTOM}, h as ({_custom('up', 'true')}), p as (select quantile_cont(hours, 0.9) as p90 from h) select call_id, occurrence, hours, round(p90, 4) as p90 from h, p where hours > p90 or hours < 0")
def custom_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = leadtime.custom_lead_time(_events(spark, d), "ANCHORAGE_ARRIVAL", "CARGO_END", pick="all").withColumn("occurrence", F.col("occurrence").cast("long"))
    return leadtime.builder_outliers(rows).withColumn("p90", F.round("p90", 4))


@query(
    "duration_histogram",
    f"""with {_CUSTOM}, h as ({_custom('up', 'true')}), e as (select min(hours) as lo, max(hours) as hi from h),
    b as (select i as bin, round(lo + i * (hi - lo) / 5, 2) as bin_start, round(lo + (i + 1) * (hi - lo) / 5, 2) as bin_end from e, range(5) as r(i))
    select cast(bin as int) as bin, bin_start, bin_end, count(hours) as n from b left join h on hours >= bin_start and (hours < bin_end or (bin = 4 and hours = bin_end)) group by all""",
)
def duration_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(leadtime.custom_lead_time(_events(spark, d), "ANCHORAGE_ARRIVAL", "CARGO_END", pick="all"), "hours")


@query(
    "turnaround_contribution",
    f"""with {_CALLS}, {_POINTS}, {_LEAD}, t as (select call_id, hours as total from lead_rows where metric = 'Turnaround' and status = 'AVAILABLE')
    select r.call_id, r.metric, r.hours, round(r.hours / nullif(t.total, 0) * 100, 2) as share_pct from lead_rows r left join t using (call_id) where r.status = 'AVAILABLE'""",
)
def turnaround_contribution(spark: SparkSession, d: str) -> DataFrame:
    return leadtime.contribution(_lead_times(spark, d))


@query("stage_occurrences", f"with {_CALLS}, {_POINTS}, {_STAGES} select call_id, stage, category, start_utc, end_utc, hours, status, reason from stage_rows")
def stage_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d).select("call_id", "stage", "category", "start_utc", "end_utc", "hours", "status", "reason")


_SHIFTS = """shift_events as (select call_id, event_name, utc, event_id, row_number() over (partition by call_id, event_name order by utc, event_id) as n from live where event_name in ('SHIFT_PILOT_ON_BOARD', 'SHIFT_ALL_FAST')),
    shifts as (select coalesce(a.call_id, z.call_id) as call_id, coalesce(a.n, z.n) as n, a.utc as start_utc, z.utc as end_utc from (select * from shift_events where event_name = 'SHIFT_PILOT_ON_BOARD') a
        full outer join (select * from shift_events where event_name = 'SHIFT_ALL_FAST') z on a.call_id = z.call_id and a.n = z.n)"""


@query(
    "shift_pairs",
    f"""with {_LIVE}, {_SHIFTS} select call_id, cast(n as bigint) as occurrence, start_utc, end_utc, {_hours('start_utc', 'end_utc')} as hours,
    case when start_utc is null or end_utc is null then 'MISSING' when end_utc < start_utc then 'DEVIATED' else 'AVAILABLE' end as status from shifts""",
)
def shift_pairs(spark: SparkSession, d: str) -> DataFrame:
    got = journey.shift_occurrences(events.live(_events(spark, d)), *registry.REPEATABLE)
    return got.select("call_id", F.col("occurrence").cast("long").alias("occurrence"), "start_utc", "end_utc", "hours", "status")


_BUCKETS = ", ".join(f"coalesce(sum(hours) filter (category = '{c}'), 0) as {c}" for c in journey.CATEGORIES)
_DECOMPOSED = f"""main as (select call_id, sequence, category, start_utc, end_utc, hours from stage_rows where status = 'AVAILABLE' and sequence < 100), sums as (select call_id, {_BUCKETS} from main group by call_id),
    ok_shifts as (select call_id, n, start_utc as s, end_utc as e, {_hours('start_utc', 'end_utc')} as h from shifts where end_utc >= start_utc),
    homes as (select f.call_id, n, h, arg_min(category, sequence) filter (s >= start_utc and e <= end_utc) as home from ok_shifts f left join main m on m.call_id = f.call_id group by all),
    moved as (select call_id, home, sum(h) as h from homes group by all),
    left_over as (select coalesce(s.call_id, k.call_id) as call_id, {', '.join(f"greatest(coalesce({c}, 0) - coalesce((select sum(h) from moved v where v.call_id = coalesce(s.call_id, k.call_id) and v.home = '{c}'), 0), 0) as {c}" for c in journey.CATEGORIES if c != 'DELAY')}, coalesce(DELAY, 0) as d0,
        {' + '.join(f'coalesce({c}, 0)' for c in journey.CATEGORIES if c != 'DELAY')} as t0, coalesce((select sum(h) from moved v where v.call_id = coalesce(s.call_id, k.call_id) and v.home is null), 0) as outside from sums s full outer join (select distinct call_id from homes) k on k.call_id = s.call_id),
    decomposed as (select call_id, {', '.join(f'round({c}, 6) as {c}' for c in journey.CATEGORIES if c != 'DELAY')}, round(d0 + outside + t0 - ({' + '.join(c for c in journey.CATEGORIES if c != 'DELAY')}), 6) as DELAY from left_over)"""


@query("journey_decomposition", f"with {_CALLS}, {_POINTS}, {_STAGES}, {_SHIFTS}, {_DECOMPOSED} select *, round({' + '.join(journey.CATEGORIES)}, 6) as total from decomposed")
def journey_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return journey.decompose(_stages(spark, d), journey.shift_occurrences(events.live(_events(spark, d)), *registry.REPEATABLE))


@query(
    "handovers",
    f"""with {_CALLS}, {_POINTS}, {_STAGES}, n as (select *, lead(stage) over w as next_stage, lead(start_utc) over w as next_start, lead(status) over w as next_status from stage_rows where sequence < 100 window w as (partition by call_id order by sequence))
    select call_id, stage, next_stage, actor_from, actor_to, case when status = 'AVAILABLE' and next_status = 'AVAILABLE' then {_hours('end_utc', 'next_start')} end as wait_hours from n where next_stage is not null""",
)
def handovers(spark: SparkSession, d: str) -> DataFrame:
    return journey.handovers(_stages(spark, d))


@query(
    "journey_status",
    f"""with {_CALLS}, {_POINTS}, {_STAGES} select call_id, count(*) filter (status <> 'MISSING') as n_covered, count(*) filter (status = 'MISSING') as n_missing, count(*) filter (status = 'DEVIATED') as n_deviated,
    case when count(*) filter (status <> 'MISSING') > 0 then 'RECONSTRUCTED' else 'FAILED' end as status from stage_rows group by call_id""",
)
def journey_status(spark: SparkSession, d: str) -> DataFrame:
    return journey.journeys(_stages(spark, d)).drop("deviations")


@query("journey_coverage", f"with {_CALLS}, {_POINTS}, {_STAGES}, j as (select call_id, bool_or(status <> 'MISSING') as ok from stage_rows group by call_id) select count(*) filter (ok) as n_reconstructed, count(*) as n_calls from j")
def journey_coverage(spark: SparkSession, d: str) -> DataFrame:
    return journey.coverage(bound(spark, d, "calls"), journey.journeys(_stages(spark, d)))


_LINES = """lines as (select call_id, sequence, stage, case status when 'AVAILABLE' then printf('%s took %.2f hours.', stage, hours) when 'DEVIATED' then printf('%s is out of sequence by %.2f hours.', stage, abs(hours)) end as line from stage_rows where status <> 'MISSING')"""


@query("journey_narrative", f"with {_CALLS}, {_POINTS}, {_STAGES}, {_LINES} select call_id, string_agg(line, ' ' order by sequence) as summary, string_agg(stage, '|' order by sequence) as grounding from lines group by call_id")
def journey_narrative(spark: SparkSession, d: str) -> DataFrame:
    return journey.narrative(_stages(spark, d)).withColumn("grounding", _joined("grounding"))


_CONCEPT = "round(sum(hours) filter (status = 'AVAILABLE' and category in ({})), 6)"


@query("waiting_and_service_time", f"with {_CALLS}, {_POINTS}, {_STAGES} select call_id, {_CONCEPT.format(chr(39) + chr(39).join(['PASSIVE_WAIT', ', ', 'HOLD']) + chr(39))} as waiting_hours, {_CONCEPT.format(chr(39) + 'ACTIVE_SERVICE' + chr(39))} as service_hours from stage_rows group by call_id")
def waiting_and_service_time(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d).groupBy("call_id").agg(leadtime.concept_total(leadtime.WAITING).alias("waiting_hours"), leadtime.concept_total(leadtime.SERVICE).alias("service_hours"))


@query("service_timings", f"with {_TIMINGS} select call_id, service_id, leg, kind, planning_hours, gap_hours, delay_hours, wait_hours, status, dq_status from timings")
def service_timings(spark: SparkSession, d: str) -> DataFrame:
    return _timings(spark, d).drop("missing", "service_type")


@query(
    "delay_frequency",
    f"""with {_TIMINGS}, s as (select leg, count(*) filter (status = 'LATE') as n_late, count(*) filter (status <> 'UNAVAILABLE') as n_eligible from timings group by leg)
    select leg, n_late, n_eligible, round(n_late * 100.0 / n_eligible, 1) as late_pct, case when n_late * 100.0 / n_eligible < 40 then 'GREEN' when n_late * 100.0 / n_eligible <= 60 then 'ORANGE' else 'RED' end as band from s""",
)
def delay_frequency(spark: SparkSession, d: str) -> DataFrame:
    return delays.delay_frequency(_timings(spark, d))


@query(
    "delay_overview",
    f"""with {_TIMINGS} select kind, round(avg(delay_hours), 4) as mean_delay_hours, count(*) filter (status = 'LATE') as n_late, count(*) filter (status = 'ON_TIME') as n_on_time, count(*) filter (status = 'EARLY') as n_early,
    case when kind = 'TUG' then round(avg(wait_hours), 4) end as mean_wait_hours from timings group by kind""",
)
def delay_overview(spark: SparkSession, d: str) -> DataFrame:
    return delays.delay_overview(_timings(spark, d))


@query("late_vessels", f"with {_TIMINGS} select kind, count(distinct call_id) as n_calls from timings where status = 'LATE' group by kind")
def late_vessels(spark: SparkSession, d: str) -> DataFrame:
    return delays.late_vessels(_timings(spark, d))


@query(
    "service_performance",
    f"with {_TIMINGS} select service_type, leg, round(avg(delay_hours), 4) as mean_delay_hours, count(*) - count(delay_hours) as n_missing, count(*) as n_records, count(distinct call_id) as n_calls, min(service_id) as first_record, max(service_id) as last_record from timings group by service_type, leg",
)
def service_performance(spark: SparkSession, d: str) -> DataFrame:
    return kpi.service_performance(_timings(spark, d))


@query(
    "execution_delays",
    f"""with {_SERVICES}, p as (select * from services where service_type = 'Pilotage'), m as (select movement, call_id, arg_min(service_id, struct_pack(n := scheduled is null, s := scheduled, i := service_id)) as service_id from p where movement in ('Arrival', 'Sailing') group by all),
    e as (select call_id, arg_min(service_id, struct_pack(n := scheduled is null, s := scheduled, i := service_id)) as first_id, arg_max(service_id, struct_pack(n := scheduled is null, s := scheduled, i := service_id)) as last_id, count(*) as n from p group by call_id),
    k as (select 'Arrival' as movement union all select 'Sailing'), r as (select k.movement, e.call_id, coalesce(m.service_id, case when e.n > 1 then case k.movement when 'Arrival' then e.first_id else e.last_id end end) as service_id from e cross join k left join m on m.call_id = e.call_id and m.movement = k.movement)
    select r.movement, r.call_id, r.service_id, (select max({_hours('scheduled', 'served')}) from p where p.service_id = r.service_id and p.call_id = r.call_id) as hours from r where r.service_id is not null""",
)
def execution_delays(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, "services")
    return leadtime.execution_delays(rows, "Arrival").withColumn("movement", F.lit("Arrival")).unionByName(leadtime.execution_delays(rows, "Sailing").withColumn("movement", F.lit("Sailing")))
