"""Small inputs with results worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wharfline.operators import bottleneck, delays, events, journey, kpi, leadtime, quality, stats
from wharfline.plans import registry

T0 = datetime(2026, 6, 1, 8)
EVENT = "call_id long, event_name string, utc timestamp_ntz, event_id string, source_system string, verification_status string, confidence double, created_at timestamp_ntz, occurrence_index int, is_superseded boolean, is_quarantined boolean"


def make_events(spark, rows):
    """rows: (call, name, hours after T0[, overrides])."""
    full = []
    for i, (call, name, hours, *more) in enumerate(rows):
        x = {"source_system": "AIS", "verification_status": "Verified", "confidence": 1.0, "occurrence_index": 1, "is_superseded": False, "is_quarantined": False} | (more[0] if more else {})
        full.append((call, name, T0 + timedelta(hours=hours), f"e{i:03d}", x["source_system"], x["verification_status"], x["confidence"], T0 + timedelta(minutes=i), x["occurrence_index"], x["is_superseded"], x["is_quarantined"]))
    return spark.createDataFrame(full, EVENT)


A = {"ATA": 0, "ANCHORAGE_ARRIVAL": 0, "PILOT_ON_BOARD_ARRIVAL": 2, "FIRST_LINE_TIED_ARRIVAL": 3, "ALL_FAST_ARRIVAL": 4, "CARGO_START": 5, "CARGO_END": 20, "LAST_LINE_UNTIED_SAILING": 24, "BREAKWATER_OUT": 26, "ATD": 28}
B = {"ATA": 0, "ANCHORAGE_ARRIVAL": 0, "PILOT_ON_BOARD_ARRIVAL": 4, "ALL_FAST_ARRIVAL": 6, "CARGO_START": 7, "CARGO_END": 15, "LAST_LINE_UNTIED_SAILING": 16, "ATD": 18}


@pytest.fixture(scope="module")
def two(spark):
    ev = make_events(spark, [(1, n, h) for n, h in A.items()] + [(2, n, h) for n, h in B.items()])
    calls = spark.createDataFrame([(1, "A", "Container"), (2, "B", "Bulk")], "call_id long, vessel_name string, vessel_type string")
    cargo = spark.createDataFrame([(1, "TEU", "Load", 1000.0, 15.0, 2, 1.0), (2, "MT", "Discharge", 5000.0, 8.0, 1, 0.5)], "call_id long, unit string, operation string, quantity double, working_hours double, resources int, downtime_hours double")
    return calls, ev, cargo


def test_kpi_arithmetic(spark, two):
    calls, ev, cargo = two
    shifts = kpi.pair_shifts(ev, *registry.REPEATABLE)
    for unit, size in (("TEU", 1000.0), ("MT", 5000.0), (None, None)):
        got = {r.kpi: r for r in kpi.results(kpi.measures(calls, events.instants(ev), cargo, shifts, unit=unit), registry.kpis(spark)).collect()}
        assert got["KPI-02"].value == size
    assert len(got) == 55
    assert {k: got[k].value for k in ("KPI-01", "KPI-03", "KPI-15", "KPI-17", "KPI-18", "KPI-21", "KPI-24", "KPI-29", "KPI-41", "KPI-43")} == {
        "KPI-01": 2.0, "KPI-03": 3.0, "KPI-15": 15.0, "KPI-17": 3.5, "KPI-18": 23.3333, "KPI-21": 33.3333, "KPI-24": 1000.0, "KPI-29": 6.1224, "KPI-41": 22.0, "KPI-43": 2.0,
    }
    assert (got["KPI-10"].status, got["KPI-10"].value, got["KPI-10"].band) == ("NO_SOURCE_DATA", None, "GRAY")
    assert got["KPI-51"].status == "NO_SOURCE_DATA"  # before its alias
    assert got["KPI-02"].status == "UNAVAILABLE"


def test_empty_input_is_unavailable_not_zero(spark, two):
    calls, ev, cargo = two
    got = {r.kpi: r for r in kpi.results(kpi.measures(calls.limit(0), events.instants(ev.limit(0)), cargo.limit(0), kpi.pair_shifts(ev.limit(0), *registry.REPEATABLE)), registry.kpis(spark)).collect()}
    assert got["KPI-03"].value is None and got["KPI-03"].status == "UNAVAILABLE"
    assert got["KPI-01"].value == 0.0


def test_repeated_shifts(spark):
    ev = make_events(spark, [(1, "SHIFT_PILOT_ON_BOARD", 0), (1, "SHIFT_PILOT_ON_BOARD", 3, {"occurrence_index": 2}), (1, "SHIFT_ALL_FAST", 1), (1, "SHIFT_ALL_FAST", 5, {"occurrence_index": 2})])
    got = kpi.pair_shifts(ev, *registry.REPEATABLE).agg(F.count("*"), F.avg("hours")).first()
    assert tuple(got) == (2, 1.5)
    again = journey.shift_occurrences(ev.filter("event_id <> 'e003'"), *registry.REPEATABLE).orderBy("occurrence").collect()
    assert [(r.status, r.hours) for r in again] == [("AVAILABLE", 1.0), ("MISSING", None)]


@pytest.mark.parametrize(("direction", "green", "amber", "values", "bands"), [("LOWER", 5.0, 10.0, [3, 7.5, 15, None], ["GREEN", "AMBER", "RED", "GRAY"]), ("HIGHER", 70.0, 50.0, [75, 55, 40], ["GREEN", "AMBER", "RED"]), ("BAND", 70.0, 50.0, [75, 40], ["GREEN", "RED"])])
def test_bands(spark, direction, green, amber, values, bands):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(kpi.band(F.col("v"), F.lit(5.0), F.lit(direction), F.lit(green), F.lit(amber))).collect()] == bands


def test_percentiles_and_statistics(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("a", 10.0, 2), ("b", 7.0, 3), ("c", None, 4)], "k string, v double, id long")
    got = {r.k: r for r in stats.duration_stats(df, ["k"], "v", "id").collect()}
    assert (got["a"].median, got["a"].p90, got["a"].p95, got["a"].fastest, got["a"].slowest) == (5.0, 9.0, 9.5, 1, 2)
    assert (got["b"].sd, got["b"].n, got["b"].small_sample) == (0.0, 1, True)
    assert (got["c"].n, got["c"].n_missing, got["c"].mean, got["c"].sd) == (0, 1, None, None)
    assert stats.nearest_rank(spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double"), ["k"], "v", 0.9).first().rank_value == 9.0


def test_leadtimes_keep_signs_and_say_what_is_missing(spark, two):
    calls, ev, _ = two
    got = {(r.call_id, r.metric): r for r in leadtime.lead_times(calls, events.instants(ev), registry.lead_times(spark)).collect()}
    assert len(got) == 2 * len(registry.LEAD_TIMES)
    assert got[1, "Turnaround"].hours == 28.0 and len(got[1, "Turnaround"].source_ids) == 2
    assert (got[2, "Breakwater Out to ATD"].status, got[2, "Breakwater Out to ATD"].reason) == ("UNAVAILABLE", "MISSING_START")
    assert got[1, "Truck Gate Turnaround"].status == "NO_SOURCE_DATA"
    blocked = spark.createDataFrame([(1, "Turnaround")], "call_id long, metric string")
    again = {(r.call_id, r.metric): r for r in leadtime.lead_times(calls, events.instants(ev), registry.lead_times(spark), blocked=blocked).collect()}
    assert (again[1, "Turnaround"].hours, again[1, "Turnaround"].status, again[2, "Turnaround"].hours) == (None, "UNAVAILABLE", 18.0)


def test_canonical_observation_keeps_all_candidates(spark):
    ev = make_events(spark, [(1, "ATA", 0, {"verification_status": "Conflicting"}), (1, "ATA", 5, {"confidence": 0.5}), (1, "ATA", 6, {"confidence": 0.9, "source_system": "VTS"}), (1, "ATA", 7, {"confidence": 0.9})])
    got = events.canonical_observations(ev).first()
    assert (got.event_id, got.reason, got.candidates) == ("e003", "SOURCE_PRIORITY", ["e000", "e001", "e002", "e003"])
    chosen = spark.createDataFrame([(1, "ATA", "e000")], "call_id long, event_name string, event_id string")
    assert events.canonical_observations(ev, overrides=chosen).first().event_id == "e000"
    fixed = events.apply_corrections(ev, spark.createDataFrame([("e003", T0)], "event_id string, utc timestamp_ntz"))
    assert fixed.count() == 5 and fixed.filter("is_superseded").count() == 1


def test_decomposition_is_conserved(spark):
    rows = [(1, "PILOT_ON_BOARD_ARRIVAL", 0), (1, "ALL_FAST_ARRIVAL", 10), (1, "PILOT_DISEMBARK_ARRIVAL", 11), (1, "CARGO_START", 15), (1, "CARGO_END", 30), (1, "SHIFT_PILOT_ON_BOARD", 16), (1, "SHIFT_ALL_FAST", 18), (1, "SHIFT_PILOT_ON_BOARD", 40, {"occurrence_index": 2}), (1, "SHIFT_ALL_FAST", 43, {"occurrence_index": 2})]
    ev = make_events(spark, rows)
    calls = spark.createDataFrame([(1,)], "call_id long")
    stages = journey.stage_occurrences(calls, events.instants(ev), registry.stages(spark))
    got = journey.decompose(stages, journey.shift_occurrences(ev, *registry.REPEATABLE)).first()
    assert (got.ACTIVE_SERVICE, got.PASSIVE_WAIT, got.HOLD, got.DELAY, got.total) == (23.0, 4.0, 1.0, 5.0, 33.0)


def test_service_timings(spark):
    t = T0
    m = lambda x: timedelta(minutes=x)
    rows = [(1, "s1", "Arrival", "Pilotage", t, t + m(10), t + m(25), t + m(45)), (1, "s2", "Sailing", "Tug", t, t + m(10), t + m(10), t + m(10)), (2, "s3", "Shifting", "Berthing", t, t + m(10), t + m(25), t + m(15)), (2, "s4", "x", "y", t, t + m(15), t + m(10), None)]
    df = spark.createDataFrame(rows, "call_id long, service_id string, movement string, service_type string, submission timestamp_ntz, requested timestamp_ntz, scheduled timestamp_ntz, served timestamp_ntz")
    got = {r.service_id: r for r in delays.service_timings(df).collect()}
    assert (got["s1"].status, got["s1"].delay_hours, got["s1"].gap_hours, got["s1"].leg) == ("LATE", 0.333333, 0.25, "Arrival")
    assert (got["s2"].status, got["s3"].status, got["s3"].delay_hours) == ("ON_TIME", "EARLY", -0.166667)
    assert (got["s4"].status, got["s4"].dq_status, got["s4"].gap_hours, got["s4"].missing, got["s4"].leg) == ("UNAVAILABLE", "DQ_SCHEDULE_BEFORE_REQUEST", -0.083333, ["served"], "UNCLASSIFIED")
    frequency = {r.leg: (r.late_pct, r.band) for r in delays.delay_frequency(delays.service_timings(df)).collect()}
    assert frequency == {"Arrival": (100.0, "RED"), "Sailing": (0.0, "GREEN"), "Shifting": (0.0, "GREEN")}


@pytest.mark.parametrize(("source", "reason", "category"), [("Marine Service", "Change of Shift", "Port-Side"), ("Weather", None, "Weather"), (None, "Tug unavailable", "Tug"), (None, "pilot late due to fog", "Weather"), ("Vessel", "x", "Vessel-Side"), ("Cargo Operation", "", "Cargo Operation"), (None, None, "Other"), ("?", "berth congestion", "Berth Non-Availability")])
def test_categories(spark, source, reason, category):
    df = spark.createDataFrame([(source, reason)], "s string, r string")
    assert df.select(delays.delay_category(F.col("s"), F.col("r"))).first()[0] == category


def test_allocations(spark):
    d = spark.createDataFrame([("d1", 2.0), ("d2", 1.0)], "delay_id string, hours double")
    x = spark.createDataFrame([("d1", "Tug", 1.5, False, 1), ("d1", "Pilot", 0.505, False, 2), ("d2", "Tug", 1.5, True, 1)], "delay_id string, category string, hours double, is_primary boolean, ordinal int")
    accepted, refused = delays.apply_allocations(d, x)
    assert {(r.delay_id, r.category, r.is_primary) for r in accepted.collect()} == {("d1", "Tug", True), ("d1", "Pilot", False)}
    assert [r.delay_id for r in refused.collect()] == ["d2"]


def test_bottleneck_contrast_and_criticality(spark):
    rows = [("steady", "PROCESS", float(x), 48.0) for x in (38, 39, 40, 41, 42)] + [("erratic", "PROCESS", x, 2.0) for x in (1.0, 1.2, 1.5, 4.0, 17.3)]
    got = bottleneck.rank(spark.createDataFrame(rows, "name string, kind string, hours double, target double")).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.rank)] == ["erratic", "steady"]
    level = bottleneck.with_levels(spark.createDataFrame([("x", 1.0, 1.3, 3.8)], "metric string, mean double, cv double, tail_ratio double"), "metric").first()
    assert (level.duration_level, level.variability_level, level.tail_level, level.score, level.criticality) == (1, 5, 5, 3.67, "HIGH")


def test_quality_rules(spark):
    ev = make_events(spark, [(1, "ATA", 0), (1, "ATA", 5, {"occurrence_index": 2}), (1, "ETA", 1), (2, "PILOT_REQUEST_ARRIVAL", 0), (3, "ANCHORAGE_ARRIVAL", 5), (3, "PILOT_ON_BOARD_ARRIVAL", 1)])
    calls = spark.createDataFrame([(1,), (2,), (3,)], "call_id long")
    ids = lambda df: sorted((r.rule_id, r.call_id) for r in df.collect())
    assert ids(quality.missing_arrival(calls, ev)) == [("DQ-003", 2), ("DQ-003", 3)]
    assert ids(quality.eta_after_ata(ev)) == [("DQ-004", 1)]
    assert ids(quality.unscheduled_pilot(ev)) == [("DQ-005", 2)]
    assert ids(quality.conflicting_arrivals(ev)) == [("DQ-010", 1)]
    broken = quality.sequence_violations(ev, registry.SEQUENCE)
    assert ids(broken) == [("DQ-006", 3)]
    assert quality.quarantine(ev, broken).filter("is_quarantined").select("event_id").first()[0] == "e005"
    parts = {r.call_id: (r.quality_status, r.quality_score) for r in quality.partition(calls, broken.unionByName(quality.eta_after_ata(ev))).collect()}
    assert parts == {1: ("FLAGGED", 85), 2: ("CLEAN", 100), 3: ("QUARANTINED", 40)}
    once = quality.merge_issues(broken, broken.limit(0))
    assert quality.merge_issues(broken, once).count() == once.count() == 1


def test_service_issues_in_one_pass(spark):
    """What two rules find apart: services without times, out of order, late with and without a reason, late twice in a call."""
    at = lambda h: None if h is None else datetime(2026, 1, 1, h)
    rows = [(1, "a", 1, 2, 3), (1, "b", 1, 2, 4), (2, "c", 1, 2, 3), (3, "d", None, 2, 2), (3, "e", 3, 2, None), (4, "f", 1, None, 5), (5, "g", None, None, None), (6, "h", 5, 2, 9), (None, "i", 1, 2, 3)]
    services = spark.createDataFrame([(c, s, *map(at, hours)) for c, s, *hours in rows], "call_id long, service_id string, requested timestamp_ntz, scheduled timestamp_ntz, served timestamp_ntz")
    reasons = spark.createDataFrame([(2, "fog"), (2, "wind"), (1, " "), (6, None)], "call_id long, reason string")
    got = [tuple(r) for r in quality.service_issues(services, reasons).collect()]
    want = [tuple(r) for r in quality.unexplained_lateness(services, reasons).unionByName(quality.service_times(services)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 10
