"""Listings and figures by hand: outliers as presented, the KPI catalogue, cargo by operation, traces, delays from staged rows, file manifests."""

import datetime
import hashlib

from pyspark.sql import functions as F

from wharfline.operators import canonical, dashboard, kpi, outlier
from wharfline.plans import registry
from wharfline.sources import landing


def test_outliers_as_presented(spark):
    schema = "rule string, call_id long, metric string, value double, threshold double, severity string, category string, is_excluded boolean, source_ids array<string>"
    rows = [
        (None, 1, "Turnaround", 90.0, 50.0, "HIGH", "OPERATIONAL_OUTLIER", False, []),
        ("OUT-1", 1, "Turnaround", 80.0, 50.0, "HIGH", "OPERATIONAL_OUTLIER", False, []),
        ("OUT-2", 2, "Wait", 9.0, 1.0, "MEDIUM", "Time-based Outlier", True, ["s9"]),
        ("OUT-3", 2, "Wait", 99.0, 1.0, "CRITICAL", "Sequence Outlier", False, None),
        ("OUT-4", 7, "Wait", 99.0, 1.0, "CRITICAL", "Time-based Outlier", False, None),
    ]
    found = spark.createDataFrame(rows, schema)
    calls = spark.createDataFrame([(1, "V1", "A"), (2, "V10", "B")], "call_id long, vcn string, vessel_name string")
    lead = spark.createDataFrame([(1, "Turnaround", 1, ["a", "b"]), (1, "Turnaround", 2, ["c", "a"]), (1, "Wait", 3, ["x"])], "call_id long, metric string, calculated_at int, source_ids array<string>")
    got = outlier.presented(found, calls, lead).collect()
    assert [r.rule for r in got] == ["OUT-2", None, "OUT-1", "OUT-3"]  # by the text of the severity, Z to A; unknown calls go
    old = got[1]
    assert (old.category, old.is_legacy, old.divergence, old.source_ids, old.threshold_label, old.leg) == ("Time-based Outlier", True, 40.0, ["c", "a", "b"], "Historical threshold", "Unavailable / Legacy record")
    assert (got[2].category, got[2].is_legacy, got[2].source_ids, got[2].issue) == ("Time-based Outlier", False, [], None)
    assert [r.rule for r in outlier.presented(found, calls, lead, category="Time-based Outlier").collect()] == ["OUT-2", None, "OUT-1"]
    assert [r.rule for r in outlier.presented(found, calls, lead, vcn="V1", is_excluded=False).collect()] == [None, "OUT-1"]
    assert outlier.presented(found, calls, lead, vcn="V").count() == 0 and outlier.presented(found, calls, lead, severity="CRITICAL").count() == 1


def test_catalogue_and_systems(spark):
    known = registry.kpis(spark)
    found = kpi.results(spark.createDataFrame([("KPI-01", 3.0, 3.0, 1.0)], "kpi string, value double, numerator double, denominator double"), known)
    listed = kpi.catalogue(known, found, category="Yard operations")
    assert [r.kpi for r in listed.collect()] == ["KPI-31", "KPI-32", "KPI-33", "KPI-34", "KPI-35"] and {r.availability for r in listed.collect()} == {"NO_SOURCE_DATA"}
    assert [r.kpi for r in kpi.catalogue(known, found, is_primary=False, availability="NO_SOURCE_DATA").collect()] == ["KPI-51", "KPI-53"]
    assert {(r.availability, r.result_status): r.n for r in kpi.availability_counts(kpi.catalogue(known, found)).collect()} == {("COMPUTED", "COMPUTED"): 1, ("COMPUTED", "UNAVAILABLE"): 26, ("NO_SOURCE_DATA", "NO_SOURCE_DATA"): 28}
    systems = {r.kpi: r.required_systems for r in kpi.with_required_systems(found, registry.required_systems(spark)).collect()}
    assert systems["KPI-36"] == ["GATE_OCR", "APPOINTMENT_SYSTEM"] and systems["KPI-53"] == ["TUG_POSITION_OR_ARRIVAL_LOG"] and systems["KPI-01"] == []
    assert {k for k, v in systems.items() if v} == {k[0] for k in registry.KPIS if not k[8]}  # each KPI without source data names what it would need


def test_scorecard_takes_the_newest(spark):
    history = spark.createDataFrame([("KPI-01", 1, 5.0), ("KPI-01", 2, 6.0), ("KPI-51", 2, 7.0)], "kpi string, calculated_at int, value double").withColumns({"band": F.lit("GREEN"), "status": F.lit("COMPUTED")})
    rows = {r.kpi: r for r in kpi.scorecard_results(kpi.latest(history), registry.kpis(spark)).collect()}
    assert len(rows) == 53 and rows["KPI-01"].value == 6.0 and rows["KPI-02"].value is None and "KPI-51" not in rows
    assert {r.kpi for r in kpi.scorecard_results(kpi.latest(history), registry.kpis(spark), aliases=True).collect()} >= {"KPI-51"}


def test_cargo_by_operation(spark):
    rows = [("Container", "TEU", 10.0), ("Container", "TEU", None), ("Container", "Boxes", 5.0), ("Liquid Bulk", "Barrels", 7.04), (None, None, 1.0), ("Cars", "Units", 2.0)]
    broken = dashboard.cargo_breakdown(spark.createDataFrame(rows, "cargo_type string, unit string, quantity double"))
    assert {(r.cargo_type, r.unit): (r.quantity, r.n_operations) for r in broken.collect()} == {("Container", "TEU"): (10.0, 2), ("Container", "Boxes"): (5.0, 1), ("Liquid Bulk", "Barrels"): (7.0, 1), ("General", "Units"): (1.0, 1), ("Cars", "Units"): (2.0, 1)}
    assert {r.unit: (r.quantity, r.n_operations) for r in dashboard.breakdown_totals(broken).collect()} == {"TEU": (15.0, 3), "MT": (7.0, 1), "Units": (3.0, 2)}
    assert {r.unit: r.quantity for r in dashboard.breakdown_totals(broken.limit(0)).collect()} == {"TEU": 0.0, "MT": 0.0, "Units": 0.0}


def test_traces_keep_the_order_of_metrics(spark):
    lead = spark.createDataFrame([(1, "B", 2.0, "AVAILABLE", None, ["y"]), (1, "A", None, "UNAVAILABLE", "MISSING_END", []), (1, "C", 1.0, "AVAILABLE", None, [])], "call_id long, metric string, hours double, status string, reason string, source_ids array<string>")
    (row,) = dashboard.duration_traces(lead, ["B", "A"]).collect()
    assert [tuple(t) for t in row.trace] == [("B", 2.0, "AVAILABLE", None, ["y"]), ("A", None, "UNAVAILABLE", "MISSING_END", [])]


def test_delays_from_staged_rows(spark):
    stage = lambda row, status, **values: ("f.xlsx", "Delays", row, "Delays", {"VCN": "V1", **values}, status)
    rows = [stage(4, "VALID", Delay_Hours="1.5", Scheduled_Time="2026-01-01 10:00:00", Served_Time="2026-01-01 12:00:00", Delay_Reason=" ", Note="late", Blank=" "), stage(5, "INVALID"), stage(6, "VALID", VCN="V2")]
    staging = spark.createDataFrame(rows, "file string, sheet string, row_number int, target string, values map<string,string>, validation_status string")
    (got,) = canonical.delays(staging, spark.createDataFrame([("V1", "c1")], "vcn string, call_id string")).collect()
    assert (got.delay_id, got.call_id, got.stated_hours, got.reason, got.attributes, got.record_reference) == ("f.xlsx:Delays:4", "c1", 1.5, None, {"Note": "late"}, "f.xlsx:Delays:4")
    assert got.served - got.scheduled == datetime.timedelta(hours=2)


def test_file_manifests(spark, tmp_path):
    texts = {"a.xlsx": b"one", "b.xlsx": b"two"}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    rows = landing.file_manifest(spark, [str(tmp_path / n) for n in texts]).collect()
    sums = {n: hashlib.sha256(c).hexdigest() for n, c in texts.items()}
    assert {(r.file.rsplit("/", 1)[1], r.checksum, r.n_bytes) for r in rows} == {(n, sums[n], 3) for n in texts}
    assert {r.group_checksum for r in rows} == {hashlib.sha256("".join(sorted(sums.values())).encode()).hexdigest()}


def test_manifest_of_a_file_over_two_gigabytes(spark, tmp_path):
    """No array holds such a file; one of holes takes no disk. A folder stands for its files, but for hidden ones."""
    (tmp_path / "parts").mkdir()
    for name in ("one", "two", "_SUCCESS"):
        (tmp_path / "parts" / name).write_text(name)
    with open(tmp_path / "large file", "wb") as f:
        f.truncate(2**31 + 5)
    rows = landing.file_manifest(spark, [str(tmp_path / "large file"), str(tmp_path / "parts")])
    with open(tmp_path / "large file", "rb") as f:
        sums = {"large file": hashlib.file_digest(f, "sha256").hexdigest(), **{n: hashlib.sha256(n.encode()).hexdigest() for n in ("one", "two")}}
    assert {(r.file.rsplit("/", 1)[1], r.checksum, r.n_bytes) for r in rows.collect()} == {(n, s, 2**31 + 5 if " " in n else 3) for n, s in sums.items()}
    assert {r.group_checksum for r in rows.collect()} == {hashlib.sha256("".join(sorted(sums.values())).encode()).hexdigest()}
