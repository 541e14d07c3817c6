import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from wharfline.operators import alerts, canonical, identity, lifecycle, reconcile
from wharfline.sources import landing

ALIASES = [("Calls", "vcn", "VCN"), ("Calls", "vesselname", "Vessel_Name"), ("Calls", "name", "Vessel_Name"), ("Calls", "eta", "ETA")]
GRID = [
    ["Port report", None, None, None],
    [None, None, None, None],
    ["Vessel name", "V.C.N.", "ETA", "Name"],
    ["Étoile", "V1", "2026-06-01 10:00", "Étoile"],
    ["Aurora", "V2", "not-a-timestamp", "AURORA"],
    ["Étoile", "V1", "2026-06-01 10:00", "Étoile"],
    [None, None, None, None],
    ["* footnote", None, None, None],
]


def cells(spark, grid=GRID, sheet="Sheet1"):
    rows = [("f.xlsx", sheet, r + 1, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "file string, sheet string, row_number int, column_number int, value string")


def test_messy_sheet(spark):
    aliases = spark.createDataFrame(ALIASES, "target string, token string, column string")
    c = cells(spark)
    headers = landing.detect_headers(c, aliases, {"Calls": ["VCN", "Vessel_Name"]})
    assert [(r.header_row, r.target, r.score) for r in headers.collect()] == [(3, "Calls", 3)]
    raw = landing.raw_cells(c, headers, landing.name_columns(c, headers), aliases)
    rows = landing.validate_staging(landing.normalise_rows(raw), ["ETA"]).orderBy("row_number").collect()
    assert [(r.row_number, r.validation_status) for r in rows] == [(4, "VALID"), (5, "INVALID"), (6, "DUPLICATE")]
    assert rows[1]["values"] == {"VCN": "V2", "ETA": "not-a-timestamp", "Vessel_Name": "Aurora", "Vessel_Name__source_2": "AURORA"}
    assert landing.missing_columns(cells(spark, GRID, "Calls"), aliases, {"Calls": ["VCN", "ATA"]}).first().missing == ["ATA"]


def test_cells_of_random_sheets(spark):
    """Against one row after the other: rows without known columns go, so do single values below a gap; equal values of a column once, others numbered."""
    rng = random.Random(8)
    head = ["VCN", "Name", "Vessel name", "Note", "note", "ETA"]
    column = {0: "VCN", 1: "Vessel_Name", 2: "Vessel_Name", 3: "Note", 4: "note__duplicate_2", 5: "ETA"}
    rows, want = [], {}
    for f in range(12):
        rows += [(f"{f}.xlsx", "Sheet1", 1, c, v) for c, v in enumerate(head)]
        last = None
        for r in range(2 + f % 2, 40):
            width = rng.choice([0, 0, 1, 1, 2, 4, 7])
            own = {c: rng.choice(["a", "b", "c", " "]) for c in sorted(rng.sample(range(7), width))}
            rows += [(f"{f}.xlsx", "Sheet1", r, c, v) for c, v in own.items()]
            own = {c: v for c, v in own.items() if v != " " and c in column}
            if not own:
                continue
            gap, last = last is not None and r - last > 1, r
            if set(own) <= {3, 4} or (len(own) == 1 and gap):
                continue
            values = {}
            for c, v in own.items():
                values.setdefault(column[c], [])
                if v not in values[column[c]]:
                    values[column[c]].append(v)
            want[f"{f}.xlsx", r] = {k if i == 1 else f"{k}__source_{i}": v for k, vs in values.items() for i, v in enumerate(vs, 1)}
    c = spark.createDataFrame(rows, "file string, sheet string, row_number int, column_number int, value string")
    aliases = spark.createDataFrame(ALIASES, "target string, token string, column string")
    headers = landing.detect_headers(c, aliases, {"Calls": ["VCN", "Vessel_Name"]})
    raw = landing.raw_cells(c, headers, landing.name_columns(c, headers), aliases)
    staged = landing.normalise_rows(raw)
    assert {(r.file, r.row_number): r["values"] for r in staged.collect()} == want and len(want) < 12 * 38
    first, status = {}, {}
    for (file, r), values in sorted(want.items()):
        status[file, r] = "DUPLICATE" if first.setdefault(tuple(sorted(values.items())), (file, r)) != (file, r) else "VALID"
    assert {(r.file, r.row_number): r.validation_status for r in landing.validate_staging(staged, []).collect()} == status and "DUPLICATE" in status.values()


def test_cells_are_dealt_to_their_rows_once(spark):
    """Headers, names of columns and rows that go are few and broadcast; of rows that occur once only hashes are dealt again."""
    rows = spark.range(2, 2000).select(F.lit("f.xlsx").alias("file"), F.lit("Sheet1").alias("sheet"), F.col("id").cast("int").alias("row_number"), F.posexplode(F.array(F.concat(F.lit("V"), "id"), F.concat(F.lit("Ship "), "id"))).alias("column_number", "value"))
    c = cells(spark, [["VCN", "Vessel name"]]).unionByName(rows)
    aliases = spark.createDataFrame(ALIASES, "target string, token string, column string")
    headers = landing.detect_headers(c, aliases, {"Calls": ["VCN", "Vessel_Name"]})
    raw = landing.raw_cells(c, headers, landing.name_columns(c, headers), aliases)
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    staged = landing.normalise_rows(raw)
    assert (dealt(raw), dealt(staged), dealt(landing.validate_staging(staged, ["ETA"]))) == (0, 1, 0) and staged.count() == 1998


def test_repeated_headers(spark):
    c = cells(spark, [["VCN", "Name", "name", "ETA"]])
    headers = spark.createDataFrame([("f.xlsx", "Sheet1", 1, "Calls")], "file string, sheet string, header_row int, target string")
    assert [r.unique_header for r in landing.name_columns(c, headers).orderBy("column_number").collect()] == ["VCN", "Name", "name__duplicate_2", "ETA"]


def test_event_names(spark):
    rows = spark.createDataFrame([("ALL_FAST", None), ("Pilot On-Board 2", "Shifting"), ("Served Date and Time", None), ("Served Date and Time", "Arrival"), ("Odd one", None)], "name string, movement string")
    words = spark.createDataFrame([("x", "X")], "token string, event_name string")
    aliases = spark.createDataFrame([("pilotonboard2", "SHIFTING", "PILOT_ON_BOARD_{MOVEMENT}", 1), ("serveddateandtime", None, "SERVED_{MOVEMENT}", 1)], "token string, scope string, target string, ordinal int")
    got = [r.event_name for r in landing.canonical_event_name(rows, words, aliases).orderBy("name", "movement").collect()]
    assert sorted(got) == sorted(["ALL_FAST", "PILOT_ON_BOARD_SHIFTING", "Served Date and Time", "SERVED_ARRIVAL", "Odd one"])


def test_manifest(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    got = landing.file_manifest(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert {r.n_bytes for r in got} == {1} and len({r.group_checksum for r in got}) == 1 and len({r.checksum for r in got}) == 2


def test_canonical_build(spark):
    row = "file string, sheet string, row_number int, target string, values map<string,string>, validation_status string"
    staged = spark.createDataFrame(
        [("f", "s", 1, "VesselCalls", {"VCN": "V1", "GRT": "x", "LOA": "200"}, "VALID"), ("f", "s", 2, "VesselCalls", {"VCN": "V1", "Vessel_Name": "late"}, "VALID"), ("f", "s", 3, "VesselCalls", {"VCN": "V2"}, "DUPLICATE"), ("f", "e", 1, "Events", {"VCN": "V1", "Event_Name": "ATA", "Event_Timestamp": "2026-06-01 10:00"}, "VALID"), ("f", "e", 2, "Events", {"VCN": "V9", "Event_Name": "ATA", "Event_Timestamp": "2026-06-01 10:00"}, "VALID")],
        row,
    )
    calls = canonical.vessel_calls(staged, ["GRT", "LOA"], [])
    got = calls.collect()
    assert [(r.vcn, r.vessel_name, r.grt, r.loa, r.record_reference) for r in got] == [("V1", "UNKNOWN", None, 200.0, "f:s:1")]
    events = {r.vcn: r for r in canonical.events(staged, calls).collect()}
    assert events["V1"].utc == datetime(2026, 6, 1, 8) and not events["V1"].is_quarantined
    assert events["V9"].is_quarantined and events["V9"].call_id is None


CALL = "call_id long, vessel_name string, vcn string, imo string, vessel_type string, flag string, loa double, grt double, teu int, is_merged boolean"


def test_identity(spark):
    calls = spark.createDataFrame(
        [(1, "SYNTHETIC HORIZON 12", "V1", "I1", "Bulk", "ZA", 200.0, 1.0, None, False), (2, "SYNTHETIC- HORIZON 12", "V1", "I1", "Bulk", "ZA", 200.0, 2.0, None, False), (3, "SYNTHETIC HORIZON 12", "V3", "I3", None, None, None, None, None, False), (4, "OTHER", "V4", None, None, None, None, None, None, False)],
        CALL,
    )
    pairs = identity.candidate_pairs(calls)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)} 
    scored = {(r.a, r.b): r for r in identity.score_pairs(pairs, calls).collect()}
    assert (scored[1, 2].disposition, scored[1, 2].similarity, scored[1, 2].score >= 0.98) == ("AUTO_MERGE", 0.99, True)
    assert scored[1, 3].disposition == "BLOCKED_BY_CONFLICT"
    groups = identity.survivors(identity.merge_groups(identity.score_pairs(pairs, calls)), calls, ["vcn", "imo", "grt"])
    assert {tuple(r) for r in groups.collect()} == {(1, 1), (2, 1)}
    merged = identity.apply_merges(calls, groups)
    assert tuple(identity.population(merged).first()) == (4, 1, 3)
    one = identity.consolidate(groups, calls, ["grt"], ["flag"]).first()
    assert (one.grt, one.grt_rule, one.flag, one.flag_rule) == (2.0, "MAX_NUMERIC", "ZA", "UNANIMOUS")
    assert {r.outcome for r in identity.evidence_rows(identity.score_pairs(pairs, calls)).filter("a = 1 and b = 2").collect()} == {"AGREED", "PARTIAL"}


def test_rekeyed_events_keep_the_survivors_slot(spark):
    ev = spark.createDataFrame([(1, "ATA", 1, "a"), (2, "ATA", 1, "b"), (2, "ATD", 1, "c"), (3, "ATD", 1, "d")], "call_id long, event_name string, occurrence_index int, event_id string")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "call_id long, survivor_id long")
    assert {(r.call_id, r.event_id) for r in identity.rekey_events(ev, groups).collect()} == {(1, "a"), (1, "c"), (3, "d")}


def test_lifecycle(spark, tmp_path):
    batches = spark.createDataFrame([("t", "b1", datetime(2026, 1, 1), "COMMITTED", "c1"), ("t", "b2", datetime(2026, 1, 2), "COMMITTED", "c2"), ("u", "b3", datetime(2026, 1, 1), "FAILED", "c3")], "tenant string, batch_id string, created_at timestamp, status string, checksum string")
    assert {(r.batch_id, r.status, r.is_active) for r in lifecycle.activate_latest(batches).collect()} == {("b1", "SUPERSEDED", False), ("b2", "COMMITTED", True), ("b3", "FAILED", False)}
    files = lambda rows: spark.createDataFrame(rows, "tenant string, file string, checksum string")
    got = lifecycle.append_files(files([("t", "a", "1")]), files([("t", "b", "1"), ("t", "c", "2"), ("t", "d", "2")]), most=2)
    assert {(r.file, r.intake) for r in got.collect()} == {("a", "ACCEPTED"), ("c", "ACCEPTED")}
    path = str(tmp_path / "x")
    lifecycle.replace_tenant(spark.createDataFrame([("t", 1), ("u", 2)], "tenant string, v int"), path)
    lifecycle.replace_tenant(spark.createDataFrame([("t", 3)], "tenant string, v int"), path)
    assert {(r.tenant, r.v) for r in spark.read.parquet(path).collect()} == {("t", 3), ("u", 2)}
    refs = spark.createDataFrame([("a:b:s:7",), ("odd",)], "record_reference string")
    staged = spark.createDataFrame([("a:b", "s", 7, {"k": "v"})], "file string, sheet string, row_number int, values map<string,string>")
    assert [r["values"] for r in lifecycle.lineage(refs, staged).orderBy("record_reference").collect()] == [{"k": "v"}, None]


def test_alerts_are_not_repeated(spark):
    found = spark.createDataFrame([("r", "delay", "1", "HIGH", "m"), ("r", "delay", "2", "HIGH", "m")], "rule string, entity_type string, entity_id string, severity string, message string")
    open_ = spark.createDataFrame([("r", "delay", "1", "NEW"), ("r", "delay", "2", "RESOLVED")], "rule string, entity_type string, entity_id string, status string")
    assert [r.entity_id for r in alerts.suppress(found, open_).collect()] == ["2"]


def test_reconciliation(spark):
    t = "key long, metric string, value double"
    actual = spark.createDataFrame([(1, "m", 1.0), (2, "m", 1.03)], t)
    wide = spark.createDataFrame([(1, 1.02), (2, 1.0), (3, 5.0), (4, None)], "id long, e double")
    got = {r.key: r.result for r in reconcile.reconcile(actual, reconcile.melt(wide, "id", {"e": "m"})).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "UNAVAILABLE"}
    assert reconcile.compare_totals({"a": actual.withColumn("call_id", F.col("key")), "b": actual.limit(1).withColumn("call_id", F.col("key"))}).filter("is_equal").count() == 0


def test_alike_names_equal_all_pairs(spark):
    """Pairs and classes of names against every pair, with blanks, the default name, hot keys and names that share no start."""
    from difflib import SequenceMatcher

    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("AEIORSTLNMK") for _ in range(n))
    names = ["EVERGREEN", "EVRGREEN", "MAERSK", "MEARSK", "HANJIN", "HANGIN", "hanjin.", None, "", "UNKNOWN", "Unknown", "UNKNOWN"] + [f"SHIP 0000{i:02}" for i in range(25)]
    for _ in range(20):
        base = say(rng.randint(3, 14))
        at = rng.randrange(len(base))
        names += [base, base[:at] + say(1) + base[at + 1 :], say(2) + base[at:], base[::-1]]
    rows = [(i, n, None, None, False) for i, n in enumerate(names)] + [(900, "EVERGREEN", None, None, True)]
    calls = spark.createDataFrame(rows, "call_id long, vessel_name string, vcn string, imo string, is_merged boolean")
    norm = {i: re.sub("[^A-Z0-9]+", " ", (n or "").upper().strip()).strip() for i, n, *_, merged in rows if not merged}
    named = {i: n for i, n in norm.items() if n not in ("", "UNKNOWN")}
    for least in (0.7, 0.85):
        want = {(a, b) for a in named for b in named if a < b and (named[a] == named[b] or round(SequenceMatcher(None, min(named[a], named[b]), max(named[a], named[b])).ratio(), 4) >= least)}
        assert {tuple(r) for r in identity.candidate_pairs(calls, least=least).collect()} == want
        group = {i: i for i in norm}
        for _ in range(len(norm)):
            for a, b in want:
                group[a] = group[b] = min(group[a], group[b])
        for crowd in (500, 4):
            assert {r.call_id: r.class_id for r in identity.name_classes(calls, least=least, crowd=crowd).collect()} == group


def test_merges_reach_a_fixpoint_and_can_be_taken_back(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").withColumn("disposition", F.lit("AUTO_MERGE"))
    groups = identity.merge_groups(chain)
    assert {r.leader for r in groups.collect()} == {0} and groups.count() == 41
    merged = groups.select("call_id", F.col("leader").alias("survivor_id"))
    back = identity.unmerge(merged, spark.createDataFrame([(7,), (7,), (99,)], "call_id long"))
    assert {r.call_id: r.survivor_id for r in back.collect()} == {i: 7 if i == 7 else 0 for i in range(41)}
