"""Stored results and merges from a log: concurrent writers, buckets, repeated runs, replays against a sequential merger with before-images."""

import random
import threading
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from wharfline.functions import names as name_functions
from wharfline.functions import store
from wharfline.operators import canonical, dashboard, identity, leadtime, quality, reconcile


def test_one_of_many_writers_publishes(spark, tmp_path):
    path, got = f"{tmp_path}/t", []

    def write(i):
        try:
            got.append(store.publish(spark, path, None, {"x": str(i)}).number)
        except store.Conflict:
            got.append("conflict")

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, got)) == ["1"] + ["conflict"] * 5
    first = store.current(spark, path)
    assert store.publish(spark, path, first, {"y": "2"}).number == 2 and [v.number for v in store.versions(spark, path)] == [1, 2]
    with pytest.raises(store.Conflict):
        store.publish(spark, path, first, {"z": "3"})
    assert store.current(spark, path).parts == {"y": "2"}


def test_read_through(spark, tmp_path):
    path, made = f"{tmp_path}/snapshots", []

    def compute():
        made.append(1)
        return {"population": spark.range(7), "notes": spark.createDataFrame([], "text string")}

    read = lambda **more: dashboard.read_through(spark, path, compute, tenant="a", lineage={"batch_id": f"B{len(made)}"}, **more)
    sections, state, lineage = read()
    assert (sections["population"].count(), sections["notes"].columns, state, lineage) == (7, ["text"], "MISS", {"batch_id": "B0"})
    assert read()[1:] == ("HIT", {"batch_id": "B0"}) and len(made) == 1
    assert read(filters="bulk")[1] == "COMPUTED" and read()[1] == "HIT"
    assert read(recompute=True)[1] == "MISS" and len(store.versions(spark, f"{path}/tenant=a")) == 2
    assert dashboard.read_through(spark, path, compute, tenant="b", worth=lambda f: False)[1] == "COMPUTED" and store.current(spark, f"{path}/tenant=b") is None

    def overtaken():
        if store.current(spark, f"{path}/tenant=c") is None:
            dashboard.read_through(spark, path, compute, tenant="c", lineage={"batch_id": "other"})
        return compute()

    sections, state, lineage = dashboard.read_through(spark, path, overtaken, tenant="c", lineage={"batch_id": "mine"})
    assert (state, lineage["batch_id"], sections["population"].count()) == ("SHARED", "other", 7)
    assert len(store.versions(spark, f"{path}/tenant=c")) == 1


def test_one_change_rewrites_one_bucket(spark, tmp_path):
    path = f"{tmp_path}/derived"
    source = spark.range(1000).select(F.col("id").alias("call_id"), (F.col("id") % 7).alias("x")).union(spark.createDataFrame([(None, 1)], "call_id long, x long"))
    derive = lambda rows: rows.groupBy("call_id").agg(F.sum("x").alias("total"))
    _, written = store.rebuild(spark, path, derive, source, buckets=16)
    assert len(written) == 16
    changed = source.withColumn("x", F.when(F.col("call_id") == 41, 100).otherwise(F.col("x"))).filter("call_id is null or call_id <> 42")
    before = store.current(spark, path)
    after, written = store.rebuild(spark, path, derive, changed, changed=spark.createDataFrame([(41,)], "call_id long"), buckets=16)
    assert len(written) == 1 and {n for n in after.parts if after.parts[n] != before.parts[n]} == set(written)
    after, written = store.rebuild(spark, path, derive, changed, changed=spark.createDataFrame([(42,), (41,)], "call_id long"), buckets=16)
    assert 1 <= len(written) <= 2
    full = {tuple(r) for r in derive(changed).collect()}
    assert {tuple(r) for r in store.read(spark, after).collect()} == full
    same, written = store.rebuild(spark, path, derive, changed, changed=spark.createDataFrame([], "call_id long"), buckets=16)
    assert (same.number, written) == (after.number, [])
    gone, _ = store.rebuild(spark, path, derive, changed.filter("call_id < 0"), changed=changed, buckets=16)
    assert store.read(spark, gone).count() == 0 and store.read(spark, gone).columns == ["call_id", "total"]
    with pytest.raises(ValueError):
        store.rebuild(spark, path, derive, changed, changed=changed, buckets=8)


def test_vacuum_keeps_what_newer_versions_share(spark, tmp_path):
    path = f"{tmp_path}/t"
    source = spark.range(50).select(F.col("id").alias("call_id"))
    derive = lambda rows: rows.withColumn("x", F.lit(1))
    store.rebuild(spark, path, derive, source, buckets=4)
    for i in range(3):
        last, touched = store.rebuild(spark, path, derive, source, changed=source.filter(f"call_id = {i}"), buckets=4)
    before = store.versions(spark, path)
    gone = store.vacuum(spark, path, keep=2)
    assert [v.number for v in store.versions(spark, path)] == [3, 4] and len(gone) >= 1
    assert not set(gone) & {f for v in before[2:] for f in v.parts.values()}
    assert store.read(spark, store.current(spark, path)).count() == 50 and store.read(spark, before[2]).count() == 50
    assert store.vacuum(spark, path, keep=2) == [] and store.rebuild(spark, path, derive, source, changed=source.limit(1), buckets=4)[0].number == 5


def test_upserts_repeat_without_effect(spark, tmp_path):
    path, keys = f"{tmp_path}/issues", ["rule_id", "record_reference"]
    rows = spark.createDataFrame([("A", f"r{i}", "OPEN") for i in range(9)] + [("B", None, "OPEN")] * 2, "rule_id string, record_reference string, status string")
    merge = lambda stored, new: quality.merge_issues(new, stored)
    counts = lambda v: sorted(tuple(r) for r in store.read(spark, v).groupBy("rule_id", "status").count().collect())
    one, _ = store.upsert(spark, path, rows, keys)
    two, _ = store.upsert(spark, path, rows, keys)
    assert counts(one) == counts(two) == [("A", "OPEN", 9), ("B", "OPEN", 1)]
    three, touched = store.upsert(spark, path, rows.filter("record_reference = 'r3'").withColumn("status", F.lit("RESOLVED")), keys)
    assert counts(three) == [("A", "OPEN", 8), ("A", "RESOLVED", 1), ("B", "OPEN", 1)] and len(touched) == 1
    four, _ = store.upsert(spark, path, rows.filter("record_reference is not null"), keys, merge=merge)
    five, _ = store.upsert(spark, path, rows.filter("record_reference is not null"), keys, merge=merge)
    assert counts(four) == counts(five) == [("A", "OPEN", 9), ("A", "RESOLVED", 1), ("B", "OPEN", 1)]
    newest = spark.createDataFrame([("A", "r1", "OLD", 1), ("A", "r1", "NEW", 2)], "rule_id string, record_reference string, status string, at int")
    six, _ = store.upsert(spark, f"{tmp_path}/other", newest, keys, newest=[F.col("at")])
    assert [r.status for r in store.read(spark, six).collect()] == ["NEW"]


def test_upserts_deal_new_rows_by_their_keys_once(spark, tmp_path, monkeypatch):
    """What meets stored rows is dealt by the keys once and for its bucket once more; a row's columns go along once, not as its order too."""
    plans = []
    write = store.write_buckets
    monkeypatch.setattr(store, "write_buckets", lambda rows, *more: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, *more))
    rows = spark.range(500).select(F.concat(F.lit("A"), F.col("id") % 3).alias("rule_id"), F.concat(F.lit("r"), "id").alias("record_reference"), F.lit("OPEN").alias("status"))
    store.upsert(spark, f"{tmp_path}/t", rows, ["rule_id", "record_reference"], merge=lambda stored, new: quality.merge_issues(new, stored))
    assert plans[0].split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2 and "max_by" not in plans[0]
    twice = spark.createDataFrame([(None, 1, "b", None), (None, 1, "a", 5), ("k", 2, None, 1), ("k", 1, "z", 9)], "k string, at int, x string, y int")
    version, _ = store.upsert(spark, f"{tmp_path}/u", twice, ["k"], newest=[F.col("at")])
    assert {tuple(r) for r in store.read(spark, version).select("k", "at", "x", "y").collect()} == {(None, 1, "b", None), ("k", 2, None, 1)}
    version, _ = store.upsert(spark, f"{tmp_path}/v", twice.select("k"), ["k"])
    assert sorted(store.read(spark, version).toPandas()["k"].tolist(), key=str) == [None, "k"]


def test_runs_are_appended_once(spark, tmp_path):
    path = f"{tmp_path}/runs"
    assert store.history(spark, path) is None
    for run, n in (("a", 3), ("b", 4), ("a", 9)):
        store.append_run(spark, path, spark.range(n), run)
    assert sorted(tuple(r) for r in store.history(spark, path).groupBy("run_id").count().collect()) == [("a", 3), ("b", 4)]


def merged_one_by_one(decisions, calls, children):
    """A merger that takes before-images and moves children; what was undone is left out, as the log knows it from the start."""
    undone = {u for seq, _, action, _, _, u in decisions if action == "UNMERGE" for s, i, a, *_ in decisions if i == u and a == "MERGE" and s < seq}
    calls, children, into = {k: dict(v) for k, v in calls.items()}, dict(children), {}
    for _, i, action, call, survivor, _ in sorted(decisions):
        if action != "MERGE" or i in undone or call in into or call == survivor:
            continue
        into[call] = survivor
        image = calls[call]
        calls[survivor]["grt"] = max((x for x in (calls[survivor]["grt"], image["grt"]) if x is not None), default=None)
        calls[survivor]["name"] = calls[survivor]["name"] or image["name"]
        for child, owner in children.items():
            if owner == call:
                children[child] = survivor
    return calls, children, into


def test_replay_equals_merging_one_by_one(spark):
    rng = random.Random(8)
    for _ in range(4):
        n = 25
        calls = {i: {"grt": rng.choice([None, 1.0, 5.0, rng.random() * 9]), "name": rng.choice([None, f"n{i}"])} for i in range(n)}
        children = {f"e{k}": rng.randrange(n) for k in range(80)}
        decisions = []
        for seq in range(30):
            if decisions and rng.random() < 0.25:
                decisions.append((seq, f"d{seq}", "UNMERGE", 0, 0, rng.choice(decisions)[1]))
            else:
                a, b = rng.randrange(n), rng.randrange(n)
                decisions.append((seq, f"d{seq}", "MERGE", a, b, None))
        df = spark.createDataFrame(decisions, "seq long, decision_id string, action string, call_id long, survivor_id long, undoes string")
        table = spark.createDataFrame([(i, c["grt"], c["name"]) for i, c in calls.items()], "call_id long, grt double, name string")
        merged = identity.replay(df)
        want_calls, want_children, into = merged_one_by_one(decisions, calls, children)
        owned = identity.with_owner(spark.createDataFrame(list(children.items()), "event_id string, call_id long"), merged)
        assert {r.event_id: (r.call_id, r.own_id) for r in owned.collect()} == {k: (v, children[k]) for k, v in want_children.items()}
        got = {r.call_id: r for r in identity.replayed_calls(table, merged, ["grt"], ["name"]).collect() if r.merged_into is None}
        assert set(got) == set(calls) - set(into) | {v for v in want_children.values() if v not in into} or set(got) >= set(calls) - set(into)
        assert all((got[i].grt, got[i].name) == (want_calls[i]["grt"], want_calls[i]["name"]) for i in set(calls) - set(into))


def test_merge_merge_unmerge_the_first(spark):
    rows = [(1, "m1", "MERGE", 2, 1, None), (2, "m2", "MERGE", 1, 3, None), (3, "u1", "UNMERGE", 2, 1, "m1")]
    df = spark.createDataFrame(rows, "seq long, decision_id string, action string, call_id long, survivor_id long, undoes string")
    assert {(r.call_id, r.survivor_id) for r in identity.replay(df).collect()} == {(1, 3)} == {(r.call_id, r.survivor_id) for r in identity.replay(df.filter("seq = 2")).collect()}
    assert {(r.call_id, r.survivor_id, *r.path) for r in identity.replay(df.filter("seq < 3")).collect()} == {(1, 3, 2), (2, 3, 2, 1)}


def test_few_names_reach_the_ratio(spark):
    """400 random names: under a tenth of all pairs have their ratio taken, and none that is alike is missed; short names of few letters too."""
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(300)}
    for n in sorted(names)[:100]:
        at = rng.randrange(len(n))
        names.add(n[:at] + rng.choice(letters) + n[at + rng.randint(0, 2) :])
    short = {"".join(rng.choice("ABC") for _ in range(rng.randint(1, 9))) for _ in range(150)}
    for own, most in ((sorted(names), 0.1), (sorted(short), 1.0)):
        alike = {(p, q) for i, p in enumerate(own) for q in own[i + 1 :] if round(SequenceMatcher(None, p, q).ratio(), 4) >= 0.7}
        keys = identity._alike_keys(spark.createDataFrame([(n,) for n in own], "norm string"), 0.7)
        met = {(r.p, r.q) for r in identity.name_pairs(keys, 0.7).collect()}
        assert alike and alike <= met and len(met) < most * len(own) * (len(own) - 1) / 2


@pytest.mark.parametrize("letters, longest, tile", [("AB", 6, 7), ("ABCDEFGHIJ 0123456789", 20, 1024), ("AEIORSTL", 64, 50), ("ABC", 90, 16), ("ÄÖ漢字AB", 12, 5)])
def test_names_compared_in_tiles_equal_every_pair(monkeypatch, letters, longest, tile):
    """Lengths up to a word of the machine and beyond it, repeated characters, one side and two, tiles of a few names."""
    monkeypatch.setattr(name_functions, "TILE", tile)
    rng = random.Random(longest)
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(60)}
    for n in sorted(names)[:40]:
        at = rng.randrange(len(n))
        names.add(n[:at] + rng.choice(letters) + n[at + rng.randint(0, 2) :])
    own = sorted(names)
    rng.shuffle(own)
    for least in (0.7, 0.9):
        alike = lambda xs, ys: {(p, q) for x in xs for y in ys for p, q in [sorted((x, y))] if p < q and round(SequenceMatcher(None, p, q).ratio(), 4) >= least}  # noqa: E731, B023
        for got, want in ((name_functions.alike_names(own, None, least), alike(own, own)), (name_functions.alike_names(own[:30], own[30:], least), alike(own[:30], own[30:]))):
            got = list(got)
            assert len(got) == len(set(got)) and set(got) == want and want


def test_blocks_of_names_meet_once(spark):
    names = [f"{a}{b}" for a in ("AURORA", "BOREAS", "CASTOR") for b in range(30)]
    want = {(p, q) for p in names for q in names if p < q and round(SequenceMatcher(None, p, q).ratio(), 4) >= 0.8}
    got = identity.alike_pairs(spark.createDataFrame([(n,) for n in names], "norm string"), 0.8, block=20).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_many_names_of_one_length(spark):
    """20,000 names of 18 random characters, of which 5,000 are another one's with one replaced: nearly all share parts with nearly all."""
    name = F.upper(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 18))
    rows = spark.range(15_000).select((F.col("id") * 2).alias("call_id"), name.alias("vessel_name"))
    again = spark.range(0, 15_000, 3).select(F.col("id") * 2 + 1, F.concat(F.substring(name, 1, 7), F.lit("-"), F.substring(name, 9, 10)))
    calls = rows.union(again).withColumns({"vcn": F.lit(None).cast("string"), "imo": F.lit(None).cast("string"), "is_merged": F.lit(False)})
    start = time.monotonic()
    assert {tuple(r) for r in identity.candidate_pairs(calls).collect()} == {(2 * i, 2 * i + 1) for i in range(0, 15_000, 3)}
    assert time.monotonic() - start < 120  # seconds; over 200 by meeting under shared parts


def test_copies_have_one_representative(spark):
    rows = [(3, "a", None), (1, "a", None), (2, "a", 5), (4, None, None), (9, None, None)]
    df = spark.createDataFrame(rows, "call_id long, name string, n int")
    assert {tuple(r) for r in identity.representatives(df, ["name", "n"]).collect()} == {(3, 1), (1, 1), (2, 2), (4, 4), (9, 4)}


def test_filter_sets_in_one_pass(spark):
    calls = spark.createDataFrame([(i, i % 3) for i in range(50)], "call_id long, kind int").union(spark.createDataFrame([(7, 1)], "call_id long, kind int"))
    sources = {"all": calls, "some": calls.filter("call_id < 20"), "rows": spark.createDataFrame([(1,), (1,), (4,), (99,)], "call_id long")}
    filters = {"every": F.lit(True), "one": F.col("kind") == 1, "none": F.col("kind").isNull()}
    got = reconcile.compare_masked(calls, filters, sources)
    slow = reconcile.compare_filtered({name: {s: frame.join(calls.filter(c).select("call_id").distinct(), "call_id", "left_semi") for s, frame in sources.items()} for name, c in filters.items()})
    columns = ["filter_set", "source", "n", "is_equal"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, slow.select(*columns).collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 6


def test_newest_source_row(spark):
    stage = lambda row, batch, vcn, eta, ata: ("f", "VesselCalls", row, "VesselCalls", {"VCN": vcn, "ETA": eta, "ATA": ata}, "VALID", batch)
    rows = [stage(1, "b1", "V1", "2026-01-02 00:00:00", "2026-01-01 00:00:00"), stage(9, "b1", "V2", "2026-01-01 00:00:00", "2026-01-02 00:00:00"), stage(2, "b2", "V1", "2026-01-02 00:00:00", "  "), stage(3, "b3", "V2", None, None), stage(4, "b2", "V3", "2026-01-05 00:00:00", "2026-01-04 00:00:00"), stage(5, "b2", "V9", None, None)]
    staging = spark.createDataFrame(rows, "file string, sheet string, row_number int, target string, values map<string,string>, validation_status string, batch_id string")
    batches = spark.createDataFrame([("b1", 1, "COMMITTED"), ("b2", 2, "PROCESSING"), ("b3", 3, "FAILED")], "batch_id string, created_at int, status string")
    calls = spark.createDataFrame([(1, "V1"), (2, "V2"), (3, "V3"), (4, "V4")], "call_id long, vcn string")
    source = canonical.source_times(canonical.newest_rows(staging, batches), calls)
    assert {(r.call_id, r.rule_id, r.record_reference) for r in quality.source_row_issues(source).collect()} == {(1, "DQ-003", "call:1"), (3, "DQ-004", "call:3")}
    lead = spark.createDataFrame([(c, m, 5.0, "AVAILABLE", None) for c in (1, 2, 4) for m in ("Turnaround", "Wait")], "call_id long, metric string, hours double, status string, reason string")
    got = {(r.call_id, r.metric): (r.hours, r.status, r.reason) for r in leadtime.gate_turnaround(lead, source).collect()}
    assert got[1, "Turnaround"] == (None, "UNAVAILABLE", "SOURCE_ATA_BLANK") and all(v == (5.0, "AVAILABLE", None) for k, v in got.items() if k != (1, "Turnaround"))


def test_duplicate_issues_are_the_second_calls(spark):
    rows = [(1, 2, True, True, 1.0, 0.99), (1, 3, True, True, 1.0, 0.99), (2, 3, True, True, 1.0, 0.99), (1, 4, False, True, 0.99, 0.99), (1, 5, False, False, 0.99, 0.99)]
    scored = spark.createDataFrame(rows, "a long, b long, same_name boolean, same_vcn boolean, similarity double, score double")
    got = {(r.rule_id, r.call_id, r.record_reference, r.status) for r in quality.duplicate_calls(scored).collect()}
    assert got == {("DQ-001", 2, "call:2", "RESOLVED"), ("DQ-001", 3, "call:3", "RESOLVED"), ("DQ-002", 4, "call:4", "OPEN")}
    assert quality.duplicate_calls(scored).count() == 3


def test_merges_by_keys_need_no_pairs(spark):
    """Groups by links equal those of all scored pairs; a hot key gives links in proportion."""
    rng = random.Random(5)
    for _ in range(5):
        rows = [(i, f"NAME {i % 3}", rng.choice([None, " ", "V1", "V2", "V3", f"V{i}"]), rng.choice([None, "", "I1", "I2", "I3"]), "t", "f", None, 1.0, None, rng.random() < 0.1) for i in range(30)]
        calls = spark.createDataFrame(rows, "call_id long, vessel_name string, vcn string, imo string, vessel_type string, flag string, loa double, grt double, teu int, is_merged boolean")
        live = calls.filter("not is_merged")
        pairs = identity._pairs(live, "vcn").union(identity._pairs(live, "imo")).distinct()
        want = {tuple(r) for r in identity.merge_groups(identity.score_pairs(pairs, live)).collect()}
        assert {tuple(r) for r in identity.merge_groups_by_key(calls).collect()} == want
    hot = spark.range(2000).select(F.col("id").alias("call_id"), F.lit("V").alias("vcn"), F.lit(None).cast("string").alias("imo"), F.lit(False).alias("is_merged"))
    assert identity.key_links(hot).count() == 1999
