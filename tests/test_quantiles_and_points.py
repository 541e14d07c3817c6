import math

import numpy as np
from pyspark.sql import functions as F

from wharfline.operators import events, quality, stats


def test_quantiles_are_exact(spark):
    """By linear, nearest and upper rank against sorted lists: sizes from none to more than the sketch holds, ties, nulls."""
    rng = np.random.default_rng(6)
    groups = {"one": [3.5], "two": [0.0, 10.0], "ties": [1.0] * 50 + [2.0] * 50, "many": rng.normal(size=30_000).round(3).tolist(), "odd": rng.exponential(size=101).tolist(), "few": rng.integers(-3, 3, 1000).astype(float).tolist(), "none": []}
    rows = [(k, v) for k, values in groups.items() for v in values] + [(k, None) for k in groups]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    qs = (0.0, 0.25, 0.3, 0.5, 0.9, 0.95, 1.0)
    picks = {f"{rule}{i}": (q, rule) for rule in ("linear", "nearest", "upper") for i, q in enumerate(qs) if not (rule == "upper" and q == 1.0)}
    got = {r.k: r for r in stats.with_quantiles(df, ["k"], "v", picks, [F.count("*").alias("rows")]).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        x, n = sorted(values), len(values)
        assert got[k].n == n and got[k].rows == n + 1
        for name, (q, rule) in picks.items():
            if not n:
                assert got[k][name] is None
                continue
            at = max(1, math.ceil(round(q * n, 9))) - 1 if rule == "nearest" else math.floor(round(q * n, 9))
            want = float(np.quantile(x, q)) if rule == "linear" else x[at]
            assert abs(got[k][name] - want) < 1e-9, (k, name)
    assert stats.with_quantiles(df, [], "v", {"m": (0.5, "linear")}).first().m == np.median([v for values in groups.values() for v in values])


def test_equal_values_are_counted_not_gathered(spark):
    """Ten million equal values of one key, null keys, and the plan: no pass deals rows by key, no list of values."""
    many = spark.range(10_000_000).select(F.lit("a").alias("k"), F.when(F.col("id") % 10 < 8, 0.0).otherwise(F.col("id") % 1000).cast("double").alias("v"))
    df = many.union(spark.createDataFrame([(None, 1.0), (None, 3.0)], "k string, v double"))
    got = stats.with_quantiles(df, ["k"], "v", {"m": (0.5, "linear"), "p90": (0.9, "nearest"), "p81": (0.81, "upper")})
    ids = np.arange(10_000_000)
    x = np.sort(np.where(ids % 10 < 8, 0, ids % 1000))
    assert {tuple(r) for r in got.collect()} == {("a", 10_000_000, 0.0, float(x[9_000_000 - 1]), float(x[8_100_000])), (None, 2, 2.0, 3.0, 3.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_pages_know_their_total(spark):
    got = stats.page(spark.range(25), ["id"], 10, 5, total=True).collect()
    assert [tuple(r) for r in got] == [(i, 25) for i in range(10, 15)]


def test_points_and_issues_in_one_pass(spark):
    """Instants and issues by the single pass equal those of the operators one by one."""
    rng = np.random.default_rng(9)
    names = ["ATA", "ETA", "PILOT_REQUEST_ARRIVAL", "PILOT_SCHEDULED_ARRIVAL", "ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "SHIFT_ALL_FAST"]
    pick = lambda options: options[int(rng.integers(len(options)))]
    rows = [(int(rng.integers(40)), pick(names), f"e{i:04}", pick(["AIS", "VTS", "Odd", None]), pick(["Verified", "Conflicting", None]), pick([None, 0.5, 0.9]), int(rng.integers(0, 90_000)), bool(rng.random() < 0.2), bool(rng.random() < 0.2)) for i in range(700)]
    df = spark.createDataFrame(rows, "call_id long, event_name string, event_id string, source_system string, verification_status string, confidence double, minute long, is_superseded boolean, is_quarantined boolean")
    base = F.lit("2026-01-01").cast("timestamp_ntz")
    df = df.withColumns({"utc": F.when(F.col("minute") % 17 != 0, F.timestamp_add("MINUTE", F.col("minute"), base)), "created_at": F.timestamp_add("MINUTE", F.col("minute") % 50, base)})
    ev = events.occurrence_index(df, ["event_id"])
    want = events.instants(ev, events.canonical_observations(ev, repeatable=["SHIFT_ALL_FAST"]))
    assert sorted(map(tuple, events.points(ev, repeatable=["SHIFT_ALL_FAST"]).collect())) == sorted(map(tuple, want.collect()))
    calls = spark.range(45).withColumnRenamed("id", "call_id")
    edges = [("ANCHORAGE_ARRIVAL", "PILOT_ON_BOARD_ARRIVAL", "DQ-006")]
    apart = [quality.missing_arrival(calls, ev), quality.eta_after_ata(ev), quality.unscheduled_pilot(ev), quality.sequence_violations(ev, edges)]
    key = lambda frames: sorted(str(tuple(r)) for f in frames for r in f.collect())
    assert key([quality.event_issues(calls, ev, edges)]) == key(apart)
