"""Data-quality rules as set operations, the issues they make, and what follows: quarantine, partitions, scores, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.names import is_blank
from .events import live

#: Severities of the rules.
SEVERITY = {"DQ-001": "CRITICAL", "DQ-002": "HIGH", "DQ-003": "HIGH", "DQ-004": "HIGH", "DQ-005": "HIGH", "DQ-006": "CRITICAL", "DQ-SEQUENCE-VIOLATION": "CRITICAL", "DQ-007": "MEDIUM", "DQ-010": "HIGH", "DQ-REQUESTED-MISSING": "HIGH", "DQ-SCHEDULED-MISSING": "HIGH", "DQ-SERVED-MISSING": "HIGH", "DQ-SCHEDULE-ORDER": "HIGH", "DQ-MANDATORY": "HIGH", "DQ-DUPLICATE": "MEDIUM", "DQ-TIMESTAMP": "HIGH"}
PENALTY = {"CRITICAL": 50, "HIGH": 20, "MEDIUM": 10, "LOW": 5}
DIMENSIONS = ("COMPLETENESS", "VALIDITY", "CONSISTENCY", "UNIQUENESS", "TIMELINESS", "ACCURACY", "INTEGRITY", "SEQUENCE")


def _issues(rows: DataFrame, rule: Column | str, reference: Column | str, event_id: Column | str | None = None) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[rule]
    event = F.lit(None).cast("string") if event_id is None else F.col(event_id) if isinstance(event_id, str) else event_id
    return rows.select(rule.alias("rule_id"), severity.alias("severity"), "call_id", (F.col(reference) if isinstance(reference, str) else reference).alias("record_reference"), event.alias("event_id"), F.lit("OPEN").alias("status"))


def _call_reference() -> Column:
    return F.concat(F.lit("call:"), F.col("call_id").cast("string"))


def missing_arrival(calls: DataFrame, events: DataFrame) -> DataFrame:
    """DQ-003: calls without an ATA."""
    return _issues(calls.join(events.filter("event_name = 'ATA' and utc is not null").select("call_id"), "call_id", "left_anti"), "DQ-003", _call_reference())


def source_row_issues(source: DataFrame) -> DataFrame:
    """DQ-003, DQ-004: calls whose newest source row (``canonical.source_times``) has a blank ATA, or an ETA after its ATA."""
    found = F.array_compact(F.array(F.when(F.col("ata").isNull(), F.lit("DQ-003")), F.when(F.col("eta_utc") > F.col("ata_utc"), F.lit("DQ-004"))))
    return _issues(source.select("call_id", F.explode(found).alias("rule")), F.col("rule"), _call_reference())


def _first(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first live event of each name and call, side by side as structs (utc, event_id)."""
    first = F.min(F.struct("occurrence_index", "utc", "event_id"))
    return live(events).filter(F.col("event_name").isin(*names)).groupBy("call_id").pivot("event_name", list(names)).agg(first)


def eta_after_ata(events: DataFrame) -> DataFrame:
    """DQ-004: calls whose ETA is after the ATA."""
    return _issues(_first(events, ("ETA", "ATA")).filter("ETA.utc > ATA.utc"), "DQ-004", _call_reference(), "ETA.event_id")


def unscheduled_pilot(events: DataFrame) -> DataFrame:
    """DQ-005: a pilot was requested, none is scheduled."""
    have = lambda name: live(events).filter(F.col("event_name") == name).select("call_id").distinct()
    return _issues(have("PILOT_REQUEST_ARRIVAL").join(have("PILOT_SCHEDULED_ARRIVAL"), "call_id", "left_anti"), "DQ-005", _call_reference())


def sequence_violations(events: DataFrame, edges: Sequence[tuple[str, str, str]], seconds: int = 300) -> DataFrame:
    """DQ-006, DQ-SEQ: the later event of an edge (from, to, rule) precedes the earlier one by more than ``seconds``."""
    names = sorted({n for a, z, _ in edges for n in (a, z)})
    wide = _first(events, names)
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(a)["utc"].alias("a"), F.col(z)["utc"].alias("z"), F.col(z)["event_id"].alias("event_id")) for a, z, rule in edges])
    broken = wide.select("call_id", F.inline(pairs)).filter(F.timestamp_diff("SECOND", F.col("a"), F.col("z")) < -seconds)
    return _issues(broken, F.col("rule"), F.concat(F.lit("event:"), "event_id"), "event_id")


def event_issues(calls: DataFrame, events: DataFrame, edges: Sequence[tuple[str, str, str]], seconds: int = 300) -> DataFrame:
    """DQ-003 to DQ-006 and DQ-SEQ: what ``missing_arrival``, ``eta_after_ata``, ``unscheduled_pilot`` and ``sequence_violations`` find, in one pass over the events."""
    names = sorted({"ETA", "ATA", "PILOT_REQUEST_ARRIVAL", "PILOT_SCHEDULED_ARRIVAL", *(n for a, z, _ in edges for n in (a, z))})
    is_live = ~F.col("is_superseded") & ~F.col("is_quarantined")
    first = lambda n: F.min(F.when(is_live & (F.col("event_name") == n), F.struct("occurrence_index", "utc", "event_id"))).alias(n)
    seen = events.filter(F.col("event_name").isin(*names) & F.col("utc").isNotNull()).groupBy("call_id").agg(F.max(F.col("event_name") == "ATA").alias("_arrived"), *[first(n) for n in names])
    known = calls.select("call_id", F.lit(True).alias("_known")).join(seen, "call_id", "full_outer")
    none = F.lit(None).cast("string")
    found = lambda when, rule, reference, event: F.when(when, F.struct(F.lit(rule).alias("rule"), reference.alias("reference"), event.alias("event_id")))
    rules = [
        found(F.col("_known") & ~F.coalesce("_arrived", F.lit(False)), "DQ-003", _call_reference(), none),
        found(F.col("ETA.utc") > F.col("ATA.utc"), "DQ-004", _call_reference(), F.col("ETA.event_id")),
        found(F.col("PILOT_REQUEST_ARRIVAL").isNotNull() & F.col("PILOT_SCHEDULED_ARRIVAL").isNull(), "DQ-005", _call_reference(), none),
        *[found(F.timestamp_diff("SECOND", F.col(a)["utc"], F.col(z)["utc"]) < -seconds, rule, F.concat(F.lit("event:"), F.col(z)["event_id"]), F.col(z)["event_id"]) for a, z, rule in edges],
    ]
    rows = known.select("call_id", F.inline(F.array_compact(F.array(*rules))))
    return _issues(rows, F.col("rule"), F.col("reference"), "event_id")


def unexplained_lateness(services: DataFrame, delays: DataFrame) -> DataFrame:
    """DQ-007: calls with a late service and no delay that has a reason."""
    return _unexplained(services.filter("served > scheduled").select("call_id"), delays)


def _unexplained(late: DataFrame, delays: DataFrame) -> DataFrame:
    return _issues(late.distinct().join(delays.filter(~is_blank("reason")).select("call_id").distinct(), "call_id", "left_anti"), "DQ-007", _call_reference())


def conflicting_arrivals(events: DataFrame, hours: float = 5.0) -> DataFrame:
    """DQ-010: the first two ATAs of a call are ``hours`` or more apart."""
    order = Window.partitionBy("call_id").orderBy("occurrence_index", "utc", "event_id")
    two = live(events).filter("event_name = 'ATA'").withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    apart = two.groupBy("call_id").agg(F.timestamp_diff("SECOND", F.min("utc"), F.max("utc")).alias("s")).filter(F.col("s") >= hours * 3600)
    return _issues(apart, "DQ-010", _call_reference())


def service_times(services: DataFrame) -> DataFrame:
    """DQ-REQ, DQ-SCH, DQ-SRV, DQ-ORD: one missing or misordered time of each service; a missing schedule hides what follows it."""
    return _issues(services.select("call_id", "service_id", F.explode(F.array_compact(F.array(*_time_rules()))).alias("rule")), F.col("rule"), F.concat(F.lit("service:"), "service_id"))


def _time_rules() -> list[Column]:
    return [
        F.when(F.col("requested").isNull(), F.lit("DQ-REQUESTED-MISSING")),
        F.when(F.col("scheduled").isNull(), F.lit("DQ-SCHEDULED-MISSING")),
        F.when(F.col("scheduled").isNotNull() & F.col("served").isNull(), F.lit("DQ-SERVED-MISSING")),
        F.when(F.col("scheduled") < F.col("requested"), F.lit("DQ-SCHEDULE-ORDER")),
    ]


def service_issues(services: DataFrame, delays: DataFrame) -> DataFrame:
    """DQ-007, DQ-REQ, DQ-SCH, DQ-SRV, DQ-ORD: what ``unexplained_lateness`` and ``service_times`` find, in one pass over the services."""
    late = F.when(F.col("served") > F.col("scheduled"), F.lit("DQ-007"))
    marks = services.select("call_id", "service_id", F.explode(F.array_compact(F.array(*_time_rules(), late))).alias("rule"))
    marks = saved(marks.withColumn("service_id", F.when(F.col("rule") != "DQ-007", F.col("service_id"))))
    return _unexplained(marks.filter("rule = 'DQ-007'").select("call_id"), delays).unionByName(_issues(marks.filter("rule <> 'DQ-007'"), F.col("rule"), F.concat(F.lit("service:"), "service_id")))


def staging_issues(staging: DataFrame, mandatory: Sequence[str]) -> DataFrame:
    """DQ-MAND, DQ-DUP, DQ-TS: one issue of each kind for a staged row. staging: (call_id, record_reference, values map, validation_status)."""
    blank = F.exists(F.array(*[F.lit(c) for c in mandatory]), lambda c: F.coalesce(F.trim(F.try_element_at("values", c)), F.lit("")) == "")
    found = F.array_compact(F.array(F.when(blank, F.lit("DQ-MANDATORY")), F.when(F.col("validation_status") == "DUPLICATE", F.lit("DQ-DUPLICATE")), F.when(F.col("validation_status") == "INVALID", F.lit("DQ-TIMESTAMP"))))
    return _issues(staging.select("call_id", "record_reference", F.explode(found).alias("rule")), F.col("rule"), "record_reference")


def duplicate_calls(scored: DataFrame) -> DataFrame:
    """DQ-001, DQ-002: from scored pairs (a, b, same_name, same_vcn, similarity, score): exact copies, and near ones.

    The issue is the second call's, and of each kind it has one, however many calls it repeats.
    """
    rule = F.when(F.col("same_name") & F.col("same_vcn"), "DQ-001").when(F.col("same_vcn") & (F.col("similarity") >= 0.98), "DQ-002")
    rows = scored.filter("score >= 0.98").select(rule.alias("rule"), F.col("b").alias("call_id")).filter("rule is not null").distinct()
    return _issues(rows, F.col("rule"), _call_reference()).withColumn("status", F.when(F.col("rule_id") == "DQ-001", "RESOLVED").otherwise("OPEN"))


def merge_issues(new: DataFrame, existing: DataFrame) -> DataFrame:
    """DQ-UPS: the existing issues, and the new ones for whose rule and record none is open."""
    key = ["rule_id", "record_reference"]
    return existing.unionByName(new.dropDuplicates(key).join(existing.filter("status <> 'RESOLVED'").select(*key), key, "left_anti"))


def quarantine(events: DataFrame, issues: DataFrame) -> DataFrame:
    """DQ-QUAR: events with a critical issue are quarantined."""
    hit = issues.filter("severity = 'CRITICAL' and event_id is not null").select("event_id", F.lit(True).alias("_hit")).distinct()
    return events.join(hit, "event_id", "left").withColumn("is_quarantined", F.col("is_quarantined") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def partition(calls: DataFrame, issues: DataFrame) -> DataFrame:
    """DQ-PART, DQ-SCORE: each call's open issues, status and score; never below 0."""
    open_ = issues.filter("status <> 'RESOLVED'").groupBy("call_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count("*").alias("n_open"))
    rows = calls.select("call_id").join(open_, "call_id", "left").na.fill(0, ["n_critical", "n_open"])
    status = F.when(F.col("n_critical") > 0, "QUARANTINED").when(F.col("n_open") > 0, "FLAGGED").otherwise("CLEAN")
    score = F.when(F.col("n_critical") > 0, 100 - 50 * F.col("n_critical") - 10 * F.col("n_open")).when(F.col("n_open") > 0, 100 - 15 * F.col("n_open")).otherwise(F.lit(100).cast("long"))
    return rows.select("call_id", "n_critical", "n_open", status.alias("quality_status"), F.greatest(F.lit(0).cast("long"), score).alias("quality_score"))


def cleanliness(parts: DataFrame) -> DataFrame:
    """DQ-PART: calls by status, and the clean share in percent."""
    return parts.agg(*[F.count_if(F.col("quality_status") == s).alias(f"n_{s.lower()}") for s in ("CLEAN", "FLAGGED", "QUARANTINED")], F.round(F.avg((F.col("quality_status") == "CLEAN").cast("double")) * 100, 1).alias("clean_pct"))


def dimension_scores(issues: DataFrame, types: DataFrame) -> DataFrame:
    """DQ-DIM: by dimension 100 less the penalties of its issues, resolved ones too, and not below 0; and their mean. types: (rule_id, dimension); unknown rules count as VALIDITY."""
    spark = issues.sparkSession
    penalty = F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])[F.col("severity")], F.lit(0))
    typed = issues.groupBy("rule_id").agg(F.sum(penalty).alias("p")).join(types, "rule_id", "left")
    sums = typed.groupBy(F.coalesce("dimension", F.lit("VALIDITY")).alias("dimension")).agg(F.sum("p").alias("p"))
    every = spark.createDataFrame([(d,) for d in DIMENSIONS], "dimension string").join(sums, "dimension", "left")
    scored = every.select("dimension", F.greatest(F.lit(0).cast("long"), 100 - F.coalesce("p", F.lit(0))).alias("score"))
    return scored.withColumn("overall", F.round(F.avg("score").over(Window.partitionBy()), 2))  # eight rows


def summary(issues: DataFrame) -> DataFrame:
    """DQ-SUM, DB-12: issues, open ones, resolved ones and calls by severity."""
    return issues.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "RESOLVED").alias("n_open"), F.count_if(F.col("status") == "RESOLVED").alias("n_resolved"), F.countDistinct("call_id").alias("n_calls"))


def overall(issues: DataFrame, parts: DataFrame, staging: DataFrame) -> DataFrame:
    """DQ-SUM in one row: issues, open and resolved, quarantined calls, staged rows by status, sequence errors."""
    sequence = F.col("rule_id").contains("SEQUENCE") | (F.col("rule_id") == "DQ-006")
    one = issues.agg(F.count("*").alias("n_issues"), F.count_if(F.col("status") != "RESOLVED").alias("n_open"), F.count_if(F.col("status") == "RESOLVED").alias("n_resolved"), F.count_if(sequence).alias("n_sequence"))
    two = parts.agg(F.count_if(F.col("quality_status") == "QUARANTINED").alias("n_quarantined"))
    three = staging.agg(*[F.count_if(F.col("validation_status") == s).alias(f"n_{s.lower()}") for s in ("VALID", "INVALID", "DUPLICATE")])
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # a row each


def listing(
    issues: DataFrame, *, severities: Sequence[str] = (), status: str | None = None, rules: Sequence[str] = (), search: str = "", file: str | None = None, services: DataFrame | None = None, service_type: str | None = None,
    movement: str | None = None, incomplete: bool = False, chronology: bool = False,
) -> DataFrame:
    """DQ-LIST: filtered issues.

    file: of records of that file. service_type and movement: issues of services (service_id, service_type, movement) that
    have it. incomplete: only missing values; chronology: only times out of order.
    """
    rows = issues
    if severities:
        rows = rows.filter(F.col("severity").isin(*severities))
    if status:
        rows = rows.filter(F.col("status") == status)
    if rules:
        rows = rows.filter(F.col("rule_id").isin(*rules))
    if search:
        rows = rows.filter(F.col("record_reference").ilike(f"%{search}%") | F.col("rule_id").ilike(f"%{search}%"))
    if file is not None:
        rows = rows.filter(F.startswith("record_reference", F.lit(f"{file}:")))
    if services is not None:
        if service_type is not None:
            services = services.filter(F.col("service_type") == service_type)
        if movement is not None:
            services = services.filter(F.col("movement") == movement)
        rows = rows.join(services.select(F.concat(F.lit("service:"), "service_id").alias("record_reference")).distinct(), "record_reference", "left_semi")
    if incomplete:
        rows = rows.filter(F.col("rule_id").endswith("-MISSING") | F.col("rule_id").isin("DQ-003", "DQ-MANDATORY"))
    if chronology:
        rows = rows.filter(F.col("rule_id").isin("DQ-004", "DQ-006", "DQ-SEQUENCE-VIOLATION", "DQ-SCHEDULE-ORDER"))
    return rows


def verify_cases(expected: DataFrame, issues: DataFrame) -> DataFrame:
    """RC-03: whether each expected issue (case_id, rule_id, record_reference) was found."""
    hits = issues.select("rule_id", "record_reference", F.lit(True).alias("_hit")).distinct()
    return expected.join(hits, ["rule_id", "record_reference"], "left").select("case_id", "rule_id", "record_reference", F.when(F.col("_hit"), "PASS").otherwise("FAIL").alias("result"))
