"""Alerts from delays, issues, bottlenecks and outliers, each kind once for an entity while one is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _alerts(rows: DataFrame, rule: str, severity: Column | str, kind: str, entity: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(kind).alias("entity_type"), entity.cast("string").alias("entity_id"), message.alias("message"))


def evaluate(delays: DataFrame, issues: DataFrame, bottlenecks: DataFrame, outliers: DataFrame, *, least_score: float = 65.0, least_hours: float = 1.0) -> DataFrame:
    """AL-01 to AL-05: one alert for each rule and entity."""
    text = lambda name, c: F.concat(F.lit(name), F.round(c, 2).cast("string"))
    found = [
        _alerts(delays.filter("needs_review"), "MISSING_DELAY_REASON", "MEDIUM", "delay", F.col("delay_id"), F.lit("A delay has no reason")),
        _alerts(issues.filter("rule_id = 'DQ-007' and status <> 'RESOLVED'"), "MISSING_DELAY_REASON", "MEDIUM", "call", F.col("call_id"), F.lit("Late services have no reason")),
        _alerts(bottlenecks.filter(F.col("score") >= least_score), "CRITICAL_BOTTLENECK", "HIGH", "bottleneck", F.col("name"), text("Score ", F.col("score"))),
        _alerts(outliers.filter("severity in ('HIGH', 'CRITICAL')"), "EXTREME_OUTLIER", F.col("severity"), "outlier", F.concat_ws(":", "rule", F.col("call_id").cast("string")), text("Value ", F.col("value"))),
        _alerts(delays.filter(F.col("category").isin("Tug", "Pilot") & (F.col("hours") >= least_hours)), "RESOURCE_SHORTAGE", "HIGH", "delay", F.col("delay_id"), text("Hours ", F.col("hours"))),
        _alerts(delays.filter((F.col("category") == "Berth Non-Availability") & (F.col("hours") >= least_hours)), "BERTH_CONFLICT", "HIGH", "delay", F.col("delay_id"), text("Hours ", F.col("hours"))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    key = ["rule", "entity_type", "entity_id"]
    return out.groupBy(*key).agg(F.min_by("severity", F.struct("severity", "message")).alias("severity"), F.min_by("message", F.struct("severity", "message")).alias("message"))


def suppress(found: DataFrame, existing: DataFrame) -> DataFrame:
    """AL-06: alerts for whose rule and entity none is new or acknowledged."""
    open_ = existing.filter("status in ('NEW', 'ACKNOWLEDGED')").select("rule", "entity_type", "entity_id")
    return found.join(open_, ["rule", "entity_type", "entity_id"], "left_anti")


def listing(found: DataFrame, actions: DataFrame, limit: int = 100) -> DataFrame:
    """AL-07: the newest alerts with how many actions each has."""
    counts = actions.groupBy("alert_id").agg(F.count("*").alias("n_actions"))
    joined = found.join(counts, "alert_id", "left").na.fill(0, ["n_actions"])
    return joined.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities")).withColumn("share_pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 2))  # a few rows
