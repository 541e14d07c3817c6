"""Bottlenecks of stages and resources, and criticality of lead times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import with_quantiles

#: Weights of the six scores.
WEIGHTS = {"duration": 0.15, "frequency": 0.20, "variability": 0.20, "tail_risk": 0.20, "contribution": 0.10, "breach": 0.15}


#: Resources by delay category: name, service keyword, target hours.
RESOURCES = [("Pilot", "Pilot Availability / Shortage", "PILOT", 0.5), ("Tug", "Tug Availability / Shortage", "TUG", 0.5), ("Berth Non-Availability", "Berth Non-Availability / Congestion", None, 1.0)]


def candidates(lead_times: DataFrame, delays: DataFrame, timings: DataFrame, targets: DataFrame) -> DataFrame:
    """BN-01, BN-02: (name, kind, hours, target): available lead times of the target table (metric, target); delays by resource.

    Delays of over 0 hours count; a resource without any takes the late services of its kind instead.
    """
    spark = timings.sparkSession
    stages = lead_times.filter("status = 'AVAILABLE'").join(F.broadcast(targets), "metric").select(F.col("metric").alias("name"), F.lit("PROCESS").alias("kind"), "hours", "target")  # the registry has a few rows
    resources = F.broadcast(spark.createDataFrame(RESOURCES, "category string, name string, service string, target double"))  # three rows
    stated = delays.filter("hours > 0").join(resources, "category").select("name", F.lit("RESOURCE").alias("kind"), "hours", "target")
    bare = resources.join(stated.select("name").distinct(), "name", "left_anti").filter("service is not null")
    late = timings.filter("status = 'LATE'").join(F.broadcast(bare), F.col("kind") == F.col("service")).select("name", F.lit("RESOURCE").alias("kind"), F.col("delay_hours").alias("hours"), "target")
    return stages.union(stated).union(late)


def rank(values: DataFrame, *, total_hours: DataFrame | float = 50.0, population: float = 72.0, weights: dict[str, float] | None = None) -> DataFrame:
    """BN-03 to BN-05: statistics, six scores from 0 to 100, their weighted mean and the rank.

    The median is true, P90 by nearest rank, the deviation that of a sample (0 for one value). total_hours: what
    contributions are shares of, a number or a table of one row (total). population: how many values make a frequency of
    100. Durations score against 48 hours for stages and 10 for resources.
    """
    w = {**WEIGHTS, **(weights or {})}
    rows = values.filter("hours is not null").select("name", "kind", "hours", "target")
    aggs = [F.avg("hours").alias("mean"), F.coalesce(F.stddev_samp("hours"), F.lit(0.0)).alias("sd"), F.avg((F.col("hours") > F.col("target")).cast("double")).alias("breach_rate")]
    got = with_quantiles(rows, ["name", "kind"], "hours", {"median": (0.5, "linear"), "p90": (0.9, "nearest")}, aggs)
    got = got.crossJoin(F.broadcast(total_hours)) if isinstance(total_hours, DataFrame) else got.withColumn("total", F.lit(total_hours))  # one row
    total = F.col("total")
    got = got.withColumns({"cv": F.when(F.col("mean") > 0.0001, F.col("sd") / F.col("mean")).otherwise(0.0), "tail_ratio": F.when(F.col("median") > 0.0001, F.col("p90") / F.col("median")).otherwise(F.greatest(F.lit(1.0), F.col("p90"))), "share": F.when(total > 0, F.col("mean") / total * 100).otherwise(0.0)})
    score = lambda c: F.least(F.lit(100.0), F.round(c, 2))
    got = got.withColumns(
        {
            "variability": score(F.col("cv") / 1.5 * 100), "tail_risk": score(F.greatest(F.lit(0.0), F.col("tail_ratio") - 1) / 2.5 * 100), "breach": score(F.col("breach_rate") * 100), "frequency": score(F.col("n") / F.lit(population) * 100),
            "contribution": score(F.col("share")), "duration": score(F.col("mean") / F.when(F.col("kind") == "PROCESS", 48.0).otherwise(10.0) * 100),
        }
    )
    composite = F.round(sum((F.col(k) * v for k, v in w.items()), F.lit(0.0)) / sum(w.values()), 2)
    order = Window.orderBy(F.desc("score"), "name")  # a row for each candidate
    names = ("mean", "median", "p90", "sd", "cv", "tail_ratio", "breach_rate")
    return got.withColumn("score", composite).withColumn("rank", F.row_number().over(order)).select("rank", "name", "kind", "n", *[F.round(c, 4).alias(c) for c in names], *WEIGHTS, "score")


def _level(value: Column, limits: tuple[float, float, float, float]) -> Column:
    out = F.when(value >= limits[3], 5)
    for points, limit in ((4, limits[2]), (3, limits[1]), (2, limits[0])):
        out = out.when(value >= limit, points)
    return out.otherwise(1)


def criticality(values: DataFrame, key: str = "metric", value: str = "hours", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """CR-01, CR-02: levels 1 to 5 for mean duration, CV and tail ratio, their weighted mean and its name.

    The median is the upper one, P90 by nearest rank. weights: of the three levels.
    """
    rows = values.filter(F.col(value).isNotNull()).select(key, value)
    got = with_quantiles(rows, [key], value, {"median": (0.5, "upper"), "p90": (0.9, "nearest")}, [F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")])
    return with_levels(got.withColumns({"cv": F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0), "tail_ratio": F.when(F.col("median") > 0, F.col("p90") / F.col("median")).otherwise(1.0)}), key, weights)


def with_levels(stats: DataFrame, key: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """CR-01: from mean, cv and tail_ratio."""
    levels = {"duration_level": _level(F.col("mean"), (2, 6, 18, 36)), "variability_level": _level(F.col("cv"), (0.2, 0.5, 0.8, 1.2)), "tail_level": _level(F.col("tail_ratio"), (1.3, 1.8, 2.5, 3.5))}
    weighted = sum((F.col(c) * w for c, w in zip(levels, weights, strict=True)), F.lit(0.0))
    got = stats.withColumns(levels).withColumn("score", F.round(weighted / sum(weights), 2))
    name = F.when(F.col("score") >= 4, "CRITICAL").when(F.col("score") >= 3, "HIGH").when(F.col("score") >= 2, "MODERATE").otherwise("LOW")
    return got.select(key, F.round("mean", 4).alias("mean"), F.round("cv", 4).alias("cv"), F.round("tail_ratio", 4).alias("tail_ratio"), *levels, "score", name.alias("criticality"))
