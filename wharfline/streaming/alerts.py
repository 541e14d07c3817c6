"""Late services as a stream: one alert for a service within the suppression window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_services(services: DataFrame, *, least_hours: float = 1.0, suppression: str = "12 hours") -> DataFrame:
    """Alerts for streamed services (call_id, service_id, scheduled and served TIMESTAMP) served at least ``least_hours`` late.

    Repeats of a service are dropped within the watermark, which is the suppression window; services that come later than
    that are dropped.
    """
    hours = F.round((F.unix_micros("served") - F.unix_micros("scheduled")) / 3.6e9, 6)
    late = services.withWatermark("served", suppression).withColumn("delay_hours", hours).filter(F.col("delay_hours") >= least_hours)
    return late.dropDuplicatesWithinWatermark(["service_id"]).select("call_id", "service_id", "served", "delay_hours", F.lit("LATE_SERVICE").alias("rule"))
