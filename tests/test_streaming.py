from datetime import datetime, timedelta

from wharfline.streaming.alerts import late_services


def test_late_services_alert_once(spark, tmp_path):
    t = datetime(2026, 6, 1, 8)
    rows = [(1, "a", t, t + timedelta(hours=2)), (1, "a", t, t + timedelta(hours=2)), (2, "b", t, t + timedelta(minutes=30)), (3, "c", t, t - timedelta(hours=2))]
    schema = "call_id long, service_id string, scheduled timestamp, served timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = late_services(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.service_id, r.delay_hours) for r in spark.table("late").collect()] == [("a", 2.0)]
