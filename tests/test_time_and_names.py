from datetime import datetime

from pyspark.sql import functions as F

from wharfline.functions import names, time


def one(df, c):
    return [r[0] for r in df.select(c.alias("x")).collect()]


def test_signed_hours_and_availability(spark):
    df = spark.createDataFrame([("2026-03-01 08:00:00", "2026-03-01 09:30:00"), ("2026-03-01 08:00:00", "2026-03-01 06:30:00"), (None, "2026-03-01 06:30:00")], "a string, z string").select(F.to_timestamp_ntz("a").alias("a"), F.to_timestamp_ntz("z").alias("z"))
    assert one(df, time.hours_between("a", "z")) == [1.5, -1.5, None]
    assert one(df, time.availability("a", "z")) == ["AVAILABLE", "AVAILABLE", "UNAVAILABLE"]
    assert one(df, time.missing_inputs(start="a", end="z")) == [[], [], ["start"]]
    assert one(df, time.signed_hours_text(time.hours_between("a", "z"))) == ["1h 30m (+1.50h)", "-1h 30m (-1.50h)", "—"]
    early, size = time.early_delivery(time.hours_between("a", "z"))
    assert one(df, early) == [0.0, -1.5, None]
    assert one(df, size) == [0.0, 1.5, None]


def test_parse_local(spark):
    rows = ["2026-06-01 10:00:00", "13/06/2026 10:00", "03/04/2026", "10:00", "", None, "not-a-timestamp", "2026-06-01T10:00"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = one(df, time.parse_local("v", F.lit("Africa/Johannesburg")))
    assert got == [datetime(2026, 6, 1, 8), datetime(2026, 6, 13, 8), None, None, None, None, None, datetime(2026, 6, 1, 8)]


def test_clock_change(spark):
    df = spark.createDataFrame([("2026-03-29 00:30:00", "2026-03-29 03:30:00")], "a string, z string")
    z = F.lit("Europe/London")
    assert one(df, time.hours_between(time.parse_local("a", z), time.parse_local("z", z))) == [2.0]


def test_excel_serials(spark):
    df = spark.createDataFrame([(1.0,), (59.0,), (61.0,), (44197.5,)], "v double")
    assert one(df, time.excel_serial("v")) == [datetime(1900, 1, 1), datetime(1900, 2, 28), datetime(1900, 3, 1), datetime(2021, 1, 1, 12)]


def test_names(spark):
    df = spark.createDataFrame([("MSC AURORA",), ("MSC AURORA.",), ("MSC-AURORA",), ("  MSC   AURORA.  ",)], "v string")
    assert set(one(df, names.normalise_name("v"))) == {"MSC AURORA"}
    pairs = spark.createDataFrame([("MSC AURORA", "MSC AURORA"), ("MSC AURORA", "MSC-AURORA"), ("", "x"), (None, "x"), ("ABCD", "ABXY")], "a string, b string")
    assert one(pairs, names.name_similarity("a", "b")) == [1.0, 0.99, 0.0, 0.0, 0.5]
    assert one(spark.createDataFrame([("License No.",), ("V.C.N.__duplicate_2",)], "v string"), names.header_token("v")) == ["licenseno", "vcn"]
