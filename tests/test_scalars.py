"""Tier 1: scalar helpers on hand-made rows (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from fleetlens.functions import scalars
from fleetlens.operators import fleet


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_map_uid(spark):
    df = one_col(spark, ["0", "1", "999", "1000", "-5", "x", None])
    got = [r[0] for r in df.select(scalars.map_uid("x", loose=True)).collect()]
    assert got == [0, 1, 1, 1000, -5, -1, -1]


def test_safe_casts(spark):
    df = one_col(spark, ["3", "3.7", "x", None, " 12 "])
    got = df.select(scalars.safe_int("x", 0), scalars.safe_float("x", 0.0)).collect()
    assert [r[0] for r in got] == [3, 3, 0, 0, 12]
    assert [r[1] for r in got] == [3.0, 3.7, 0.0, 0.0, 12.0]
    d = spark.createDataFrame([(3.7,)], "x double")
    assert d.select(scalars.safe_int("x")).first()[0] == 3


def test_prefixes(spark):
    df = one_col(spark, ["SMALL-1x", "SMALL-2", "OTHER"])
    pre = ["SMALL", "SMALL-1"]
    got = df.select(scalars.longest_prefix("x", pre), scalars.first_prefix("x", pre)).collect()
    assert [tuple(r) for r in got] == [("SMALL-1", "SMALL"), ("SMALL", "SMALL"), (None, None)]


def test_normalize_comm(spark):
    df = one_col(spark, ["", None, "kworker/0:1", "python3", "gsd-power"])
    got = [r[0] for r in df.select(scalars.normalize_comm("x")).collect()]
    assert got == ["unknown", "unknown", "kworker", "python3", "gsd"]


def test_cluster_health(spark):
    df = spark.createDataFrame([(9, 10), (6, 10), (5, 10), (0, 0)], "a int, t int")
    got = [r[0] for r in df.select(scalars.cluster_health("a", "t")).collect()]
    assert got == ["Healthy", "Degraded", "Critical", "Critical"]


def test_memory_percent(spark):
    df = spark.createDataFrame([(0, 0), (1000, 250), (3, 1)], "t long, a long")
    got = [r[0] for r in df.select(scalars.memory_percent("t", "a")).collect()]
    assert got == [0.0, 75.0, 66.67]


def test_age_text(spark):
    base = "2024-01-01 00:00:00"
    rows = [("2023-12-31 23:59:30",), ("2023-12-31 23:50:00",), ("2023-12-31 21:00:00",), ("2023-12-29 00:00:00",)]
    df = spark.createDataFrame(rows, "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    got = [r[0] for r in df.select(scalars.age_text("ts", F.lit(base).cast("timestamp"))).collect()]
    assert got == ["30s ago", "10m ago", "3h ago", "3d ago"]


def test_parse_float(spark):
    df = one_col(spark, ["10.0", "12abc", "bad", None, " 5 "])
    got = [r[0] for r in df.select(fleet.parse_float(F.col("x"))).collect()]
    assert got == [10.0, 12.0, None, None, 5.0]


def test_status_map(spark):
    df = one_col(spark, ["running", "stopped", "unknown"])
    assert [r[0] for r in df.select(scalars.status_map("x")).collect()] == ["active", "down", "idle"]
