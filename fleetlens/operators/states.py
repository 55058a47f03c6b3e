"""Stored partial states of the rollups (AGG-4..10, AGG-13): sums, counts, minima and maxima per key
and hour, from which any coarser grain follows exactly without the points.

Points are reduced once per (hour, key); a later batch of points makes rows of its own for the same
keys, and readers merge them (sum of sums, least of minima, largest of maxima). A day or any other
grain of whole hours is one more merge under a coarser bucket. Means are sum / count and spreads are
max - min, so they are those of the points.

Merging is exact for points that are new. A point that overwrites an earlier one of its series and
second (SNK-3) can't be taken out of a state again; ``streaming.ledger`` rolls its hour anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable
from .rollup import APP_KEYS, IO_FIELDS, NODE_KEYS, _dated, hour

COUNTERS = ["cpu_ontime_ns", *IO_FIELDS]
GPU_KEYS = [*NODE_KEYS, "gpu_index"]

# state column -> (aggregate of points, aggregate that merges states)
NODE_STATE = {"n": (F.count, F.sum, "cpu_usage_percent"), "mem_n": (F.count, F.sum, "memory_usage_percent"),
              "cpu_sum": (F.sum, F.sum, "cpu_usage_percent"), "cpu_max": (F.max, F.max, "cpu_usage_percent"),
              "mem_sum": (F.sum, F.sum, "memory_usage_percent"), "used_max": (F.max, F.max, "memory_used_bytes")}
GPU_STATE = {f"{c}_{a}": (f, F.sum, field) for c, field in (("util", "utilization_percent"), ("power", "power_watts"), ("temp", "temperature_celsius"))
             for a, f in (("sum", F.sum), ("n", F.count))}
APP_STATE = {f"{c}_{a}": (f, f, c) for c in COUNTERS for a, f in (("min", F.min), ("max", F.max), ("sum", F.sum))} | {
    "rss_max": (F.max, F.max, "avg_rss_bytes"), "rss_sum": (F.sum, F.sum, "avg_rss_bytes"), "rss_n": (F.count, F.sum, "avg_rss_bytes"),
    "procs_max": (F.max, F.max, "process_count"), "gpu_max": (F.max, F.max, "gpu_used_memory_mib")}
KINDS = {"node": (NODE_KEYS, NODE_STATE), "gpu": (GPU_KEYS, GPU_STATE), "app": (APP_KEYS, APP_STATE)}


def states(points: DataFrame, kind: str) -> DataFrame:
    """Partial states of points, one row per hour and key."""
    keys, state = KINDS[kind]
    g = points.groupBy(hour().alias("bucket_time"), *keys[1:])
    return g.agg(*[make(field).alias(name) for name, (make, _, field) in state.items()])


def merge(stored: DataFrame, kind: str, grain: str = "hour") -> DataFrame:
    """States of one row per (``grain`` bucket, key), from any number of rows per key and hour."""
    keys, state = KINDS[kind]
    g = stored.groupBy(F.date_trunc(grain, "bucket_time").alias("bucket_time"), *keys[1:])
    return g.agg(*[again(name).alias(name) for name, (_, again, _) in state.items()])


def _mean(total: str, n: str) -> Column:
    return F.col(total) / F.col(n)


def node_values(merged: DataFrame) -> DataFrame:
    """AGG-4/5 from merged node states."""
    return merged.select(*NODE_KEYS, stable(_mean("cpu_sum", "n")).alias("avg_cpu_usage_percent"), F.col("cpu_max").alias("max_cpu_usage_percent"),
                         stable(_mean("mem_sum", "mem_n")).alias("avg_mem_usage_percent"), F.col("used_max").alias("max_mem_used_bytes"))


def gpu_values(merged: DataFrame) -> DataFrame:
    """AGG-6 from merged GPU states: means per GPU, then mean, mean and maximum over the GPUs."""
    zero = F.lit(0.0)
    mean = {c: F.coalesce(_mean(f"{c}_sum", f"{c}_n"), zero) for c in ("util", "power", "temp")}
    return merged.groupBy(*NODE_KEYS).agg(
        stable(F.avg(mean["util"])).alias("avg_gpu_utilization"), stable(F.greatest(F.max(mean["temp"]), zero)).alias("max_gpu_temperature"),
        stable(F.avg(mean["power"])).alias("total_gpu_power_watts"), F.count("*").alias("gpu_count"))


def _spread(c: str) -> Column:
    return F.col(f"{c}_max") - F.col(f"{c}_min")


def app_values(merged: DataFrame, mode: str = "spread") -> DataFrame:
    """AGG-9/10/11 from merged app states, in either mode of ``rollup.user_app_hourly``."""
    if mode not in ("spread", "sum"):
        raise ValueError(f"unknown rollup mode {mode!r}")
    busy = _spread("cpu_ontime_ns") > 0
    value = {c: F.when(busy, _spread(c)).otherwise(F.lit(0)) if mode == "spread" else F.col(f"{c}_sum") for c in COUNTERS}
    avg_rss = F.col("rss_max") if mode == "spread" else F.expr("rss_sum div rss_n")
    long = lambda c, name: c.cast("bigint").alias(name)
    return merged.select(
        *APP_KEYS, (value["cpu_ontime_ns"] / F.lit(1e9)).alias("total_cpu_time_seconds"), long(avg_rss, "avg_rss_memory_bytes"),
        long(F.col("rss_max"), "max_rss_memory_bytes"), long(F.col("gpu_max"), "max_gpu_memory_mib"),
        *[long(value[c], f"total_{c}") for c in IO_FIELDS], long(F.col("procs_max"), "process_count"))


def node_io_values(merged: DataFrame, mode: str = "spread") -> DataFrame:
    """AGG-8 from merged app states."""
    value = _spread if mode == "spread" else lambda c: F.col(f"{c}_sum")
    return merged.groupBy(*NODE_KEYS).agg(*[F.sum(value(c)).cast("bigint").alias(c) for c in IO_FIELDS])


def add_states(points: DataFrame, path: str, kind: str, batch_id: int) -> None:
    """Add a batch of new points to the stored states. A batch has partitions of its own, so a
    replayed batch replaces its first attempt and nothing stored is read or rewritten."""
    (_dated(states(points, kind), "bucket_time").withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour", "batch_id").parquet(f"{path}/{kind}"))


def read_states(spark, path: str, kind: str, grain: str = "hour", first: str | None = None, last: str | None = None) -> DataFrame:
    """Merged states of the days ``first`` to ``last`` (partition pruning; open ends read all)."""
    df = spark.read.parquet(f"{path}/{kind}")
    if first is not None:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col("date") <= F.lit(last).cast("date"))
    return merge(df, kind, grain)


# ------------------------------------------------- distinct users of any range (AGG-18, AGG-29) ----

def user_bitmaps(proc_points: DataFrame) -> DataFrame:
    """Which users were active in an hour, as exact bitmaps: (bucket_time, part, users). A bitmap
    covers one run of user ids (``bitmap_bucket_number``), so its size is fixed."""
    uid = F.col("uid")
    return proc_points.where("uid >= 0").groupBy(hour().alias("bucket_time"), F.bitmap_bucket_number(uid).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(uid)).alias("users"))


def active_users(bitmaps: DataFrame, start: Column, end: Column, *by: str) -> DataFrame:
    """Exact distinct users of the hours in [start, end], from the bitmaps alone; with ``by`` per
    group of further bitmap columns."""
    inside = bitmaps.where(F.col("bucket_time").between(start, end))
    merged = inside.groupBy("part", *by).agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("active_users"))
