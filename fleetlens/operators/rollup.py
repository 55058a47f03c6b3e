"""Hourly rollups: points -> ``node_status_hourly`` and ``user_app_hourly``.

Buckets are ``date_trunc('hour', ts)`` (start of the hour, D-1). Two modes for counter
fields (D-3): ``"spread"`` reproduces the reference (max - min of the per-window values
inside the hour) and ``"sum"`` gives true totals of per-window deltas.

Plan shape: one hash aggregate per (hour, node, uid, comm) feeds both the app rollup and the
node IO totals; node, GPU and IO aggregates are all keyed by (hour, node) and meet in one
last group-by over stacked rows. Partial aggregation runs before every shuffle, so a hot node
or app never moves its raw rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import spread, stable

IO_FIELDS = ["read_bytes", "write_bytes", "net_rx_bytes", "net_tx_bytes"]
APP_KEYS = ["bucket_time", "node_id", "uid", "comm"]
NODE_KEYS = ["bucket_time", "node_id"]


def hour(ts: str | Column = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts) if isinstance(ts, str) else ts)


def _bucketed(df: DataFrame) -> DataFrame:
    """A streaming ``window`` struct key becomes its start time after the aggregate."""
    from pyspark.sql import types as T
    if isinstance(df.schema["bucket_time"].dataType, T.StructType):
        return df.withColumn("bucket_time", F.col("bucket_time.start"))
    return df


def app_aggregates(proc_points: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Per (hour, node, uid, comm): spreads, sums and maxima of the process counters.

    ``bucket`` defaults to ``date_trunc('hour', ts)``; streams pass
    ``window('ts', '1 hour')`` so the watermark can close buckets (append mode)."""
    b = (hour() if bucket is None else bucket).alias("bucket_time")
    g = proc_points.groupBy(b, "node_id", "uid", "comm")
    aggs = [spread("cpu_ontime_ns").alias("cpu_spread"), F.sum("cpu_ontime_ns").alias("cpu_sum")]
    for f in IO_FIELDS:
        aggs += [spread(f).alias(f + "_spread"), F.sum(f).alias(f + "_sum")]
    aggs += [F.max("avg_rss_bytes").alias("max_rss"), F.sum("avg_rss_bytes").alias("rss_sum"),
             F.count("avg_rss_bytes").alias("rss_n"), F.max("process_count").alias("max_procs"),
             F.max("gpu_used_memory_mib").alias("max_gpu_mib")]
    return _bucketed(g.agg(*aggs))


def process_spread(proc_points: DataFrame) -> DataFrame:
    """AGG-7: max - min per (hour, node, uid, comm) for cpu and the IO counters."""
    a = app_aggregates(proc_points)
    return a.select(*APP_KEYS, F.col("cpu_spread").alias("cpu_ontime_ns"),
                    *[F.col(f + "_spread").alias(f) for f in IO_FIELDS])


def user_app_hourly(proc_points: DataFrame, mode: str = "spread", bucket: Column | None = None) -> DataFrame:
    """AGG-9/10/11 + JON-12 in one aggregate.

    spread mode: cpu seconds = spread / 1e9; apps whose cpu spread is <= 0 keep zero cpu
    and zero IO (D-5: they come back through the RSS side); avg_rss = max_rss (D-6).
    sum mode: true totals and a true mean RSS (floor of sum / count).
    """
    a = app_aggregates(proc_points, bucket)
    if mode == "spread":
        pos = F.col("cpu_spread") > 0
        cpu = F.when(pos, F.col("cpu_spread") / F.lit(1e9)).otherwise(F.lit(0.0))
        io = {f: F.when(pos, F.col(f + "_spread")).otherwise(F.lit(0).cast("bigint")) for f in IO_FIELDS}
        avg_rss = F.col("max_rss")
    elif mode == "sum":
        cpu = F.col("cpu_sum") / F.lit(1e9)
        io = {f: F.col(f + "_sum") for f in IO_FIELDS}
        avg_rss = F.expr("rss_sum div rss_n")
    else:
        raise ValueError(f"unknown rollup mode {mode!r}")
    return a.select(
        *APP_KEYS,
        cpu.alias("total_cpu_time_seconds"),
        avg_rss.cast("bigint").alias("avg_rss_memory_bytes"),
        F.col("max_rss").cast("bigint").alias("max_rss_memory_bytes"),
        F.col("max_gpu_mib").cast("bigint").alias("max_gpu_memory_mib"),
        io["read_bytes"].cast("bigint").alias("total_read_bytes"),
        io["write_bytes"].cast("bigint").alias("total_write_bytes"),
        io["net_rx_bytes"].cast("bigint").alias("total_net_rx_bytes"),
        io["net_tx_bytes"].cast("bigint").alias("total_net_tx_bytes"),
        F.col("max_procs").cast("bigint").alias("process_count"),
    )


def node_io_hourly(proc_points: DataFrame, mode: str = "spread") -> DataFrame:
    """AGG-8: per (hour, node), the sum over (uid, comm) of each IO counter's spread
    (or sum). Two-level group-by; the second level is over already-reduced rows."""
    a = app_aggregates(proc_points)
    suffix = "_spread" if mode == "spread" else "_sum"
    return a.groupBy(*NODE_KEYS).agg(*[F.sum(f + suffix).cast("bigint").alias(f) for f in IO_FIELDS])


def gpu_hourly(gpu_points: DataFrame) -> DataFrame:
    """AGG-6: mean per (hour, node, gpu); then over GPUs: mean utilisation, mean power
    (stored as ``total_gpu_power_watts``, D-4) and the max of mean temperatures (floor 0)."""
    per_gpu = gpu_points.groupBy(hour().alias("bucket_time"), "node_id", "gpu_index").agg(
        F.avg("utilization_percent").alias("u"), F.avg("power_watts").alias("p"),
        F.avg("temperature_celsius").alias("t"))
    return per_gpu.groupBy(*NODE_KEYS).agg(
        stable(F.avg(F.coalesce("u", F.lit(0.0)))).alias("avg_gpu_utilization"),
        stable(F.greatest(F.max(F.coalesce("t", F.lit(0.0))), F.lit(0.0))).alias("max_gpu_temperature"),
        stable(F.avg(F.coalesce("p", F.lit(0.0)))).alias("total_gpu_power_watts"),
        F.count(F.lit(1)).alias("gpu_count"))


def node_hourly_core(node_points: DataFrame, bucket: Column | None = None) -> DataFrame:
    """AGG-4/5: hourly mean and max of the node point fields."""
    b = (hour() if bucket is None else bucket).alias("bucket_time")
    return _bucketed(node_points.groupBy(b, "node_id").agg(
        stable(F.avg("cpu_usage_percent")).alias("avg_cpu_usage_percent"),
        F.max("cpu_usage_percent").alias("max_cpu_usage_percent"),
        stable(F.avg("memory_usage_percent")).alias("avg_mem_usage_percent"),
        F.max("memory_used_bytes").alias("max_mem_used_bytes")))


NODE_PARTS = ("node", "gpu", "io")


def node_status_hourly(node_points: DataFrame, gpu_points: DataFrame, proc_points: DataFrame | None,
                       mode: str = "spread", parts: Sequence[str] = NODE_PARTS) -> DataFrame:
    """JON-14 + JON-11: node keys are the union of the node and GPU aggregates (missing
    parts -> 0); IO totals attach only to nodes already present.

    The three aggregates hold at most one row per key, so they are stacked and grouped once
    more instead of joined: filters on the hour or the node then reach every branch's scan,
    and all branches share one hash partitioning. A caller that reads no IO totals names the
    other ``parts``: a branch of a union can't be pruned by the optimizer, and the process points
    are by far the largest input. Columns of parts left out are zero; rows are the same as long as
    "node" and "gpu" are in."""
    if not set(parts) <= set(NODE_PARTS) or not {"node", "gpu"} <= set(parts):
        raise ValueError(f"parts are node, gpu and optionally io, not {parts!r}")
    both = node_hourly_core(node_points).unionByName(gpu_hourly(gpu_points).drop("gpu_count"), allowMissingColumns=True)
    both = both.withColumn("present", F.lit(1))
    if "io" in parts:
        both = both.unionByName(node_io_hourly(proc_points, mode), allowMissingColumns=True)
    else:
        both = both.withColumns({f: F.lit(None).cast("bigint") for f in IO_FIELDS})
    values = [c for c in both.columns if c not in NODE_KEYS]
    j = both.groupBy(*NODE_KEYS).agg(*[F.max(c).alias(c) for c in values]).filter("present = 1")
    z = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t))
    return j.select(
        *NODE_KEYS,
        z("avg_cpu_usage_percent", "double").alias("avg_cpu_usage_percent"),
        z("max_cpu_usage_percent", "double").alias("max_cpu_usage_percent"),
        z("avg_mem_usage_percent", "double").alias("avg_mem_usage_percent"),
        z("max_mem_used_bytes", "bigint").alias("max_mem_used_bytes"),
        z("avg_gpu_utilization", "double").alias("avg_gpu_utilization"),
        z("max_gpu_temperature", "double").alias("max_gpu_temperature"),
        z("total_gpu_power_watts", "double").alias("total_gpu_power_watts"),
        z("read_bytes", "bigint").alias("total_disk_read_bytes"),
        z("write_bytes", "bigint").alias("total_disk_write_bytes"),
        z("net_rx_bytes", "bigint").alias("total_net_rx_bytes"),
        z("net_tx_bytes", "bigint").alias("total_net_tx_bytes"),
        F.lit(True).alias("is_active"),  # D-20: real liveness is fleet.liveness
    )


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-4: rows of ``new`` whose key is not in ``existing`` (first write wins, D-7)."""
    return new.join(existing.select(*keys), keys, "left_anti")


def upsert(updates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-5: key match -> every non-key column replaced; other rows kept."""
    return updates.unionByName(existing.join(updates.select(*keys), keys, "left_anti"))


def field_pivot(long: DataFrame, row_keys: list[str], fields: list[str], field_col: str = "_field",
                value_col: str = "_value", order_col: str | None = None) -> DataFrame:
    """AGG-12: (row key, field, value) -> one column per listed field. Of several values of one
    cell the one with the greatest ``order_col`` wins, without one the greatest value. The field
    list is explicit, so no distinct-values job runs first."""
    best = F.max(value_col) if order_col is None else F.max_by(value_col, order_col)
    return long.groupBy(*row_keys).pivot(field_col, fields).agg(best)


def window_aggregate(proc_points: DataFrame, width: str = "5 minutes") -> DataFrame:
    """UDF-2 aggregator: tumbling-window totals per (node, uid, comm). The same expression
    runs on a stream with a watermark (``streaming.windowed_app_usage``)."""
    g = proc_points.groupBy(F.window("ts", width).start.alias("window_start"), "node_id", "uid", "comm")
    return g.agg(F.sum("cpu_ontime_ns").cast("bigint").alias("cpu_ontime_ns"),
                 F.sum(F.col("read_bytes") + F.col("write_bytes")).cast("bigint").alias("disk_bytes"),
                 F.sum(F.col("net_rx_bytes") + F.col("net_tx_bytes")).cast("bigint").alias("net_bytes"),
                 F.max("avg_rss_bytes").cast("bigint").alias("max_rss_bytes"),
                 F.sum("process_count").cast("bigint").alias("process_count"))


def _dated(df: DataFrame, time_col: str) -> DataFrame:
    return df.withColumns({"date": F.to_date(time_col), "hour": F.hour(time_col)})


def write_rollup(df: DataFrame, path: str, time_col: str = "bucket_time") -> None:
    """Store a rollup as parquet partitioned by ``date`` and ``hour``; dynamic partition
    overwrite replaces exactly the hours in ``df`` (idempotent reruns and backfills) and
    leaves the day's other hours as they are. An hour is written by as many tasks as its size asks
    for (rebalance), not by all of them."""
    (_dated(df, time_col).hint("rebalance", "date", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "hour").parquet(path))


# Buckets of node ids of a folded day (see ``fold_days``).
NODE_BUCKETS = 64


def node_bucket(node: Column, buckets: int = NODE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def fold_days(df: DataFrame, path: str, time_col: str = "bucket_time", buckets: int = NODE_BUCKETS) -> None:
    """Layout for reads by node: the days of ``df`` partitioned by date and node bucket, sorted by
    node and time, with bloom filters on the node. Dynamic overwrite replaces whole buckets of the
    days in ``df``, so ``df`` has to hold whole days."""
    d = df.withColumns({"date": F.to_date(time_col), "node_bucket": node_bucket(F.col("node_id"), buckets)})
    (d.hint("rebalance", "date", "node_bucket").sortWithinPartitions("date", "node_bucket", "node_id", time_col)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#node_id", "true")
        .partitionBy("date", "node_bucket").parquet(path))


def read_node(spark, path: str, node_id: str, first: str, last: str, buckets: int = NODE_BUCKETS) -> DataFrame:
    """One node's rows of the days ``first`` to ``last`` of a folded table: partitions of other days
    and buckets are pruned, row groups without the node are skipped."""
    day = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    mine = F.col("node_bucket") == node_bucket(F.lit(node_id), buckets)
    return spark.read.parquet(path).where(day & mine & (F.col("node_id") == node_id)).drop("date", "node_bucket")


def _stored(spark, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing is stored yet. Any other failure
    (permissions, a broken store) is an error: appending blindly would undo first-write-wins."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_if_absent(new: DataFrame, path: str, keys: list[str], time_col: str = "bucket_time",
                     overwrite: bool = False) -> None:
    """SNK-4 against a stored table: append only keys not yet present (first write wins).
    Rows of ``new`` that share a key count once (the smallest row). ``overwrite=True``
    replaces the hours of ``new`` instead, which is how late data reaches a stored rollup.

    Only the date range of ``new`` is read back (partition pruning on ``date``)."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    if overwrite:
        write_rollup(once, path, time_col)
        return
    existing = _stored(new.sparkSession, path)
    if existing is not None:
        first, last = new.agg(F.min(F.to_date(time_col)), F.max(F.to_date(time_col))).first()
        if first is None:
            return
        once = insert_if_absent(once, existing.filter(F.col("date").between(F.lit(first), F.lit(last))), keys)
    _dated(once, time_col).write.mode("append").partitionBy("date", "hour").parquet(path)
