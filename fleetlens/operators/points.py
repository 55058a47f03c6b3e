"""Report -> raw time-series points (PRJ-4, PRJ-5, AGG-1, SNK-3, PRJ-6).

Three wide point tables replace the tag/field store: ``node_status``, ``gpu_status`` and
``process_status``. Point time is the report's event time at second precision (D-2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import map_uid, normalize_comm, round_half_up, tag_or

POINT_SUMS = ["cpu_ontime_ns", "read_bytes", "write_bytes", "net_rx_bytes", "net_tx_bytes",
              "gpu_used_memory_mib", "avg_rss_bytes"]


def point_time(reports: DataFrame) -> Column:
    if "event_time" in reports.columns:
        return F.date_trunc("second", F.col("event_time"))
    return F.timestamp_seconds(F.col("timestamp"))


def _report_key(reports: DataFrame) -> list[str]:
    """Ingest-order key carried on points (series overwrite and latest-sample ties)."""
    return ["report_id"] if "report_id" in reports.columns else []


def _z(c: Column, t: str) -> Column:
    return F.coalesce(c.cast(t), F.lit(0).cast(t))


def node_points(reports: DataFrame) -> DataFrame:
    """PRJ-4: one node point per report; missing values -> 0, missing tags -> 'unknown'."""
    sm = F.col("system_metrics")
    md = F.col("metadata")
    return reports.select(
        point_time(reports).alias("ts"),
        F.coalesce("node_id", F.lit("unknown_node")).alias("node_id"),
        *_report_key(reports),
        tag_or(F.col("collect_agent_id"), "unknown").alias("collect_agent_id"),
        tag_or(md["collect_agent_version"], "unknown").alias("collect_agent_version"),
        _z(F.col("collection_window_seconds"), "double").alias("collection_window_seconds"),
        _z(F.col("received_timestamp"), "bigint").alias("received_timestamp"),
        _z(sm["cpu_usage_percent"], "double").alias("cpu_usage_percent"),
        _z(sm["memory_usage_percent"], "double").alias("memory_usage_percent"),
        _z(sm["memory_used_bytes"], "bigint").alias("memory_used_bytes"),
        _z(sm["memory_total_bytes"], "bigint").alias("memory_total_bytes"),
    )


def gpu_points(reports: DataFrame) -> DataFrame:
    """PRJ-5: one point per GPU (inner explode: no GPUs -> no rows)."""
    g = reports.select(point_time(reports).alias("ts"),
                       F.coalesce("node_id", F.lit("unknown_node")).alias("node_id"),
                       *_report_key(reports),
                       F.explode(F.col("system_metrics")["gpus"]).alias("g"))
    return g.select(
        "ts", "node_id", *_report_key(reports),
        F.coalesce(F.col("g.gpu_index").cast("string"), F.lit("0")).alias("gpu_index"),
        tag_or(F.col("g.gpu_name"), "unknown").alias("gpu_name"),
        *[_z(F.col(f"g.{n}"), "double").alias(n) for n in
          ("utilization_percent", "temperature_celsius", "power_watts", "power_limit_watts")],
        *[_z(F.col(f"g.{n}"), "bigint").alias(n) for n in ("memory_used_mib", "memory_total_mib")],
    )


def explode_processes(reports: DataFrame) -> DataFrame:
    """Nested reports -> one row per process with its report key, node and time."""
    keys = [c for c in ("report_id",) if c in reports.columns]
    x = reports.select(*keys, F.coalesce("node_id", F.lit("unknown_node")).alias("node_id"),
                       point_time(reports).alias("ts"),
                       F.posexplode("processes").alias("pos", "p"))
    return x.select(*keys, "node_id", "ts", (F.col("pos") + 1).cast("bigint").alias("pos"), "p.*")


def process_points(procs: DataFrame, report_key: Sequence[str] = ("report_id",)) -> DataFrame:
    """AGG-1: per report, processes grouped by (mapped uid, normalised comm): sums of the
    counters and a process count. Input: one row per process with ``node_id`` and ``ts``.

    The report key is unique per report, so the groups are bounded (skew-free) and the
    partial aggregation collapses most rows before the shuffle."""
    keys = [*report_key, "node_id", "ts"]
    g = procs.groupBy(*keys, map_uid(F.col("uid")).alias("uid"), normalize_comm(F.col("comm")).alias("comm"))
    pts = g.agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).cast("bigint").alias(n) for n in POINT_SUMS],
                F.count(F.lit(1)).alias("process_count"))
    keep = [k for k in report_key if k not in ("node_id", "ts")]
    return pts.select("ts", "node_id", *keep, "uid", "comm", *POINT_SUMS, "process_count")


def series_dedup(points: DataFrame, tags: Sequence[str], ts: str = "ts", order_by: str | None = None) -> DataFrame:
    """SNK-3: a later point with the same tags and second replaces the earlier one.

    Keeps the row with the greatest ``order_by`` (ingest order, distinct within a key) per
    (tags, second). Each field is a ``max_by`` of its own, so a numeric table is a hash
    aggregate (a struct would force sorting), and partial aggregation keeps a hot series
    from landing in one task as whole rows."""
    key = [*tags, ts]
    fields = [c for c in points.columns if c not in key and c != order_by]
    if order_by is None:
        raise ValueError("series_dedup needs an ingest-order column")
    return points.groupBy(*key).agg(*[F.max_by(c, order_by).alias(c) for c in fields], F.max(order_by).alias(order_by))


# Node-page chart fields (key, divisor, decimals). Bytes are shown in MB.
CHART_FIELDS = [
    ("avg_cpu_usage_percent", 1, 1),
    ("max_cpu_usage_percent", 1, 1),
    ("avg_mem_usage_percent", 1, 1),
    ("max_mem_used_bytes", 1048576, 2),
    ("avg_gpu_utilization", 1, 1),
    ("max_gpu_temperature", 1, 1),
    ("total_gpu_power_watts", 1, 1),
    ("total_disk_read_bytes", 1048576, 2),
    ("total_disk_write_bytes", 1048576, 2),
    ("total_net_rx_bytes", 1048576, 2),
    ("total_net_tx_bytes", 1048576, 2),
]


def chart_fields(hourly: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """PRJ-6 / SHP-3: chosen node-hourly fields converted for charts; nulls stay null."""
    chosen = [f for f in CHART_FIELDS if fields is None or f[0] in fields]
    cols = [round_half_up(F.col(n) / F.lit(float(div)), dec).alias(n) for n, div, dec in chosen]
    return hourly.select("bucket_time", "node_id", *cols)
