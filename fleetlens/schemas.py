"""Explicit schemas: nested metric reports, raw points, hourly rollups, dimensions, alerts.

Everything is nullable: readers must treat every report key as optional (dynamic field
projection removes keys from the exported JSON).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
TS = T.TimestampType()
STR_MAP = T.MapType(S, S)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Process fields in wire order (the allow-list for field projection is this list minus
# metadata/status).
PROCESS_FIELDS = [
    ("pid", L), ("cpu_ontime_ns", L), ("uid", L), ("comm", S),
    ("read_bytes", L), ("write_bytes", L), ("net_rx_bytes", L), ("net_tx_bytes", L),
    ("avg_rss_bytes", L), ("process_name", S), ("gpu_used_memory_mib", L),
]
PROCESS = _struct(*PROCESS_FIELDS, ("metadata", STR_MAP), ("status", S))

GPU = _struct(
    ("gpu_index", I), ("gpu_name", S), ("utilization_percent", D), ("temperature_celsius", D),
    ("power_watts", D), ("power_limit_watts", D), ("memory_used_mib", L), ("memory_total_mib", L),
)

SYSTEM_METRICS = _struct(
    ("cpu_usage_percent", D), ("memory_usage_percent", D), ("memory_used_bytes", L),
    ("memory_total_bytes", L), ("gpus", T.ArrayType(GPU)),
)

REPORT = _struct(
    ("node_id", S), ("timestamp", L), ("collection_window_seconds", D),
    ("processes", T.ArrayType(PROCESS)), ("system_metrics", SYSTEM_METRICS),
    ("collect_agent_id", S), ("received_timestamp", L), ("metadata", STR_MAP),
)


def _loose(dt: T.DataType) -> T.DataType:
    """Numbers may arrive as JSON strings on the topic; decode every leaf number as text."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_loose(dt.elementType), True)
    if isinstance(dt, (T.LongType, T.IntegerType, T.DoubleType)):
        return S
    return dt


# Wire schema for JSON decode: same shape, numeric leaves as strings (see scalars.safe_int).
REPORT_WIRE = _loose(REPORT)

NODE_POINT = _struct(
    ("ts", TS), ("node_id", S), ("collect_agent_id", S), ("collect_agent_version", S),
    ("collection_window_seconds", D), ("received_timestamp", L), ("cpu_usage_percent", D),
    ("memory_usage_percent", D), ("memory_used_bytes", L), ("memory_total_bytes", L),
)

GPU_POINT = _struct(
    ("ts", TS), ("node_id", S), ("gpu_index", S), ("gpu_name", S), ("utilization_percent", D),
    ("temperature_celsius", D), ("power_watts", D), ("power_limit_watts", D),
    ("memory_used_mib", L), ("memory_total_mib", L),
)

PROCESS_POINT = _struct(
    ("ts", TS), ("node_id", S), ("uid", L), ("comm", S), ("cpu_ontime_ns", L),
    ("read_bytes", L), ("write_bytes", L), ("net_rx_bytes", L), ("net_tx_bytes", L),
    ("gpu_used_memory_mib", L), ("avg_rss_bytes", L), ("process_count", L),
)

# Union of the two rollup DDLs (max_gpu_temperature as double, max_gpu_memory_mib kept).
NODE_STATUS_HOURLY = _struct(
    ("bucket_time", TS), ("node_id", S), ("avg_cpu_usage_percent", D),
    ("max_cpu_usage_percent", D), ("avg_mem_usage_percent", D), ("max_mem_used_bytes", L),
    ("avg_gpu_utilization", D), ("max_gpu_temperature", D), ("total_gpu_power_watts", D),
    ("total_disk_read_bytes", L), ("total_disk_write_bytes", L), ("total_net_rx_bytes", L),
    ("total_net_tx_bytes", L), ("is_active", B),
)

USER_APP_HOURLY = _struct(
    ("bucket_time", TS), ("node_id", S), ("uid", L), ("comm", S),
    ("total_cpu_time_seconds", D), ("avg_rss_memory_bytes", L), ("max_rss_memory_bytes", L),
    ("max_gpu_memory_mib", L), ("total_read_bytes", L), ("total_write_bytes", L),
    ("total_net_rx_bytes", L), ("total_net_tx_bytes", L), ("process_count", L),
)

ALERT = _struct(
    ("node_id", S), ("collect_agent_id", S), ("alert_type", S), ("severity", S), ("message", S),
    ("timestamp", L), ("metadata", STR_MAP),
)

THRESHOLD_RULE = _struct(("metric_name", S), ("max_value", D), ("min_value", D))

ALERT_RULE = _struct(
    ("id", S), ("name", S), ("node_group", S), ("resource", S), ("operator", S),
    ("threshold", D), ("severity", S), ("enabled", B),
)

PIPELINE_RULE = _struct(
    ("id", S), ("name", S), ("type", S), ("resource", S), ("condition", S), ("enabled", B),
)

HEARTBEAT = _struct(("status", S), ("ts", D))
