"""Report wire format: JSON encode / decode, batch and stream sources, sinks
(SURVEY SRC-1/2, SNK-1/2, PRJ-2).

The topic carries one JSON object per report keyed by node id. Numbers may arrive as text
(dynamic projection and loose producers), so decoding reads every numeric leaf as a string
and converts it with ``safe_int`` / ``safe_float``; a value that does not parse becomes null
and malformed JSON lands in ``_corrupt`` (PERMISSIVE mode).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import safe_float, safe_int
from ..schemas import GPU, PROCESS, REPORT, REPORT_WIRE
from ..operators.stages import exported_process_struct


def _typed(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return safe_int(c, None).cast(dt)
    if isinstance(dt, T.DoubleType):
        return safe_float(c, None)
    return c


def _typed_struct(x: Column, st: T.StructType) -> Column:
    return F.struct(*[_typed(x[f.name], f.dataType).alias(f.name) for f in st.fields])


def encode_reports(reports: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """SNK-1 / PRJ-2: (key = node_id, value = JSON text). Null ``system_metrics`` is left
    out of the object. A report whose metadata lists exported process fields carries only
    those keys per process; any other report all of them and the process metadata."""
    listed = F.coalesce(F.regexp_extract_all(F.col("metadata")["exported_process_fields"], F.lit("'([^']*)'"), F.lit(1)), F.array())
    procs = F.transform("processes", lambda p: exported_process_struct(p, listed))
    body = F.struct(*[F.col(c) for c in extra], "node_id", "timestamp", "collection_window_seconds",
                    procs.alias("processes"), "system_metrics", "collect_agent_id", "received_timestamp", "metadata")
    return reports.select(F.col("node_id").alias("key"), F.to_json(body).alias("value"))


def wire_schema(extra: dict[str, str] | None = None) -> T.StructType:
    fields = list(REPORT_WIRE.fields)
    for n in (extra or {}):
        fields.append(T.StructField(n, T.StringType(), True))  # loose on the wire
    fields.append(T.StructField("_corrupt", T.StringType(), True))
    return T.StructType(fields)


def decode_reports(wire: DataFrame, value_col: str = "value", extra: dict[str, str] | None = None) -> DataFrame:
    """SRC-2: JSON text -> typed nested reports. Absent ``system_metrics`` -> null struct;
    rows whose text is not JSON keep their text in ``_corrupt`` (and null fields)."""
    schema = wire_schema(extra)
    j = wire.select(F.from_json(F.col(value_col), schema,
                                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    r = F.col("r")
    procs = F.transform(F.coalesce(r["processes"], F.array()), lambda p: _typed_struct(p, PROCESS))
    sm = r["system_metrics"]
    gpus = F.transform(F.coalesce(sm["gpus"], F.array()), lambda g: _typed_struct(g, GPU))
    sys_fields = [f for f in REPORT["system_metrics"].dataType.fields if f.name != "gpus"]
    sm_t = F.when(sm.isNotNull(), F.struct(*[_typed(sm[f.name], f.dataType).alias(f.name) for f in sys_fields],
                                           gpus.alias("gpus")))
    cols = [safe_int(r[n], None).alias(n) if t in ("bigint", "int") else r[n].alias(n) for n, t in (extra or {}).items()]
    return j.select(
        *cols,
        r["node_id"].alias("node_id"),
        safe_int(r["timestamp"], None).alias("timestamp"),
        safe_float(r["collection_window_seconds"], None).alias("collection_window_seconds"),
        procs.alias("processes"), sm_t.alias("system_metrics"),
        r["collect_agent_id"].alias("collect_agent_id"),
        safe_int(r["received_timestamp"], None).alias("received_timestamp"),
        F.coalesce(r["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
        r["_corrupt"].alias("_corrupt"),
    ).withColumn("event_time", F.timestamp_seconds("timestamp"))


def read_report_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-1 offline form: a directory of JSON-lines report files as a stream of text
    values (the Kafka source has the same ``value`` column; its consumer group maps to the
    query's checkpoint location)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def read_kafka_reports(spark: SparkSession, brokers: str, topic: str, earliest: bool = True) -> DataFrame:
    """SRC-1: Kafka topic as a stream of ``value`` text (needs the Kafka connector jar)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers)
            .option("subscribe", topic).option("startingOffsets", "earliest" if earliest else "latest")
            .load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))


def write_points(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-2: append points partitioned by date (partition pruning on time ranges)."""
    df.withColumn("date", F.to_date("ts")).write.mode(mode).partitionBy("date").parquet(path)
