"""Structured Streaming jobs.

* ``points_stream``: report JSON -> decode -> collect stages -> ``foreachBatch`` fan-out
  to the node / GPU / process point tables, alert records and rejects. Each micro-batch
  writes its own ``batch_id`` partition with dynamic partition overwrite, so a replayed
  batch (after an executor or driver loss) replaces its earlier attempt: idempotent.
* ``app_rollup_stream`` / ``node_rollup_stream``: event-time hourly rollups with a
  watermark in append mode; a bucket is emitted once the watermark passes its end.
  Rows later than the watermark are dropped from these streams but stay in the point
  tables, so ``rollup_hours`` (a batch job over explicit hours) can backfill them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts, points, rollup, stages
from ..operators.joins import literal_table
from ..session import checkpoint_dir
from ..sources import ingest
from ..sources.keyed import KeyedTable
from . import ledger

POINT_TABLES = ("node_status", "gpu_status", "process_status", "alerts", "rejects")


def collect_batch(reports: DataFrame, config: dict) -> dict[str, DataFrame]:
    """One micro-batch of decoded reports -> the output tables (all lazy). Text that was
    not JSON is rejected as ``malformed_json`` (D-22) before any stage runs."""
    if "_corrupt" in reports.columns:
        reports = reports.withColumn("_reject_reason", F.when(F.col("_corrupt").isNotNull(), F.lit("malformed_json")))
    annotated = stages.run_collect(
        reports, config.get("stages"), config.get("process_fields"), config.get("comm_prefixes"),
        config.get("collect_agent_id", "collect_agent"), config.get("threshold_rules", ()),
        config.get("received_timestamp"), config.get("sample_rate"))
    ok = annotated.filter(F.col("_reject_reason").isNull())
    procs = points.explode_processes(ok)
    rules = literal_table(ok.sparkSession, list(config.get("threshold_rules", ())),
                          "metric_name string, max_value double, min_value double")
    viol = alerts.threshold_check(stages.node_metrics(ok), rules)
    return {
        "node_status": points.node_points(ok),
        "gpu_status": points.gpu_points(ok),
        "process_status": points.process_points(procs),
        "alerts": alerts.alert_records(viol, config.get("collect_agent_id", "collect_agent")),
        "rejects": annotated.filter(F.col("_reject_reason").isNotNull()).select(
            "node_id", "timestamp", "_reject_reason", F.col("_invalid").alias("invalid_processes")),
    }


def _write_batch(tables: dict[str, DataFrame], root: str, batch_id: int) -> None:
    """Tables are partitioned by (date, batch_id): time-range reads prune by date, and
    dynamic overwrite replaces exactly this batch's partitions on a replay. ``compact``
    folds the batches of closed days together."""
    for name, df in tables.items():
        out = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        parts = ["batch_id"]
        if "ts" in df.columns or "timestamp" in df.columns:
            time = F.col("ts") if "ts" in df.columns else F.timestamp_seconds("timestamp")
            out = out.withColumn("date", F.to_date(time))
            parts = ["date", "batch_id"]
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts).parquet(f"{root}/{name}"))


def compact(spark: SparkSession, root: str, table: str, day: str, target: str) -> None:
    """Rewrite one closed day of a stream table into ``target`` with few files, keeping
    ``batch_id`` as a column (the order of writes). Idempotent: it replaces that day in
    ``target`` and leaves the source alone. A reader takes a day from one of the two roots: closed
    days from ``target``, the others from ``root``."""
    df = spark.read.parquet(f"{root}/{table}").filter(F.col("date") == F.lit(day).cast("date"))
    (df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("date").parquet(f"{target}/{table}"))


def points_stream(spark: SparkSession, source: DataFrame, sink_root: str, config: dict,
                  checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """STR-5: continuous report -> points job. ``source`` has a JSON ``value`` column
    (``ingest.read_report_stream`` or ``ingest.read_kafka_reports``)."""
    ckpt = checkpoint or f"{checkpoint_dir(spark)}/points_stream"
    extra = config.get("extra_fields")
    reports = ingest.decode_reports(source, extra=extra)
    if "report_id" not in reports.columns:
        # A stable per-report key from the content: a replayed batch gets the same keys.
        reports = reports.withColumn("report_id", F.xxhash64("node_id", "timestamp", F.to_json("processes")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The batch is used by five writers: persist it once (spilling to disk) instead of
        # decoding the source five times.
        b = batch.persist()
        try:
            tables = collect_batch(b, config)
            _write_batch(tables, sink_root, batch_id)
            # every point of a report carries its time, and each report has a node point
            ledger.note_hours(tables["node_status"], sink_root, batch_id)
        finally:
            b.unpersist()

    w = reports.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# Series tags and rolled-up fields of the point tables.
NODE_TAGS = ["node_id", "collect_agent_id", "collect_agent_version"]
GPU_TAGS = ["node_id", "gpu_index", "gpu_name"]
APP_TAGS = ["node_id", "uid", "comm"]
NODE_FIELDS = ["cpu_usage_percent", "memory_usage_percent", "memory_used_bytes"]
GPU_FIELDS = ["utilization_percent", "power_watts", "temperature_celsius"]
APP_FIELDS = ["cpu_ontime_ns", *rollup.IO_FIELDS, "avg_rss_bytes", "process_count", "gpu_used_memory_mib"]


def overwrite_stream(points: DataFrame, tags: Sequence[str], fields: Sequence[str], watermark: str, order_by: str) -> DataFrame:
    """SNK-3 on a stream: per series and second the point with the greatest ``order_by`` (ingest
    order), emitted when the watermark passes the second. The time that goes on is the end of the
    second's window, which further windows are chained on under the same watermark.

    A stream without the order column has nothing to choose by; its points go on as they are."""
    p = points.withWatermark("ts", watermark)
    if order_by not in points.columns:
        return p
    tags = [c for c in tags if c in points.columns]
    g = p.groupBy(F.window("ts", "1 second").alias("_w"), *tags).agg(*[F.max_by(c, order_by).alias(c) for c in fields])
    return g.select(F.window_time("_w").alias("ts"), *tags, *fields)


def app_rollup_stream(process_points: DataFrame, watermark: str = "10 minutes", mode: str = "spread", order_by: str = "report_id") -> DataFrame:
    """STR-6 (b): hourly app rollup over a point stream, append mode under a watermark. Points that
    a later one of the same series and second overwrites don't count (SNK-3), as in the batch."""
    p = overwrite_stream(process_points, APP_TAGS, APP_FIELDS, watermark, order_by)
    return rollup.user_app_hourly(p, mode, bucket=F.window("ts", "1 hour"))


def node_rollup_stream(node_points: DataFrame, watermark: str = "10 minutes", order_by: str = "report_id") -> DataFrame:
    """STR-6 (b): hourly node mean / max over a point stream, append mode, after SNK-3."""
    p = overwrite_stream(node_points, NODE_TAGS, NODE_FIELDS, watermark, order_by)
    return rollup.node_hourly_core(p, bucket=F.window("ts", "1 hour"))


def gate_stream(reports: DataFrame, changes: DataFrame, max_age_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """STA-4 on streams: ``fleet.gate_at_report_time`` of a report stream (node_id, event_time,
    report_id, ...) and a stream of status changes (node_id, change_time, seq, status), append mode.

    Both sides are joined over the interval in which a change can count, and the last change per
    report is chosen when the watermark has passed the report, so late changes within the watermark
    still count. State is bounded by the watermark and ``max_age_seconds``. Reports are told apart by
    ``report_id``."""
    r = reports.withWatermark("event_time", watermark)
    c = changes.withWatermark("change_time", watermark).select(F.col("node_id").alias("_node"), "change_time", "seq", "status")
    j = r.join(c, (F.col("node_id") == F.col("_node")) & (F.col("change_time") <= F.col("event_time"))
               & (F.col("change_time") >= F.col("event_time") - F.expr(f"INTERVAL {int(max_age_seconds)} SECONDS")))
    rest = [x for x in reports.columns if x not in ("event_time", "node_id", "report_id")]
    j = j.select("node_id", "report_id", "event_time", F.struct(F.unix_micros("change_time").alias("us"), "seq").alias("_at"), "status",
                 F.struct(F.col("event_time").cast("timestamp_ntz").alias("event_time"), *rest).alias("_row"))
    g = j.groupBy(F.window("event_time", "1 second").alias("_w"), "node_id", "report_id").agg(F.max_by("status", "_at").alias("_status"), F.first("_row").alias("_row"))
    out = g.where("_status = 'running'").select("node_id", "report_id", "_row.*")
    return out.withColumn("event_time", F.col("event_time").cast("timestamp")).select(*reports.columns)


def read_points(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def rollup_hours(spark: SparkSession, root: str, hours: Sequence[str], mode: str = "spread") -> dict[str, DataFrame]:
    """STR-6 (a): batch rollup of exactly the listed hours from the stored points (backfill,
    late data); ``rollup.write_rollup`` then overwrites those hours and no others. The dates
    of the hours prune the scan. A later batch's point replaces an earlier one of the same
    series and second (SNK-3); within a batch the larger report key wins."""
    listed = sorted({dt.datetime.fromisoformat(str(h)).replace(minute=0, second=0, microsecond=0) for h in hours})
    if not listed:
        raise ValueError("no hours given")
    hour_list = [F.lit(str(h)).cast("timestamp") for h in listed]
    dates = [F.lit(str(d)).cast("date") for d in sorted({h.date() for h in listed})]

    def stored(table: str, tags: list[str]) -> DataFrame:
        df = read_points(spark, root, table)
        df = df.filter(F.col("date").isin(dates) & F.date_trunc("hour", "ts").isin(hour_list)
                       & (F.col("ts") >= hour_list[0]) & (F.col("ts") < hour_list[-1] + F.expr("INTERVAL 1 HOUR")))
        # one number that orders by batch, then by report key, keeps the overwrite a hash aggregate
        order = F.col("batch_id").cast("decimal(18,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + F.col("report_id")
        df = df.withColumn("_order", order.cast("decimal(38,0)")).drop("date", "batch_id", "report_id")
        return points.series_dedup(df, tags, "ts", "_order").drop("_order")

    n = stored("node_status", NODE_TAGS)
    g = stored("gpu_status", GPU_TAGS)
    p = stored("process_status", APP_TAGS)
    return {"node_status_hourly": rollup.node_status_hourly(n, g, p, mode),
            "user_app_hourly": rollup.user_app_hourly(p, mode)}


def latest_heartbeats_stream(heartbeats: DataFrame) -> DataFrame:
    """STA-3 (stream): the newest heartbeat per node as streaming state (update mode). The
    state is one row per node, and the aggregate is partial per micro-batch."""
    return heartbeats.groupBy("node_id").agg(
        F.max_by(F.struct(F.col("event_time").cast("double").alias("timestamp"), "status"), "event_time").alias("h")
    ).select("node_id", "h.timestamp", "h.status")


def liveness_table(spark: SparkSession, sink_path: str) -> KeyedTable:
    return KeyedTable(spark, sink_path, ["node_id"])


def current_liveness(spark: SparkSession, sink_path: str, node_config: DataFrame, now=None) -> DataFrame:
    """Node liveness at ``now`` (default: the clock) from the stored newest heartbeats and the
    pivoted live config."""
    from ..operators import fleet
    newest = liveness_table(spark, sink_path).read()
    return fleet.liveness(node_config, newest, F.current_timestamp() if now is None else now)


def liveness_stream(spark: SparkSession, heartbeats: DataFrame, sink_path: str,
                    checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """STA-3 (stream): each micro-batch merges the nodes it heard of into a keyed table of newest
    heartbeats (update mode; buckets without news stay as they are, readers never see half a batch,
    a replay merges the same rows again, older versions are pruned). Liveness depends on
    the clock, so ``current_liveness`` derives it when read: a fleet that falls silent expires
    although no further batch runs."""
    ckpt = checkpoint or f"{checkpoint_dir(spark)}/liveness_stream"

    def handle(latest: DataFrame, batch_id: int) -> None:
        table = liveness_table(latest.sparkSession, sink_path)
        table.merge(latest, order_by="timestamp")
        table.prune()

    w = (latest_heartbeats_stream(heartbeats).writeStream.outputMode("update").foreachBatch(handle)
         .option("checkpointLocation", ckpt))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def liveness_session_stream(heartbeats: DataFrame, gaps: DataFrame, watermark: str = "1 minute", default_gap_seconds: int = 60) -> DataFrame:
    """STA-3 (stream): ``fleet.liveness_sessions`` in append mode; a silent node's stretch is a row
    once the watermark has passed its lapse."""
    from ..operators import fleet
    return fleet.liveness_sessions(heartbeats.withWatermark("event_time", watermark), gaps, default_gap_seconds)


def publish_kafka(reports: DataFrame, brokers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """SNK-1 / PRJ-2: reports -> topic keyed by node id, gzip batches (needs the Kafka
    connector on the classpath)."""
    out = ingest.encode_reports(reports)
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic)
            .option("kafka.compression.type", "gzip").option("kafka.linger.ms", "10")
            .option("kafka.batch.size", str(64 * 1024)).option("checkpointLocation", checkpoint).start())


def publish_files(reports: DataFrame, path: str) -> None:
    """SNK-1 offline: the same JSON values as gzip-compressed text files (batch)."""
    ingest.encode_reports(reports).select("value") \
        .write.mode("overwrite").option("compression", "gzip").text(path)


def gpu_rollup_stream(gpu_points: DataFrame, watermark: str = "10 minutes", order_by: str = "report_id") -> DataFrame:
    """STR-6 (b): the two-level GPU rollup (AGG-6) over a point stream: per-GPU hourly
    means, then per node, chained on ``window_time`` so both stateful aggregates close
    under the same watermark (append mode)."""
    from ..functions.scalars import stable
    p = overwrite_stream(gpu_points, GPU_TAGS, GPU_FIELDS, watermark, order_by)
    per_gpu = p.groupBy(F.window("ts", "1 hour").alias("w"), "node_id", "gpu_index").agg(
        F.avg("utilization_percent").alias("u"), F.avg("power_watts").alias("p"), F.avg("temperature_celsius").alias("t"))
    per_gpu = per_gpu.select(F.window_time("w").alias("wt"), "node_id", "u", "p", "t")
    node = per_gpu.groupBy(F.window("wt", "1 hour").alias("bucket_time"), "node_id").agg(
        stable(F.avg(F.coalesce("u", F.lit(0.0)))).alias("avg_gpu_utilization"),
        stable(F.greatest(F.max(F.coalesce("t", F.lit(0.0))), F.lit(0.0))).alias("max_gpu_temperature"),
        stable(F.avg(F.coalesce("p", F.lit(0.0)))).alias("total_gpu_power_watts"),
        F.count(F.lit(1)).alias("gpu_count"))
    return node.withColumn("bucket_time", F.col("bucket_time.start"))
