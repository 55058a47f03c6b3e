"""Alerting: threshold compile, per-report threshold check, alert records, group rules,
notification feed and audit log (SURVEY AGG-25, STR-3/4, JON-10/13, SNK-6, FLT-8, TOP-5).

Rule tables are small configuration tables; they join to metrics on an equality key
(metric name, resource) through ``checked_broadcast``, never through a cartesian product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MIB, age_text
from .joins import checked_broadcast
from .stages import node_metrics

# Alert-rule resource -> collector threshold metric (upper bounds only).
RESOURCE_TO_METRIC = {
    "cpu": "cpu_usage_percent",
    "mem": "memory_usage_percent",
    "gpu": "gpu_max_utilization_percent",
    "disk": "disk_usage_percent",
}

HOURLY_RESOURCES = ["cpu", "mem", "gpu", "disk", "net"]


def hourly_resource_value(resource: str) -> Column:
    """Alert-rule resource -> hourly node value used by group rules."""
    return {
        "cpu": F.col("avg_cpu_usage_percent"),
        "mem": F.col("avg_mem_usage_percent"),
        "gpu": F.col("avg_gpu_utilization"),
        "disk": (F.col("total_disk_read_bytes") + F.col("total_disk_write_bytes")) / F.lit(MIB),
        "net": (F.col("total_net_rx_bytes") + F.col("total_net_tx_bytes")) / F.lit(MIB),
    }[resource]


def _metric_of(resource: Column) -> Column:
    out = None
    for r, m in RESOURCE_TO_METRIC.items():
        out = (F.when(resource == r, F.lit(m)) if out is None else out.when(resource == r, F.lit(m)))
    return out


def _upper_bound_rules(alert_rules: DataFrame) -> DataFrame:
    return alert_rules.filter(F.col("enabled") & F.col("operator").isin(">", ">="))


def compile_thresholds(alert_rules: DataFrame) -> DataFrame:
    """AGG-25: enabled '>' / '>=' rules mapped to agent metrics; the most restrictive
    (lowest) threshold per metric wins. Output: (metric_name, max_value, min_value)."""
    r = _upper_bound_rules(alert_rules).withColumn("metric_name", _metric_of(F.col("resource")))
    g = r.filter(F.col("metric_name").isNotNull()).groupBy("metric_name").agg(F.min("threshold").alias("max_value"))
    return g.withColumn("min_value", F.lit(None).cast("double"))


def skipped_rules(alert_rules: DataFrame) -> DataFrame:
    """AGG-25: enabled upper-bound rules without a metric mapping (pushed nowhere)."""
    r = _upper_bound_rules(alert_rules)
    return r.filter(_metric_of(F.col("resource")).isNull()).select("name")


def _value_text(v: Column, is_int: Column) -> Column:
    return F.when(v.isNull(), F.lit("None")).when(is_int, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _threshold_text(v: Column) -> Column:
    # Thresholds travel as JSON numbers: integral values print without a fraction.
    return (F.when(v.isNull(), F.lit("None"))
             .when(v == F.floor(v), v.cast("bigint").cast("string"))
             .otherwise(v.cast("string")))


def threshold_check(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """STR-3 + JON-10: metric rows joined to rules by name (absent metric -> no row);
    '> max' -> exceeded_max, '< min' -> below_min, below_min wins when both (strict)."""
    r = checked_broadcast(rules.select("metric_name", F.col("max_value").alias("threshold_max"),
                                       F.col("min_value").alias("threshold_min")))
    j = metrics.join(r, "metric_name")
    v = F.col("metric_value")
    vt = (F.when(F.col("threshold_min").isNotNull() & (v < F.col("threshold_min")), F.lit("below_min"))
           .when(F.col("threshold_max").isNotNull() & (v > F.col("threshold_max")), F.lit("exceeded_max")))
    return j.withColumn("violation_type", vt).filter(F.col("violation_type").isNotNull())


def threshold_alerts(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """Per report: compute the metric map, check every rule, keep violations."""
    return threshold_check(node_metrics(reports), rules)


def alert_records(violations: DataFrame, collect_agent_id: str | Column) -> DataFrame:
    """SNK-6 + SCL-15: violation -> Alert{node, agent, type, severity, message, ts, metadata}."""
    agent = collect_agent_id if isinstance(collect_agent_id, Column) else F.lit(collect_agent_id)
    vtxt = _value_text(F.col("metric_value"), F.col("is_int"))
    mx, mn = _threshold_text(F.col("threshold_max")), _threshold_text(F.col("threshold_min"))
    msg = F.concat(F.lit("Threshold violation: "), F.col("metric_name"), F.lit(" value "), vtxt, F.lit(" "),
                   F.col("violation_type"), F.lit(" (max: "), mx, F.lit(", min: "), mn, F.lit(")"))
    md = F.create_map(F.lit("metric_value"), vtxt, F.lit("threshold_max"), mx, F.lit("threshold_min"), mn,
                      F.lit("violation_type"), F.col("violation_type"))
    return violations.select(
        "node_id", agent.alias("collect_agent_id"), F.col("metric_name").alias("alert_type"),
        F.when(F.col("violation_type") == "exceeded_max", F.lit("critical")).otherwise(F.lit("warning")).alias("severity"),
        msg.alias("message"), F.col("timestamp").cast("bigint").alias("timestamp"), md.alias("metadata"))


def _compare(op: Column, v: Column, t: Column) -> Column:
    return (F.when(op == ">", v > t).when(op == ">=", v >= t).when(op == "<", v < t).when(op == "<=", v <= t)
             .otherwise(F.lit(False)))


def group_alerts(node_hourly: DataFrame, nodes: DataFrame, alert_rules: DataFrame) -> DataFrame:
    """STR-4 + JON-13: operator-exact evaluation of enabled alert rules on hourly node
    values, scoped by node group ('all' = every node); output shaped as notifications.

    Node values are unpivoted to (resource, value) rows and equi-joined to the rules on
    ``resource``; the group scope is a filter on the joined row, so no cartesian product."""
    res = HOURLY_RESOURCES
    wide = node_hourly.select("bucket_time", "node_id", *[hourly_resource_value(r).cast("double").alias(r) for r in res])
    long = wide.unpivot(["bucket_time", "node_id"], res, "resource", "value")
    grp = checked_broadcast(nodes.select(F.col("id").alias("node_id"), F.col("group_name")))
    long = long.join(grp, "node_id", "left")
    rules = checked_broadcast(alert_rules.filter("enabled").select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "node_group", "resource", "operator",
        "threshold", "severity"))
    j = long.join(rules, "resource")
    j = j.filter((F.col("node_group") == "all") | (F.col("node_group") == F.col("group_name")))
    j = j.filter(F.coalesce(_compare(F.col("operator"), F.col("value"), F.col("threshold")), F.lit(False)))
    msg = F.concat(F.col("rule_name"), F.lit(": "), F.col("resource"), F.lit(" "), F.col("operator"), F.lit(" "),
                   F.col("threshold").cast("string"))
    return j.select(
        F.concat_ws(":", "rule_id", "node_id", F.date_format("bucket_time", "yyyyMMddHH")).alias("id"),
        "rule_id", "severity", msg.alias("message"), "node_id", "value", F.lit(False).alias("acknowledged"),
        F.col("bucket_time").alias("created_at"))


def alert_episodes(breaches: DataFrame, alert_rules: DataFrame) -> DataFrame:
    """STR-4: consecutive breached hours of a rule and node (``group_alerts`` rows) as one episode:
    ``(id, rule_id, node_id, severity, message, started_at, ended_at, n_hours, worst_value)``.

    The worst value is the greatest for rules that bound from above, else the least. ended_at is the
    end of the last hour. Gaps and islands: an hour's number minus its rank is the same within an
    unbroken run; a partition has one row per hour of one rule and node."""
    rules = checked_broadcast(alert_rules.select(F.col("id").alias("rule_id"), F.col("operator").alias("_op")))
    b = breaches.join(rules, "rule_id")
    hour_no = F.unix_seconds("created_at") / 3600
    rank = F.dense_rank().over(Window.partitionBy("rule_id", "node_id").orderBy("created_at"))
    b = b.withColumn("_run", hour_no.cast("bigint") - rank)
    worst = F.when(F.first("_op").isin(">", ">="), F.max("value")).otherwise(F.min("value"))
    g = b.groupBy("rule_id", "node_id", "_run").agg(
        F.max("severity").alias("severity"), F.max("message").alias("message"), F.min("created_at").alias("started_at"),
        (F.max("created_at") + F.expr("INTERVAL 1 HOUR")).alias("ended_at"), F.count_distinct("created_at").alias("n_hours"), worst.alias("worst_value"))
    return g.select(F.concat_ws(":", "rule_id", "node_id", F.date_format("started_at", "yyyyMMddHH")).alias("id"), "rule_id", "node_id", "severity",
                    "message", "started_at", "ended_at", "n_hours", "worst_value")


NOTIFICATION_KEYS, NOTIFICATION_BUCKETS = ["id"], ["rule_id", "node_id"]


def notify(table, episodes: DataFrame, now: Column) -> int:
    """STR-4: write episodes as notifications into a ``sources.keyed.KeyedTable`` (keys
    NOTIFICATION_KEYS, bucketed by NOTIFICATION_BUCKETS); returns its version.

    A notification that is already there keeps ``acknowledged`` and ``created_at`` and takes the
    episode's new end and worst value, so a rerun adds nothing and clears no flag. When late data
    joins two episodes, the later one's notification goes. ``episodes`` has to reach back to
    the start of runs that may still go on."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        seen = old.select("id", F.col("acknowledged").alias("_ack"), F.col("created_at").alias("_made"))
        kept = new.join(seen, "id", "left").withColumns({
            "acknowledged": F.coalesce("_ack", "acknowledged"), "created_at": F.coalesce("_made", "created_at")}).drop("_ack", "_made")
        span = new.select("rule_id", "node_id", F.col("started_at").alias("_from"), F.col("ended_at").alias("_to"))
        inside = [old.rule_id == span.rule_id, old.node_id == span.node_id, old.started_at >= span["_from"], old.started_at < span["_to"]]
        return kept.unionByName(old.join(span, inside, "left_anti").select(*kept.columns))

    return table.merge(episodes.withColumns({"acknowledged": F.lit(False), "created_at": now}), combine=combine)


def notifications_feed(notifications: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """JON-5 + SCL-11 + TOP-8: notifications with the node name (left join) and an age
    label relative to ``as_of``, newest first."""
    nd = checked_broadcast(nodes.select(F.col("id").alias("nid"), F.col("name").alias("node_name")))
    j = notifications.join(nd, notifications.node_id == nd.nid, "left").drop("nid")
    return j.withColumn("age", age_text(F.col("created_at"), as_of)).orderBy(F.col("created_at").desc(), F.col("id").desc())


def unread(notifications: DataFrame) -> DataFrame:
    """FLT-8: unacknowledged notifications."""
    return notifications.filter(~F.coalesce(F.col("acknowledged"), F.lit(False)))


def audit_recent(audit: DataFrame, n: int = 100) -> DataFrame:
    """TOP-5: the newest n audit rows (a top-k report: TakeOrderedAndProject)."""
    return audit.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
