"""Usage analytics over the hourly rollups (SURVEY 2.2-2.7: AGG-13..22, JON-1/2, FLT-2..5,
TOP-2..4, SET-3/4, SCL-16).

All relative ranges take an explicit ``as_of`` (D-16). Dimension tables (users) are joined
through ``checked_broadcast``: broadcast only below a row bound verified at plan time,
otherwise a shuffle join (and AQE may still convert it at runtime).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MIB, round_half_up
from .joins import checked_broadcast

# Resource -> aggregate expression over user_app_hourly.
RESOURCES = ("cpu", "mem", "gpu", "disk", "net")

# Allowed relative ranges.
CLUSTER_RANGES = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours"}   # default 1h
NODE_RANGES = {"1d": "1 day", "2d": "2 days", "7d": "7 days",
               "24h": "1 day", "48h": "2 days", "30d": "30 days"}        # default 1d
PAGE_RANGES = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days"}


def resource_metric(resource: str) -> Column | None:
    """PRJ-7: allow-listed aggregate for a resource; unknown -> None (empty result)."""
    h = F.col
    return {
        "cpu": F.sum(h("total_cpu_time_seconds")),
        "mem": F.max(h("max_rss_memory_bytes")) / F.lit(MIB),
        "gpu": F.max(h("max_gpu_memory_mib")).cast("double"),
        "disk": F.sum(h("total_read_bytes") + h("total_write_bytes")) / F.lit(MIB),
        "net": F.sum(h("total_net_rx_bytes") + h("total_net_tx_bytes")) / F.lit(MIB),
    }.get(resource)


def _ts(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, dt.datetime):
        return F.lit(x).cast("timestamp")
    return F.lit(str(x)).cast("timestamp")


def range_interval(range_key: str | None, allowed: dict[str, str], default: str) -> str:
    """FLT-5: allow-listed interval text; unknown -> the default."""
    return allowed.get(range_key or "", allowed[default])


def range_filter(df: DataFrame, range_key: str | None, as_of, allowed: dict[str, str] = CLUSTER_RANGES,
                 default: str = "1h", col: str = "bucket_time") -> DataFrame:
    """FLT-5: keep rows with ``col >= as_of - interval``."""
    iv = range_interval(range_key, allowed, default)
    return df.filter(F.col(col) >= _ts(as_of) - F.expr(f"INTERVAL {iv}"))


def between_closed(df: DataFrame, start, end, col: str = "bucket_time") -> DataFrame:
    """D-17: closed range [start, end]."""
    return df.filter((F.col(col) >= _ts(start)) & (F.col(col) <= _ts(end)))


def latest_time(df: DataFrame, col: str = "bucket_time") -> Column:
    """Default ``as_of``: the table's newest time, as a lazy scalar subquery."""
    return df.select(F.max(col)).scalar()


# ------------------------------------------------------------------ cluster stats ----
def cluster_stats(node_hourly: DataFrame, range_key: str | None = "1h", as_of=None) -> DataFrame:
    """AGG-13: one row: rounded means of cpu/gpu/mem and rounded MB totals; empty -> nulls."""
    as_of = latest_time(node_hourly) if as_of is None else as_of
    f = range_filter(node_hourly, range_key, as_of, CLUSTER_RANGES, "1h")
    return f.agg(
        round_half_up(F.avg("avg_cpu_usage_percent"), 1).alias("avg_cpu_pct"),
        round_half_up(F.avg("avg_gpu_utilization"), 1).alias("avg_gpu_pct"),
        round_half_up(F.avg("avg_mem_usage_percent"), 1).alias("avg_mem_pct"),
        round_half_up((F.sum("total_disk_read_bytes") + F.sum("total_disk_write_bytes")) / F.lit(MIB), 1).alias("total_disk_mb"),
        round_half_up(F.sum("total_net_rx_bytes") / F.lit(MIB), 1).alias("net_rx_mb"),
        round_half_up(F.sum("total_net_tx_bytes") / F.lit(MIB), 1).alias("net_tx_mb"),
    )


# ------------------------------------------------------------------ user usage -------
def usage_summary(users: DataFrame, app_hourly: DataFrame, start, end) -> DataFrame:
    """JON-1 + AGG-14 + TOP-3: every user, idle ones with null totals (the time predicate
    belongs to the join, so it is applied to the usage side before the left join)."""
    h = between_closed(app_hourly, start, end)
    h = h.groupBy("uid").agg(
        F.sum("total_cpu_time_seconds").alias("total_cpu_seconds"),
        F.max("max_rss_memory_bytes").alias("peak_mem_bytes"),
        F.max("max_gpu_memory_mib").alias("peak_gpu_mib"),
        F.sum(F.col("total_read_bytes") + F.col("total_write_bytes")).alias("total_disk_bytes"),
        F.sum(F.col("total_net_rx_bytes") + F.col("total_net_tx_bytes")).alias("total_net_bytes"))
    # Pre-aggregating usage per uid before the join keeps the join input at one row per
    # uid (it shrinks from hours x nodes x apps); grouping by uid alone is exact because
    # (uid) determines (username, group_name) in the users table.
    u = users.select("uid", "username", "group_name")
    out = u.join(h, "uid", "left")
    return out.select("uid", "username", "group_name", "total_cpu_seconds", "peak_mem_bytes",
                      "peak_gpu_mib", "total_disk_bytes", "total_net_bytes") \
              .orderBy(F.col("total_cpu_seconds").desc_nulls_last())


def usage_timeseries(app_hourly: DataFrame, uid: int, resource: str, start, end) -> DataFrame:
    """AGG-15: hourly series of one resource for one uid; unknown resource -> empty."""
    m = resource_metric(resource)
    h = between_closed(app_hourly.filter(F.col("uid") == F.lit(uid)), start, end)
    if m is None:
        return h.limit(0).select(F.col("bucket_time").alias("t"), F.lit(None).cast("double").alias("value"))
    return h.groupBy(F.date_trunc("hour", "bucket_time").alias("t")).agg(m.cast("double").alias("value")).orderBy("t")


def _selected_users(users: DataFrame, uids: Sequence[int]) -> DataFrame:
    return checked_broadcast(users.filter(F.col("uid").isin(list(uids))).select("uid", "username"))


def usage_app_timeseries(app_hourly: DataFrame, users: DataFrame, uids: Sequence[int], resource: str,
                         start, end) -> DataFrame:
    """AGG-16 + JON-2: hourly series per (user, app) for several uids."""
    m = resource_metric(resource)
    h = between_closed(app_hourly.filter(F.col("uid").isin(list(uids))), start, end)
    j = h.join(_selected_users(users, uids), "uid")
    if m is None:
        return j.limit(0).select(F.col("bucket_time").alias("t"), "username", "comm", F.lit(None).cast("double").alias("value"))
    g = j.groupBy(F.date_trunc("hour", "bucket_time").alias("t"), "uid", "username", "comm").agg(m.cast("double").alias("value"))
    return g.select("t", "username", "comm", "value").orderBy("t", "username", "comm")


def usage_apps(app_hourly: DataFrame, users: DataFrame, uids: Sequence[int], start, end) -> DataFrame:
    """AGG-17 + JON-2: per (username, app) breakdown of all resources, by cpu desc."""
    h = between_closed(app_hourly.filter(F.col("uid").isin(list(uids))), start, end)
    j = h.join(_selected_users(users, uids), "uid")
    g = j.groupBy("username", "comm").agg(
        F.sum("total_cpu_time_seconds").alias("cpu_seconds"),
        (F.max("max_rss_memory_bytes") / F.lit(MIB)).alias("peak_mem_mb"),
        F.max("max_gpu_memory_mib").alias("peak_gpu_mib"),
        (F.sum(F.col("total_read_bytes") + F.col("total_write_bytes")) / F.lit(MIB)).alias("disk_io_mb"),
        (F.sum(F.col("total_net_rx_bytes") + F.col("total_net_tx_bytes")) / F.lit(MIB)).alias("net_io_mb"),
        F.sum("process_count").alias("total_processes"))
    return g.orderBy(F.col("cpu_seconds").desc())


# -------------------------------------------------------------- app shaping ----------
def app_search(apps: DataFrame, text: str, col: str = "comm") -> DataFrame:
    """FLT-3: case-insensitive contains."""
    return apps.filter(F.lower(F.col(col)).contains(text.lower()))


def apps_selected(apps: DataFrame, selected: Sequence[str] | DataFrame, empty_means_all: bool = True) -> DataFrame:
    """FLT-4: keep selected apps, listed by name or as the ``comm`` column of a DataFrame;
    an empty list keeps all (table) or none (chart)."""
    if isinstance(selected, DataFrame):
        return apps.join(selected.select("comm"), "comm", "left_semi")
    if not selected:
        return apps if empty_means_all else apps.limit(0)
    return apps.filter(F.col("comm").isin(list(selected)))


def app_totals(apps: DataFrame) -> DataFrame:
    """Per app: distinct users and summed cpu (input: usage_apps rows; unnamed apps skipped)."""
    named = apps.filter(F.col("comm").isNotNull() & (F.col("comm") != ""))
    return named.groupBy("comm").agg(F.countDistinct("username").alias("n_users"),
                                    F.sum("cpu_seconds").alias("cpu_seconds"))


def common_apps(apps: DataFrame) -> DataFrame:
    """AGG-18 / SET-4: apps used by every user present (relational division; with one
    user or none the filter is off), ranked by cpu. The user total is a scalar subquery."""
    totals = app_totals(apps)
    n_users = apps.select(F.countDistinct("username")).scalar()
    keep = (n_users <= 1) | (F.col("n_users") == n_users)
    return totals.filter(keep).orderBy(F.col("cpu_seconds").desc(), F.col("comm"))


def top_apps(apps: DataFrame, n: int = 5) -> DataFrame:
    """TOP-2: the first n of the common-apps list by cpu (TakeOrderedAndProject)."""
    return common_apps(apps).orderBy(F.col("cpu_seconds").desc(), F.col("comm")).limit(n)


def app_bar_share(apps: DataFrame) -> DataFrame:
    """AGG-19: bar length = max(2, 100 * cpu / top cpu) over the common-apps list; the top
    is a scalar subquery (no global window, no join); an empty list divides by 1."""
    totals = common_apps(apps)
    top = F.coalesce(totals.select(F.max("cpu_seconds")).scalar(), F.lit(1.0))
    return totals.select("comm", "cpu_seconds",
                         F.greatest(F.lit(2.0), F.lit(100.0) * F.col("cpu_seconds") / top).alias("bar_pct"))


# Sortable columns of the apps table.
APP_SORT_COLUMNS = ("cpu_seconds", "peak_mem_mb", "peak_gpu_mib", "disk_io_mb", "net_io_mb", "total_processes")


def apps_sorted(apps: DataFrame, column: str = "cpu_seconds", descending: bool = True) -> DataFrame:
    """TOP-4: sort by an allow-listed column, nulls as 0."""
    c = column if column in APP_SORT_COLUMNS else "cpu_seconds"
    k = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return apps.orderBy(k.desc() if descending else k.asc(), "username", "comm")


def pie_by_user(apps: DataFrame, field: str = "cpu_seconds") -> DataFrame:
    """AGG-20: per user, the sum of a field over that user's apps, > 0 only (D-13: peaks
    are summed too)."""
    g = apps.groupBy("username").agg(F.sum(F.coalesce(F.col(field).cast("double"), F.lit(0.0))).alias("value"))
    return g.filter(F.col("value") > 0)


def pie_by_app(apps: DataFrame, field: str = "cpu_seconds") -> DataFrame:
    """AGG-21: per (user, app) slices > 0, descending inside each user."""
    v = F.coalesce(F.col(field).cast("double"), F.lit(0.0))
    s = apps.select("username", F.col("comm").alias("name"), v.alias("value")).filter(F.col("value") > 0)
    return s.orderBy("username", F.col("value").desc(), "name")


def usage_share(slices: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """AGG-22: each slice's share of its partition in %, 1 decimal. The per-partition total
    is a grouped aggregate joined back on the partition key (no unpartitioned window)."""
    if part:
        tot = slices.groupBy(*part).agg(F.sum("value").alias("_tot"))
        j = slices.join(tot, list(part))
        return j.withColumn("share_pct", round_half_up(F.lit(100.0) * F.col("value") / F.col("_tot"), 1)).drop("_tot")
    total = slices.select(F.sum("value")).scalar()
    return slices.withColumn("share_pct", round_half_up(F.lit(100.0) * F.col("value") / total, 1))


def chart_series(app_ts: DataFrame, by: str = "app", selected: Sequence[str] = ()) -> DataFrame:
    """SHP-2 / SCL-16: series rows for the by-user or by-app chart; the series name is
    ``"user - app"`` (kept next to its parts, never re-split)."""
    if by == "user":
        g = app_ts.groupBy("t", "username").agg(F.sum("value").alias("value"))
        return g.select("t", F.col("username").alias("series"), "username", F.lit(None).cast("string").alias("comm"), "value")
    s = app_ts if not selected else app_ts.filter(F.col("comm").isin(list(selected)))
    return s.select("t", F.concat_ws(" - ", "username", "comm").alias("series"), "username", "comm", "value")


def chart_matrix(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """SHP-1 / SET-3: one row per chart time (union of all series' times), one column per
    listed series, missing -> 0, rounded to 2. The series list is the chart's selection,
    passed explicitly, so the pivot needs no distinct-values pass and no pair expansion."""
    g = series.groupBy("t").pivot("series", list(names)).agg(F.sum("value"))
    return g.select("t", *[round_half_up(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)), 2).alias(n) for n in names])


def node_search(nodes: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    """FLT-2: status equals, name contains (case-insensitive) or ip contains."""
    out = nodes
    if status:
        out = out.filter(F.col("status") == status)
    if text:
        t = text.lower()
        out = out.filter(F.lower(F.col("name")).contains(t) | F.col("ip").contains(text))
    return out
