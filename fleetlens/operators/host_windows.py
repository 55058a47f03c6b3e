"""Host samples by collection window and by life of a pid.

A collector resets its counters every window and sends one report per node and window, so its
figures are keyed ``(node, window, pid)``. Sample rows carry an instant; a window is the half-open
span ``[k * w, (k + 1) * w)`` counted from the epoch, named by its start.

A pid names several processes over time. A life runs from a fork to the first exit after it (or to
the next fork of the pid, when no exit was seen); samples belong to the life they fall in.

Intervals are split at window borders by exploding a sequence of window numbers: the rows made are
the intervals plus the borders they cross, which is at most one row per interval and one per CPU and
window, and never more than the result needs. Ordered look-ups go through ``windows.bucketed_last``,
which sorts one (key, time bucket) at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .host import DISK_READ, DISK_WRITE, NET_RX, NET_TX, cpu_runs
from .windows import asof, bucketed_last

# Reporting interval of the collectors, in seconds.
WINDOW_SECONDS = 5

IO_COLUMNS = ("read_bytes", "write_bytes", "net_rx_bytes", "net_tx_bytes")


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the window an instant falls in."""
    width = seconds * 1_000_000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(width)))


def oncpu_by_window(switches: DataFrame, seconds: int = WINDOW_SECONDS, attribution: str = "lag",
                    bucket_unit: str = "hour") -> DataFrame:
    """WIN-4 / HST-1 per window: ``(node_id, window_start, pid, cpu_ontime_ns, uid, comm)``.

    A run on a CPU adds to every window it touches, with the part that lies in it, so sums over
    windows are the totals of ``oncpu_from_switches`` and no CPU gives a window more than its
    length. uid and comm are those of the window's latest run. pid 0 is dropped before runs are
    split."""
    width = seconds * 1_000_000
    runs = cpu_runs(switches, attribution, bucket_unit).where("end_us > start_us")
    number = F.sequence(F.floor(F.col("start_us") / width), F.floor((F.col("end_us") - 1) / width))
    split = runs.withColumn("_w", F.explode(number))
    inside = F.least("end_us", (F.col("_w") + 1) * width) - F.greatest("start_us", F.col("_w") * width)
    newest = F.max_by(F.struct("uid", "comm"), F.struct("start_us", "seq"))
    g = split.groupBy("node_id", "_w", "pid").agg(F.sum(inside * 1000).cast("bigint").alias("cpu_ontime_ns"), newest.alias("_i"))
    return g.select("node_id", F.timestamp_micros(F.col("_w") * width).alias("window_start"), "pid", "cpu_ontime_ns",
                    F.col("_i.uid").alias("uid"), F.col("_i.comm").alias("comm"))


def _io_sums() -> list[Column]:
    names = (DISK_READ, DISK_WRITE, NET_RX, NET_TX)
    return [F.sum(F.when(F.col("name").isin(n), F.col("ret")).otherwise(F.lit(0))).cast("bigint").alias(c) for c, n in zip(IO_COLUMNS, names)]


def io_by_window(syscalls: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """HST-3 / HST-4 per window: disk and network bytes from positive syscall returns, one pass."""
    s = syscalls.where((F.col("ret") > 0) & (F.col("pid") != 0))
    return s.groupBy("node_id", window_start(F.col("ts"), seconds).alias("window_start"), "pid").agg(*_io_sums())


def rss_by_window(samples: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """HST-5 per window: floor(sum / count) of the RSS samples; all-zero pids dropped."""
    g = samples.groupBy("node_id", window_start(F.col("ts"), seconds).alias("window_start"), "pid").agg(
        F.sum("rss").alias("_s"), F.count("rss").alias("_n"))
    return g.where("_s > 0").select("node_id", "window_start", "pid", F.expr("_s div _n").cast("bigint").alias("avg_rss_bytes"))


def gpu_by_window(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """HST-7 per window: GPU memory and process name of a pid from the window's compute-app file
    (the last line of a pid counts)."""
    return parsed.groupBy("node_id", "window_start", "pid").agg(
        F.max_by(F.struct("used_memory_mib", "process_name"), order).alias("_g")).select(
        "node_id", "window_start", "pid", F.col("_g.used_memory_mib").alias("gpu_used_memory_mib"), "_g.process_name")


def process_lives(events: DataFrame, bucket_unit: str = "day") -> DataFrame:
    """HST-2 / SET-2: one row per life of a pid: ``(node_id, pid, life_start, life_seq, ppid, comm,
    life_end, exited)`` from ``(node_id, ts, seq, type, pid, ppid, comm)``.

    A life starts at a fork, with that fork's parent and comm; execs before its end replace comm;
    it ends at the first exit after the fork (exited) or, without one, at the pid's next fork; the
    last life of a pid that is still there has no end. Exec and exit outside a life change nothing."""
    k = ["node_id", "pid"]
    fork, exit_ = F.col("type") == "fork", F.col("type") == "exit"
    e = events.where(F.col("type").isin("fork", "exec", "exit")).withColumn("at", F.struct("ts", "seq"))
    e = bucketed_last(e, k, ["ts", "seq"], {"_fork": F.when(fork, F.struct("ts", "seq", "ppid", "comm")), "_gone": F.when(exit_, F.col("at"))},
                      F.date_trunc(bucket_unit, "ts"))
    # what lives at an exec or exit is the last fork before it, unless an exit came in between
    born = F.struct("_fork.ts", "_fork.seq")
    alive = F.col("_fork").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") < born))
    own = F.struct("ts", "seq", "ppid", "comm")
    e = e.where(fork | alive).select(
        *k, "type", "at", "comm", F.when(fork, own).otherwise(F.col("_fork")).alias("life"),
        # a fork closes the life before it
        F.when(fork & alive, F.col("_fork")).alias("closed"))
    lives = e.groupBy(*k, "life").agg(
        F.min(F.when(exit_, F.col("at"))).alias("_end"),
        F.max(F.when(F.col("type") == "exec", F.struct("at", "comm"))).alias("_exec"))
    replaced = e.where("closed IS NOT NULL").select(*k, F.col("closed").alias("life"), F.col("at.ts").alias("_next"))
    out = lives.join(replaced, [*k, "life"], "left")
    return out.select(*k, F.col("life.ts").alias("life_start"), F.col("life.seq").alias("life_seq"), F.col("life.ppid").alias("ppid"),
                      F.coalesce("_exec.comm", "life.comm").alias("comm"), F.coalesce("_end.ts", "_next").alias("life_end"),
                      F.col("_end").isNotNull().alias("exited"))


def last_life(rows: DataFrame, lives: DataFrame, ts: Column, bucket_unit: str = "day") -> DataFrame:
    """As-of join: ``rows`` (with node_id and pid) and the ``life`` (life_start, life_seq, life_end,
    ppid, exited) of the pid that was born last at or before ``ts``; null before its first fork.
    At one instant forks come before rows."""
    return asof(rows, lives, ["node_id", "pid"], ts, F.col("life_start"), "life_seq",
                ["life_start", "life_seq", "life_end", "ppid", "exited"], "life", bucket_unit)


def in_lives(samples: DataFrame, lives: DataFrame, bucket_unit: str = "day") -> DataFrame:
    """``samples`` (node_id, pid, ts) with the life each falls in; null for samples before the pid's
    first fork or after the end of its last life. A sample at the instant of a fork belongs to the
    new life, one at the instant of an exit to the life that ends."""
    found = last_life(samples, lives, F.col("ts"), bucket_unit)
    over = F.col("ts") > F.col("life.life_end")
    return found.withColumn("life", F.when(~F.coalesce(over, F.lit(False)), F.col("life")))


def usage_by_life(switches: DataFrame, syscalls: DataFrame, rss: DataFrame, events: DataFrame, bucket_unit: str = "day") -> DataFrame:
    """HST-1..5 per life: CPU time, syscall bytes and mean RSS of every life of a pid.

    A run on a CPU counts for the life at its start. What falls in no life is the row with a null
    ``life_start``, so sums over a pid's rows are its totals. Lives without samples have zeros."""
    k = ["node_id", "pid"]
    zero = F.lit(None).cast("bigint")
    name, ret = F.lit(None).cast("string").alias("name"), zero.alias("ret")
    runs = cpu_runs(switches, "lag").select(*k, F.timestamp_micros("start_us").alias("ts"), ((F.col("end_us") - F.col("start_us")) * 1000).alias("cpu"),
                                            name, ret, zero.alias("rss"))
    calls = syscalls.where((F.col("ret") > 0) & (F.col("pid") != 0)).select(*k, "ts", zero.alias("cpu"), "name", "ret", zero.alias("rss"))
    sizes = rss.where("pid != 0").select(*k, "ts", zero.alias("cpu"), name, ret, "rss")
    lives = process_lives(events.where("pid != 0"), bucket_unit)
    placed = in_lives(runs.unionByName(calls).unionByName(sizes), lives, bucket_unit)
    info = F.struct("ppid", "comm", "life_end", "exited")
    kind = lives.select(info.alias("i")).schema["i"].dataType
    placed = placed.select(*k, F.col("life.life_start").alias("life_start"), F.col("life.life_seq").alias("life_seq"), "cpu", "name", "ret", "rss",
                           F.lit(None).cast(kind).alias("_info"))
    # lives are stacked with the samples, so a life without samples has its row too
    own = lives.select(*k, "life_start", "life_seq", zero.alias("cpu"), name, ret, zero.alias("rss"), info.alias("_info"))
    g = placed.unionByName(own).groupBy(*k, "life_start", "life_seq").agg(
        F.max("_info").alias("_info"), F.coalesce(F.sum("cpu"), F.lit(0)).cast("bigint").alias("cpu_ontime_ns"), *_io_sums(),
        F.expr("coalesce(sum(rss) div count(rss), 0)").cast("bigint").alias("avg_rss_bytes"))
    return g.select(*k, "life_start", "life_seq", "_info.ppid", "_info.comm", "_info.life_end", F.coalesce("_info.exited", F.lit(False)).alias("exited"),
                    "cpu_ontime_ns", *IO_COLUMNS, "avg_rss_bytes")


def merge_window_samples(cpu: DataFrame, io: DataFrame, rss: DataFrame, gpu: DataFrame, lives: DataFrame,
                         seconds: int = WINDOW_SECONDS, bucket_unit: str = "day") -> DataFrame:
    """JON-9 / HST-8: the processes of one report: per (node, window, pid) the merge of CPU, syscall,
    RSS and GPU figures. CPU drives, missing values are 0 / '' / not exited.

    ppid is that of the pid's last life born before the window's end; exited holds when that life
    ended with an exit inside the window. The four inputs are unique by the key, so the joins share
    one partitioning."""
    k = ["node_id", "window_start", "pid"]
    last = F.timestamp_micros(F.unix_micros("window_start") + (seconds * 1_000_000 - 1))
    j = cpu.join(io, k, "left").join(rss, k, "left").join(gpu, k, "left")
    j = last_life(j, lives, last, bucket_unit)
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c.split(".")[-1])
    exited = F.col("life.exited") & F.col("life.life_end").between(F.col("window_start"), last)
    return j.select(
        *k, z("cpu_ontime_ns"), F.coalesce("uid", F.lit(-1)).cast("bigint").alias("uid"), F.coalesce("comm", F.lit("")).alias("comm"),
        *map(z, (*IO_COLUMNS, "avg_rss_bytes", "gpu_used_memory_mib", "life.ppid")),
        F.coalesce("process_name", F.lit("")).alias("process_name"), F.coalesce(exited, F.lit(False)).alias("exited"))


def window_reports(merged: DataFrame, cpu_percent: DataFrame, memory: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """HST-8: one report row per (node, window): how many processes it carries, their totals, and the
    node's CPU and memory figures (mean of the window's samples; null without one). A window without
    a process sends no report, as the validator drops reports without processes."""
    k = ["node_id", "window_start"]
    totals = merged.groupBy(*k).agg(
        F.count("*").alias("n_processes"), F.sum("cpu_ontime_ns").cast("bigint").alias("cpu_ontime_ns"),
        *[F.sum(c).cast("bigint").alias(c) for c in IO_COLUMNS], F.count_if("exited").alias("n_exited"))
    w = window_start(F.col("ts"), seconds).alias("window_start")
    # percentages have two decimals: their decimal sum doesn't depend on the order
    mean = F.sum(F.col("cpu_usage_percent").cast("decimal(18,2)")).cast("double") / F.count("cpu_usage_percent")
    cpu = cpu_percent.groupBy("node_id", w).agg(mean.alias("cpu_usage_percent"))
    mem = memory.groupBy("node_id", w).agg(F.max("memory_used_bytes").alias("memory_used_bytes"))
    return totals.join(cpu, k, "left").join(mem, k, "left")
