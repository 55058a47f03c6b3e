"""Host-sample operators: the collectors' arithmetic over sample / trace
tables, as Spark jobs (WIN-3, WIN-4, SCL-8, SCL-19, SCL-20, JON-9, SET-2, HST-1..8).

Per-pid results are grouped aggregates keyed by (node, pid); ordered computations use
``bucketed_lag`` so a busy node or CPU is split by time bucket before the window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import memory_percent, round_half_up
from .windows import bucketed_lag

# Syscall names counted as disk and network traffic.
DISK_READ = ["read", "pread64"]
DISK_WRITE = ["write", "pwrite64"]
NET_RX = ["recvfrom", "recvmsg"]
NET_TX = ["sendto", "sendmsg"]

# GPU process CSV header names for the memory column, in lookup order.
GPU_MEM_HEADERS = ["used_memory", "used_gpu_memory [MiB]", "used_gpu_memory", "used_memory [MiB]"]


def _micros(c: Column) -> Column:
    return F.unix_micros(c)


def cpu_runs(switches: DataFrame, attribution: str = "lag", bucket_unit: str = "hour") -> DataFrame:
    """Runs on a CPU: ``(node_id, cpu, pid, uid, comm, seq, start_us, end_us)`` between consecutive
    switches of one CPU, credited as in ``oncpu_from_switches``; pid 0 is dropped. seq is that of the
    credited switch."""
    s = bucketed_lag(switches, ["node_id", "cpu"], ["ts", "seq"], ["ts", "pid", "uid", "comm", "seq"], F.date_trunc(bucket_unit, "ts"))
    who = "prev_" if attribution == "lag" else ""
    runs = s.filter(F.col("prev_ts").isNotNull()).select(
        "node_id", "cpu", *[F.col(who + c).alias(c) for c in ("pid", "uid", "comm", "seq")],
        _micros(F.col("prev_ts")).alias("start_us"), _micros(F.col("ts")).alias("end_us"))
    return runs.filter(F.col("pid") != 0)


def oncpu_from_switches(switches: DataFrame, attribution: str = "lag", bucket_unit: str = "hour") -> DataFrame:
    """WIN-4 / HST-1: on-CPU time per (node, pid) from context-switch events
    ``(node_id, cpu, ts, seq, pid, uid, comm)``.

    The time between consecutive switches on one CPU is credited to the pid recorded at
    the previous switch (``attribution="lag"``, D-21) or to the event's own pid
    (``"outgoing"``); the first switch of a CPU credits nothing; pid 0 is dropped. uid and
    comm are the newest seen for the pid."""
    s = bucketed_lag(switches, ["node_id", "cpu"], ["ts", "seq"], ["ts", "pid"],
                     F.date_trunc(bucket_unit, "ts"))
    delta_ns = (_micros(F.col("ts")) - _micros(F.col("prev_ts"))) * 1000
    who = F.col("prev_pid") if attribution == "lag" else F.col("pid")
    credit = s.filter(F.col("prev_ts").isNotNull()).select("node_id", who.alias("pid"), delta_ns.alias("d"))
    sums = credit.filter(F.col("pid") != 0).groupBy("node_id", "pid").agg(F.sum("d").cast("bigint").alias("cpu_ontime_ns"))
    info = switches.groupBy("node_id", "pid").agg(F.max_by(F.struct("uid", "comm"), F.struct("ts", "seq")).alias("_i"))
    out = sums.join(info, ["node_id", "pid"], "left")
    return out.select("node_id", "pid", "cpu_ontime_ns", F.col("_i.uid").alias("uid"), F.col("_i.comm").alias("comm"))


def process_lifecycle(events: DataFrame) -> DataFrame:
    """HST-2: per (node, pid) the state after its last fork, which starts the pid anew:
    parent and comm from that fork, comm replaced by each exec until the first exit after
    it, exited if there is such an exit. Exec and exit without a live fork change nothing.
    Input ``(node_id, ts, seq, type, pid, ppid, comm)``."""
    k = ["node_id", "pid"]
    at = F.struct("ts", "seq")
    fork = events.filter(F.col("type") == "fork").groupBy(*k).agg(F.max(F.struct("ts", "seq", "ppid", "comm")).alias("f"))
    later = events.filter(F.col("type").isin("exec", "exit")).join(fork, k)
    later = later.filter(at > F.struct("f.ts", "f.seq")).select(*k, "type", "ts", "seq", "comm")
    end = later.filter(F.col("type") == "exit").groupBy(*k).agg(F.min(at).alias("e"))
    execs = later.filter(F.col("type") == "exec").join(end, k, "left").filter(F.col("e").isNull() | (at < F.col("e")))
    comm = execs.groupBy(*k).agg(F.max(F.struct("ts", "seq", "comm")).alias("x"))
    return fork.join(end, k, "left").join(comm, k, "left").select(
        *k, F.col("f.ppid").alias("ppid"), F.coalesce("x.comm", "f.comm").alias("comm"), F.col("e").isNotNull().alias("exited"))


def _syscall_bytes(syscalls: DataFrame, a: list[str], b: list[str], na: str, nb: str) -> DataFrame:
    s = syscalls.filter((F.col("ret") > 0) & (F.col("pid") != 0))
    return s.groupBy("node_id", "pid").agg(
        F.sum(F.when(F.col("name").isin(a), F.col("ret")).otherwise(F.lit(0))).cast("bigint").alias(na),
        F.sum(F.when(F.col("name").isin(b), F.col("ret")).otherwise(F.lit(0))).cast("bigint").alias(nb)
    ).filter((F.col(na) > 0) | (F.col(nb) > 0))


def disk_bytes(syscalls: DataFrame) -> DataFrame:
    """HST-3: positive return values of read/pread vs write/pwrite per (node, pid)."""
    return _syscall_bytes(syscalls, DISK_READ, DISK_WRITE, "read_bytes", "write_bytes")


def net_bytes(syscalls: DataFrame) -> DataFrame:
    """HST-4: positive return values of recvfrom/recvmsg vs sendto/sendmsg per (node, pid)."""
    return _syscall_bytes(syscalls, NET_RX, NET_TX, "net_rx_bytes", "net_tx_bytes")


def avg_rss(samples: DataFrame) -> DataFrame:
    """HST-5: mean RSS per (node, pid) over the window: floor(sum / count); all-zero pids
    dropped."""
    g = samples.groupBy("node_id", "pid").agg(F.sum("rss").alias("_s"), F.count("rss").alias("_n"))
    return g.filter(F.col("_s") > 0).select("node_id", "pid", F.expr("_s div _n").cast("bigint").alias("avg_rss_bytes"))


def cpu_percent_from_counters(counters: DataFrame, bucket_unit: str = "hour") -> DataFrame:
    """WIN-3 / HST-6: CPU% from cumulative counters ``(node_id, ts, seq, idle, iowait,
    total)``: first sample 0, else round(100 * (1 - d_idle / d_total), 2) with idle =
    idle + iowait; d_total = 0 -> 0."""
    c = counters.withColumn("_idle", F.col("idle") + F.col("iowait"))
    s = bucketed_lag(c, ["node_id"], ["ts", "seq"], ["_idle", "total"], F.date_trunc(bucket_unit, "ts"))
    d_idle = F.col("_idle") - F.col("prev__idle")
    d_total = F.col("total") - F.col("prev_total")
    pct = (F.when(F.col("prev_total").isNull(), F.lit(0.0))
            .when(d_total == 0, F.lit(0.0))
            .otherwise(round_half_up(F.lit(100.0) * (F.lit(1.0) - d_idle / d_total), 2)))
    return s.select("node_id", "ts", "seq", pct.alias("cpu_usage_percent"))


def memory_usage(counters: DataFrame) -> DataFrame:
    """SCL-8 / HST-6: used bytes and percent from ``(total, available)`` counters."""
    t, a = F.col("total"), F.col("available")
    return counters.select("node_id", "ts", "seq", (t - a).alias("memory_used_bytes"),
                           memory_percent(t, a).alias("memory_usage_percent"))


def _pfloat(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0))


def _pint(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def gpu_csv_parse(lines: DataFrame, col: str = "line") -> DataFrame:
    """SCL-19: GPU query CSV lines -> typed rows; fewer than 8 fields or a non-integer
    index -> dropped; unparsable numbers (N/A, [Not Supported]) -> 0."""
    p = lines.select("*", F.split(F.col(col), ",").alias("_p"))
    p = p.filter(F.size("_p") >= 8)
    idx = F.trim(F.col("_p")[0]).try_cast("int")
    p = p.withColumn("_idx", idx).filter(F.col("_idx").isNotNull())
    keep = [c for c in lines.columns if c != col]
    return p.select(*keep, F.col("_idx").alias("gpu_index"), F.trim(F.col("_p")[1]).alias("gpu_name"),
                    _pfloat(F.col("_p")[2]).alias("utilization_percent"), _pfloat(F.col("_p")[3]).alias("temperature_celsius"),
                    _pfloat(F.col("_p")[4]).alias("power_watts"), _pfloat(F.col("_p")[5]).alias("power_limit_watts"),
                    _pint(F.col("_p")[6]).alias("memory_used_mib"), _pint(F.col("_p")[7]).alias("memory_total_mib"))


def gpu_proc_csv_parse(lines: DataFrame, file_keys: Sequence[str] = ("node_id", "window_start")) -> DataFrame:
    """SCL-20: GPU compute-app CSV files, ``(*file_keys, line_no, line)`` with a header on line 0 of
    every file (one file per node and collection window). Column positions come from the file's
    own header (aliases for the memory column; fall back to 0/1/2 when a name is missing); 'MiB'
    is stripped; bad pid or memory -> dropped. Headers are reduced to one row per file (the first
    in text order, should a file repeat it) and joined back on the file key; lines of a file
    without header are dropped."""
    k = list(file_keys)
    hdr = lines.filter(F.col("line_no") == 0).groupBy(*k).agg(F.min("line").alias("line"))
    hdr = hdr.select(*k, F.transform(F.split("line", ","), lambda h: F.trim(h)).alias("_h"))

    def pos(names: list[str]) -> Column:
        return F.coalesce(*[F.when(F.array_position("_h", n) > 0, F.array_position("_h", n) - 1) for n in names],
                          F.lit(-1))

    idx = hdr.select(*k, pos(["pid"]).alias("pi"), pos(["process_name"]).alias("ni"), pos(GPU_MEM_HEADERS).alias("mi"))
    bad = (F.col("pi") < 0) | (F.col("ni") < 0) | (F.col("mi") < 0)
    idx = idx.select(*k, F.when(bad, 0).otherwise(F.col("pi")).cast("int").alias("pi"),
                     F.when(bad, 1).otherwise(F.col("ni")).cast("int").alias("ni"),
                     F.when(bad, 2).otherwise(F.col("mi")).cast("int").alias("mi"))
    body = lines.filter(F.col("line_no") > 0).select(*k, "line_no", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("_p"))
    j = body.join(idx, k)
    j = j.filter(F.size("_p") > F.greatest("pi", "ni", "mi"))
    pid = F.element_at("_p", F.col("pi") + 1).try_cast("bigint")
    mem_txt = F.trim(F.regexp_replace(F.regexp_replace(F.element_at("_p", F.col("mi") + 1), "MiB", ""), "Mib", ""))
    mem = mem_txt.try_cast("double").try_cast("bigint")
    out = j.select(*k, "line_no", pid.alias("pid"), F.element_at("_p", F.col("ni") + 1).alias("process_name"),
                   mem.alias("used_memory_mib"))
    return out.filter(F.col("pid").isNotNull() & F.col("used_memory_mib").isNotNull())


def merge_process_samples(cpu: DataFrame, disk: DataFrame, net: DataFrame, ram: DataFrame, gpu: DataFrame,
                          lifecycle: DataFrame) -> DataFrame:
    """JON-9 / HST-8: per (node, pid) merge; the CPU table drives, missing values -> 0 /
    '' / not exited. ``gpu`` gives the process name next to its memory, ``lifecycle`` the
    parent and the exit. All inputs are aggregated by (node, pid), so the left joins share
    one hash partitioning."""
    k = ["node_id", "pid"]
    j = (cpu.join(disk, k, "left").join(net, k, "left").join(ram, k, "left")
            .join(gpu.select(*k, "process_name", F.col("used_memory_mib").alias("gpu_used_memory_mib")), k, "left")
            .join(lifecycle.select(*k, "ppid", "exited"), k, "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.select(*k, z("cpu_ontime_ns").alias("cpu_ontime_ns"), F.coalesce("uid", F.lit(-1)).cast("bigint").alias("uid"),
                    F.coalesce("comm", F.lit("")).alias("comm"), z("read_bytes").alias("read_bytes"),
                    z("write_bytes").alias("write_bytes"), z("net_rx_bytes").alias("net_rx_bytes"),
                    z("net_tx_bytes").alias("net_tx_bytes"), z("avg_rss_bytes").alias("avg_rss_bytes"),
                    z("gpu_used_memory_mib").alias("gpu_used_memory_mib"), z("ppid").alias("ppid"),
                    F.coalesce("process_name", F.lit("")).alias("process_name"), F.coalesce("exited", F.lit(False)).alias("exited"))


def active_exited_union(active: DataFrame, exited: DataFrame) -> DataFrame:
    """SET-2: union of active and exited per-pid rows; cpu summed on a shared pid;
    ``exited`` only when the pid is not active; uid / comm from the active row first."""
    a = active.select("node_id", "pid", "cpu_ontime_ns", "uid", "comm", F.lit(False).alias("exited"))
    e = exited.select("node_id", "pid", "cpu_ontime_ns", "uid", "comm", F.lit(True).alias("exited"))
    u = a.unionByName(e)
    g = u.groupBy("node_id", "pid").agg(F.sum("cpu_ontime_ns").cast("bigint").alias("cpu_ontime_ns"),
                                         F.min_by(F.struct("uid", "comm"), F.col("exited")).alias("_i"),
                                         F.bool_and("exited").alias("exited"))
    return g.select("node_id", "pid", "cpu_ontime_ns", F.col("_i.uid").alias("uid"), F.col("_i.comm").alias("comm"), "exited")
