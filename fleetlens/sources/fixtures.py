"""Driver tables -> telemetry tables (FIXTURES.md section 3), as lazy DataFrames.

The driver ships TPC-H-like tables; these views give them telemetry meaning (orders are
reports, line items are processes, suppliers are nodes, customers are users, events are
heartbeats / notifications / audit rows / host samples). Event times are cast to
``TIMESTAMP`` (UTC session) on read, because watermarks reject ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.host_windows import window_start
from ..session import configure

# Fixed values of the fixture mapping.
EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC
GIB = 1073741824
N_REPORT_NODES = 6

# Collection window of the host samples in seconds. Events are half a minute apart at the largest
# scale, so windows of the collectors' five seconds would nearly all be empty.
HOST_WINDOW = 600

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def node_name(x: Column) -> Column:
    return F.concat(F.lit("node_"), x.cast("string"))


PROCESS_ARRAY = ("array<struct<pid:bigint,cpu_ontime_ns:bigint,uid:bigint,comm:string,read_bytes:bigint,"
                 "write_bytes:bigint,net_rx_bytes:bigint,net_tx_bytes:bigint,avg_rss_bytes:bigint,"
                 "process_name:string,gpu_used_memory_mib:bigint,metadata:map<string,string>,status:string>>")
GPU_ARRAY = ("array<struct<gpu_index:int,gpu_name:string,utilization_percent:double,temperature_celsius:double,"
             "power_watts:double,power_limit_watts:double,memory_used_mib:bigint,memory_total_mib:bigint>>")


class Fixtures:
    """Lazily built telemetry views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Parquet table, listed once per ``Fixtures``."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # ---------------------------------------------------------------- reports ----------
    @cached_property
    def reports_flat(self) -> DataFrame:
        """One row per report with flat system metrics (fx_reports)."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        ts = F.lit(EPOCH_2024) + (c % 24) * 3600 + (k % 60) * 60
        return o.select(
            k.alias("report_id"),
            F.when(k % 97 == 0, F.lit("")).otherwise(node_name(k % N_REPORT_NODES)).alias("node_id"),
            ts.cast("bigint").alias("timestamp"),
            F.timestamp_seconds(ts).alias("event_time"),
            F.lit(5.0).alias("collection_window_seconds"),
            (F.col("o_orderstatus") != "P").alias("has_system_metrics"),
            ((k % 1010).cast("double") / 10).alias("cpu_usage_percent"),
            (((k * 3) % 1005).cast("double") / 10).alias("memory_usage_percent"),
            ((k % 64) * GIB).cast("bigint").alias("memory_used_bytes"),
            F.lit(64 * GIB).cast("bigint").alias("memory_total_bytes"),
            (c % 3).cast("int").alias("gpu_count"),
        ).withColumn("gpus", self._gpu_array())

    @staticmethod
    def _gpu_array() -> Column:
        """The report's GPUs (fx_gpus rows) generated inside the report row: a report
        carries its GPU list, so nothing is exploded and joined back."""
        rid = F.col("report_id")
        idx = F.filter(F.array(F.lit(0), F.lit(1)), lambda g: g < F.col("gpu_count"))
        gpus = F.transform(idx, lambda g: F.struct(
            g.cast("int").alias("gpu_index"),
            ((rid * 7 + g * 31) % 103).cast("double").alias("utilization_percent"),
            (30 + (rid + g * 13) % 60).cast("double").alias("temperature_celsius"),
            (50 + (rid * 3 + g) % 300).cast("double").alias("power_watts"),
            ((rid + g) % 24576).cast("bigint").alias("memory_used_mib")))
        return F.when(F.col("has_system_metrics"), gpus).otherwise(F.array().cast(
            "array<struct<gpu_index:int,utilization_percent:double,temperature_celsius:double,"
            "power_watts:double,memory_used_mib:bigint>>"))

    @cached_property
    def processes_flat(self) -> DataFrame:
        """One row per process (fx_processes); ``(report_id, pos)`` is unique."""
        li = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
            "l_quantity", "l_discount")
        part = self.table("part").select("p_partkey", "p_type", "p_size")
        # An order's line items are a bounded group, so this window is skew-safe.
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        j = li.join(part, li.l_partkey == part.p_partkey).withColumn("pos", F.row_number().over(w).cast("bigint"))
        sk, pk = F.col("l_suppkey"), F.col("l_partkey")
        price = F.floor("l_extendedprice").cast("bigint")
        return j.select(
            F.col("l_orderkey").alias("report_id"),
            "pos",
            F.when(F.col("l_quantity") <= 1, F.lit(0).cast("bigint"))
             .otherwise((F.col("l_orderkey") % 10000) * 100 + F.col("pos")).alias("pid"),
            (F.col("l_quantity").cast("bigint") * 1000000000).alias("cpu_ontime_ns"),
            F.when(sk % 10 == 0, F.lit(0).cast("bigint"))
             .when(sk % 10 == 1, 100 + sk % 50)
             .otherwise(1000 + pk % 20).alias("uid"),
            F.when(F.col("l_discount") == 0, F.lit(""))
             .when(pk % 11 == 0, F.concat(F.lit("kworker/"), (F.col("p_size") % 4).cast("string")))
             .otherwise(F.concat(F.col("p_type"), F.lit("-"), (F.col("p_size") % 4).cast("string"))).alias("comm"),
            (price * 4096).alias("read_bytes"),
            (pk * 1024).alias("write_bytes"),
            (sk * 2048).alias("net_rx_bytes"),
            (F.col("l_linenumber").cast("bigint") * 512).alias("net_tx_bytes"),
            (price * 1024).alias("avg_rss_bytes"),
            ((pk % 8) * 256).alias("gpu_used_memory_mib"),
        )

    @cached_property
    def gpus_flat(self) -> DataFrame:
        """One row per GPU of a report that carries system metrics (fx_gpus). No join:
        the GPU list is generated inside the row."""
        r = self.reports_flat.filter("has_system_metrics")
        return r.select("report_id", "node_id", "event_time", F.explode("gpus").alias("g")).select(
            "report_id", "node_id", "event_time", "g.*")

    @cached_property
    def reports(self) -> DataFrame:
        """Nested metric reports (the wire shape), processes in ``pos`` order.

        Building them groups line items by order; real deployments receive reports
        already nested, so this shuffle exists only for the fixture.
        """
        p = self.processes_flat
        proc = F.struct(
            "pos", "pid", "cpu_ontime_ns", "uid", "comm", "read_bytes", "write_bytes",
            "net_rx_bytes", "net_tx_bytes", "avg_rss_bytes",
            F.lit("").alias("process_name"), "gpu_used_memory_mib")
        procs = p.groupBy("report_id").agg(F.sort_array(F.collect_list(proc)).alias("_p"))
        with_md = F.transform("_p", lambda x: x.dropFields("pos").withField(
            "metadata", F.create_map().cast("map<string,string>")).withField("status", F.lit("valid")))
        procs = procs.select("report_id", with_md.alias("processes"))
        gpus = F.transform("gpus", lambda g: F.struct(
            g["gpu_index"].alias("gpu_index"), F.lit(None).cast("string").alias("gpu_name"),
            g["utilization_percent"].alias("utilization_percent"), g["temperature_celsius"].alias("temperature_celsius"),
            g["power_watts"].alias("power_watts"), F.lit(None).cast("double").alias("power_limit_watts"),
            g["memory_used_mib"].alias("memory_used_mib"), F.lit(None).cast("bigint").alias("memory_total_mib")))
        r = self.reports_flat.join(procs, "report_id", "left").withColumn("gpus", gpus)
        sm = F.when(F.col("has_system_metrics"), F.struct(
            "cpu_usage_percent", "memory_usage_percent", "memory_used_bytes", "memory_total_bytes",
            F.coalesce("gpus", F.array().cast(GPU_ARRAY)).alias("gpus")))
        return r.select(
            "report_id", "node_id", "timestamp", "event_time", "collection_window_seconds",
            F.coalesce("processes", F.array().cast(PROCESS_ARRAY)).alias("processes"),
            sm.alias("system_metrics"),
            F.lit(None).cast("string").alias("collect_agent_id"),
            F.lit(None).cast("bigint").alias("received_timestamp"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )

    # ------------------------------------------------------------- dimensions ----------
    @cached_property
    def nodes(self) -> DataFrame:
        s = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        # nation is a fixed 25-row dimension: a proven size bound, so broadcast it.
        j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
        return j.select(
            node_name(F.col("s_suppkey")).alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."),
                     (F.col("s_suppkey") % 256).cast("string")).alias("ip"),
            F.col("n_name").alias("group_name"),
            F.concat(F.lit("agent_"), F.col("n_regionkey").cast("string")).alias("collect_agent"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            (1000 + F.col("c_custkey")).alias("uid"), F.col("c_name").alias("username"),
            F.col("c_mktsegment").alias("group_name"))

    @cached_property
    def _events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def heartbeats(self) -> DataFrame:
        e = self._events.filter(F.col("event_type").isin("view", "click"))
        return e.select(
            "event_id", node_name(F.col("user_id") % 12).alias("node_id"),
            F.col("ts").alias("event_time"),
            F.when(F.col("event_type") == "click", F.lit("stopping")).otherwise(F.lit("alive")).alias("status"))

    @cached_property
    def status_changes(self) -> DataFrame:
        """Status messages of the nodes: (node_id, change_time, seq, status)."""
        return self.heartbeats.select("node_id", F.col("event_time").alias("change_time"), F.col("event_id").alias("seq"),
                                      F.when(F.col("status") == "alive", F.lit("running")).otherwise(F.lit("stopped")).alias("status"))

    @cached_property
    def notifications(self) -> DataFrame:
        e = self._events.filter(F.col("event_type") == "error")
        v = F.col("value")
        return e.select(
            F.col("event_id").alias("id"),
            F.when(v >= 100, F.lit("critical")).when(v >= 40, F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
            node_name(F.col("user_id") % 12).alias("node_id"),
            (F.col("event_id") % 3 == 0).alias("acknowledged"),
            F.col("ts").alias("created_at"))

    @cached_property
    def audit_logs(self) -> DataFrame:
        e = self._events.filter(F.col("event_type") == "signup")
        m = F.col("event_id") % 3
        return e.select(
            F.col("event_id").alias("id"),
            F.when(m == 0, F.lit("UPDATE")).when(m == 1, F.lit("CREATE")).otherwise(F.lit("ROLLOUT")).alias("action"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"),
            F.col("ts").alias("created_at"))

    @cached_property
    def collection_settings(self) -> DataFrame:
        s = self.table("supplier").select("s_suppkey").filter(F.col("s_suppkey") % 2 == 0)
        k = F.col("s_suppkey")
        return s.select(
            node_name(k).alias("node_id"),
            (5 + (k % 3) * 5).cast("int").alias("interval_seconds"),
            (30 + (k % 4) * 30).cast("int").alias("window_seconds"),
            F.concat(F.lit("agent_"), (k % 5).cast("string")).alias("collect_agent"))

    @cached_property
    def config_kv(self) -> DataFrame:
        s = self.table("supplier").select("s_suppkey")
        k = F.col("s_suppkey")

        def key(field: str) -> Column:
            return F.concat(F.lit("/config/compute_node/node_"), k.cast("string"), F.lit("/" + field))

        window = s.filter(k % 3 != 0).select(key("window").alias("key"), (30 + (k % 5) * 30).cast("string").alias("value"))
        hb = s.filter(k % 4 != 0).select(
            key("heartbeat_interval").alias("key"),
            F.when(k % 7 == 0, F.lit("bad")).otherwise((5 + (k % 3) * 5).cast("string")).alias("value"))
        status = s.filter(k % 3 != 0).select(
            key("status").alias("key"),
            F.when(k % 2 == 0, F.lit("running")).otherwise(F.lit("stopped")).alias("value"))
        target = s.filter(k % 5 != 1).select(
            key("target_collect_agent").alias("key"),
            F.concat(F.lit("agent_"), F.when(k % 2 == 0, k % 5).otherwise((k + 1) % 5).cast("string")).alias("value"))
        r = F.col("r_regionkey")
        agent = F.concat(F.lit("/config/collect_agent/agent_"), r.cast("string"))
        agents = self.table("region").select(F.inline(F.array(
            F.struct(F.concat(agent, F.lit("/kafka_topic")).alias("key"), F.concat(F.lit("topic_"), r.cast("string")).alias("value")),
            F.struct(F.concat(agent, F.lit("/window")).alias("key"), (r * 30).cast("string").alias("value")))))
        return window.unionByName(hb).unionByName(status).unionByName(target).unionByName(agents)

    @cached_property
    def alert_rules(self) -> DataFrame:
        """Alert rules of an administrator, one per part (fx_alert_rules)."""
        k, size = F.col("p_partkey"), F.col("p_size")
        pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
        return self.table("part").select(
            F.concat(F.lit("rule_"), k.cast("string")).alias("id"), F.col("p_type").alias("name"), F.lit("all").alias("node_group"),
            pick(["cpu", "mem", "gpu", "disk", "net", "fan"], k).alias("resource"), pick([">", ">=", "<", "<="], size).alias("operator"),
            (size + k % 7).cast("double").alias("threshold"), F.lit("warning").alias("severity"), (k % 3 != 0).alias("enabled"))

    # ------------------------------------------------------------ host samples ---------
    @cached_property
    def host_events(self) -> DataFrame:
        """events as a counter / trace source: node = user_id % 6, cpu = user_id % 4,
        pid = event_id % 50, return value = floor(value) - 5."""
        e = self._events
        return e.select(
            "event_id", node_name(F.col("user_id") % 6).alias("node_id"),
            (F.col("user_id") % 4).cast("int").alias("cpu"),
            (F.col("event_id") % 50).alias("pid"),
            "ts", "event_type", "value", "user_id",
            (F.floor("value").cast("bigint") - 5).alias("ret"))

    # The host tables below give each events row one meaning per collector; the mapping
    # of event types to trace kinds is part of the fixture.
    @cached_property
    def switches(self) -> DataFrame:
        """sched_switch trace: (node_id, cpu, ts, seq, pid, uid, comm)."""
        h = self.host_events
        return h.select("node_id", "cpu", "ts", F.col("event_id").alias("seq"), "pid",
                        F.col("user_id").alias("uid"), F.col("event_type").alias("comm"))

    @cached_property
    def sched_events(self) -> DataFrame:
        """fork / exec / exit trace: (node_id, ts, seq, type, pid, ppid, comm)."""
        h = self.host_events
        t = F.col("event_type")
        typ = (F.when(t == "signup", F.lit("fork")).when(t == "purchase", F.lit("exec"))
                .when(t == "error", F.lit("exit")).otherwise(F.lit("switch")))
        return h.select("node_id", "ts", F.col("event_id").alias("seq"), typ.alias("type"), "pid",
                        (F.col("user_id") % 50).alias("ppid"),
                        F.concat(F.lit("proc_"), (F.col("user_id") % 7).cast("string")).alias("comm"))

    @cached_property
    def syscalls(self) -> DataFrame:
        """syscall exits: (node_id, ts, pid, name, ret)."""
        h = self.host_events
        t = F.col("event_type")
        name = (F.when(t == "view", F.lit("read")).when(t == "click", F.lit("write"))
                 .when(t == "purchase", F.lit("recvfrom")).when(t == "signup", F.lit("sendto"))
                 .otherwise(F.lit("pwrite64")))
        return h.select("node_id", "ts", "pid", name.alias("name"), "ret")

    @cached_property
    def rss_samples(self) -> DataFrame:
        h = self.host_events
        return h.select("node_id", "ts", "pid", (F.floor("value").cast("bigint") * 1024).alias("rss"))

    @cached_property
    def cpu_counters(self) -> DataFrame:
        h = self.host_events
        e = F.col("event_id")
        return h.select("node_id", "ts", e.alias("seq"), (e * 37 + F.floor("value").cast("bigint")).alias("idle"),
                        (e * 3).alias("iowait"), (e * 100 + 1000).alias("total"))

    @cached_property
    def mem_counters(self) -> DataFrame:
        h = self.host_events
        return h.select("node_id", "ts", F.col("event_id").alias("seq"),
                        ((F.col("user_id") % 7) * 1048576).alias("total"),
                        (F.floor("value").cast("bigint") * 4096).alias("available"))

    @cached_property
    def gpu_csv_lines(self) -> DataFrame:
        """GPU query CSV text: one line per fixture GPU, plus the events' JSON props as
        lines that are not CSV (they must be dropped by the parser)."""
        g = self.gpus_flat
        line = F.concat_ws(", ", F.col("gpu_index").cast("string"),
                           F.concat(F.lit("GPU-"), (F.col("report_id") % 4).cast("string")),
                           F.col("utilization_percent").cast("bigint").cast("string"),
                           F.col("temperature_celsius").cast("bigint").cast("string"),
                           F.col("power_watts").cast("bigint").cast("string"), F.lit("N/A"),
                           F.col("memory_used_mib").cast("string"), F.lit("24576"))
        good = g.select("report_id", line.alias("line"))
        junk = self._events.select(F.col("event_id").alias("report_id"), F.col("props").alias("line"))
        return good.unionByName(junk)

    @cached_property
    def gpu_proc_lines(self) -> DataFrame:
        """GPU compute-app CSV files, one per node and window: (node_id, window_start, line_no, line).
        Line 0 is the header, in four variants by node and window; their columns differ in name
        and order, and body lines follow their file's order."""
        h = self.host_events.withColumn("window_start", window_start(F.col("ts"), HOST_WINDOW))
        files = h.select("node_id", "window_start").distinct()
        v = ((F.substring("node_id", 6, 10).cast("int") + F.expr("unix_micros(window_start)") / (HOST_WINDOW * 1_000_000)).cast("bigint") % 4).cast("int")
        header = (F.when(v == 0, F.lit("pid, process_name, used_gpu_memory [MiB]")).when(v == 1, F.lit("pid, process_name, used_memory"))
                   .when(v == 2, F.lit("used_memory [MiB], pid, process_name")).otherwise(F.lit("pid, name, memory")))
        hdr = files.select("node_id", "window_start", F.lit(0).cast("bigint").alias("line_no"), header.alias("line"))
        pid, mem = F.col("pid").cast("string"), F.concat(F.floor("value").cast("bigint").cast("string"), F.lit(" MiB"))
        line = F.when(v == 2, F.concat_ws(", ", mem, pid, "event_type")).otherwise(F.concat_ws(", ", pid, "event_type", mem))
        body = h.select("node_id", "window_start", (F.col("event_id") + 1).alias("line_no"), line.alias("line"))
        return hdr.unionByName(body)

    @cached_property
    def exited_processes(self) -> DataFrame:
        """Per-pid totals of processes that exited inside the window (exit events)."""
        e = self.host_events.filter(F.col("event_type") == "error")
        return e.groupBy("node_id", "pid").agg(
            (F.sum(F.floor(F.col("value") * 1000).cast("bigint")) * 1000).alias("cpu_ontime_ns"),
            F.max_by(F.struct(F.col("user_id").alias("uid"), F.col("event_type").alias("comm")),
                     F.struct("ts", "event_id")).alias("_i")
        ).select("node_id", "pid", "cpu_ontime_ns", "_i.uid", "_i.comm")
