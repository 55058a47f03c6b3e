"""Collector-side stages on nested reports.

Each stage is ``DataFrame -> DataFrame`` over report rows (``node_id, timestamp,
processes: array<struct>, system_metrics: struct, ...``). All per-report work runs inside
the row with higher-order array functions, so the stages add no shuffle and keep no
streaming state; a report is a bounded unit (one node, one collection window).

Counters travel as columns: ``_invalid`` (processes rejected), ``_filtered`` (rows removed
by sampling/filters) and ``_alerts``; ``_reject_reason`` marks reports a stage dropped.
``annotate_*`` functions keep every report; the plain names drop the rejected ones.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_prefix, hash_fraction, longest_prefix
from ..schemas import PROCESS_FIELDS

PROCESS_FIELD_NAMES = [n for n, _ in PROCESS_FIELDS]
NUMERIC_PROCESS_FIELDS = [n for n, t in PROCESS_FIELDS if n not in ("comm", "process_name")]
SUMMED_FIELDS = ["cpu_ontime_ns", "read_bytes", "write_bytes", "net_rx_bytes", "net_tx_bytes",
                 "avg_rss_bytes", "gpu_used_memory_mib"]


def _ensure_counters(df: DataFrame) -> DataFrame:
    add = {}
    for c in ("_invalid", "_filtered", "_alerts"):
        if c not in df.columns:
            add[c] = F.lit(0).cast("bigint")
    if "_reject_reason" not in df.columns:
        add["_reject_reason"] = F.lit(None).cast("string")
    return df.withColumns(add) if add else df


# ------------------------------------------------------------------ validation -------
def process_ok(get: Callable[[str], Column]) -> Column:
    """VAL-3: pid > 0, cpu_ontime_ns >= 0, non-empty comm. ``get`` reads a field, so the
    same predicate serves nested lambdas (``lambda n: p[n]``) and flat rows (``F.col``)."""
    return (F.coalesce(get("pid") > 0, F.lit(False))
            & F.coalesce(get("cpu_ontime_ns") >= 0, F.lit(False))
            & (F.coalesce(F.length(get("comm")), F.lit(0)) > 0))


def header_ok(node_id: Column, timestamp: Column) -> Column:
    """VAL-1: non-empty node id and an integer timestamp."""
    return F.coalesce((node_id != "") & timestamp.isNotNull(), F.lit(False))


def system_metrics_ok(sm: Column) -> Column:
    """VAL-2: cpu% and mem% in [0, 100], bytes >= 0, every GPU in range."""
    def between(x, lo, hi):
        return (x >= lo) & (x <= hi)
    gpu_ok = F.forall(F.coalesce(sm["gpus"], F.array()), lambda g: F.coalesce(
        between(g["utilization_percent"], 0, 100)
        & between(g["temperature_celsius"], -50, 200)
        & (g["power_watts"] >= 0), F.lit(False)))
    return F.coalesce(
        between(sm["cpu_usage_percent"], 0, 100)
        & between(sm["memory_usage_percent"], 0, 100)
        & (sm["memory_used_bytes"] >= 0) & (sm["memory_total_bytes"] >= 0)
        & gpu_ok, F.lit(False))


def annotate_validation(reports: DataFrame) -> DataFrame:
    """Run the schema validator on every report, keeping rejected reports marked."""
    r = _ensure_counters(reports)
    n_in = F.coalesce(F.size("processes"), F.lit(0))
    kept = F.filter(F.coalesce("processes", F.array()), lambda p: process_ok(lambda n: p[n]))
    hdr = header_ok(F.col("node_id"), F.col("timestamp"))
    # Each array check runs once per report: the kept list and the system-metrics verdict
    # are materialised as columns and then only referenced.
    r = r.withColumns({
        "_hdr_ok": hdr,
        "_kept": kept,
        "_sm_ok": F.col("system_metrics").isNotNull() & system_metrics_ok(F.col("system_metrics")),
    })
    n_kept = F.size("_kept")
    reason = (F.when(F.col("_reject_reason").isNotNull(), F.col("_reject_reason"))
               .when(~F.col("_hdr_ok"), F.lit("invalid_header"))
               .when(n_kept == 0, F.lit("no_valid_processes")))
    return r.withColumns({
        "_invalid": F.col("_invalid") + F.when(F.col("_hdr_ok"), n_in - n_kept).otherwise(n_in),
        "_reject_reason": reason,
        "processes": F.when(F.col("_hdr_ok"), F.col("_kept")).otherwise(F.col("processes")),
        "system_metrics": F.when(F.col("_sm_ok"), F.col("system_metrics")),
        "_sm_invalid": F.col("system_metrics").isNotNull() & ~F.col("_sm_ok"),
    }).drop("_hdr_ok", "_kept", "_sm_ok")


def validate(reports: DataFrame) -> DataFrame:
    return annotate_validation(reports).filter(F.col("_reject_reason").isNull())


def rejects(annotated: DataFrame) -> DataFrame:
    """Side output: reports a stage dropped, with the reason (STR-2)."""
    return annotated.filter(F.col("_reject_reason").isNotNull())


# ------------------------------------------------------------ field projection -------
def normalize_fields(names: Sequence[str] | None) -> list[str] | None:
    """Allow-listed field names in given order; unknown ignored; nothing left -> None."""
    if not names:
        return None
    out = [n for n in names if n in PROCESS_FIELD_NAMES]
    return out or None


def project_fields(reports: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """PRJ-1: keep listed process fields, zero / '' the others, record the kept list in
    report metadata. No valid names -> no-op (and the metadata key is removed)."""
    keep = normalize_fields(fields)
    md = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    if keep is None:
        return reports.withColumn("metadata", F.map_filter(md, lambda k, v: k != "exported_process_fields"))

    def proj(p):
        cols = []
        for n, _ in PROCESS_FIELDS:
            if n in keep:
                cols.append(p[n].alias(n))
            elif n in ("comm", "process_name"):
                cols.append(F.lit("").alias(n))
            else:
                cols.append(F.lit(0).cast("bigint").alias(n))
        return F.struct(*cols, p["metadata"].alias("metadata"), p["status"].alias("status"))

    listed = "[" + ", ".join(f"'{n}'" for n in keep) + "]"
    return reports.withColumns({
        "processes": F.transform("processes", proj),
        "metadata": F.map_concat(F.map_filter(md, lambda k, v: k != "exported_process_fields"),
                                 F.create_map(F.lit("exported_process_fields"), F.lit(listed))),
    })


def exported_process_struct(p: Column, listed: Column) -> Column:
    """PRJ-2: the process object as exported: the listed keys, or with an empty list all of
    them and the process metadata. Keys left out are null, which JSON output omits."""
    every = F.size(listed) == 0
    fields = [F.when(every | F.array_contains(listed, n), p[n]).alias(n) for n in PROCESS_FIELD_NAMES]
    return F.struct(*fields, F.when(every, p["metadata"]).alias("metadata"))


# --------------------------------------------------------------- prefix merge --------
def prefix_merge(reports: DataFrame, prefixes: Sequence[str] | None) -> DataFrame:
    """AGG-2 / WIN-5 / SET-1: processes with the same (uid, longest matching prefix) are
    summed into one row (pid 0, comm = prefix, process_name '', metadata and status of the
    first row). Merged groups come first in order of first appearance, then the
    pass-through rows in input order. Runs inside each report row: no shuffle."""
    if not prefixes:
        return reports
    def at(k):
        return F.get("processes", k["i"])

    def merge(grp):
        first = at(F.get(grp, 0))
        zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in SUMMED_FIELDS])
        sums = F.aggregate(grp, zero, lambda acc, k: F.struct(
            *[(acc[n] + F.coalesce(at(k)[n], F.lit(0))).alias(n) for n in SUMMED_FIELDS]))
        return _bind(sums, lambda cols: merged_row(F.get(grp, 0), first, cols))

    def merged_row(k, first, cols):
        out = []
        for n, _ in PROCESS_FIELDS:
            if n == "pid":
                out.append(F.lit(0).cast("bigint").alias(n))
            elif n == "uid":
                out.append(k["uid"].alias(n))
            elif n == "comm":
                out.append(k["pfx"].alias(n))
            elif n == "process_name":
                out.append(F.lit("").alias(n))
            else:
                out.append(cols[n].alias(n))
        return F.struct(*out, first["metadata"].alias("metadata"), first["status"].alias("status"))

    # Sorting the (uid, prefix, position) keys puts each group in one slice, so the work per
    # report is n log n in its processes whatever the number of groups.
    keys = F.transform("processes", lambda p, i: F.struct(
        p["uid"].alias("uid"), longest_prefix(p["comm"], prefixes).alias("pfx"), i.alias("i")))

    def new_group(s, k, j):
        before = F.get(s, j - 1)
        return (j == 0) | ~(k["uid"].eqNullSafe(before["uid"]) & (k["pfx"] == before["pfx"]))

    def groups(s):
        numbered = F.filter(F.transform(s, lambda k, j: F.when(new_group(s, k, j), j)), lambda j: j.isNotNull())
        return _bind(numbered, lambda starts: F.transform(starts, lambda a, n: F.struct(
            F.get(s, a)["i"].alias("first"), a.alias("a"), F.coalesce(F.get(starts, n + 1), F.size(s)).alias("b"))))

    def rows(s):
        return F.transform(F.array_sort(groups(s)), lambda g: merge(F.slice(s, g["a"] + 1, g["b"] - g["a"])))

    merged = _bind(F.array_sort(F.filter(keys, lambda k: k["pfx"].isNotNull())), rows)
    passthrough = F.filter("processes", lambda p: longest_prefix(p["comm"], prefixes).isNull())
    return reports.withColumn("processes", F.concat(merged, passthrough))


def _bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


# ------------------------------------------------------------------- enrichment ------
def enrich(reports: DataFrame, collect_agent_id: str, received_timestamp: Column | str | int | None = None,
           version: str = "1.0.0") -> DataFrame:
    """PRJ-3: stamp agent id, receive time (default: the micro-batch clock), stage and
    agent version into report metadata."""
    if isinstance(received_timestamp, Column):
        rt = received_timestamp
    elif isinstance(received_timestamp, str):
        rt = F.col(received_timestamp)  # a column holding the receive time
    elif received_timestamp is not None:
        rt = F.lit(received_timestamp).cast("bigint")
    else:
        rt = F.unix_timestamp(F.current_timestamp())
    md = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    stamp = F.create_map(F.lit("processing_stage"), F.lit("enriched"),
                         F.lit("collect_agent_version"), F.lit(version))
    return reports.withColumns({
        "collect_agent_id": F.lit(collect_agent_id),
        "received_timestamp": rt,
        "metadata": F.map_concat(F.map_filter(md, lambda k, v: ~k.isin("processing_stage", "collect_agent_version")), stamp),
    })


# --------------------------------------------------------------- node metrics --------
def metric_entries(reports: DataFrame) -> Column:
    """AGG-3: the per-report metric map as an array of (metric_name, metric_value,
    is_int) entries: 7 process sums/counts, 4 system values, 5 per GPU, 6 over GPUs."""
    procs = F.coalesce("processes", F.array())

    def psum(n):
        return F.aggregate(procs, F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p[n], F.lit(0)))

    def ent(name, v, is_int):
        n = name if isinstance(name, Column) else F.lit(name)
        return F.struct(n.alias("metric_name"), v.cast("double").alias("metric_value"), F.lit(is_int).alias("is_int"))

    base = F.array(
        ent("cpu_total_ns", psum("cpu_ontime_ns"), True),
        ent("memory_total_bytes", psum("avg_rss_bytes"), True),
        ent("disk_read_bytes", psum("read_bytes"), True),
        ent("disk_write_bytes", psum("write_bytes"), True),
        ent("network_rx_bytes", psum("net_rx_bytes"), True),
        ent("network_tx_bytes", psum("net_tx_bytes"), True),
        ent("process_count", F.size(procs), True),
    )
    sm = F.col("system_metrics")
    gpus = F.coalesce(sm["gpus"], F.array())
    # a repeated index overwrites: only its last entry keeps per-GPU metrics
    indexes = F.reverse(F.transform(gpus, lambda g: g["gpu_index"]))
    last_gpus = F.filter(gpus, lambda g, i: F.array_position(indexes, g["gpu_index"]) == F.size(gpus) - i)
    system = F.array(
        ent("cpu_usage_percent", sm["cpu_usage_percent"], False),
        ent("memory_usage_percent", sm["memory_usage_percent"], False),
        ent("system_memory_used_bytes", sm["memory_used_bytes"], True),
        ent("system_memory_total_bytes", sm["memory_total_bytes"], True),
    )

    def per_gpu(g):
        pre = F.concat(F.lit("gpu_"), g["gpu_index"].cast("string"), F.lit("_"))
        return F.array(
            ent(F.concat(pre, F.lit("utilization_percent")), g["utilization_percent"], False),
            ent(F.concat(pre, F.lit("temperature_celsius")), g["temperature_celsius"], False),
            ent(F.concat(pre, F.lit("power_watts")), g["power_watts"], False),
            ent(F.concat(pre, F.lit("memory_used_mib")), g["memory_used_mib"], True),
            ent(F.concat(pre, F.lit("memory_total_mib")), g["memory_total_mib"], True),
        )

    def gmax(n):
        return F.array_max(F.transform(gpus, lambda g: g[n]))

    over = F.array(
        ent("gpu_max_utilization_percent", gmax("utilization_percent"), False),
        ent("gpu_max_temperature_celsius", gmax("temperature_celsius"), False),
        ent("gpu_max_power_watts", gmax("power_watts"), False),
        ent("gpu_total_memory_used_mib", F.aggregate(gpus, F.lit(0).cast("bigint"), lambda a, g: a + F.coalesce(g["memory_used_mib"], F.lit(0))), True),
        ent("gpu_count", F.size(gpus), True),
        ent("gpu_utilization_percent", gmax("utilization_percent"), False),
    )
    empty = F.array().cast("array<struct<metric_name:string,metric_value:double,is_int:boolean>>")
    sys_part = F.when(sm.isNotNull(), F.concat(system, F.flatten(F.transform(last_gpus, per_gpu)))).otherwise(empty)
    over_part = F.when(sm.isNotNull() & (F.size(gpus) > 0), over).otherwise(empty)
    return F.concat(base, sys_part, over_part)


def node_metrics(reports: DataFrame) -> DataFrame:
    """Long form of the per-report metric map: one row per (report, metric)."""
    keep = [c for c in ("report_id", "node_id", "timestamp", "event_time", "collect_agent_id") if c in reports.columns]
    m = reports.select(*keep, F.explode(metric_entries(reports)).alias("m"))
    return m.select(*keep, "m.metric_name", "m.metric_value", "m.is_int")


# ---------------------------------------------------------- user processors ----------
def sample(reports: DataFrame, rate: float, key: str = "node_id", salt: str | None = "timestamp") -> DataFrame:
    """UDF-1 sampler: keep a deterministic share of reports by an md5 bucket of the key
    (node id + timestamp by default). Removed reports are dropped; in a stage list the
    ``user_processor`` stage drops the same reports and counts their processes as filtered."""
    k = F.col(key) if salt is None else F.concat_ws("|", F.col(key).cast("string"), F.col(salt).cast("string"))
    keep = hash_fraction(k) < F.lit(int(round(rate * 10000)))
    r = _ensure_counters(reports)
    return r.filter(keep)


def system_process_filter(reports: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """FLT-9: drop processes whose comm starts with a listed prefix; count them filtered."""
    r = _ensure_counters(reports)
    kept = F.filter("processes", lambda p: first_prefix(F.coalesce(p["comm"], F.lit("")), prefixes).isNull())
    return r.withColumns({
        "_filtered": F.col("_filtered") + F.size("processes") - F.size(kept),
        "processes": kept,
    })


# -------------------------------------------------------------- stage registry -------
DEFAULT_STAGES = ["schema_validator", "field_projection", "prefix_aggregation",
                  "metrics_enricher", "threshold_checker"]

def _letters(name) -> str:
    """A stage name without case and separators."""
    return "".join(c for c in str(name).lower() if c.isalnum())


# Stage names by their letters. Fixed value: the one misspelling that configurations may hold.
KNOWN_STAGES = {_letters(n): n for n in [*DEFAULT_STAGES, "user_processor"]} | {"schemapvalidator": "schema_validator"}

# UDF-3: user stages, ``name -> (DataFrame -> DataFrame)``, addressable in the stage list.
CUSTOM_STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_stage(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Register a custom stage (a DataFrame function over report rows). It must keep the
    report columns and may update the counters (``_filtered``, ``_invalid``) and
    ``_reject_reason``."""
    CUSTOM_STAGES[_letters(name)] = fn


def normalize_stage_name(raw) -> str | None:
    """The key of a custom stage or the name of a built-in one; None for anything else."""
    letters = _letters(raw if raw is not None else "")
    return letters if letters in CUSTOM_STAGES else KNOWN_STAGES.get(letters)


def resolve_stages(configured: Sequence[str] | None) -> list[str]:
    """Configured order, unknown names skipped; nothing usable -> the default order."""
    names = list(configured) if configured else list(DEFAULT_STAGES)
    out = [c for c in (normalize_stage_name(n) for n in names) if c]
    return out or list(DEFAULT_STAGES)


def warn_if_validation_after_merge(stages: Sequence[str]) -> bool:
    """D-11: validating after the prefix merge rejects merged rows (pid 0)."""
    s = list(stages)
    return ("schema_validator" in s and "prefix_aggregation" in s
            and s.index("schema_validator") > s.index("prefix_aggregation"))



# -------------------------------------------------------- in-row threshold check -----
def rules_literal(rules: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """The agent's threshold rules (metric, max, min) as a literal array column."""
    if not rules:
        return F.array().cast("array<struct<metric_name:string,max_value:double,min_value:double>>")
    return F.array(*[F.struct(F.lit(n).alias("metric_name"), F.lit(mx).cast("double").alias("max_value"),
                              F.lit(mn).cast("double").alias("min_value")) for n, mx, mn in rules])


def count_violations(reports: DataFrame, rules: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """STR-3 evaluated inside the report row: number of rules violated by the report's
    metric map (strict comparisons; a missing or null metric violates nothing)."""
    entries = metric_entries(reports)
    rl = rules_literal(rules)

    def violated(r):
        hits = F.filter(entries, lambda e: (e["metric_name"] == r["metric_name"]) & e["metric_value"].isNotNull())
        v = F.try_element_at(hits, F.lit(-1))["metric_value"]  # last entry wins, like a dict update
        return F.coalesce((r["min_value"].isNotNull() & (v < r["min_value"]))
                          | (r["max_value"].isNotNull() & (v > r["max_value"])), F.lit(False))

    return F.size(F.filter(rl, violated))


def run_collect(reports: DataFrame, stages: Sequence[str] | None = None, process_fields: Sequence[str] | None = None,
                comm_prefixes: Sequence[str] | None = None, collect_agent_id: str = "collect_agent",
                threshold_rules: Sequence[tuple[str, float | None, float | None]] = (),
                received_timestamp: Column | None = None, sample_rate: float | None = None) -> DataFrame:
    """STR-1 / STR-2: the configured stage order over nested reports (unknown names
    skipped, empty -> default order). Every report is kept with its counters;
    ``_reject_reason`` marks the dropped ones (filter it for the survivors)."""
    r = _ensure_counters(reports).withColumn("_sm_invalid", F.lit(False))
    alive = F.col("_reject_reason").isNull()
    order = resolve_stages(stages)
    if warn_if_validation_after_merge(order):
        logging.getLogger(__name__).warning("schema_validator after prefix_aggregation rejects merged processes (pid 0)")
    for st in order:
        if st == "schema_validator":
            r = annotate_validation(r)
        elif st == "field_projection":
            r = project_fields(r, process_fields)
        elif st == "prefix_aggregation":
            r = prefix_merge(r, comm_prefixes)
        elif st == "metrics_enricher":
            r = enrich(r, collect_agent_id, received_timestamp)
        elif st == "threshold_checker":
            r = r.withColumn("_alerts", F.col("_alerts") + F.when(alive, count_violations(r, threshold_rules)).otherwise(F.lit(0)))
        elif st in CUSTOM_STAGES:
            r = _ensure_counters(CUSTOM_STAGES[st](r))
        elif st == "user_processor" and sample_rate is not None:
            keep = hash_fraction(F.concat_ws("|", F.col("node_id"), F.col("timestamp").cast("string"))) < int(round(sample_rate * 10000))
            r = r.withColumns({
                "_filtered": F.col("_filtered") + F.when(alive & ~keep, F.size("processes")).otherwise(F.lit(0)),
                "_reject_reason": F.when(alive & ~keep, F.lit("sampled_out")).otherwise(F.col("_reject_reason"))})
    return r


def accounting(annotated: DataFrame) -> DataFrame:
    """AGG-26: pipeline result totals over all reports (one row)."""
    return annotated.agg(
        F.count(F.lit(1)).alias("reports_in"),
        F.count_if(F.col("_reject_reason").isNull()).alias("reports_out"),
        F.sum("_invalid").cast("bigint").alias("invalid_count"),
        F.sum("_filtered").cast("bigint").alias("filtered_count"),
        F.sum("_alerts").cast("bigint").alias("alerts_triggered"),
        F.count_if(F.col("_sm_invalid")).alias("system_metrics_nulled"))


def top_processes(reports: DataFrame, n: int = 5) -> DataFrame:
    """TOP-1: the n processes with the most cpu time in each report (ties: earlier
    position first), ranked inside the row: no shuffle."""
    ranked = F.transform("processes", lambda p, i: F.struct(
        F.negative(F.coalesce(p["cpu_ontime_ns"], F.lit(0))).alias("k"), i.alias("i"),
        p["pid"].alias("pid"), p["comm"].alias("comm"), p["cpu_ontime_ns"].alias("cpu_ontime_ns")))
    top = F.slice(F.sort_array(ranked), 1, n)
    keys = [c for c in ("report_id", "node_id") if c in reports.columns]
    x = reports.select(*keys, F.posexplode(top).alias("rank0", "t"))
    return x.select(*keys, (F.col("rank0") + 1).alias("rank"), "t.pid", "t.comm", "t.cpu_ontime_ns")
