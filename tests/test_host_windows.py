"""Host samples by collection window and by life of a pid, against plain Python on made rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import host, host_windows
from fleetlens.operators.windows import bucketed_last

T0 = dt.datetime(2024, 1, 1, 10)
SWITCH = "node_id string, cpu int, ts timestamp, seq long, pid long, uid long, comm string"
EVENT = "node_id string, ts timestamp, seq long, type string, pid long, ppid long, comm string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def micros(ts):
    return int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def test_a_run_over_three_windows(spark):
    rows = [("n", 0, at(3), 1, 7, 100, "a"), ("n", 0, at(13), 2, 0, 0, "idle"), ("n", 0, at(14), 3, 7, 101, "b"), ("n", 0, at(15), 4, 0, 0, "idle")]
    got = {(r["window_start"], r["pid"]): (r["cpu_ontime_ns"], r["uid"], r["comm"])
           for r in host_windows.oncpu_by_window(spark.createDataFrame(rows, SWITCH), 5).collect()}
    s = 10**9
    assert got == {(at(0), 7): (2 * s, 100, "a"), (at(5), 7): (5 * s, 100, "a"), (at(10), 7): (4 * s, 101, "b")}


@pytest.mark.parametrize("attribution", ["lag", "outgoing"])
def test_windows_add_up_to_the_totals(spark, attribution):
    rng = random.Random(6)
    rows = [(f"n{rng.randrange(2)}", rng.randrange(3), at(rng.randrange(40_000) / 10), i, rng.randrange(5), 1, "c") for i in range(600)]
    s = spark.createDataFrame(rows, SWITCH)
    w = host_windows.oncpu_by_window(s, 60, attribution)
    total = host.oncpu_from_switches(s, attribution)
    want = {(r["node_id"], r["pid"]): r["cpu_ontime_ns"] for r in total.collect() if r["cpu_ontime_ns"]}
    got = {(r["node_id"], r["pid"]): r["n"] for r in w.groupBy("node_id", "pid").agg(F.sum("cpu_ontime_ns").alias("n")).collect()}
    assert got == want
    # three CPUs give a node at most three windows' lengths
    assert w.groupBy("node_id", "window_start").agg(F.sum("cpu_ontime_ns").alias("n")).agg(F.max("n")).first()[0] <= 3 * 60 * 10**9
    one = host_windows.oncpu_by_window(s.where("cpu = 1"), 60, attribution)
    assert one.groupBy("node_id", "window_start").agg(F.sum("cpu_ontime_ns").alias("n")).agg(F.max("n")).first()[0] <= 60 * 10**9
    assert host_windows.oncpu_by_window(s.limit(0), 60).count() == 0


def test_bucketed_last_equals_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(2)}", at(rng.randrange(300_000)), i, rng.choice([None, None, rng.randrange(9)])) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, seq long, v long")
    got = {r["seq"]: r["p"] for r in bucketed_last(d, ["k"], ["ts", "seq"], {"p": F.col("v")}, F.date_trunc("hour", "ts")).collect()}
    last, want = {}, {}
    for k, _, seq, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[seq] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


def plain_lives(rows):
    """{(node, pid): [[start, seq, ppid, comm, end, exited], ...]}"""
    lives, open_ = defaultdict(list), {}
    for node, ts, seq, kind, pid, ppid, comm in sorted(rows, key=lambda r: (r[1], r[2])):
        k = (node, pid)
        if kind == "fork":
            if k in open_:
                open_[k][4] = ts
            open_[k] = [ts, seq, ppid, comm, None, False]
            lives[k].append(open_[k])
        elif k in open_ and kind == "exec":
            open_[k][3] = comm
        elif k in open_ and kind == "exit":
            open_[k][4:] = [ts, True]
            del open_[k]
    return lives


@pytest.fixture(scope="module")
def events():
    rng = random.Random(9)
    kinds = ["fork", "exec", "exit", "switch"]
    return [(f"n{rng.randrange(2)}", at(rng.randrange(400_000)), i, rng.choice(kinds), rng.randrange(1, 6), rng.randrange(50), f"c{rng.randrange(9)}")
            for i in range(500)]


def test_lives_of_reused_pids(spark, events):
    got = defaultdict(list)
    for r in host_windows.process_lives(spark.createDataFrame(events, EVENT)).collect():
        got[r["node_id"], r["pid"]].append([r["life_start"], r["life_seq"], r["ppid"], r["comm"], r["life_end"], r["exited"]])
    want = plain_lives(events)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(map(len, want.values())) > 5
    # the last life is what process_lifecycle tells
    old = {(r["node_id"], r["pid"]): (r["ppid"], r["comm"], r["exited"]) for r in host.process_lifecycle(spark.createDataFrame(events, EVENT)).collect()}
    assert old == {k: (v[-1][2], v[-1][3], v[-1][5]) for k, v in want.items()}


def test_usage_goes_to_the_life_it_falls_in(spark, events):
    rng = random.Random(10)
    lives = plain_lives(events)
    calls = [(f"n{rng.randrange(2)}", at(rng.randrange(-5, 400_000)), rng.randrange(0, 7), rng.choice(["read", "write", "sendto", "recvmsg", "open"]), rng.randrange(-3, 9))
             for _ in range(600)]
    rss = [(n, ts, pid, max(0, ret) * 1000) for n, ts, pid, _, ret in calls[::2]]
    switches = [(f"n{rng.randrange(2)}", rng.randrange(2), at(rng.randrange(400_000)), i, rng.randrange(0, 6), 1, "c") for i in range(300)]
    got = host_windows.usage_by_life(spark.createDataFrame(switches, SWITCH), spark.createDataFrame(calls, "node_id string, ts timestamp, pid long, name string, ret long"),
                                     spark.createDataFrame(rss, "node_id string, ts timestamp, pid long, rss long"), spark.createDataFrame(events, EVENT)).collect()

    def life(node, pid, ts):
        born = [v for v in lives.get((node, pid), []) if v[0] <= ts]
        return max(born)[0] if born and (max(born)[4] is None or ts <= max(born)[4]) else None

    want = defaultdict(lambda: [0, 0, 0, 0, 0, []])
    for node, pid in lives:
        for v in lives[node, pid]:
            want[node, pid, v[0]]
    column = {"read": 1, "write": 2, "recvmsg": 3, "sendto": 4}
    for node, ts, pid, name, ret in calls:
        if pid and ret > 0:
            cell = want[node, pid, life(node, pid, ts)]
            if name in column:
                cell[column[name]] += ret
    for node, ts, pid, size in rss:
        if pid:
            want[node, pid, life(node, pid, ts)][5].append(size)
    last = {}
    for node, cpu, ts, seq, pid, _, _ in sorted(switches, key=lambda r: (r[2], r[3])):
        if (node, cpu) in last:
            t, p = last[node, cpu]
            if p:
                want[node, p, life(node, p, t)][0] += (micros(ts) - micros(t)) * 1000
        last[node, cpu] = (ts, pid)
    found = {(r["node_id"], r["pid"], r["life_start"]): [r[c] for c in ("cpu_ontime_ns", "read_bytes", "write_bytes", "net_rx_bytes", "net_tx_bytes", "avg_rss_bytes")] for r in got}
    assert found == {k: [*v[:5], sum(v[5]) // len(v[5]) if v[5] else 0] for k, v in want.items()}
    assert any(k[2] is None for k in found) and len(found) == len(got)


def test_every_gpu_file_is_read_by_its_own_header(spark):
    w = [at(0), at(600)]
    lines = [("n", w[0], 0, "pid, process_name, used_memory"), ("n", w[0], 1, "5, python, 100 MiB"),
             ("n", w[1], 0, "used_memory [MiB], pid, process_name"), ("n", w[1], 1, "200 MiB, 5, python"),
             ("n", w[1], 0, "used_memory [MiB], pid, process_name"), ("m", w[1], 1, "1, no header, 3 MiB")]
    d = spark.createDataFrame(lines, "node_id string, window_start timestamp, line_no long, line string")
    got = sorted(tuple(r) for r in host.gpu_proc_csv_parse(d).collect())
    assert got == [("n", w[0], 1, 5, "python", 100), ("n", w[1], 1, 5, "python", 200)]


def test_window_merge_marks_the_window_of_an_exit(spark):
    switches = spark.createDataFrame([("n", 0, at(1), 1, 7, 100, "a"), ("n", 0, at(12), 2, 0, 0, "i")], SWITCH)
    events = spark.createDataFrame([("n", at(0), 1, "fork", 7, 3, "a"), ("n", at(8), 2, "exit", 7, 0, "a"), ("n", at(20), 3, "fork", 7, 4, "z")], EVENT)
    calls = spark.createDataFrame([("n", at(6), 7, "read", 10), ("n", at(6), 7, "sendto", 4), ("n", at(11), 8, "read", 1)],
                                  "node_id string, ts timestamp, pid long, name string, ret long")
    rss = spark.createDataFrame([("n", at(2), 7, 10), ("n", at(3), 7, 21)], "node_id string, ts timestamp, pid long, rss long")
    gpu = host_windows.gpu_by_window(host.gpu_proc_csv_parse(spark.createDataFrame(
        [("n", at(5), 0, "pid, process_name, used_memory"), ("n", at(5), 1, "7, train, 64 MiB")],
        "node_id string, window_start timestamp, line_no long, line string")))
    got = host_windows.merge_window_samples(host_windows.oncpu_by_window(switches, 5), host_windows.io_by_window(calls, 5),
                                            host_windows.rss_by_window(rss, 5), gpu, host_windows.process_lives(events), 5)
    rows = {r["window_start"]: (r["cpu_ontime_ns"] // 10**9, r["read_bytes"], r["net_tx_bytes"], r["avg_rss_bytes"], r["gpu_used_memory_mib"], r["ppid"],
                                r["process_name"], r["exited"]) for r in got.collect()}
    assert rows == {at(0): (4, 0, 0, 15, 0, 3, "", False), at(5): (5, 10, 4, 0, 64, 3, "train", True), at(10): (2, 0, 0, 0, 0, 3, "", False)}
