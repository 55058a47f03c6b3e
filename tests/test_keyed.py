"""Keyed tables, alert episodes and the notifications written from them."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts
from fleetlens.sources.keyed import KeyedTable

ROWS = "k long, v string"


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir, ["k"], buckets=32)
    assert t.read() is None and t.merge(spark.createDataFrame([], ROWS)) == 0
    assert t.merge(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))) == 1
    before = files(tmp_dir)
    new = spark.createDataFrame([(i * 100, "b") for i in range(10)] + [(5000, "b")], ROWS)
    assert t.merge(new) == 2
    added = set(files(tmp_dir)) - set(before)
    assert {f: m for f, m in files(tmp_dir).items() if f in before} == before and all("version=2" in f for f in added)
    touched = {r[0] for r in new.select(t._bucket()).distinct().collect()}
    assert {v for b, v in t.manifest()[1].items() if b in touched} == {2} and {v for b, v in t.manifest()[1].items() if b not in touched} == {1}
    want = {i: "b" if i % 100 == 0 else "a" for i in range(1000)} | {5000: "b"}
    assert dict(rows_of(t.read(), "k", "v")) == want and t.read().count() == len(want)
    assert t.merge(spark.createDataFrame([(5000, "c"), (6000, "c")], ROWS), "if_absent") == 3
    assert dict(rows_of(t.read(), "k", "v")) == want | {6000: "c"}


def test_repeated_keys_count_once(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir, ["k"], buckets=4)
    t.merge(spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "x"), (2, 1, "x")], "k long, n int, v string"), order_by="n")
    assert rows_of(t.read(), "k", "v") == [(1, "new"), (2, "x")]


def test_a_killed_merge_leaves_the_old_version_readable(spark, tmp_dir, monkeypatch):
    t = KeyedTable(spark, tmp_dir, ["k"], buckets=4)
    t.merge(spark.createDataFrame([(1, "a"), (2, "a")], ROWS))
    real = KeyedTable._point_to

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(KeyedTable, "_point_to", dies)
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(1, "b"), (3, "b")], ROWS))
    assert rows_of(KeyedTable(spark, tmp_dir, ["k"], buckets=4).read(), "k", "v") == [(1, "a"), (2, "a")]
    monkeypatch.setattr(KeyedTable, "_point_to", real)
    assert t.merge(spark.createDataFrame([(1, "b"), (3, "b")], ROWS)) == 2
    assert rows_of(t.read(), "k", "v") == [(1, "b"), (2, "a"), (3, "b")]


def test_prune_keeps_what_the_newest_versions_read(spark, tmp_dir):
    t = KeyedTable(spark, tmp_dir, ["k"], buckets=8)
    for n in range(5):
        t.merge(spark.createDataFrame([(n % 3, f"v{n}")], ROWS))
    before = rows_of(t.read(), "k", "v")
    t.prune(1)
    assert rows_of(t.read(), "k", "v") == before == [(0, "v3"), (1, "v4"), (2, "v2")]
    assert len(glob.glob(f"{tmp_dir}/manifest/version=*")) == 1 and len(files(tmp_dir)) == 3
    t.merge(t.read(), combine=lambda old, new: new.limit(0))
    assert t.read() is None  # all rows gone


T0 = dt.datetime(2024, 1, 1)
RULES = [("r1", ">"), ("r2", "<")]


def breaches(spark, hours, rule="r1", node="n", value=None):
    rows = [(f"{rule}:{node}:{h}", rule, "warning", f"{rule} cpu", node, float(value(h) if value else h), False, T0 + dt.timedelta(hours=h)) for h in hours]
    return spark.createDataFrame(rows, "id string, rule_id string, severity string, message string, node_id string, value double, acknowledged boolean, created_at timestamp")


def test_episodes_are_unbroken_runs(spark):
    rules = spark.createDataFrame(RULES, "id string, operator string")
    b = breaches(spark, [1, 2, 3, 7, 8]).unionByName(breaches(spark, [2, 3], "r2")).unionByName(breaches(spark, [4], node="m"))
    got = rows_of(alerts.alert_episodes(b, rules), "rule_id", "node_id", "started_at", "ended_at", "n_hours", "worst_value")
    h = lambda n: T0 + dt.timedelta(hours=n)
    assert got == [("r1", "m", h(4), h(5), 1, 4.0), ("r1", "n", h(1), h(4), 3, 3.0), ("r1", "n", h(7), h(9), 2, 8.0), ("r2", "n", h(2), h(4), 2, 2.0)]


def test_notifications_keep_their_flags(spark, tmp_dir):
    rules = spark.createDataFrame(RULES, "id string, operator string")
    t = KeyedTable(spark, tmp_dir, alerts.NOTIFICATION_KEYS, 8, alerts.NOTIFICATION_BUCKETS)
    first, later = F.lit(dt.datetime(2024, 2, 1)), F.lit(dt.datetime(2024, 3, 1))
    run = lambda hours, now: alerts.notify(t, alerts.alert_episodes(breaches(spark, hours), rules), now)
    cols = ("id", "n_hours", "worst_value", "acknowledged", "created_at")
    run([1, 2, 5], first)
    once = rows_of(t.read(), *cols)
    assert len(once) == 2 and not any(r[3] for r in once)
    t.merge(t.read().withColumn("acknowledged", F.col("id").endswith("01")))  # a user acknowledges the first
    run([1, 2, 5], later)
    assert rows_of(t.read(), *cols) == [(*r[:3], r[0].endswith("01"), r[4]) for r in once]  # nothing added, no flag cleared
    run([1, 2, 3, 5], later)  # the first goes on
    assert [r[1:4] for r in rows_of(t.read(), *cols)] == [(3, 3.0, True), (1, 5.0, False)]
    run([1, 2, 3, 4, 5], later)  # late data joins the two
    assert [(r[1:4], r[4]) for r in rows_of(t.read(), *cols)] == [((5, 5.0, True), dt.datetime(2024, 2, 1))]
