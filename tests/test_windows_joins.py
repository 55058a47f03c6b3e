"""bucketed_lag equals a plain lag (gaps between buckets, a hot key); checked_broadcast
broadcasts only below its bound."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.joins import checked_broadcast, estimated_bytes, literal_table
from fleetlens.operators.windows import bucketed_lag
from fleetlens.plans.compare import rows_key


def test_bucketed_lag_matches_plain_lag(spark):
    rows = []
    for i in range(400):           # hot key: most rows, across many hours with gaps
        if (i // 20) % 3 != 1:
            rows.append(("hot", i * 180, i))
    for i in range(30):
        rows.append((f"k{i % 3}", i * 7200 + 5, 1000 + i))
    df = spark.createDataFrame(rows, "k string, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    got = bucketed_lag(df, ["k"], ["ts", "v"], ["v", "ts"], F.date_trunc("hour", "ts"))
    w = Window.partitionBy("k").orderBy("ts", "v")
    want = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_ts", F.lag("ts").over(w))
    cols = ["k", "v", "prev_v", "prev_ts"]
    assert rows_key(got.select(*cols).collect()) == rows_key(want.select(*cols).collect())


def test_checked_broadcast(spark):
    small = literal_table(spark, [(1, "a"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in small.collect()) == [(1, "a"), (2, "b")]
    plan = checked_broadcast(small)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan.lower()
    assert literal_table(spark, [], "k int").count() == 0
    big = spark.range(0, 10_000_000).withColumn("pad", F.lit("x" * 50))
    assert estimated_bytes(big) > 64 * 1024 * 1024
    assert checked_broadcast(big) is big
