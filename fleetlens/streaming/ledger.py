"""The hourly job (STR-6): rolls up exactly the hours that stored points have touched.

Every micro-batch notes the hours its points fall in (``note_hours``), next to the points and keyed
by its batch id, so a replayed batch replaces its note. ``run_hourly`` compares the notes with the
hours it has done, rolls those that are closed (an hour is closed ``LAG`` after its end, hh:05 for
the hour before), overwrites their partitions and only then notes them as done. A run that was
missed is made up by the next one, a late file makes its hours due again, a run with nothing due
writes nothing, and a run that dies half-way is repeated with the same result.

The notes have one row per batch and hour; what reaches the driver are the due hours.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup

LAG = dt.timedelta(minutes=5)

# Hours rolled in one go: their literals stand in a filter, and a long gap is made up in steps.
HOURS_AT_ONCE = 96


def note_hours(points: DataFrame, root: str, batch_id: int) -> None:
    """Note the hours that a batch's points fall in."""
    hours = points.select(rollup.hour().alias("hour")).distinct().withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    (hours.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/touched_hours"))


def due_hours(spark: SparkSession, root: str, store: str, now: dt.datetime) -> DataFrame:
    """(batch_id, hour) notes of closed hours that no run has rolled since."""
    notes = spark.read.schema("hour timestamp, batch_id bigint").parquet(f"{root}/touched_hours").select("batch_id", "hour")
    done = rollup._stored(spark, f"{store}/rolled_hours")
    if done is not None:
        notes = notes.join(done.select("batch_id", "hour"), ["batch_id", "hour"], "left_anti")
    return notes.where(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(now - LAG).cast("timestamp"))


def run_hourly(spark: SparkSession, root: str, store: str, now: dt.datetime, mode: str = "spread") -> list[dt.datetime]:
    """One run of the hourly job at ``now``; returns the hours it rolled, in order."""
    from .jobs import rollup_hours
    due = [(r["batch_id"], r["hour"]) for r in due_hours(spark, root, store, now).collect()]
    hours = sorted({h for _, h in due})
    for k in range(0, len(hours), HOURS_AT_ONCE):
        some = hours[k : k + HOURS_AT_ONCE]
        for table, df in rollup_hours(spark, root, some, mode).items():
            rollup.write_rollup(df, f"{store}/{table}")
        rows = [d for d in due if some[0] <= d[1] <= some[-1]]
        spark.createDataFrame(rows, "batch_id bigint, hour timestamp").coalesce(1).write.mode("append").parquet(f"{store}/rolled_hours")
    return hours
