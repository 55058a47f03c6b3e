"""Skew-safe ordered windows.

``lag`` over ``partitionBy(node)`` sends every row of a node to one task; with one node
holding a third of the rows that task is the job. ``bucketed_lag`` partitions by the key
*and* a time bucket, then repairs the first row of each bucket from a small per-bucket
summary (the last row of the previous non-empty bucket), so the result equals the plain
window while no task holds more than one key-bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 bucket: Column, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the previous row of the same key in ``order``.

    ``bucket`` must be monotone in ``order`` (e.g. ``date_trunc('hour', ts)``)."""
    keys, order, cols = list(keys), list(order), list(cols)
    d = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    d = d.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in cols})
    d = d.withColumn("_first", F.row_number().over(w) == 1)
    # Last row of every (key, bucket): one row per bucket, reduced by partial aggregation.
    last = d.groupBy(*keys, "_bkt").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    # Previous bucket's last row, per key. The summary has one row per (key, bucket), so
    # this window is over bucket counts, not raw rows.
    wb = Window.partitionBy(*keys).orderBy("_bkt")
    fill = last.select(*keys, "_bkt", F.lag("_last").over(wb).alias("_fill"))
    j = d.join(fill, [*keys, "_bkt"], "left")
    return j.withColumns({
        f"{prefix}{c}": F.when(F.col("_first"), F.col(f"_fill.{c}")).otherwise(F.col(f"{prefix}{c}")) for c in cols
    }).drop("_bkt", "_first", "_fill")


def bucketed_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, Column], bucket: Column) -> DataFrame:
    """Add, for each name in ``cols``, the last non-null value of its expression on *earlier* rows of
    the same key in ``order`` (an as-of carry).

    ``bucket`` must be monotone in ``order``. Within a (key, bucket) a window carries values on; what
    a bucket starts with comes from a summary of one row per (key, bucket)."""
    keys, order = list(keys), list(order)
    d = df.withColumn("_bkt", bucket).withColumns({f"_v_{n}": c for n, c in cols.items()})
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    seen = d.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n in cols})
    at = F.struct(*order)
    ends = d.groupBy(*keys, "_bkt").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in cols])
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(*keys, "_bkt", *[F.last(f"_e_{n}", ignorenulls=True).over(wb).alias(f"_s_{n}") for n in cols])
    j = seen.join(start, [*keys, "_bkt"], "left")
    return j.withColumns({n: F.coalesce(F.col(n), F.col(f"_s_{n}")) for n in cols}).drop(
        "_bkt", *[f"{p}{n}" for n in cols for p in ("_v_", "_s_")])


def asof(rows: DataFrame, events: DataFrame, keys: Sequence[str], at: Column, event_at: Column, seq: str, cols: Sequence[str],
         name: str, bucket_unit: str = "day") -> DataFrame:
    """``rows`` with ``name``: a struct of ``cols`` of the last event of the same key at or before
    ``at`` (null without one). Of several events at one instant the one with the greatest ``seq``
    counts, and an event counts for rows of its own instant.

    Events and rows are stacked and the last event is carried on in time order, so each side is read
    once and nothing is joined by a range."""
    keys = list(keys)
    event = F.struct(*cols)
    kind = events.select(event.alias("e")).schema["e"].dataType
    r = rows.select(*keys, at.alias("_t"), F.lit(None).cast(kind).alias("_event"), F.lit(None).cast(events.schema[seq].dataType).alias("_seq"),
                    F.struct(*[c for c in rows.columns if c not in keys]).alias("_row"))
    e = events.select(*keys, event_at.alias("_t"), event.alias("_event"), F.col(seq).alias("_seq"),
                      F.lit(None).cast(r.schema["_row"].dataType).alias("_row"))
    u = r.unionByName(e).withColumn("_is_row", F.col("_row").isNotNull())
    u = bucketed_last(u, keys, ["_t", "_is_row", "_seq"], {name: F.col("_event")}, F.date_trunc(bucket_unit, "_t"))
    return u.where("_is_row").select(*keys, "_row.*", name)
