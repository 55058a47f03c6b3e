"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when Catalyst's size estimate for it is at most this many bytes.
DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's plan-time size estimate (no job runs). For scans it is derived from the
    (compressed) file sizes, and generators can grow a side beyond it, so it is an estimate
    and no proven bound; the default limit leaves room for that."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else str(size))
    except Exception:  # noqa: BLE001 - estimates are best effort (e.g. Spark Connect)
        return None


def checked_broadcast(side: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``side`` only when its estimated size is at most
    ``max_bytes``; otherwise return it unchanged, so the planner uses a shuffle join and
    AQE can still switch to a broadcast from sizes measured at runtime."""
    n = estimated_bytes(side)
    return F.broadcast(side) if n is not None and n <= max_bytes else side


def literal_table(spark, rows, schema: str) -> DataFrame:
    """A small configuration table (rule lists) as an inline literal over a one-row range,
    so Catalyst knows its exact size (a parallelized local list has no size estimate and
    would never be broadcast by ``checked_broadcast``)."""
    from pyspark.sql import types as T
    st = T._parse_datatype_string(schema)
    fields = st.fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
