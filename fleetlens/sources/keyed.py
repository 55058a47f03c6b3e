"""Keyed tables on plain Parquet: merges that rewrite only what they touch (SNK-4, SNK-5).

Rows are dealt into buckets by a hash of the key. A merge reads the buckets of its updates, writes
their new content into a folder of the next version and at last a manifest that says which version
holds each bucket. The manifest is one small file, put in place by a single rename, so readers see
the whole merge or nothing of it; a merge that dies leaves the old manifest and is simply repeated.
Files of untouched buckets stay as they are, and older versions stay readable until ``prune``.

One writer at a time is assumed, as a streaming query or an hourly job is. What reaches the driver
are bucket numbers, at most ``buckets`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import _stored, insert_if_absent, upsert

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A table with one row per ``keys``, in ``buckets`` by the hash of ``bucket_keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, bucket_keys: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.bucket_keys = list(bucket_keys or keys)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_keys), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, int]]:
        """The newest version, and the version that holds each bucket (0 and none before the first merge)."""
        stored = _stored(self.spark, f"{self.path}/manifest")
        if stored is None:
            return 0, {}
        rows = stored.where(F.col("version") == stored.select(F.max("version")).scalar()).collect()
        return rows[0]["version"], {r["bucket"]: r["data_version"] for r in rows if r["bucket"] >= 0}

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("version", "bucket")

    def read(self) -> DataFrame | None:
        """The rows of the newest version; None before the first merge or when no row is left."""
        return self._read(self.manifest()[1])

    def merge(self, updates: DataFrame, how: str = "upsert", order_by: str | None = None, combine: Combine | None = None) -> int:
        """Merge ``updates`` and return the new version (the old one when there are none).

        ``how``: "upsert" replaces rows with equal keys, "if_absent" keeps them. ``combine(old,
        new)`` takes the place of both; it gets the touched buckets' rows and must return rows of
        those buckets. Updates that share a key count once: the one with the greatest ``order_by``,
        or the greatest row."""
        rest = [c for c in updates.columns if c not in self.keys]
        row = F.struct(*rest) if rest else F.lit(True)
        best = F.max(row) if order_by is None else F.max_by(row, order_by)
        new = updates.groupBy(*self.keys).agg(best.alias("_r"))
        new = new.select(*self.keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*updates.columns)
        version, held = self.manifest()
        touched = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        if not touched:
            return version
        old = self._read({b: v for b, v in held.items() if b in touched})
        if old is None:
            old = self.spark.createDataFrame([], new.schema)
        if combine is None:
            combine = {"upsert": lambda o, n: upsert(n, o, self.keys),
                       "if_absent": lambda o, n: o.unionByName(insert_if_absent(n, o, self.keys))}[how]
        target = f"{self.path}/data/version={version + 1}"
        merged = combine(old, new).withColumn("bucket", self._bucket())
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        filled = {r[0] for r in self.spark.read.schema(merged.schema).parquet(target).select("bucket").distinct().collect()}
        held = {b: v for b, v in held.items() if b not in touched} | {b: version + 1 for b in filled}
        self._point_to(version + 1, held)
        return version + 1

    def _point_to(self, version: int, held: dict[int, int]) -> None:
        # bucket -1 keeps a manifest of an empty table from being an empty file
        rows = [(-1, version), *sorted(held.items())]
        (self.spark.createDataFrame(rows, "bucket int, data_version bigint").coalesce(1).write.mode("overwrite")
            .parquet(f"{self.path}/manifest/version={version}"))

    def prune(self, keep: int = 2) -> None:
        """Delete manifests older than the newest ``keep``, and data folders that none of those name."""
        stored = _stored(self.spark, f"{self.path}/manifest")
        if stored is None:
            return
        rows = [(r["version"], r["bucket"], r["data_version"]) for r in stored.collect()]
        newest = max(v for v, _, _ in rows)
        used = {(d, b) for v, b, d in rows if v > newest - keep}
        for v in {v for v, _, _ in rows if v <= newest - keep}:
            self._delete(f"{self.path}/manifest/version={v}")
        for d, b in {(d, b) for v, b, d in rows if v <= newest - keep and b >= 0} - used:
            self._delete(f"{self.path}/data/version={d}/bucket={b}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
