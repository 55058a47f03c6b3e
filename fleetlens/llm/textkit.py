"""Vectorised text helpers used inside Arrow tasks, and small DataFrame helpers.

Words are found on UTF-8 bytes: every byte of a non-ASCII code point counts as a word byte in
both word definitions below, so byte classes give exactly the code-point classes of the patterns
``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing A-Z).
Word identity is a 64-bit hash of the word's bytes.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64

# Bytes of text that one vectorised step handles (a longer document is one step of its own).
CHUNK_BYTES = 1 << 18

_ALL = np.arange(256)
PLAIN_WORD = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
ALNUM_WORD = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

# Rows of an Arrow batch at most (Spark's default is 10,000, which is too many whole texts).
BATCH_ROWS = 1000

_own_folder = ""

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.full(size, base, U64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) pieces of a string column; null reads as ''."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the index of its first word (rows + 1)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = table[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[offs < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[offs > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word (prefix sums of a polynomial hash)."""
    n = len(buf)
    sums = np.zeros(n + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * _power_table("up", _BASE, n + 1)[:n], out=sums[1:])
    down = _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (length max(0, n - k + 1))."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.zeros(n, U64)
    for j in range(k):
        acc = acc * U64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(acc)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every word, from the per-row word bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def named(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and backquotes in them included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def ship(spark) -> None:
    """Send this package to the Python workers once per application, for sessions whose executors
    don't have it on their path (a no-op when it was itself installed from an archive), and keep
    the batches that go to them small: their rows are whole texts."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if getattr(context, "_fleetlens_shipped", False) or not os.path.isdir(os.path.join(root, "fleetlens")):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="fleetlens-ship-"), "fleetlens")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "fleetlens"))
    context._fleetlens_shipped = True


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with one row per non-null id, for operators that join on the id.

    A row without id can't be named in a result and is left out; rows that share an id are one
    document, whose text is the largest of theirs in string order. The ids are checked in a job
    that reads the id column alone, and the texts are only regrouped when an id repeats.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.where(F.col("doc_id").isNotNull())
    repeated = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull())
    if repeated.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return d.groupBy("doc_id").agg(F.max("text").alias("text"))
    return d


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with rows that share a non-null id reduced to the one with the largest text (as in
    ``keyed_documents``); rows without id stay as they are."""
    known = docs.where(F.col(id_col).isNotNull())
    if not known.groupBy(id_col).count().where("count > 1").limit(1).count():
        return docs
    row = F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.struct(*named(docs.columns)).alias("__row"))
    best = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(row).alias("__best")).select("__best.__row.*")
    return best.unionByName(docs.where(F.col(id_col).isNull()))


def shared_folder(spark) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share. Where it is
    unset, a local session (one JVM, as in tests) gets a folder of its own and any other an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder or tempfile.mkdtemp(prefix="fleetlens-shared-")
        globals()["_own_folder"] = folder
    return folder.rstrip("/")


_scratch: list[str] | None = None


@contextmanager
def scratch(spark) -> Iterator[None]:
    """Delete what ``written`` makes inside, tables written with ``keep`` excepted. For jobs whose
    result is written at the end; a lazy result may still read its working tables."""
    global _scratch
    before, _scratch = _scratch, []
    try:
        yield
    finally:
        mine, _scratch = _scratch, before
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_partitions(spark, size: int = 16 << 20) -> Iterator[None]:
    """Jobs run inside put at most about ``size`` bytes of a shuffle into one task where adaptive
    execution joins small partitions (its own target is total / cores, up to 64 MB compressed),
    so that fetched blocks and sorts of concurrent tasks stay small."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back, so a
    lost executor costs no recomputation of what stands before. Inside ``scratch`` the table is
    deleted at the end unless it is to ``keep``."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    if _scratch is not None and not keep:
        _scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
