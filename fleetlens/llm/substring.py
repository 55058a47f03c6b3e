"""Substring dedup: FM-indexes over shards of passages, streamed windows searched backwards.

A window is 20 consecutive words. Equal windows must meet in one shard, so shards are made by
content: the smallest hash of the 6-word grams in a window (its minimizer) names the shard key,
and consecutive windows with one minimizer travel together as a segment.

1. Every document is cut into segments; a minimizer that occurs once in the corpus can't belong
   to a repeated window, so only segments of minimizers that occur again go on.
2. Equal segments are combined before the shuffle: one copy stays, with its first occurrence.
   All windows of the other occurrences are repeats by definition.
3. Segments are dealt to shards by minimizer. Each shard builds a compressed FM-index over its
   segments in corpus order and streams their windows through it: backward search gives each
   window its interval, and sampled suffix positions locate its first occurrence. A window stays
   only at its first occurrence.
4. A minimizer that occurs more than ``HOT`` times could make one long shard; the windows of its
   different segments become segments of their own and are combined by their whole content
   instead, which leaves one row per window and map task whatever the size of the group.
5. Per document, words covered by a removed window go.

Defined results: null and empty texts have no words; documents of under 20 words lose nothing; a
row without doc_id is left out and rows that share a doc_id are one document with the largest of
their texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K
from fleetlens.llm.fmindex import FMIndex, expand

WINDOW = 20
GRAM = 6
MOST_WINDOWS = 64  # windows of a segment: one bit each in a long
SHARD_WORDS = 200_000
HOT = 4096


def _words(col: pa.Array):
    """Per chunk of a string column: first row, bytes, word starts, ends, bounds."""
    for lo, _, buf, offs in K.text_chunks(col):
        yield lo, buf, *K.word_spans(buf, offs, K.PLAIN_WORD)


def segments(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Segments of the rows' word hashes: row, first word in the row, words, minimizer, and how
    often the minimizer's gram occurs in the segment (a repeat may lie within one segment)."""
    row = K.row_of(bounds)
    starts = np.flatnonzero(np.arange(len(hashes)) + window <= bounds[1:][row]) if len(hashes) else np.zeros(0, np.int64)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    low, span, grams = K.gram_hashes(hashes, gram), 1, window - gram + 1
    hashed = low
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[starts], low[starts + grams - span])
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (low[1:] != low[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    at = np.flatnonzero((np.arange(len(starts)) - first) % MOST_WINDOWS == 0)
    n = np.diff(np.append(at, len(starts))) + window - 1
    inside, owner = expand(starts[at], starts[at] + n - gram + 1)
    times = np.bincount(owner[hashed[inside] == low[at][owner]], minlength=len(at))
    where = row[starts[at]]
    return where, starts[at] - bounds[where], n, low[at].view(np.int64), times


def joined_words(buf, starts, ends, keep=None):
    """Bytes of the (kept) words, each followed by one space, and the offset of each word."""
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    source, _ = expand(starts, ends + 1)
    out = buf[np.minimum(source, max(0, len(buf) - 1))]
    out[at[1:] - 1] = 0x20
    return out, at


def slices(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """Strings data[low:high]."""
    source, _ = expand(low, high)
    offs = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offs), pa.py_buffer(data[source])).cast(pa.string())


def _segment_task(batches):
    for batch in batches:
        for lo, buf, starts, ends, bounds in _words(batch.column("text")):
            row, first, n, key, times = segments(K.word_hashes(buf, starts, ends), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row + lo)), pa.array(first.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(key), pa.array(times.astype(np.int64))],
                names=["doc_id", "start", "n", "key", "times"])


def _content_task(batches):
    """Segments listed per document, with their words."""
    for batch in batches:
        segs = batch.column("segs")
        offs = np.asarray(segs.offsets)
        flat = segs.values
        start, n, key = (np.asarray(flat.field(f)) for f in ("start", "n", "key"))
        hot = flat.field("hot")
        for lo, buf, starts, ends, bounds in _words(batch.column("text")):
            rows = len(bounds) - 1
            pick, owner = expand(offs[lo : lo + rows], offs[lo + 1 : lo + rows + 1])
            data, at = joined_words(buf, starts, ends)
            w = bounds[owner] + start[pick]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[pick]), hot.take(pa.array(pick)), slices(data, at[w], at[w + n[pick]] - 1),
                 batch.column("doc_id").take(pa.array(owner + lo)), pa.array(start[pick]), pa.array(n[pick])],
                names=["key", "hot", "content", "doc_id", "start", "n"])


def first_windows(contents: pa.Array) -> np.ndarray:
    """For segments in corpus order: a bit per window that occurs nowhere earlier among them."""
    texts, counts = [], []
    for _, buf, starts, ends, bounds in _words(contents):
        texts.append(K.word_hashes(buf, starts, ends))
        counts.append(np.diff(bounds))
    n = np.concatenate(counts)
    _, symbol = np.unique(np.concatenate(texts), return_inverse=True)
    close = np.cumsum(n + 1) - 1
    text = np.zeros(len(symbol) + len(n), np.int64)
    inside = np.ones(len(text), bool)
    inside[close] = False
    text[inside] = symbol + 1
    windows = np.maximum(n - WINDOW + 1, 0)
    begin = close - n
    at, owner = expand(begin, begin + windows)
    keep = np.ones(len(at), bool)
    index = FMIndex(text)
    which, low, high = index.search(lambda j, w: text[at[w] + j], len(at), WINDOW, least=2)
    if len(which):
        intervals, group = np.unique(low, return_inverse=True)
        upto = np.zeros(len(intervals), np.int64)
        upto[group] = high
        rows, part = expand(intervals, upto)
        first = np.minimum.reduceat(index.locate(rows), np.flatnonzero(np.diff(part, prepend=-1)))
        keep[which] = at[which] == first[group]
    bits = np.where(keep, K.U64(1) << (at - begin[owner]).astype(K.U64), K.U64(0))
    out = np.zeros(len(n), K.U64)
    some = windows > 0
    if some.any():
        out[some] = np.bitwise_or.reduceat(bits, (np.cumsum(windows) - windows)[some])
    return out.view(np.int64)


def _shard_task(batches):
    """Rows come sorted by key; a shard is a run of whole keys of about SHARD_WORDS words."""
    held: list[pa.Table] = []
    words = 0

    def shard(parts):
        t = pa.concat_tables(parts).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("start", "ascending")]))
        keep = first_windows(t.column("content").combine_chunks())
        return pa.RecordBatch.from_arrays(
            [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
             for c in (t.column("doc_id"), t.column("start"), pa.array(keep))], names=["doc_id", "start", "keep"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, total = np.asarray(batch.column("key")), np.cumsum(np.asarray(batch.column("n")))
        edges = np.flatnonzero(np.diff(key, prepend=key[0])) if len(key) else []
        if held and key[0] != held[-1].column("key")[-1].as_py():
            edges = np.concatenate([[0], edges]).astype(np.int64)
        done = 0
        for e in edges:
            so_far = words + int(total[e - 1] if e else 0) - int(total[done - 1] if done else 0)
            if so_far >= SHARD_WORDS:
                held.append(pa.Table.from_batches([batch.slice(done, e - done)]))
                yield shard(held)
                held, words, done = [], 0, int(e)
        held.append(pa.Table.from_batches([batch.slice(done)]))
        words += int(total[-1] - (total[done - 1] if done else 0))
    if sum(len(t) for t in held):
        yield shard(held)


def _window_task(batches):
    """Each window of a segment as a row of its own."""
    for batch in batches:
        for lo, buf, starts, ends, bounds in _words(batch.column("content")):
            rows = len(bounds) - 1
            first, owner = expand(bounds[:-1], np.maximum(bounds[1:] - WINDOW + 1, bounds[:-1]))
            data, at = joined_words(buf, starts, ends)
            begin = np.asarray(batch.column("start"))[lo : lo + rows]
            yield pa.RecordBatch.from_arrays(
                [slices(data, at[first], at[first + WINDOW] - 1), batch.column("doc_id").take(pa.array(owner + lo)),
                 pa.array((begin[owner] + first - bounds[owner]).astype(np.int32))],
                names=["content", "doc_id", "start"])


def _keep_task(batches):
    """Per document: the words that stay, joined by one space, and the removed word spans."""
    for batch in batches:
        listed = {}
        for name in ("segs", "firsts"):
            col = batch.column(name).fill_null([]) if batch.column(name).null_count else batch.column(name)
            listed[name] = np.asarray(col.offsets), col.values
        so, segs = listed["segs"]
        fo, firsts = listed["firsts"]
        s_start, s_n = np.asarray(segs.field("start")), np.asarray(segs.field("n"))
        f_start, f_keep = np.asarray(firsts.field("start")), np.asarray(firsts.field("keep")).view(K.U64)
        for lo, buf, starts, ends, bounds in _words(batch.column("text")):
            rows = len(bounds) - 1
            gone = np.zeros(len(starts) + 1, bool)  # window starts
            pick, owner = expand(so[lo : lo + rows], so[lo + 1 : lo + rows + 1])
            w = bounds[owner] + s_start[pick]
            each, _ = expand(w, w + s_n[pick] - WINDOW + 1)
            gone[each] = True
            pick, owner = expand(fo[lo : lo + rows], fo[lo + 1 : lo + rows + 1])
            w, bits = bounds[owner] + f_start[pick], f_keep[pick]
            for b in range(MOST_WINDOWS):
                on = (bits >> K.U64(b)) & K.U64(1) == 1
                if on.any():
                    gone[w[on] + b] = False
            edge = np.zeros(len(starts) + 1, np.int64)
            at = np.flatnonzero(gone)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            removed = np.cumsum(edge[:-1]) > 0
            data, offs = joined_words(buf, starts, ends, ~removed)
            row = K.row_of(bounds)
            n_words = np.diff(bounds)
            n_removed = np.bincount(row[removed], minlength=rows)
            last = np.cumsum(n_words - n_removed)
            first = last - (n_words - n_removed)
            kept = slices(data, offs[first], np.maximum(offs[last] - 1, offs[first]))
            begin = removed.copy()
            begin[1:] &= ~(removed[:-1] & (row[1:] == row[:-1]))
            stop = removed.copy()
            stop[:-1] &= ~(removed[1:] & (row[1:] == row[:-1]))
            a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            per = np.concatenate([[0], np.cumsum(np.bincount(row[a], minlength=rows))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(per, pa.StructArray.from_arrays(
                [pa.array(a - bounds[row[a]]), pa.array(b - bounds[row[a]])], names=["begin", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, rows), pa.array(n_words), pa.array(n_removed.astype(np.int64)), spans, kept],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_removed, spans (removed words [begin, end)) and kept_text."""
    K.ship(docs.sparkSession)
    docs = K.keyed_documents(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType
    int_, long_ = T.IntegerType(), T.LongType()

    def schema(**fields):
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    cut = docs.mapInArrow(_segment_task, schema(doc_id=kind, start=int_, n=int_, key=long_, times=long_))
    again = cut.groupBy("key").agg(F.sum("times").alias("times")).where("times > 1")
    again = again.select("key", (F.col("times") > HOT).alias("hot"))
    listed = cut.select("doc_id", "start", "n", "key").join(again, "key")
    listed = listed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key", "hot")).alias("segs"))
    listed = K.written(listed)

    flag = T.BooleanType()
    contents = docs.join(listed, "doc_id").mapInArrow(
        _content_task, schema(key=long_, hot=flag, content=T.StringType(), doc_id=kind, start=int_, n=int_))
    # hot is one value per key; as an aggregate it lets both uses below share one shuffle
    distinct = contents.groupBy("key", "content", "n").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.max("hot").alias("hot"))
    distinct = distinct.select("key", "hot", "content", "n", "first.doc_id", "first.start")

    shards = distinct.where("not hot").select("key", "content", "n", "doc_id", "start")
    found = shards.repartition("key").sortWithinPartitions("key").mapInArrow(
        _shard_task, schema(doc_id=kind, start=int_, keep=long_))
    windows = distinct.where("hot").mapInArrow(_window_task, schema(content=T.StringType(), doc_id=kind, start=int_))
    single = windows.groupBy("content").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    found = found.unionByName(single.select("first.doc_id", "first.start", F.lit(1).cast("long").alias("keep")))

    firsts = found.where("keep != 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "keep")).alias("firsts"))
    span = T.ArrayType(schema(begin=long_, end=long_))
    return docs.join(listed, "doc_id", "left").join(firsts, "doc_id", "left").mapInArrow(
        _keep_task, schema(doc_id=kind, n_words=long_, n_removed=long_, spans=span, kept_text=T.StringType()))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM gone),
kept AS (
  SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.k) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) p ANTI JOIN hit ON p.doc_id = hit.doc_id AND p.k = hit.k
  GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
