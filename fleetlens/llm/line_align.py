"""Line dedup by pairwise alignment.

1. Runs of whole lines are hashed (words only; white space aside): from every line on, and back
   from every line, the shortest run of ``BLOCK_WORDS`` words, be it one line or many short ones.
   Each later document is paired with the first holder (the smallest doc_id) of each of its runs:
   one pair per run and document however many share it. Every line of a block of that many words
   that an earlier document holds lies in a run inside the block, and the run's first holder holds
   the run, so no cap on frequent lines and no other pair of a group is needed.
2. Each pair is aligned with patience diff over all its lines, short ones included: common ends,
   then lines unique in both, in longest increasing order, then the gaps between them again.
3. Aligned blocks (runs of lines that follow one another in both documents) of at least
   ``BLOCK_WORDS`` words are deleted from the later document, and so are shared runs that the
   alignment misses because they moved or are not unique. Documents are judged as they came in,
   not as earlier deletions leave them.
4. With ``most``, a shorter line that is held by more documents than that is a block of its own,
   deleted from each but its first holder. A line without words never is. Shorter lines that fewer
   documents hold stay unless they lie in a block.

Defined results: a null or empty text has one empty line and loses nothing; in ``repeated_lines``
a row without doc_id is left out and rows that share a doc_id are one document with the largest of
their texts; ``dedup_lines`` keeps rows without doc_id unchanged and one row per doc_id; an empty
table gives an empty result; further columns pass through ``dedup_lines``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K

BLOCK_WORDS = 12
LINE_DOCS = 6  # the queries delete shorter lines that more documents hold than these

_STEP = 0xD1342543DE82EF95


def run_keys(keys: np.ndarray, at: np.ndarray, bounds: np.ndarray):
    """Hashes of the shortest runs of whole lines with ``BLOCK_WORDS`` words, and per-row bounds.

    Each line with words starts one such run and ends one, as far as its row reaches. A line of a
    block with that many words lies in a run that is inside the block too."""
    n = len(keys)
    row = K.row_of(bounds)
    first, last = bounds[:-1][row], bounds[1:][row]
    some = np.diff(at) > 0
    stop = np.searchsorted(at, at[:-1] + BLOCK_WORDS)
    ahead = np.flatnonzero(some & (stop <= last))
    start = np.searchsorted(at, at[1:] - BLOCK_WORDS, side="right") - 1
    back = np.flatnonzero(some & (start >= first))
    back = back[stop[start[back]] != back + 1]  # not the runs that are met from their start
    begin, end = np.concatenate([ahead, start[back]]), np.concatenate([stop[ahead], back + 1])
    up = K._power_table("line_up", _STEP, n + 1)
    down = K._power_table("line_down", pow(_STEP, -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, K.U64)
    np.cumsum(keys * up[:n], out=sums[1:])
    runs = K.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(K.U64))
    order = np.argsort(begin, kind="stable")
    return runs[order], np.searchsorted(begin[order], bounds)


def line_keys(col: pa.Array):
    """Per chunk: first row, rows, line hashes, words per line, per-row line bounds, run hashes,
    per-row run bounds."""
    for lo, hi, buf, offs in K.text_chunks(col):
        starts, ends, _ = K.word_spans(buf, offs, K.PLAIN_WORD)
        words = K.word_hashes(buf, starts, ends)
        # a line begins at a row's start and after each newline
        rows = hi - lo
        breaks = np.flatnonzero(buf == 0x0A)
        begins = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
        owner = np.searchsorted(breaks, offs)  # newlines before each row's start
        bounds = owner + np.arange(rows + 1)
        at = np.append(np.searchsorted(starts, begins), len(starts))
        at[:-1] = np.minimum(at[:-1], len(starts))
        n = len(words)
        up = K._power_table("line_up", _STEP, n + 1)
        down = K._power_table("line_down", pow(_STEP, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, K.U64)
        np.cumsum(words * up[:n], out=sums[1:])
        count = np.diff(at)
        keys = K.mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + count.astype(K.U64))
        runs, run_bounds = run_keys(keys, at, bounds)
        yield lo, rows, keys.view(np.int64), count, bounds, runs.view(np.int64), run_bounds


def _lines_task(batches):
    for batch in batches:
        for lo, rows, keys, count, bounds, runs, run_bounds in line_keys(batch.column("text")):
            offs = pa.array(bounds.astype(np.int32))
            run_offs = pa.array(run_bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, rows), pa.ListArray.from_arrays(offs, pa.array(keys)),
                 pa.ListArray.from_arrays(offs, pa.array(count.astype(np.int32))),
                 pa.ListArray.from_arrays(run_offs, pa.array(runs))], names=["doc_id", "keys", "words", "runs"])


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (i, j) of a patience diff of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        place: dict = {}
        for x in range(i, i2):
            place[a[x]] = -1 if a[x] in place else x
        other: dict = {}
        for y in range(j, j2):
            other[b[y]] = -1 if b[y] in other else y
        unique = [(place[k], y) for k, y in other.items() if y >= 0 and place.get(k, -1) >= 0]
        # longest increasing run of the first document's positions, in the second's order
        tails: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (x, _) in enumerate(unique):
            k = bisect_left(tails, x)
            back.append(piles[k - 1] if k else -1)
            tails[k : k + 1], piles[k : k + 1] = [x], [n]
        chain, n = [], piles[-1] if piles else -1
        while n >= 0:
            chain.append(unique[n])
            n = back[n]
        if chain:
            edges = [(i - 1, j - 1), *reversed(chain), (i2, j2)]
            out += chain
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


def shortest_runs(words: list, least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """[begin, end) of the runs of ``run_keys``, from the words of each line."""
    at = [0]
    for w in words:
        at.append(at[-1] + w)
    n = len(words)
    spans = {(i, b) for i in range(n) if words[i] and (b := bisect_left(at, at[i] + least)) <= n}
    spans |= {(a, j + 1) for j in range(n) if words[j] and (a := bisect_right(at, at[j + 1] - least) - 1) >= 0}
    return sorted(spans)


def common_blocks(earlier: list, later: list, words: list, least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """[begin, end) line blocks of ``later`` that hold at least ``least`` words and are aligned, or
    that ``earlier`` holds in another place than the alignment has them."""
    blocks: list[list[int]] = []
    for i, j in patience(earlier, later):
        if blocks and blocks[-1][1] == j and blocks[-1][2] == i:
            blocks[-1][1:] = [j + 1, i + 1]
        else:
            blocks.append([j, j + 1, i + 1])
    found = [(a, b) for a, b, _ in blocks if sum(words[a:b]) >= least]
    gone = {n for a, b in found for n in range(a, b)}
    both = set(earlier)
    moved = [(a, b) for a, b in shortest_runs(words, least)
             if not gone.issuperset(range(a, b)) and both.issuperset(later[a:b])]
    if moved:
        size = dict(zip(later, words))
        held = {tuple(earlier[a:b]) for a, b in shortest_runs([size.get(k, least) for k in earlier], least)}
        found += [(a, b) for a, b in moved if tuple(later[a:b]) in held]
    return found


SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _align_task(batches):
    for batch in batches:
        found = []
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            for a, b, w in zip(*(part.column(c).to_pylist() for c in ("earlier_keys", "keys", "words"))):
                found.append([{"begin": x, "end": y} for x, y in common_blocks(a, b, w)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("earlier"), pa.array(found, _SPAN)],
                                         names=["doc_id", "earlier", "blocks"])


def lined_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, keys, words, runs): line hashes, words per line and run hashes of keyed documents."""
    return K.written(docs.mapInArrow(_lines_task, T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("runs", T.ArrayType(T.LongType()))])))


def aligned_pairs(lined: DataFrame) -> DataFrame:
    """(doc_id, earlier, blocks) for every document and first holder of one of its runs."""
    kind = lined.schema["doc_id"].dataType
    runs = lined.select("doc_id", F.explode("runs").alias("key"))
    first = runs.groupBy("key").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last"))
    # written first, so that the join on a run has plain exchanges and a hot run can be split
    first = K.written(first.where("earlier < last").select("key", "earlier"))
    pairs = runs.join(first, "key").where("doc_id != earlier").select("doc_id", "earlier").distinct()
    held = lined.select(F.col("doc_id").alias("earlier"), F.col("keys").alias("earlier_keys"))
    pairs = pairs.join(held, "earlier").join(lined, "doc_id").select("doc_id", "earlier", "earlier_keys", "keys", "words")
    return pairs.mapInArrow(_align_task, T.StructType(
        [T.StructField("doc_id", kind), T.StructField("earlier", kind), T.StructField("blocks", SPAN)])).where(F.size("blocks") > 0)


def frequent_lines(lined: DataFrame, most: int) -> DataFrame:
    """(doc_id, earlier, blocks) for every line of fewer than ``BLOCK_WORDS`` words, but at least
    one, that over ``most`` documents hold: a block of its own in each after the first holder."""
    short = (F.col("line.words") > 0) & (F.col("line.words") < BLOCK_WORDS)
    every = F.arrays_zip("keys", "words")
    lines = lined.select("doc_id", F.posexplode(every).alias("n", "line")).where(short).select(
        "doc_id", "n", F.col("line.keys").alias("key"))
    held = lined.select("doc_id", F.explode(F.array_distinct(every)).alias("line")).where(short)
    held = held.groupBy(F.col("line.keys").alias("key")).agg(F.min("doc_id").alias("earlier"), F.count("*").alias("documents"))
    held = K.written(held.where(F.col("documents") > most).select("key", "earlier"))
    return lines.join(held, "key").where("doc_id != earlier").select(
        "doc_id", "earlier", F.array(F.struct(F.col("n").alias("begin"), (F.col("n") + 1).alias("end"))).alias("blocks"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """Per document with deleted lines: doc_id, earlier (sorted ids of the documents that hold them)
    and blocks (sorted [begin, end) line spans, which may overlap)."""
    K.ship(docs.sparkSession)
    lined = lined_documents(K.keyed_documents(docs, id_col, text_col))
    found = aligned_pairs(lined)
    if most is not None:
        found = found.unionByName(frequent_lines(lined, most))
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("earlier")).alias("earlier"),
        F.sort_array(F.flatten(F.collect_set("blocks"))).alias("blocks"))


def cut_lines(text: str, blocks: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the blocks, and how many lines went."""
    lines = text.split("\n")
    gone = {n for a, b in blocks for n in range(a, b)}
    return "\n".join(s for n, s in enumerate(lines) if n not in gone), len(gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """``docs`` with repeated blocks deleted from ``text_col``, n_lines, n_removed_lines and
    earlier; ``n_chars``, where there is one, is counted anew for texts that changed. With ``most``,
    lines that more documents hold go too (``frequent_lines``)."""
    made = {"n_lines": T.LongType(), "n_removed_lines": T.LongType(), "earlier": T.ArrayType(docs.schema[id_col].dataType)}
    own = [c for c in docs.columns if c not in made]
    docs = K.one_row_per_id(docs.select(*K.named(own)), id_col, text_col)
    found = repeated_lines(docs, id_col, text_col, most).select(
        F.col("doc_id").alias("__id"), F.col("earlier").alias("__earlier"), F.col("blocks").alias("__blocks"))
    schema = T.StructType([*(docs.schema[c] for c in own), *(T.StructField(k, v) for k, v in made.items())])

    def task(batches):
        for batch in batches:
            cols = {c: batch.column(c) for c in own}
            lines = pc.add(pc.count_substring(cols[text_col].fill_null(""), "\n"), 1).cast(pa.int64())
            hit = np.flatnonzero(batch.column("__blocks").is_valid())
            removed = np.zeros(batch.num_rows, np.int64)
            if len(hit):
                texts = cols[text_col].to_pylist()
                counts = cols["n_chars"].to_pylist() if "n_chars" in own else None
                for i in hit.tolist():
                    spans = [(s["begin"], s["end"]) for s in batch.column("__blocks")[i].as_py()]
                    texts[i], removed[i] = cut_lines(texts[i], spans)
                    if counts:
                        counts[i] = len(texts[i])
                cols[text_col] = pa.array(texts, cols[text_col].type)
                if counts:
                    cols["n_chars"] = pa.array(counts, cols["n_chars"].type)
            empty = pa.array([[]] * batch.num_rows, batch.column("__earlier").type)
            yield pa.RecordBatch.from_arrays(
                [*cols.values(), lines, pa.array(removed), pc.coalesce(batch.column("__earlier"), empty)],
                names=[*own, *made])

    return docs.join(found, docs[id_col] == found["__id"], "left").mapInArrow(task, schema)
