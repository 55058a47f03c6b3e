"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents. Its indexed text holds every run of document words that
all occur in the benchmark and that is as long as the shortest window (no occurrence of a window
can lie outside such a run); the FM-index is searched backwards through wavelet-tree ranks for all
benchmark windows at once, occurrences are located by sampled suffix positions, and the spans they
cover are merged per document.

The benchmark is read in blocks of at most ``block_bytes`` of text. One block is the usual case;
each further block is another pass over the documents. Nothing is shuffled.

Defined results: a null or empty text has no words and is clean; an item without id or words names
no window; rows are judged one by one, so a null or repeated doc_id changes nothing; an empty
benchmark leaves all documents clean; further columns pass through untouched unless their names
equal a result column, which replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K
from fleetlens.llm.fmindex import FMIndex, expand

WINDOW = 10
BLOCK_BYTES = 32 << 20

SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    pa.field("items", pa.list_(pa.string())),
]


class Windows:
    """The distinct windows of a block of items: per length a matrix of symbols, and the items
    each window belongs to. Symbols are 1 + the place of a word in the sorted vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        col = pa.array([t for _, t in items], pa.string())
        words: list[np.ndarray] = []
        for _, _, buf, offs in K.text_chunks(col):
            low = K.LOWER[buf]
            starts, ends, bounds = K.word_spans(low, offs, K.ALNUM_WORD)
            h = K.word_hashes(low, starts, ends)
            words += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, K.U64)]))
        owners: dict[tuple[int, ...], set[str]] = {}
        for (item, _), w in zip(items, words):
            s = (np.searchsorted(self.vocabulary, w) + 1).tolist()
            n = min(window, len(s))
            for i in range(len(s) - n + 1 if n else 0):
                owners.setdefault(tuple(s[i : i + n]), set()).add(item)
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(p) for p in owners}):
            mine = [p for p in owners if len(p) == n]
            self.by_length.append((np.array(mine, np.int64), [sorted(owners[p]) for p in mine]))
        self.shortest = min((m.shape[1] for m, _ in self.by_length), default=0)
        self.low_bits = np.zeros(1 << 16, bool)
        self.low_bits[(self.vocabulary & K.U64(0xFFFF)).astype(np.int64)] = True

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words outside the benchmark."""
        out = np.zeros(len(words), np.int64)
        maybe = np.flatnonzero(self.low_bits[(words & K.U64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            place = np.searchsorted(self.vocabulary, words[maybe])
            place[place == len(self.vocabulary)] = 0
            out[maybe] = np.where(self.vocabulary[place] == words[maybe], place + 1, 0)
        return out


def occurrences(symbols: np.ndarray, bounds: np.ndarray, windows: Windows):
    """(first word, length, items) arrays of all occurrences of windows in a shard."""
    if not windows.shortest or not len(symbols):
        return
    inside = symbols > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = bounds[1:-1][bounds[1:-1] < len(symbols)]
    starts[edge] |= inside[edge]
    first = np.flatnonzero(starts)
    stops = ~inside
    stops[edge] = True
    stop = np.append(np.flatnonzero(stops), len(symbols))
    after = stop[np.searchsorted(stop, first, side="right")]
    long = after - first >= windows.shortest
    first, after = first[long], after[long]
    if not len(first):
        return
    word, _ = expand(first, after + 1)  # one slot more than the run: its terminator
    close = np.cumsum(after - first + 1) - 1
    text = symbols[np.minimum(word, len(symbols) - 1)]
    text[close] = 0
    index = FMIndex(text)
    for patterns, items in windows.by_length:
        length = patterns.shape[1]
        which, low, high = index.search(lambda j, w, p=patterns: p[w, j], len(patterns), length)
        rows, owner = expand(low, high)
        if len(rows):
            yield word[index.locate(rows)], length, which[owner], items


def shard_spans(col: pa.Array, windows: Windows) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Words per row, and for rows with occurrences the merged word spans and the items."""
    counts, symbols = [], []
    for _, _, buf, offs in K.text_chunks(col):
        low = K.LOWER[buf]
        starts, ends, bounds = K.word_spans(low, offs, K.ALNUM_WORD)
        counts.append(np.diff(bounds))
        symbols.append(windows.symbols(K.word_hashes(low, starts, ends)))
    n_words = np.concatenate([*counts, np.zeros(0, np.int64)])
    sym = np.concatenate([*symbols, np.zeros(0, np.int64)])
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    cover = np.zeros(len(sym) + 1, np.int64)
    named: dict[int, set[str]] = {}
    for word, length, which, items in occurrences(sym, bounds, windows) or ():
        np.add.at(cover, word, 1)
        np.add.at(cover, word + length, -1)
        rows = np.searchsorted(bounds, word, side="right") - 1
        for row, w in set(zip(rows.tolist(), which.tolist())):
            named.setdefault(row, set()).update(items[w])
    hit = np.cumsum(cover[:-1]) > 0
    found = {}
    for row, items in named.items():
        a, b = bounds[row], bounds[row + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
        found[row] = ([(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2])], items)
    return n_words, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what remains around a cut is joined by a space."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = K.word_spans(K.LOWER[raw], np.array([0, len(raw)]), K.ALNUM_WORD)
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(raw[at : starts[a]].tobytes().decode().strip(" "))
        at = ends[b - 1]
    pieces.append(raw[at:].tobytes().decode().strip(" "))
    return " ".join(p for p in pieces if p)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists of (item, text), each from at most ``block_bytes`` of text (or one item alone)."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    # twice as many blocks as bytes ask for, as a hash deals them a little unevenly
    n = 1 if size <= block_bytes else 2 * -(-size // block_bytes)
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (merged word spans [begin, end) of benchmark text) and items
    (ids, as strings, of the items with occurring windows)."""
    K.ship(docs.sparkSession)
    names = {f.name for f in FOUND}
    out = docs.select(*K.named([c for c in docs.columns if c not in names]))
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        passing = [f for f in out.schema.fields if f.name not in names]
        schema = T.StructType(passing + FOUND)
        out = out.mapInArrow(_search_task(Windows(items, window), text_col, [f.name for f in passing]), schema)
    return out


def _search_task(windows: Windows, text_col: str, passing: list[str]):
    def task(batches):
        for batch in batches:
            n_words, found = shard_spans(batch.column(text_col), windows)
            spans: list = [[]] * batch.num_rows
            items: list = [[]] * batch.num_rows
            if "spans" in batch.schema.names:
                spans = [[(s["begin"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
                items = batch.column("items").to_pylist()
            for row, (more, names) in found.items():
                spans[row] = merge_spans(spans[row] + more)
                items[row] = sorted(names.union(items[row]))
            dicts = [[{"begin": a, "end": b} for a, b in x] for x in spans]
            cols = [batch.column(c) for c in passing]
            cols += [pa.array(v, f.type) for v, f in zip((n_words, dicts, items), _ARROW)]
            yield pa.RecordBatch.from_arrays(cols, names=passing + [f.name for f in _ARROW])
    return task


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with benchmark passages cut out of the texts (columns as in ``docs``); ``n_chars``,
    where there is one, is counted anew for texts that changed."""
    found = find_benchmark(docs, benchmark, text_col, **options)
    columns = [c for c in docs.columns if c in found.columns]

    def task(batches):
        for batch in batches:
            texts, spans = batch.column(text_col), batch.column("spans")
            hit = [i for i, s in enumerate(spans.to_pylist()) if s]
            cols = {c: batch.column(c) for c in columns}
            if hit:
                new = texts.to_pylist()
                for i in hit:
                    new[i] = cut_words(new[i], [(s["begin"], s["end"]) for s in spans[i].as_py()])
                cols[text_col] = pa.array(new, texts.type)
                if "n_chars" in cols:
                    counts = cols["n_chars"].to_pylist()
                    for i in hit:
                        counts[i] = len(new[i])
                    cols["n_chars"] = pa.array(counts, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return found.mapInArrow(task, T.StructType([found.schema[c] for c in columns]))


def digest(found: DataFrame) -> DataFrame:
    """The per-document figures of ``find_benchmark``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM dw CROSS JOIN (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, wins.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos) p
  JOIN wins ON wins.n = p.n AND wins.g = p.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
