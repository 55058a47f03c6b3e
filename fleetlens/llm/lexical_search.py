"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of a block of items form one automaton, sent to every task; each pattern is a term
between two guard spaces, so only whole terms match. Documents are lower-cased (A-Z), every byte that is no
term byte becomes a space, and one scan of the text gives term frequencies: no index of the
documents is made. Three steps:

1. scan: per document its length in terms, and the item terms in it with their frequencies (written);
2. statistics: N, L and the document frequency of every item term, by grouped sums over the scan;
3. scores: the automaton's outputs map a term to its items, integer scores are added per (document,
   item) in slabs of documents, each task keeps its best ``k`` per item, and two windows (items by
   task groups, then items) keep the best of those.

A block holds at most ``block_terms`` (item, term) entries or one item; each further block scans the
documents again. What reaches the driver are a block's terms, their weights and two numbers.

Score: w = floor(1000 ln((2N+2)/(2df+1))), m = 25 + (75 n N) div L; the sum over an item's terms,
repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)), in 64-bit integers.

Defined results: a null or empty text has no terms and is no document for N; rows are judged one by
one, so rows that share a doc_id are documents of their own, and rows without doc_id count in the
statistics but are never returned; items without id, text or terms give no rows, items that share an
id are one item with all their terms; equal scores go by ascending doc_id; empty tables give no
rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import textkit as K

TOP = 10
BLOCK_TERMS = 1 << 17

# Cells of a slab of scores, and task groups of the first of the two windows.
SLAB_CELLS = 1 << 19
GROUPS = 64


def guarded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and a space for every byte that is no term byte."""
    low = K.LOWER[buf]
    return np.where(K.ALNUM_WORD[low], low, np.uint8(0x20))


def terms_of(text: str) -> list[str]:
    return guarded(np.frombuffer(text.encode(), np.uint8)).tobytes().decode().split(" ") if text else []


_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Aho-Corasick automaton of the terms between guards; its outputs are places in ``terms``.
    The last one built is kept by the worker, as many tasks use it."""
    name = hashlib.sha256("\n".join(terms).encode()).hexdigest()
    if name not in _automata:
        built = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            built.add_word(f" {term} ", place)
        built.make_automaton()
        _automata.clear()
        _automata[name] = built
    return _automata[name]


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[dict[str, Counter]]:
    """Blocks of {item id as text: its terms with repeats}."""
    words = F.regexp_extract_all(F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                 F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    rows = items.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).dropna()
    size = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    # twice as many blocks as terms ask for, as a hash deals the items a little unevenly
    n = 1 if size <= block_terms else 2 * -(-size // block_terms)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        found: dict[str, Counter] = defaultdict(Counter)
        for item, terms in part.collect():
            found[item].update(terms)
        yield {item: c for item, c in sorted(found.items()) if c}


def scan(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with terms: doc, n (terms with repeats), and the sorted places of the terms of
    ``terms`` in it with their frequencies tf."""
    K.ship(docs.sparkSession)

    def task(batches):
        found = automaton(terms)
        scanned = found.iter if terms else lambda text: ()
        for batch in batches:
            n, places, tfs, sizes = [], [], [], []
            for _, _, buf, offs in K.text_chunks(batch.column(1)):
                low = guarded(buf)
                n.append(np.diff(K.word_spans(low, offs, K.ALNUM_WORD)[2]))
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    tf = Counter(map(itemgetter(1), scanned(f" {low[a:b].tobytes().decode()} ")))
                    order = sorted(tf)
                    places += order
                    tfs += [tf[p] for p in order]
                    sizes.append(len(order))
            n = np.concatenate([*n, np.zeros(0, np.int64)])
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((places, pa.int32()), (tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc", "n", "place", "tf"])
            yield out.filter(pa.array(n > 0))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        task, f"doc {kind}, n long, place array<int>, tf array<long>")


def weights(scanned: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the weight of every term (one number per item term of the block)."""
    n_docs, length = scanned.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for place, count in scanned.select(F.explode("place").alias("place")).groupBy("place").count().collect():
        df[place] = count
    w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    return n_docs, length, np.array(w, np.int64)


def best_rows(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of every item, by descending score and ascending doc."""
    order = np.lexsort((doc, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)
    return order[np.arange(len(item)) - first < k]


def score_slab(n: np.ndarray, sizes: np.ndarray, place: np.ndarray, tf: np.ndarray, stats: tuple[int, int],
               w: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], n_items: int) -> np.ndarray:
    """Scores (documents x items) of a slab of documents."""
    n_docs, length = stats
    begin, item, repeats = postings
    m = 25 + (75 * n * n_docs) // length
    row = np.repeat(np.arange(len(n)), sizes)
    part = w[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    fan = begin[place + 1] - begin[place]
    at = np.repeat(begin[place] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
    out = np.zeros((len(n), n_items), np.int64)
    np.add.at(out, (np.repeat(row, fan), item[at]), np.repeat(part, fan) * repeats[at])
    return out


def best_of(scanned: DataFrame, found: dict[str, Counter], terms: list[str], k: int) -> DataFrame:
    """The best ``k`` documents of every item of a block: item (text), doc, score, rank."""
    names = list(found)
    place_of = {t: p for p, t in enumerate(terms)}
    entries = sorted((place_of[t], i, q) for i, name in enumerate(names) for t, q in found[name].items())
    cols = np.array(entries, np.int64).reshape(-1, 3).T
    postings = (np.searchsorted(cols[0], np.arange(len(terms) + 1)), cols[1], cols[2])
    n_docs, length, w = weights(scanned, len(terms))
    slab = max(1, SLAB_CELLS // max(1, len(names)))

    def task(batches):
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            doc, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            ends = np.cumsum([0, *sizes])
            place, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            for a in range(0, len(doc), slab):
                b = min(len(doc), a + slab)
                part = slice(ends[a], ends[b])
                scores = score_slab(n[a:b], sizes[a:b], place[part].astype(np.int64), tf[part], (n_docs, length), w, postings, len(names))
                row, item = np.nonzero(scores)
                cand = [item, doc[a:b][row], scores[row, item]]
                cand = [np.concatenate([x, y]) for x, y in zip(kept, cand)]
                best = best_rows(*cand, k)
                kept = [x[best] for x in cand]
        item = pa.array([names[i] for i in kept[0].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([item, pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64())], names=["item", "doc", "score"])

    best = scanned.where("doc IS NOT NULL").mapInArrow(task, "item string, doc long, score long")
    order = [F.col("score").desc(), F.col("doc").asc()]
    group = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(GROUPS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents with a score of every item."""
    out = None
    for found in item_blocks(items, item_col, item_text_col, block_terms):
        if not found and out is not None:
            continue
        terms = sorted(set().union(*found.values()))
        best = best_of(K.written(scan(docs, terms, id_col, text_col)), found, terms, k)
        out = best if out is None else out.unionByName(best)
    kind = items.schema[item_col].dataType
    return out.select(F.col("item").cast(kind).alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, t, count(*) AS q FROM b GROUP BY ALL),
st AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d WHERE len(ws) > 0),
tf AS (
  SELECT doc_id, n, t, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), st),
s AS (
  SELECT q.item_id, tf.doc_id,
         CAST(sum(q.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t), st GROUP BY ALL),
r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
