"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters and digits and runs of punctuation; a word that repeats the word before
it becomes one special token. A token's bucket (13 hash bits) has a fixed sparse ternary index
vector; its word vector is the sum of the index vectors of its neighbours within two tokens over
the whole corpus, scaled to unit length. A document is the mean of its tokens' vectors and of their
squares. The network (one tanh layer, one logistic unit) is fitted on at most ``SAMPLE`` labelled
documents drawn by hash; a fifth of them sets the temperature that calibrates its probabilities.

Every document counts towards the word vectors. What reaches the driver is bounded: 2^13 word
vectors and the sample's pooled vectors. Labels are learned only where crc32(doc_id) mod 4 isn't 2.

Defined results: a null or empty text has the zero vector and gets a score like any other; a
document labelled both ways counts as label 0; labels without id or value are ignored; with no
labels, or labels of one kind, the score is 0.5 or that kind's share; rows are scored one by one,
so null or repeated ids change nothing (a null id isn't held out); further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K

BUCKET_BITS = 13
DIMENSIONS = 32
NONZERO = 2
REACH = 2
SAMPLE = 20_000
HIDDEN = 24
THRESHOLD = 0.7
SEED = 7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VISIBLE = K.PLAIN_WORD & (np.arange(256) > 0x20) & (np.arange(256) != 0x7F)


def tokens(col: pa.Array):
    """Per chunk: the bucket of every token and the per-row token bounds. Bucket 0 marks repeats."""
    for _, _, buf, offs in K.text_chunks(col):
        letter = _LETTER[buf]
        # letters and punctuation are found apart, so that a run ends where the kind changes
        spans = [K.word_spans(buf, offs, t) for t in (_LETTER, _VISIBLE & ~_LETTER)]
        starts = np.concatenate([spans[0][0], spans[1][0]])
        ends = np.concatenate([spans[0][1], spans[1][1]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        bounds = np.searchsorted(starts, offs)
        h = K.word_hashes(buf, starts, ends)
        bucket = (h >> K.U64(64 - BUCKET_BITS)).astype(np.int64)
        row = K.row_of(bounds)
        word = letter[starts] if len(starts) else np.zeros(0, bool)
        for back in (1, 2):
            same = np.zeros(len(h), bool)
            same[back:] = (h[back:] == h[:-back]) & (row[back:] == row[:-back]) & word[back:]
            bucket[same] = 0
        yield bucket, bounds


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    n = 1 << BUCKET_BITS
    places = np.argsort(rng.random((n, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (n, NONZERO))


def _context_task(batches):
    """Sums of neighbours' index vectors for each bucket met in the partition."""
    places, signs = index_vectors()
    n = 1 << BUCKET_BITS
    total = np.zeros(n * DIMENSIONS)
    for batch in batches:
        for bucket, bounds in tokens(batch.column("text")):
            row = K.row_of(bounds)
            for reach in range(1, REACH + 1):
                near = np.flatnonzero(row[reach:] == row[:-reach])
                left, right = bucket[near], bucket[near + reach]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], minlength=n * DIMENSIONS)
    sums = total.reshape(n, DIMENSIONS)
    met = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(met.astype(np.int32)), *(pa.array(sums[met, d]) for d in range(DIMENSIONS))],
        names=["bucket", *(f"v{d}" for d in range(DIMENSIONS))])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets, from every text of the corpus."""
    dims = [f"v{d}" for d in range(DIMENSIONS)]
    sums = texts.mapInArrow(_context_task, "bucket int, " + ", ".join(f"{d} double" for d in dims))
    table = sums.groupBy("bucket").agg(*(F.sum(d).alias(d) for d in dims)).toPandas()  # at most 2^13 rows
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS))
    out[table["bucket"].to_numpy(np.int64)] = table[dims].to_numpy()
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and mean square of the token vectors, one row per text."""
    both = np.hstack([vectors, vectors**2])
    parts = [np.zeros((0, both.shape[1]))]
    for bucket, bounds in tokens(col):
        n = np.diff(bounds)
        out = np.zeros((len(n), both.shape[1]))
        some = n > 0
        if some.any():
            out[some] = np.add.reduceat(both[bucket], bounds[:-1][some], axis=0) / n[some, None]
        parts.append(out)
    return np.concatenate(parts)


@dataclass
class Network:
    """Standardised input, tanh layer, logistic unit, temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the rest sets the temperature."""
    rng = np.random.default_rng(SEED)
    mean = x.mean(axis=0) if len(x) else np.zeros(2 * DIMENSIONS)
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(2 * DIMENSIONS)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.b2 = float(np.log(share / (1 - share)))
        return net
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean) / scale
    state = [np.zeros_like(np.asarray(p)) for p in (net.w1, net.b1, net.w2, net.b2) for _ in range(2)]
    step = 0
    for _ in range(epochs):
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -50, 50)))
            d = (p - y[rows]) / len(rows)
            back = np.outer(d, net.w2) * (1 - h**2)
            step += 1
            for k, (name, g) in enumerate((("w1", z[rows].T @ back + 1e-4 * net.w1), ("b1", back.sum(0)),
                                           ("w2", h.T @ d + 1e-4 * net.w2), ("b2", d.sum()))):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g**2
                move = state[2 * k] / (1 - 0.9**step) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - 0.01 * move)
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """Network fitted on at most ``sample`` labelled, not held-out documents."""
    known = labels.select("doc_id", F.col("quality").alias("label")).dropna().where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def task(batches):
        for batch in batches:
            rows = pooled(batch.column("text"), vectors)
            flat = pa.array(rows.ravel())
            offs = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(offs, flat)],
                                             names=["doc_id", "label", "x"])

    joined = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sorted(joined.mapInArrow(task, schema).collect(), key=lambda r: (r[0], r[2]))
    x = np.array([r[2] for r in rows]).reshape(len(rows), 2 * DIMENSIONS)
    return fit(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (probability of label 1) and predicted."""
    K.ship(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vectors = word_vectors(docs.select("text"))
    net = train(docs, labels, vectors)

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(net.scores(pooled(batch.column("text"), vectors)))], names=["doc_id", "score"])

    scored = docs.mapInArrow(task, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
