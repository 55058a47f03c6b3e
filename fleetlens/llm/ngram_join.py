"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct five-word shingles. All shingles have one global order: by
corpus frequency (counted over all documents in 2^20 hash buckets), then by hash. The order is cut
into fragments of equal mass.

1. Documents with equal sets form a class; its smallest doc_id stands for it.
2. Two sets of at least 75 % Jaccard share a shingle among the rarest n - ceil(0.75 n) + 1 of each
   (their rare end of the order), so only entries that meet there make candidates; sizes and the
   places where two sets first meet rule out pairs whose rest can't hold the overlap.
3. A candidate pair's overlap is counted fragment by fragment, and the partial counts are summed
   per pair; the sum decides exactly.
4. The classes that meet in one entry are first compared with one leader. Where links leave the
   entry in different components, a small entry's classes are then compared with one another and, in
   the same pass, those of a larger one with a randomly drawn leader; while this lasts, the latter
   with 4, 16 and 16 more. Only classes that still are in different components are compared with one
   another, so a group of near copies costs linear work and no link that joins two components is lost.
5. Components of the links, by star contraction.

Set identity is by 64-bit shingle hashes (128 bits for whole sets).

Defined results: a null, empty or wordless text has an empty set and is linked with nothing; fewer
than five words are one shingle; a row without doc_id is left out and rows that share a doc_id are
one document with the largest of their texts; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K
from fleetlens.llm.graph import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
ORDER_BITS = 20
PIECES = 64  # parts of the count table that are summed apart
FRAGMENTS = 8
ASKED_BITS = 24
TURNS = [1, 4, 16, 16]  # leaders per larger entry, drawn at random, in the rounds after the first
FEW = 32  # classes of an entry that needs no such rounds


def shingle_sets(col: pa.Array, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    for _, _, buf, offs in K.text_chunks(col):
        low = K.LOWER[buf]
        starts, ends, bounds = K.word_spans(low, offs, K.PLAIN_WORD)
        words = K.word_hashes(low, starts, ends)
        grams = K.gram_hashes(words, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield K.mix(K.gram_hashes(words[a:b], b - a) + K.U64(b - a))
            else:
                yield grams[:0]


def _count_task(batches):
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for s in shingle_sets(batch.column("text")):
            np.add.at(counts, (s >> K.U64(64 - ORDER_BITS)).astype(np.int64), 1)
    yield from _count_rows(counts.reshape(PIECES, -1))


def _count_rows(pieces: np.ndarray):
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "counts"])


def _sum_task(batches):
    """Sum of the count arrays of each piece that came to this partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
            have = np.frombuffer(counts.as_py(), np.int64)
            sums[piece] = sums[piece] + have if piece in sums else have
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["piece", "counts"])


class Order:
    """The global shingle order: corpus count of the hash bucket, then the hash."""

    def __init__(self, docs: DataFrame):
        parts = docs.select("text").mapInArrow(_count_task, "piece int, counts binary").repartition("piece")
        # PIECES rows of 2^ORDER_BITS counts in all, whatever the size of the corpus
        sums = {r["piece"]: np.frombuffer(r["counts"], np.int64) for r in parts.mapInArrow(_sum_task, parts.schema).collect()}
        counts = np.concatenate([sums[p] for p in sorted(sums)]) if sums else np.zeros(1 << ORDER_BITS, np.int64)
        by_rank = np.argsort(counts, kind="stable")
        mass = np.cumsum(counts[by_rank])
        self.counts = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
        self.fragments = np.zeros(1 << ORDER_BITS, np.int8)
        self.fragments[by_rank] = np.minimum((mass - 1) * FRAGMENTS // max(1, int(mass[-1])), FRAGMENTS - 1)

    def _bucket(self, s: np.ndarray) -> np.ndarray:
        return (s >> K.U64(64 - ORDER_BITS)).astype(np.int64)

    def rare_end(self, s: np.ndarray) -> np.ndarray:
        """The first n - ceil(0.75 n) + 1 shingles of a sorted set, in the global order."""
        keep = len(s) - -(-NUMERATOR * len(s) // DENOMINATOR) + 1
        return s[np.argsort(self.counts[self._bucket(s)], kind="stable")[:keep]] if len(s) else s

    def slices(self, s: np.ndarray):
        """(fragment, shingles) of a set."""
        f = self.fragments[self._bucket(s)]
        order = np.argsort(f, kind="stable")
        f, s = f[order], s[order]
        cuts = np.flatnonzero(np.diff(f, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(f)).tolist()):
            yield int(f[a]), s[a:b]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, K.U64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def _packed(parts: list[np.ndarray]) -> pa.Array:
    """The low 40 bits of each shingle, five bytes each: within one pair and fragment, different
    shingles agree in them about once in 10^8 pairs, and a slice shrinks by three eighths."""
    offs = np.concatenate([[0], np.cumsum([5 * len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, K.U64)]).view(np.uint8).reshape(-1, 8)[:, :5]
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))])


def _overlap_task(batches):
    """Partial overlap of the two slices of each row."""
    def unpack(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
        return wide.view(K.U64).ravel()

    for batch in batches:
        part = [len(np.intersect1d(unpack(x), unpack(y))) for x, y in zip(*(batch.column(c).to_pylist() for c in ("ga", "gb")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(part, pa.int64())],
                                         names=["a", "b", "na", "nb", "part"])


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    one, two = np.add.reduce(K.mix(s)), np.add.reduce(K.mix(s ^ K.U64(0x5851F42D4C957F2D)))
    return int(one.view(np.int64)), int(two.view(np.int64))


def _set_task(shared):
    """doc_id, n, s1, s2 (the set's signature) and the set's rare end in the broadcast order."""
    def task(batches):
        order = shared.value
        for batch in batches:
            n, one, two, rare = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                a, b = _signature(s)
                n.append(len(s)), one.append(a), two.append(b), rare.append(order.rare_end(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, one, two)), _lists(rare)],
                names=["doc_id", "n", "s1", "s2", "rare"])
    return task


def _slice_task(shared, shared_asked):
    """Slices of the sets whose id hash is among the asked ones (see ``_asked``)."""
    def task(batches):
        order, asked = shared.value, shared_asked.value
        for batch in batches:
            at = np.asarray(batch.column("at"))
            batch = batch.filter(pa.array((asked[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            row, n, f, parts = [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column("text"))):
                for fragment, part in order.slices(s):
                    row.append(i), n.append(len(s)), f.append(fragment), parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(n, pa.int64()),
                 pa.array(f, pa.int32()), _packed(parts)], names=["doc_id", "n", "f", "grams"])
    return task


def _hashed(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << ASKED_BITS))


def _asked(pairs: DataFrame) -> np.ndarray:
    """Bit set of 2^ASKED_BITS id hashes that occur in the pairs. It has a fixed size and only
    spares the other documents the way to the join; when it fills up it spares fewer."""
    at = pairs.select(F.explode(F.array(_hashed("a"), _hashed("b"))).alias("at"))
    word = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    table = word.toArrow()  # at most 2^ASKED_BITS / 64 rows
    out = np.zeros((1 << ASKED_BITS) // 64, np.int64)
    out[table["w"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint8)


def _verified(pairs: DataFrame, docs: DataFrame, order) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over the fragments, reaches the threshold (written)."""
    asked = docs.sparkSession.sparkContext.broadcast(_asked(pairs))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()),
                           T.StructField("f", T.IntegerType()), T.StructField("grams", T.BinaryType())])
    slices = docs.withColumn("at", _hashed("doc_id")).mapInArrow(_slice_task(order, asked), schema)
    left = slices.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "f", F.col("grams").alias("ga"))
    right = slices.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "f", F.col("grams").alias("gb"))
    parts = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("f"))
    parts = parts.hint("merge").join(left, ["a", "f"]).hint("merge").join(right, ["b", "f"])
    counted = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *(T.StructField(c, T.LongType()) for c in ("na", "nb", "part"))])
    parts = parts.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_overlap_task, counted)
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    links = K.written(total.where(F.col("both") * DENOMINATOR >= (F.col("na") + F.col("nb") - F.col("both")) * NUMERATOR).select("a", "b"))
    asked.unpersist()
    return links


def _can_link(n: str, i: str, m: str, j: str) -> str:
    """Whether sets of n and m shingles that first meet at places i and j of the order can link:
    what is left of both must hold the least overlap, 75 / 175 of n + m."""
    least = f"{NUMERATOR} * ({n} + {m})"
    return (f"{NUMERATOR} * greatest({n}, {m}) <= {DENOMINATOR} * least({n}, {m}) and "
            f"{NUMERATOR + DENOMINATOR} * ({n} - {i}) >= {least} and {NUMERATOR + DENOMINATOR} * ({m} - {j}) >= {least}")


def _split_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (h, doc, n, i, c) whose classes the labels leave in different components, with comp."""
    named = entries.join(labels.hint("merge"), entries["doc"] == labels["node"], "left").select(
        "h", "doc", "n", "i", "c", F.coalesce("component", "doc").alias("comp"))
    mixed = named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("h")
    return K.written(named.join(mixed.hint("merge"), "h"))


def _leaders(split: DataFrame, turn: int, leaders: int) -> DataFrame:
    """Per entry, ``leaders`` of its classes (not all different), each the first under a hash of its own."""
    one = [F.min(F.struct(F.xxhash64("doc", "h", F.lit(turn), F.lit(k)).alias("x"), "doc", "comp", "n", "i")) for k in range(leaders)]
    return split.groupBy("h").agg(F.array_distinct(F.transform(F.array(*one), lambda e: e.dropFields("x"))).alias("leads"))


def _drawn(split: DataFrame, turn: int, leaders: int) -> DataFrame:
    """Classes and those leaders (doc, other) of their split entries that they can link, in different components."""
    lead = K.written(_leaders(split, turn, leaders))
    fit = f"filter(leads, lead -> comp != lead.comp and {_can_link('n', 'i', 'lead.n', 'lead.i')})"
    met = split.join(lead.hint("merge"), "h").select("doc", F.explode(F.expr(fit)).alias("lead"))
    return met.select("doc", F.col("lead.doc").alias("other"))


def _more(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links; those so far enter as stars, which nearly are the result."""
    return components(links.unionByName(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def _rest(split: DataFrame) -> DataFrame:
    """Two classes each (doc, other) of the split entries that can link, in different components."""
    size = split.groupBy("h", "comp").agg(F.count("*").alias("c"))
    major = size.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("major")).select("h", F.col("major.comp").alias("major"))
    x = split.join(major.hint("merge"), "h").where("comp != major")
    y = split.select("h", *(F.col(c).alias(c + "2") for c in ("doc", "n", "i", "comp")))
    rest = x.hint("merge").join(y, "h").where(
        "comp != comp2 and (comp2 = major or doc < doc2) and " + _can_link("n", "i", "n2", "i2"))
    return rest.select("doc", F.col("doc2").alias("other"))


def _pairs(met: DataFrame, x: str, y: str) -> DataFrame:
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, class_id (smallest doc_id with an equal set) and component_id."""
    K.ship(docs.sparkSession)
    with K.small_partitions(docs.sparkSession):
        return _near_classes(docs, id_col, text_col)


def _near_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = K.keyed_documents(docs, id_col, text_col)
    kind, long_ = docs.schema["doc_id"].dataType, T.LongType()
    # sent once for all steps (5 MB whatever the corpus), not with every task's closure
    order = docs.sparkSession.sparkContext.broadcast(Order(docs))
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, long_) for c in ("n", "s1", "s2"))]

    # Written with the rare ends (their bytes are about half the input's), so that the texts are read
    # for the sets once; signatures and classes are also what the result is made of.
    sets = K.written(docs.mapInArrow(_set_task(order), T.StructType([*fields, T.StructField("rare", T.ArrayType(long_))])))
    classes = K.written(sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc")))
    entries = sets.join(classes.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(
        "n", F.col("doc_id").alias("doc"), F.posexplode("rare").alias("i", "h"))
    shared = K.written(entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    entries = K.written(entries.join(shared.hint("merge"), "h").select("h", "doc", "n", "i", "c"))

    # Leaders are written first, so that a join on a hot entry has plain exchanges that can be split.
    # All these tables grow with the documents: none is broadcast, however small it is now.
    lead = K.written(entries.groupBy("h").agg(F.min(F.struct("doc", "n", "i")).alias("lead")))
    first = entries.join(lead.hint("merge"), "h").where("doc != lead.doc and " + _can_link("n", "i", "lead.n", "lead.i"))
    pairs = K.written(_pairs(first, "doc", "lead.doc"))
    labels = components(_verified(pairs, docs, order))
    split = _split_entries(entries, labels)

    def compared(met: DataFrame) -> bool:
        """Compare the classes (doc, other) that have not been; whether that changes the components."""
        nonlocal pairs, labels
        met = K.written(_pairs(met, "doc", "other").join(pairs.hint("merge"), ["a", "b"], "left_anti"))
        if met.isEmpty():
            return False
        pairs, links = pairs.unionByName(met), _verified(met, docs, order)
        if links.isEmpty():
            return False
        labels = _more(labels, links)
        return True

    small, split = split.where(F.col("c") <= FEW), split.where(F.col("c") > FEW)
    for turn, leaders in enumerate(TURNS):
        if split.isEmpty():
            break
        met = _drawn(split, turn, leaders)
        if small is not None:
            met, small = met.unionByName(_rest(small)), None
        if compared(met):
            split = _split_entries(split.drop("comp"), labels)
    split = split if small is None else split.unionByName(small)
    if not split.isEmpty():
        compared(_rest(split))
    order.unpersist()

    named = classes.join(labels.hint("merge"), F.col("doc") == F.col("node"), "left").select(
        "n", "s1", "s2", "doc", F.coalesce("component", "doc").alias("comp"))
    return sets.drop("rare").join(named.hint("merge"), ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("doc", "doc_id").alias("class_id"),
        F.coalesce("comp", "doc_id").alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id")


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE {DENOMINATOR} * o >= {NUMERATOR} * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (
  SELECT a AS doc_id, a AS r FROM e
  UNION
  SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id WHERE c.r < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) m USING (doc_id)
"""
