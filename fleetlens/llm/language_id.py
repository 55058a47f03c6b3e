"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log odds over the languages that documents declare, however few
do (where more than ``MOST_LANGUAGES`` codes occur, the most frequent ones):

* text: a byte-trigram model per language, trained by grouped counts over all documents with a
  declared language (trigrams hashed to 2^14 buckets; evidence scaled down for dependent trigrams).
  Each model is drawn towards even buckets as strongly as it has kinds of trigrams for its number of
  them, so a model of few documents is blunt in what it hasn't met, not in what it has;
* the declared (markup) language: P(declared | language), from counts of what the text alone says;
* the address suffix: P(suffix | language), counted the same way;
* the host: a prior from hierarchically smoothed counts, host under parent domain under ... under
  all documents, each level drawn towards the one above it.

Counts are grouped aggregations, combined before the shuffle; what reaches the driver is bounded
(2^14 trigram rows). Host, suffix and declaration tables are written out and joined to the documents, and Spark
broadcasts them only while their files are small.

A document is rejected when its text has no trigram of letters (digits are none), when no language
reaches ``LEAST_POSTERIOR``, or when the text is in none of the languages: a background in which
every trigram bucket is alike explains it better than the model of the language found.

Defined results: a null or empty text is rejected with a null language; null or unknown declared
languages, hosts and addresses give no evidence; rows are judged one by one, so null or repeated
ids change nothing; where no document declares a language all are rejected with a null language;
an empty table gives an empty result; further columns pass through, and ones
named like result columns are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import textkit as K

MOST_LANGUAGES = 256  # bounds the count table: 2^BUCKET_BITS rows of so many counts
BUCKET_BITS = 14
TEXT_SCALE = 0.4  # trigrams overlap, so their evidence counts less than that of independent ones
HOST_PULL = 20.0  # documents that the level above counts for
LEAST_POSTERIOR = 0.5
DEPTH = 4  # labels of a host's name that make levels of their own

# text evidence of one trigram where every bucket is alike
BACKGROUND = -TEXT_SCALE * math.log(1 << BUCKET_BITS)

_LETTER = K.ALNUM_WORD & (np.arange(256) > 0x39)
_FOLD = np.where(_LETTER[K.LOWER], K.LOWER, 0x20).astype(np.uint8)


def trigrams(col: pa.Array):
    """Per chunk: trigram buckets of the folded text (letters, else one space), and per-row
    bounds. Trigrams of which the middle byte is a space say little and are left out."""
    for _, _, buf, offs in K.text_chunks(col):
        b = _FOLD[buf].astype(np.uint32)
        if len(b) < 3:
            yield np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
            continue
        tri = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        ok = b[1:-1] != 0x20
        inner = offs[1:-1]
        for back in (1, 2):  # not across rows
            edge = inner - back
            ok[edge[(edge >= 0) & (edge < len(ok))]] = False
        at = np.flatnonzero(ok)
        bucket = (tri[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
        yield bucket.astype(np.int64), np.searchsorted(at, offs)


def _count_task(languages: list[str | None]):
    def task(batches):
        size = 1 << BUCKET_BITS
        counts = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            known = np.array([languages.index(x) if x is not None and x in languages else -1 for x in batch.column("__declared").to_pylist()], np.int64)
            lo = 0
            for bucket, bounds in trigrams(batch.column("__text")):
                rows = len(bounds) - 1
                label = np.repeat(known[lo : lo + rows], np.diff(bounds))
                keep = label >= 0
                counts += np.bincount(label[keep] * size + bucket[keep], minlength=counts.size).reshape(counts.shape)
                lo += rows
        met = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(c[met]) for c in counts)],
                                         names=["bucket", *(f"c{i}" for i in range(len(languages)))])
    return task


def declared_languages(rows: DataFrame) -> list[str | None]:
    """The declared languages by name; one without a name where there are none."""
    met = rows.where(F.trim("__declared") != "").groupBy("__declared").count()
    met = met.orderBy(F.desc("count"), "__declared").limit(MOST_LANGUAGES).collect()
    return sorted(r["__declared"] for r in met) or [None]


def trigram_model(rows: DataFrame, languages: list[str | None]) -> np.ndarray:
    """log P(bucket | language), smoothed by its number of kinds (Witten and Bell), as a (buckets, languages) table."""
    names = [f"c{i}" for i in range(len(languages))]
    counts = rows.select("__text", "__declared").mapInArrow(
        _count_task(languages), "bucket long, " + ", ".join(f"{c} long" for c in names))
    table = counts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # at most 2^BUCKET_BITS rows
    out = np.zeros((1 << BUCKET_BITS, len(languages)))
    for i, name in enumerate(names):
        out[table["bucket"].to_numpy(), i] = table[name].to_numpy()
    out += np.maximum(1, (out > 0).sum(axis=0)) / len(out)
    return np.log(out / out.sum(axis=0)).astype(np.float32)


def _text_task(model: np.ndarray, passing: list[str]):
    def task(batches):
        for batch in batches:
            parts, counts = [np.zeros((0, model.shape[1]))], [np.zeros(0, np.int64)]
            for bucket, bounds in trigrams(batch.column("__text")):
                n = np.diff(bounds)
                out = np.zeros((len(n), model.shape[1]))
                some = n > 0
                if some.any():
                    out[some] = np.add.reduceat(model[bucket], bounds[:-1][some], axis=0, dtype=np.float64)
                parts.append(out)
                counts.append(n)
            scores = TEXT_SCALE * np.concatenate(parts)
            offs = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * model.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passing), pa.ListArray.from_arrays(offs, pa.array(scores.ravel())),
                 pa.array(np.concatenate(counts))], names=[*passing, "__log", "__n"])
    return task


def _best(scores: Column) -> Column:
    """Zero-based position of the largest entry (the first of equal ones)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Documents (counted in c) per key and language, as one array column."""
    return rows.groupBy(key).agg(F.array(*(F.sum(F.when(F.col("best") == i, F.col("c")).otherwise(0.0)) for i in range(n))).alias("n"))


def _likelihood(rows: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """(key, log P(key | language)), with one added to every count."""
    counts = K.written(_counts(rows.where(F.col(key).isNotNull()), key, n))
    total = counts.agg(F.count("*"), *(F.sum(F.col("n")[i]) for i in range(n))).first()
    size = [float((t or 0) + total[0]) for t in total[1:]]
    return K.written(counts.select(F.col(key).alias(f"__{key}"), F.array(
        *(F.log((F.col("n")[i] + 1) / F.lit(max(1.0, size[i]))) for i in range(n))).alias(out)))


def _levels(host: Column) -> Column:
    """Names of a host's levels from the top: its last labels, one more each time, then itself."""
    parts = F.split(F.lower(host), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(DEPTH))),
                        lambda k: F.array_join(F.slice(parts, -k, k), "."))
    return F.array_distinct(F.concat(tails, F.array(F.lower(host))))


def host_priors(rows: DataFrame, n: int) -> DataFrame:
    """(host, log prior) by smoothing each level's counts towards the level above it."""
    counts = K.written(_counts(rows.where(F.col("host").isNotNull()), "host", n))
    top = rows.agg(*(F.sum(F.when(F.col("best") == i, F.col("c"))) for i in range(n))).first()
    every = [(x or 0.0) + 1.0 for x in top]
    every = F.array(*(F.lit(x / sum(every)) for x in every))
    nodes = counts.select(F.posexplode(_levels(F.col("host"))).alias("depth", "node"), _levels(F.col("host")).alias("path"), "n")
    nodes = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1)).otherwise(""))
    nodes = K.written(nodes.groupBy("depth", "node", "parent").agg(F.array(*(F.sum(F.col("n")[i]) for i in range(n))).alias("n")))
    share = (lambda above: F.zip_with("n", above, lambda c, p: (c + HOST_PULL * p) / (
        F.aggregate("n", F.lit(0.0), lambda s, x: s + x) + HOST_PULL)))
    level = nodes.where("depth = 0").select("node", share(every).alias("p"))
    found = [level]
    for depth in range(1, DEPTH + 1):
        above = level.select(F.col("node").alias("parent"), F.col("p").alias("above"))
        level = nodes.where(F.col("depth") == depth).join(above, "parent").select("node", share(F.col("above")).alias("p"))
        found.append(level)
    priors = reduce(DataFrame.unionByName, found)
    hosts = counts.select(F.col("host").alias("__host"), F.lower("host").alias("node"))
    return K.written(hosts.join(priors, "node").select("__host", F.transform("p", lambda x: F.log(x)).alias("__prior")))


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and suffix (last label of the host) of an address."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    return host, F.element_at(F.split(host, r"\."), -1)


def markup_language(html: Column) -> Column:
    """The language that a page's html element declares."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1), F.lit("")))


def identify(docs: DataFrame, text: Column, declared: Column | None = None, host: Column | None = None,
             suffix: Column | None = None, languages: list[str] | None = None) -> DataFrame:
    """``docs`` with language, posterior (of that language), text_language (by the text alone),
    n_trigrams and accepted; ``languages`` are the declared ones unless given."""
    K.ship(docs.sparkSession)
    made = ["language", "posterior", "text_language", "n_trigrams", "accepted"]
    own = [c for c in docs.columns if c not in made]
    none = F.lit(None).cast("string")
    parts = [c if c is not None else none for c in (declared, host, suffix)]
    rows = docs.select(*K.named(own), F.coalesce(text, F.lit("")).alias("__text"), *(
        c.cast("string").alias(f"__{name}") for c, name in zip(parts, ("declared", "host", "suffix"))))
    languages = languages or declared_languages(rows)
    n = len(languages)
    model = trigram_model(rows, languages)

    def scored(passing: list[str]) -> DataFrame:
        schema = T.StructType([*(rows.schema[c] for c in passing), T.StructField("__log", T.ArrayType(T.DoubleType())),
                               T.StructField("__n", T.LongType())])
        return rows.select(*K.named(dict.fromkeys([*passing, "__text"]))).mapInArrow(_text_task(model, passing), schema)

    keys = ["__declared", "__host", "__suffix"]
    said = scored(keys).where("__n > 0").select(
        *(F.col(k).alias(k[2:]) for k in keys), _best(F.col("__log")).alias("best"))
    said = K.written(said.groupBy("declared", "host", "suffix", "best").agg(F.count("*").cast("double").alias("c")))

    out = scored([*own, *keys])
    for key, name in (("declared", "__d"), ("suffix", "__s")):
        out = out.join(_likelihood(said, key, n, name), f"__{key}", "left")
    out = out.join(host_priors(said, n), "__host", "left")
    flat = F.array(*(F.lit(0.0) for _ in languages))
    total = F.col("__log")
    for name in ("__d", "__s", "__prior"):
        total = _plus(total, F.coalesce(F.col(name), flat))
    out = out.withColumn("__total", total).withColumn("__best", _best(F.col("__total")))
    odds = F.aggregate("__total", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("__total")))
    names = F.array(*(F.lit(x).cast("string") for x in languages))
    some = F.col("__n") > 0
    posterior = F.when(some, 1 / odds)
    return out.select(
        *K.named(own), F.when(some, F.get(names, F.col("__best"))).alias("language"), posterior.alias("posterior"),
        F.when(some, F.get(names, _best(F.col("__log")))).alias("text_language"), F.col("__n").alias("n_trigrams"),
        F.coalesce((posterior >= LEAST_POSTERIOR) & (F.get("__log", F.col("__best")) > BACKGROUND * F.col("__n")), F.lit(False)).alias("accepted"))
