"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: punctuation (too many symbols for its word characters),
navigation (a row of separators) and boilerplate (a known phrase, or a repeat of an earlier line).
Lines that fail are removed; a document that loses too much of its word characters is rejected.
Before that, base rules reject short documents and documents made of repeated three-word windows.
Everything is a function of one row: no shuffle, no state.

Defined results: a null text reads as empty, has no words and fails the base rules; rows are judged
one by one, so null or repeated ids change nothing; an empty table gives an empty result; further
columns pass through ``clean_lines``, and one named like a result column is replaced.

Three-word windows are compared by 64-bit hashes within one document: windows are first sorted by
40 bits of the hash packed with their position, and those that meet there by the whole hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import textkit as K

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30
LEAST_SYMBOLS, SYMBOL_PERCENT = 3, 12
LEAST_SEPARATORS, SEPARATOR_PERCENT = 3, 5

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BASE_SYMBOL = r"[#*$%&|<>]"
LINE_SYMBOL = r"[#*$%&<>!~^=+{}\[\]\\]"
SEPARATOR = r"[|»›•·]"
# Phrases of page furniture.
BOILERPLATE = (
    r"(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|click here|sign up now"
    r"|subscribe to our|enable javascript|skip to (main )?content|back to top")

_POSITION_BITS = 24


def _count(s: Column, pattern: str) -> Column:
    """Characters of ``s`` in the one-character class ``pattern``."""
    return F.char_length(s) - F.char_length(F.regexp_replace(s, pattern, ""))


def _bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _meets_neighbour(a: Column, x: Column, i: Column, key) -> Column:
    """Whether the i-th entry of sorted ``a`` has the key of the one before or after it."""
    before = F.when(i > 0, key(F.get(a, i - 1)) == key(x))
    after = F.when(i < F.size(a) - 1, key(F.get(a, i + 1)) == key(x))
    return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    def gram(w, i):
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def repeated(w):
        low = (1 << _POSITION_BITS) - 1
        at = F.sequence(F.lit(0), F.size(w) - 3)
        packed = F.sort_array(F.transform(at, lambda i: gram(w, i).bitwiseAND(~low) + i.bitwiseAND(F.lit(low))))
        # entries that share 40 bits with a neighbour, as (whole hash, position)
        near = _bind(packed, lambda a: F.filter(a, lambda x, i: _meets_neighbour(a, x, i, lambda v: F.shiftright(v, _POSITION_BITS))))
        near = F.transform(near, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
        # texts of 2^24 words and more: every window goes to the second comparison
        near = F.when(F.size(w) > low, at).otherwise(near)
        pairs = F.array_sort(F.transform(near, lambda i: F.struct(gram(w, i).alias("h"), i.alias("i"))))
        same = _bind(pairs, lambda a: F.filter(a, lambda x, i: _meets_neighbour(a, x, i, lambda v: v["h"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p):
        # each window adds its three words, less those that the next one covers again
        last = F.size(p) - 1
        add = F.transform(p, lambda x, i: F.when(i < last, F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(F.lit(3)))
        return F.aggregate(add, F.lit(0).cast("long"), lambda s, x: s + x)

    found = _bind(words, lambda w: _bind(repeated(w), covered))
    return F.when(F.size(words) >= 3, found).otherwise(F.lit(0).cast("long"))


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``clean_text`` (lines that pass, joined by newlines), the
    characters and lines lost, ``base_failed`` and ``kept``."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lost_lines",
            "lost_chars", "clean_text", "base_failed", "kept"]
    own = K.named([c for c in docs.columns if c not in made])
    text = F.col("__text")
    words, lines, good = F.col("__words"), F.col("__lines"), F.col("__good")
    d = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    d = d.select("*", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"),
                 F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD)).alias("__lines"))

    def chars(s):
        return F.char_length(F.regexp_replace(s, SPACE, ""))

    def passes(s):
        def rule(pattern, least, percent):
            n = _count(s, pattern)
            return F.when(n >= least, n * 100 <= chars(s) * percent).otherwise(F.lit(True))
        return (rule(LINE_SYMBOL, LEAST_SYMBOLS, SYMBOL_PERCENT)
                & rule(SEPARATOR, LEAST_SEPARATORS, SEPARATOR_PERCENT) & ~s.rlike(BOILERPLATE))

    d = d.select("*", F.array_distinct(F.filter(lines, passes)).alias("__good"))
    d = d.select(
        *own, F.size(words).cast("long").alias("n_words"), chars(text).cast("long").alias("word_chars"),
        _count(text, BASE_SYMBOL).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
        F.array_join(good, "\n").alias("clean_text"), F.size(good).cast("long").alias("__n_good"))
    lost = (F.col("word_chars") - chars(F.col("clean_text"))).alias("lost_chars")
    d = d.select("*", lost, (F.col("n_lines") - F.col("__n_good")).alias("n_lost_lines"),
                 ((F.col("n_words") < MIN_WORDS)
                  | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)).alias("base_failed"))
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)
    return d.select(*own, *made[:-1], kept.alias("kept"))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "n_lines", "n_lost_lines", "lost_chars", "base_failed", "kept")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS lines FROM d),
r AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)) WHERE c > 1) GROUP BY doc_id),
line AS (
  SELECT doc_id, s, min(p) AS p, length(regexp_replace(s, '{SPACE}', '', 'g')) AS c,
         length(s) - length(regexp_replace(s, '{LINE_SYMBOL}', '', 'g')) AS sym,
         length(s) - length(regexp_replace(s, '{SEPARATOR}', '', 'g')) AS nav
  FROM (SELECT doc_id, unnest(lines) AS s, unnest(range(len(lines))) AS p FROM w) GROUP BY doc_id, s),
good AS (
  SELECT doc_id, sum(c) AS c, count(*) AS n FROM line
  WHERE (sym < {LEAST_SYMBOLS} OR sym * 100 <= c * {SYMBOL_PERCENT})
    AND (nav < {LEAST_SEPARATORS} OR nav * 100 <= c * {SEPARATOR_PERCENT})
    AND NOT regexp_matches(s, '{BOILERPLATE}') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '{BASE_SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - coalesce(good.n, 0) AS BIGINT) AS n_lost_lines, coalesce(good.c, 0) AS good_chars
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN good USING (doc_id)),
b AS (
  SELECT *, CAST(word_chars - good_chars AS BIGINT) AS lost_chars,
         n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lost_lines, lost_chars,
       base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept FROM b
"""
