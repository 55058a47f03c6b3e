"""Cross-tokenizer alignment, ranked lexical search and token counts against plain Python versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import lexical_search, queries, token_align, token_count
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

STRANGE = [
    None, "", " ", "  x ", "\n\n", "\x00", "a\x00b", "plain words here", "plain words here", "a▁b", "▁", "日本語 テキスト", "é é 😀👩‍👩‍👧", "<s>hi</s><unk><0x0A>",
    "<|endoftext|> again <|endoftext|>", "tab\tend\r\n", " " * 700 + "z" * 3, "x" * 3000, "word " * 2000, "Größe ÉCOLE naïve", "﻿bom ​ zero",
    "".join(chr(c) for c in range(1, 400)), "".join(random.Random(3).choice("abcde ") for _ in range(60_000)),
]


@pytest.fixture(scope="module")
def strange(spark):
    """Rows with the strange texts, a null and a repeated id, and clashing further columns."""
    rows = [(i, t) for i, t in enumerate(STRANGE)] + [(None, "plain words here"), (7, "other plain words")]
    clash = ("n_tokens", "n_bytes", "n_a", "n_best", "groups_sha256", "pair", "shard", "c0", "a", "place", "n", "tf", "score", "rank", "doc", "item")
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(7).alias(c) for c in clash)).repartition(3).cache(), rows


@pytest.fixture(scope="module")
def sf_docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- op13 ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=token_count.MODEL)


def plain_counts(pieces, rows):
    return sorted(((i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in rows), key=str)


def test_token_counts(spark, strange, pieces):
    docs, rows = strange
    got = token_count.count_tokens(docs)
    assert {"place", "doc", "item"} <= set(got.columns) and got.columns.count("n_tokens") == 1
    got = got.collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == plain_counts(pieces, rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and any(r["over_limit"] for r in got)
    assert token_count.count_tokens(docs.limit(0)).count() == 0


def test_token_counts_of_the_whole_table(spark, sf_docs, pieces):
    got = queries.QUERIES["op13_token_count"](spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == plain_counts(pieces, sf_docs)


def test_merges_of_random_cuts(pieces):
    counts, rng = token_count.CutCounts(token_count.merge_ranks(token_count.MODEL)), random.Random(4)
    letters = " ▁ab\n日é😀" + "".join(list(counts.ranks)[:2500:9])
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert counts.tokens(text) == len(pieces.encode(text)), repr(text)


def test_remembered_cuts_are_bounded(pieces, monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 8)
    counts = token_count.CutCounts(token_count.merge_ranks(token_count.MODEL))
    text = " ".join(f"word{i % 23}" for i in range(200))
    assert counts.tokens(text) == len(pieces.encode(text)) and len(counts) <= 8 and len(counts.old) <= 8


# --- op12 ---------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k=10):
    terms = lambda t: [brute.lower(x) for x in TERM.findall(t or "")]
    docs = [(i, c, sum(c.values())) for i, c in ((i, Counter(terms(t))) for i, t in rows) if c]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(terms(text))
    out = []
    for item, q in asked.items():
        found = []
        for doc, c, size in docs:
            m = 25 + 75 * size * n // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, r in q.items() if c[t])
            if s > 0 and doc is not None:
                found.append((-s, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "plain WORDS, words"), (2, "x1 é😀 größe naïve école"), (3, None), (4, ""), (None, "plain"), (5, "nowhere found"),
         (6, "the abc"), (6, "here"), (7, "word a b c d e ab ba word"), (8, "日本語 hi s unk")]


def test_search(spark, strange):
    docs, rows = strange
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = plain_search(rows, ITEMS)
    for options in ({}, {"block_terms": 3}):
        got = lexical_search.search(docs, items, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} >= {1, 2, 6, 7, 8}
    assert lexical_search.search(docs.limit(0), items).count() == 0 == lexical_search.search(docs, items.limit(0)).count()


def test_search_ties_go_to_the_smaller_id(spark):
    rows = [(i, "same text") for i in range(40)] + [(100, "other"), (101, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    items = [(1, "same"), (2, "text text")]
    got = sorted(map(tuple, lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k=7).collect()))
    assert got == plain_search(rows, items, 7) and [r[2] for r in got[:7]] == list(range(7))


def test_search_of_the_whole_table(spark, sf_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "SLAB_CELLS", 200)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_lexical_search"](spark, SF).collect())) == plain_search(sf_docs, items)


# --- op11 ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def both(pieces):
    a = tokenizers.Tokenizer.from_file(token_align.MODEL_A)
    a.encode_special_tokens = True
    return a, pieces


def plain_alignment(both, rows):
    """One row of figures per document, in the order of ``rows``."""
    a_tok, b_tok = both
    letters = token_align.byte_letters()
    groups_of, linked = [], defaultdict(int)
    for _, text in rows:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_tok.id_to_piece(i)[1:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = lambda xs: [sum(map(len, xs[: i + 1])) for i in range(len(xs))] if len(xs) < 3000 else running(xs)
                ea, eb = ends(a_bytes), ends(b_bytes)
                cuts, i, j = sorted(set(ea) & set(eb)), 0, 0
                for c in cuts:
                    ga, gb = [], []
                    while i < len(a) and ea[i] <= c:
                        ga.append(a[i])
                        i += 1
                    while j < len(b) and eb[j] <= c:
                        gb.append(b[j])
                        j += 1
                    groups.append((ga, gb))
        groups_of.append(groups)
        for pair in {(x, y) for ga, gb in groups for x in ga for y in gb}:
            linked[pair] += 1
    best = defaultdict(int)
    for (x, _), n in linked.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), groups in zip(rows, groups_of):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(linked[p] == best[p[0]] for p in links), sum(linked[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def running(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark, strange, both):
    docs, rows = strange
    want = sorted(plain_alignment(both, rows), key=str)
    for options in ({}, {"shard_bytes": 2000}):
        got = token_align.align(docs, **options)
        assert {"place", "c0", "pair", "shard"} <= set(got.columns) and "text" not in got.columns
        assert sorted(map(tuple, got.select(*ALIGNED).collect()), key=str) == want
    assert token_align.align(docs.limit(0)).count() == 0
    assert sum(r[1] == 0 for r in want) >= 4 and any(r[4] > r[1] for r in want)


def test_alignment_of_the_whole_table(spark, sf_docs, both):
    got = sorted(map(tuple, queries.QUERIES["op11_token_align"](spark, SF).select(*ALIGNED).collect()))
    assert got == sorted(plain_alignment(both, sf_docs))


def test_a_ids_are_those_of_the_tokenizers_library(both):
    with open(token_align.MODEL_A, "rb") as fa, open(token_align.MODEL_B, "rb") as fb:
        tok = token_align.Tokenizers(fa.read(), fb.read())
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b  {chr(c)}" for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += [t for t in STRANGE if t]
    got = tok.encode(texts)[0].to_pylist()
    assert got == [e.ids for e in both[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
