"""The training-data operators against plain Python versions and on awkward rows."""

import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import (
    decontaminate, html_extract, language_id, license_scan, line_align, mixing, ngram_join, quality_model, quality_rules, substring)
from fleetlens.llm import fmindex, graph, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def sentence(rng, n):
    return " ".join(rng.choice(["oak", "elm", "ash", "fir", "yew", "bay", "fig", "Été", "naïve", "x1"]) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows():
    """Nulls, empty and very long texts, ties, copies, repeated rows and ids."""
    rng = random.Random(5)
    passage, base = sentence(rng, 60), sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base, "en", "b"), (4, None, None, None), (5, "", "en", "a"),
        (6, " \t\n ", "en", ""), (7, "one two", "en", "a"), (8, "One TWO", "de", "a"), (None, base, "en", "a"),
        (None, None, None, None), (9, sentence(rng, 30) + " " + passage, "fr", "b"), (10, passage + "\n" + sentence(rng, 25), "fr", "b"),
        (11, "w " * 400, "en", "c"), (12, "\n".join([sentence(rng, 9)] * 6 + [sentence(rng, 9)]), "en", "c"),
        (13, "\n".join(sentence(rng, 10) for _ in range(8)), "es", "c"), (14, "ÄÖ   \x1c ß", "de", "d.e.f"),
        (15, sentence(rng, 6000), "en", "a"), (16, base + " " + base, "en", "a"), (12, "other text for a repeated id", "en", "c"),
        (1, base, "en", "a"), (-3, passage, "en", "a"),
    ]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    d = spark.createDataFrame(awkward_rows(), DOCS)
    # further columns, some named like results and working columns
    clash = {c: F.lit(7) for c in ("n_words", "kept", "score", "spans", "items", "key", "start", "n", "hot", "domain", "epoch",
                                   "language", "component_id", "blocks", "earlier", "own_license", "path", "best", "c")}
    return d.select("*", *(v.alias(k) for k, v in clash.items())).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs():
    return [(r[0], r[1]) for r in awkward_rows()]


def sf_docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- FM-index and graph -------------------------------------------------------------------------

def test_fm_index_finds_all_occurrences():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(0, 25)), 0) for _ in range(rng.integers(1, 6))])
        index, m = fmindex.FMIndex(text, 4), int(rng.integers(1, 5))
        wanted = rng.integers(1, 6, (15, m))
        which, low, high = index.search(lambda j, w: wanted[w, j], 15, m)
        got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high)}
        want = {}
        for k in range(15):
            at = [i for i in range(len(text) - m + 1) if (text[i : i + m] == wanted[k]).all()]
            if at:
                want[k] = at
        assert got == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(100, 119)]
    rng = random.Random(2)
    rng.shuffle(links)
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, **{100 + i: 100 for i in range(1, 20)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_no_round_without_need(spark, monkeypatch):
    """Stars are not written again, and no round is made to see that the last one changed nothing."""
    made, write = [], graph.K.written
    monkeypatch.setattr(graph.K, "written", lambda df, keep=False: made.append(1) or write(df, keep))
    for links, rounds in (([(3, 1), (1, 2), (8, 9), (5, 5)], 0), ([(1, 2), (2, 3), (1, 2), (2, 1)], 1)):
        made.clear()
        found = {tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert found == ({(3, 1), (2, 1), (9, 8)} if not rounds else {(2, 1), (3, 1)}) and len(made) == rounds


# --- op1 ----------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Big &amp; small</h1><p>One  two\n three &copy; four<p>Five <b>six</b>"
     "<br>seven &#8364;8</article><footer>&copy; Site</footer>", "Big & small\nOne two three © four\nFive six seven €8"),
    ("<article><p>Alpha beta.</p><script>var a='<p>no</p>'</script><style>p{}</style><div class='comments'><p>I like it a lot, thanks.</p></div>"
     "<p><a href=x>Only a link here</a></p></article><aside><p>Side text of some length here.</p></aside>", "Alpha beta.\nOnly a link here"),
    ("<body><div class=\"cookie-banner\"><p>We use cookies on this page for many good reasons.</p></div><main><p>Text &lt;b&gt; stays.</p>"
     "<form><p>Write us a letter please now.</p></form></main><!-- <p>hidden</p> -->", "Text <b> stays."),
    (None, ""), ("", ""), ("<p", ""), ("<!-- never closed <p>text</p>", ""), ("<nav><a href=/>Home</a></nav>", ""),
    ("<article><p>First words here.</p><p class=comment>Nice one!</p><p>Last words here.</p></article>", "First words here.\nLast words here."),
    ("<article><p>He sat <span class=\"ad\">Buy <span>now</span> and save</span>down again.</p></article>", "He sat down again."),
    ("<article><p hidden>Not shown.</p><div style='color:red; display: none'><p>Nor this.</p></div><p>Shown.</p></article>", "Shown."),
    ("<article><h1>Title</h1><p>The article.</p><h3>Comments (2)</h3><p>I disagree with all of that.</p><p>Me too.</p></article>"
     "<div><p>More</p></div>", "Title\nThe article."),
    ("<article><h2>Comments</h2><p>Thanks!</p><h2>Sources</h2><p>The town's books.</p></article>", "Sources\nThe town's books."),
    ("<article><div class=share-price><p>The share lost two per cent.</p></div><p>It rose later.</p></article>",
     "The share lost two per cent.\nIt rose later."),
    ("<body><h1>On snow</h1><p>It fell.</p><p>We stayed in for the whole of that day.</p></body>",
     "On snow\nIt fell.\nWe stayed in for the whole of that day."),
    ("<div><a href=1>One</a></div><div><a href=2>Two more</a></div><div>Our links</div><div><a href=3>Three</a></div>"
     "<div>Snow fell over the hills all night, and in the morning no road could be seen any more.</div>"
     "<div>No bus came, and the children stayed at home until the end of the week.</div>"
     "<div><a href=4>Four and five</a></div><div><a href=5>Six</a></div>",
     "Snow fell over the hills all night, and in the morning no road could be seen any more.\n"
     "No bus came, and the children stayed at home until the end of the week."),
    ("<article><p>1 < 2 and a<b>b</b> <p title='a > b'>quoted</p><ul><li class=ad>Buy!<li>kept item</ul></article>", "1 < 2 and ab\nquoted\nkept item"),
    ("<article>" + "<p>word word word.</p>" * 5000 + "</article>", "\n".join(["word word word."] * 5000)),
]


def test_main_text(spark):
    rows = [(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)] + [(0, "again", PAGES[0][0], 1), (None, None, PAGES[0][0], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "n_blocks", "n_content_blocks"}
    for r in got:
        want = PAGES[r["page_id"] or 0][1]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_main_text_of_the_whole_table(spark):
    import html
    import re
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op1_html_extract"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)[^>]*>", article)
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
        assert got[r["page_id"]] == "\n".join(p for p in plain if p)


def test_tree_separates_its_training_table():
    import numpy as np
    found = [html_extract.blocks(p) for p in html_extract.LABELLED_PAGES]
    x = np.concatenate([html_extract.features(b) for b in found])
    y = np.array([b.label for f in found for b in f])
    tree = html_extract.trained_tree()
    open_ = np.array([not b.declared for f in found for b in f])
    assert (tree.predict(x) == y)[open_].all()
    x, y = html_extract.labelled()
    assert len(y) > 300 and (tree.predict(x) == y).mean() > 0.99

    def asked(t):
        return set() if t.feature < 0 else {html_extract.FEATURES[t.feature]} | asked(t.low) | asked(t.high)

    assert {"words", "link_density", "link_density_before", "words_after"} <= asked(tree)


def test_tree_on_held_out_shapes():
    import numpy as np
    pages = [html_extract.shaped_blocks(p) for p in html_extract.LABELLED_SHAPES.strip().splitlines()]
    x, y = [html_extract.features(p) for p in pages], [np.array([b.label for b in p]) for p in pages]
    right = total = 0
    for fold in range(10):
        tree = html_extract.grow(np.concatenate([v for i, v in enumerate(x) if i % 10 != fold]),
                                 np.concatenate([v for i, v in enumerate(y) if i % 10 != fold]))
        for i in range(fold, len(pages), 10):
            right, total = right + int((tree.predict(x[i]) == y[i]).sum()), total + len(y[i])
    assert right / total > 0.93


@pytest.mark.parametrize("unit,end", [
    ("<div>", ""), ("<p x=\"", ""), ("<p x=\">", ""), ("<p x=\"> ", "<p y=\"a>b\""), ("<", ""), ("<!--", ""), ("<span class=ad>x ", ""), ("</p><p>a ", "")])
def test_time_of_broken_pages_is_linear(unit, end):
    import time

    def seconds(n):
        page = unit * (n // len(unit)) + end
        best = 9e9
        for _ in range(3):
            start = time.process_time()
            html_extract.blocks(page)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(800_000) < 8 * seconds(200_000) + 0.2


# --- op2 ----------------------------------------------------------------------------------------

def test_license_inheritance(spark, empty):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("/a/LICENSE", mit), ("a/x.txt", "plain words"), ("a/b/y.txt", "more words"), ("a//b/c/z.txt", "prose " * 40 + "\n" + gpl + "\n" + "more " * 40),
        ("a/b/c/q.txt", ""), ("top.txt", "a license to wonder is given"), ("d/COPYING", gpl), ("d/COPYING", gpl), ("d/e/LICENSE.md", mit),
        ("d/e/f/g.txt", None), (None, "root words"), ("d/h.txt", "words " * 20000), ("notes/only", mit), ("notes/other", "x")]
    files = spark.createDataFrame([(i, p, t, 1) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license int")
    got = {r["doc_id"]: r for r in license_scan.scan(files, F.col("path"), F.col("text"), keep=["doc_id"]).collect()}
    want = ["MIT", "MIT", "MIT", "GPL-3.0", "MIT", None, "GPL-3.0", "GPL-3.0", "MIT", "MIT", None, "GPL-3.0", "MIT", "MIT"]
    assert [got[i]["license"] for i in range(len(rows))] == want
    assert got[2]["inherited_from"] == "a" and got[9]["inherited_from"] == "d/e" and got[3]["inherited_from"] is None
    assert got[6]["is_license_file"] and not got[3]["is_license_file"]
    assert license_scan.scan(empty, F.lit("x"), F.col("text")).count() == 0


def test_license_cosine_matches_plain_python(spark, awkward):
    text = "Licensed under the Apache License, Version 2.0 today"
    docs = [(1, text), (2, "the version of the tale"), (3, "license")]
    n = len(docs)
    words = {d: brute.ALNUM.findall(t.lower()) for d, t in docs}
    known = {w for ts in license_scan.TEMPLATES.values() for t in ts for w in brute.ALNUM.findall(t.lower())}
    known |= {w for k in license_scan.TEMPLATES for w in brute.ALNUM.findall(f"spdx license identifier {k}".lower())} | set(license_scan.MARKERS)

    def idf(w):
        return math.log((1 + n) / (1 + (sum(w in x for x in words.values()) if w in known else 0))) + 1

    def vector(ws):
        return {w: ws.count(w) * idf(w) for w in ws}

    def cosine(a, b):
        dot = sum(v * b.get(w, 0) for w, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    best = max(cosine(vector(words[1]), vector(brute.ALNUM.findall(t.lower()))) for ts in license_scan.TEMPLATES.values() for t in ts)
    files = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(files, F.col("doc_id").cast("string"), F.col("text")).collect()}
    assert got[1]["license"] == "Apache-2.0" and abs(got[1]["score"] - best) < 1e-9
    assert license_scan.scan(awkward, F.col("source"), F.col("text")).count() == len(awkward_rows())


# --- op3 ----------------------------------------------------------------------------------------

def plain_rules(text):
    import re
    text = text or ""
    w = brute.words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)} if len(grams) < 500 else set()
    lines = [s for s in text.split("\n") if brute.words(s)]
    size = lambda s: sum(map(len, brute.words(s)))
    def passes(s):
        sym, nav = len(re.findall(quality_rules.LINE_SYMBOL, s)), len(re.findall(quality_rules.SEPARATOR, s))
        return ((sym < 3 or 100 * sym <= 12 * size(s)) and (nav < 3 or 100 * nav <= 5 * size(s))
                and not re.search(quality_rules.BOILERPLATE, s))
    good = list(dict.fromkeys(s for s in lines if passes(s)))
    lost = size(text) - sum(map(size, good))
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), size(text), len(re.findall(quality_rules.BASE_SYMBOL, text)), len(lines) - len(set(lines)), len(again),
            failed, not failed and 100 * lost <= 30 * size(text), "\n".join(good))


def test_quality_rules(spark, awkward, empty):
    extra = [(20, "a b c a b c d"), (21, "a b a b a b"), (22, "x | y | z | q\n" + "good words here. " * 20),
             (23, "Spam!!! $$$ ###\nAll rights reserved.\n" + "\n".join(f"line {i} of the text stays" for i in range(30)))]
    rows = pairs()[:16] + extra
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, kept int")
    cleaned = quality_rules.clean_lines(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    got = sorted([tuple(r[n] for n in names) for r in cleaned.collect()])
    assert got == sorted(plain_rules(t) for _, t in rows)
    assert quality_rules.clean_lines(awkward).count() == len(awkward_rows())
    assert quality_rules.clean_lines(empty).count() == 0
    assert "Python" not in cleaned._jdf.queryExecution().executedPlan().toString()


# --- op4 ----------------------------------------------------------------------------------------

def test_quality_model_on_held_out_labels(spark):
    import os
    sf = "/root/testdata/sf0.01"
    scored = quality_model.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(os.path.join(sf, "labels.parquet")))
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_quality_model_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 0), (99, 1)], "doc_id long, quality int")
    assert quality_model.score(awkward, labels).count() == len(awkward_rows())
    none = quality_model.score(awkward, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert quality_model.score(empty, labels).count() == 0


# --- op5 ----------------------------------------------------------------------------------------

def test_patience_finds_common_blocks():
    a, b = list("abcdefgh"), list("xabcyfghz")
    assert line_align.patience(a, b) == brute.patience(a, b) == [(0, 1), (1, 2), (2, 3), (5, 5), (6, 6), (7, 7)]
    rng = random.Random(3)
    for _ in range(200):
        a, b = [[rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2)]
        m = line_align.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))


def test_line_dedup(spark, awkward, empty):
    for docs, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), sf_docs(spark)), (awkward, pairs())):
        got = line_align.dedup_lines(docs).collect()
        want = brute.line_dedup(rows)
        named = {r["doc_id"]: (r["text"] or "", r["n_removed_lines"]) for r in got if r["doc_id"] is not None}
        assert named == want
        assert sum(r["doc_id"] is None for r in got) == sum(d is None for d, _ in rows)
    assert line_align.dedup_lines(empty).count() == 0


def lines_left(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"].split("\n") for r in line_align.dedup_lines(docs, **how).collect()}


def test_runs_of_short_lines_pair_documents(spark):
    rng = random.Random(21)
    passage = [sentence(rng, n) for n in (5, 7, 3, 6, 4, 7, 5, 6, 7, 5)]
    own = {d: [sentence(rng, 6) for _ in range(3)] for d in (1, 2, 3)}
    rows = [(d, "\n".join([own[d][0], *passage, *own[d][1:]])) for d in own]
    got = lines_left(spark, rows)
    assert got[1] == [own[1][0], *passage, *own[1][1:]] and got[2] == own[2] and got[3] == own[3]


def test_blocks_of_lines_first_seen_apart(spark):
    rng = random.Random(22)
    hot, note, third = sentence(rng, 9), sentence(rng, 5), sentence(rng, 4)
    own = {d: sentence(rng, 7) for d in range(6)}
    rows = [(0, f"{own[0]}\n{hot}"), (1, f"{note}\n{own[1]}"), (2, f"{own[2]}\n{hot}\n{note}\n{third}"),
            (3, f"{hot}\n{note}\n{own[3]}"), (4, f"{third}\n{hot}\n{note}\n{third}\n{own[4]}"), (5, f"{hot}\n{own[5]}\n{note}")]
    got = lines_left(spark, rows)
    assert got[3] == [own[3]] and got[4] == [third, own[4]]
    assert all("\n".join(got[d]) == dict(rows)[d] for d in (0, 1, 2, 5))


def test_blocks_that_moved(spark):
    rng = random.Random(23)
    a, b, c, x = ([sentence(rng, 5) for _ in range(4)] for _ in range(4))
    rows = [(1, "\n".join(a + b + c)), (2, "\n".join(c + x + a)), (3, "\n".join(b + x[:1] + b))]
    got = lines_left(spark, rows)
    assert got[2] == x and got[3] == x[:1]


def test_shortest_runs_are_those_hashed():
    rng = random.Random(24)
    texts = ["\n".join(sentence(rng, rng.choice([0, 1, 4, 7, 13])) for _ in range(rng.randrange(9))) for _ in range(60)]
    for _, rows, keys, count, bounds, runs, run_bounds in line_align.line_keys(pa.array(texts)):
        met = {}
        for n in range(rows):
            mine, words = keys[bounds[n] : bounds[n + 1]].tolist(), count[bounds[n] : bounds[n + 1]].tolist()
            want = [tuple(mine[a:b]) for a, b in line_align.shortest_runs(words)]
            got = runs[run_bounds[n] : run_bounds[n + 1]].tolist()
            assert len(got) == len(want) and len(set(got)) == len(set(want))
            met.update((k, None) for k in got)
        assert met


def test_short_lines_that_many_documents_hold(spark):
    rng = random.Random(25)
    hot, word, some = sentence(rng, 9), "And.", sentence(rng, 6)
    rows = [(d, "\n".join([sentence(rng, 8), hot, sentence(rng, 8), "", *([some] if d < 6 else []), sentence(rng, 8), word, word]))
            for d in range(7)]
    got = lines_left(spark, rows, most=6)
    for d, text in rows:
        lines = text.split("\n")
        assert got[d] == (lines if d == 0 else [s for s in lines if s not in (hot, word)])
    assert lines_left(spark, rows[:6], most=6) == {d: t.split("\n") for d, t in rows[:6]}


def test_line_dedup_query_leaves_no_frequent_line(spark):
    texts = brute.one_per_id(sf_docs(spark))
    keys = {d: {" ".join(brute.words(s)) for s in t.split("\n")} for d, t in texts.items()}
    held = {}
    for d in sorted(keys):
        for k in keys[d]:
            held.setdefault(k, []).append(d)
    often = {k: x[0] for k, x in held.items() if k and len(x) > line_align.LINE_DOCS}
    assert often
    for r in queries.op5_line_dedup(spark, SF).collect():
        left = {" ".join(brute.words(s)) for s in r["text"].split("\n")}
        assert all(d == r["doc_id"] for k, d in often.items() if k in left)


# --- op6 ----------------------------------------------------------------------------------------

def near_rows(found):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}


def test_near_classes(spark, awkward, empty):
    assert near_rows(ngram_join.near_classes(awkward)) == brute.near(pairs())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert near_rows(ngram_join.near_classes(docs)) == brute.near(sf_docs(spark))
    assert ngram_join.near_classes(empty).count() == 0


def test_near_classes_of_chains_and_groups(spark):
    """Chains of edits, whose ends aren't linked themselves, and copies that link only through a centre."""
    rng = random.Random(9)
    base, rows, n = sentence(rng, 80).split(), [], 0
    for step in range(25):
        w = list(base)
        for k in range(step):
            w[(k * 3) % 80] = f"e{k}"
        rows.append((n, " ".join(w)))
        n += 7
    centre = sentence(rng, 100).split()
    for k in range(40):
        w = list(centre)
        for at in rng.sample(range(100), 3 if k else 0):
            w[at] = f"q{k}{at}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, sentence(rng, 12)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(ngram_join.near_classes(docs)) == brute.near(rows)


def test_near_classes_read_texts_once_for_sets(spark, monkeypatch):
    """Entries whose classes can't link take no further rounds, and the result needs no text pass of its own."""
    rng = random.Random(11)
    rows = []
    for k in range(20):  # a short text and a long one that holds it, ten times
        short = sentence(rng, 30)
        rows += [(3 * k, short), (3 * k + 1, " ".join(sentence(rng, 30) if j != 4 else short for j in range(10)))]
    rows += [(3 * k + 2, rows[2 * k][1]) for k in range(5)]
    passes = []
    for name in ("_set_task", "_slice_task"):
        task = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, name=name, task=task: passes.append(name) or task(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(ngram_join.near_classes(docs)) == brute.near(rows)
    assert sorted(passes) == ["_set_task", "_slice_task"]


def test_near_classes_of_small_and_large_entries(spark, monkeypatch):
    """The same components whether entries are compared at once or by rounds of drawn leaders."""
    rng = random.Random(12)
    rows = []
    for g in range(6):
        base = sentence(rng, 90).split()
        for k in range(12):
            w = list(base)
            for at in rng.sample(range(90), 2):
                w[at] = f"q{g}{k}{at}"
            rows.append((100 * g + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (1, 4, 64):
        monkeypatch.setattr(ngram_join, "FEW", few)
        assert near_rows(ngram_join.near_classes(docs)) == brute.near(rows)


def test_near_classes_compare_small_entries_with_the_first_draw(spark, monkeypatch):
    """Small entries and the first draw of large ones share a pass over the texts."""
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = sentence(rng, 90).split()
        for k in range(12):
            w = list(base)
            for at in rng.sample(range(90), 2):
                w[at] = f"q{g}{k}{at}"
            rows.append((100 * g + k, " ".join(w)))
    docs, passes, task = spark.createDataFrame(rows, "doc_id long, text string"), [], ngram_join._slice_task
    monkeypatch.setattr(ngram_join, "_slice_task", lambda *a: passes.append(1) or task(*a))
    monkeypatch.setattr(ngram_join, "FEW", 7)
    monkeypatch.setattr(ngram_join, "TURNS", [1])
    assert near_rows(ngram_join.near_classes(docs)) == brute.near(rows)
    assert len(passes) <= 3  # the first leader; small entries and the draw; the rest


# --- op7 ----------------------------------------------------------------------------------------

def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
    assert sum(r["language"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert sum(r["text_language"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)


FOREIGN = {
    "it": "La nostra famiglia viveva in una piccola casa vicino alla montagna e ogni mattina andavamo a scuola a piedi.",
    "ru": "Наша семья жила в маленьком доме у подножия горы, и каждое утро мы ходили в школу пешком.",
    "zh": "我们一家人住在山脚下的一座小房子里，每天早上我们都走路去上学。",
    "fi": "Perheemme asui pienessä talossa vuoren juurella ja joka aamu kävelimme kouluun yhdessä.",
    "nl": "Onze familie woonde in een klein huis aan de voet van de berg en elke ochtend liepen we naar school.",
}


def test_foreign_and_wordless_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    texts = [*((None, t) for t in FOREIGN.values()), ("en", "2024 15 88121 777 3.14159 2718 281828 4590 4523 5360"),
             ("en", "xqzjv kwpfg zzxqy vbnmk qwjxz plkjq zxcvq wqjkx fghzq"), ("", FOREIGN["it"]), ("es", FOREIGN["it"])]
    planted = spark.createDataFrame([(-1 - n, t, lang, "src1") for n, (lang, t) in enumerate(texts)], docs.schema)
    rows = language_id.identify(docs.unionByName(planted), F.col("text"), F.col("lang"), F.col("source")).collect()
    assert [r["doc_id"] for r in rows if r["doc_id"] < 0 and r["accepted"]] == []
    own = [r for r in rows if r["doc_id"] >= 0]
    assert sum(r["accepted"] and r["language"] == r["lang"] for r in own) >= 0.999 * len(own)
    assert {r["n_trigrams"] for r in rows if r["doc_id"] == -1 - len(FOREIGN)} == {0}


ITALIAN = [
    "La mattina il mercato della piazza si riempie di gente che compra frutta, pane e formaggio.",
    "Mio fratello lavora in una fabbrica di scarpe e torna a casa soltanto la domenica sera.",
    "Quando piove i bambini giocano nella stanza grande e la nonna racconta le vecchie storie.",
    "Il treno per la montagna parte alle otto e arriva quando il sole è già alto sopra la valle.",
    "Abbiamo trovato una casa piccola vicino al mare, con una finestra che guarda verso il porto.",
    "Gli amici di mia sorella cantano ogni sera nella chiesa del paese e poi mangiano insieme.",
    "Nella scuola del villaggio ci sono soltanto due maestre e una quarantina di ragazzi.",
    "Il vecchio pescatore ha venduto la barca e adesso cammina lungo la spiaggia con il suo cane.",
    "Dopo la guerra molte famiglie sono partite per cercare lavoro nelle città del nord.",
]


def test_a_rare_language_is_kept_by_its_name(spark):
    """However few documents declare a language, it has a model; nine give one that knows others of it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    for some in (ITALIAN[:1], ITALIAN[:3], ITALIAN):
        planted = spark.createDataFrame([(-1 - n, t, "it", "src1") for n, t in enumerate(some)], docs.schema)
        rows = language_id.identify(docs.unionByName(planted), F.col("text"), F.col("lang"), F.col("source")).collect()
        assert all(r["accepted"] and r["language"] == "it" for r in rows if r["doc_id"] < 0)
        own = [r for r in rows if r["doc_id"] >= 0]
        assert sum(r["accepted"] and r["language"] == r["lang"] for r in own) >= 0.998 * len(own)
    unnamed = spark.createDataFrame([(-99, FOREIGN["it"], None, None)], docs.schema).unionByName(planted).unionByName(docs)
    rows = language_id.identify(unnamed, F.col("text"), F.col("lang"), F.col("source")).where("doc_id = -99").collect()
    assert [r["language"] for r in rows] == ["it"]


def test_without_declared_languages_all_are_rejected(spark):
    docs = spark.createDataFrame([(1, ITALIAN[0], None), (2, "plain words here", " ")], "doc_id long, text string, lang string")
    rows = language_id.identify(docs, F.col("text"), F.col("lang")).collect()
    assert len(rows) == 2 and all(r["language"] is None and not r["accepted"] for r in rows)


def test_languages_come_from_the_declared_column(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.regexp_replace("lang", "^es$", "it").alias("lang"))
    rows = language_id.identify(docs, F.col("text"), F.col("lang")).collect()
    assert {r["language"] for r in rows} == {"en", "de", "fr", "it"} and all(r["language"] == r["lang"] for r in rows)


def test_language_on_awkward_rows(spark, awkward, empty):
    rows = language_id.identify(awkward, F.col("text"), F.col("lang"), F.col("source"), F.col("source")).collect()
    assert len(rows) == len(awkward_rows())
    blank = [r for r in rows if not (r["text"] or "").strip()]
    assert blank and all(r["language"] is None and not r["accepted"] for r in blank)
    assert language_id.identify(empty, F.col("text")).count() == 0


def test_host_prior_is_smoothed_level_by_level(spark):
    rows = [("x.site.org", 0, 6.0), ("y.site.org", 1, 2.0), ("z.com", 1, 4.0)]
    said = spark.createDataFrame(rows, "host string, best int, c double")
    got = {r["__host"]: [math.exp(x) for x in r["__prior"]] for r in language_id.host_priors(said, 2).collect()}
    pull = language_id.HOST_PULL
    every = [7 / 14, 7 / 14]
    def down(n, above):
        return [(c + pull * p) / (sum(n) + pull) for c, p in zip(n, above)]
    want = down([6, 0], down([6, 2], down([6, 2], every)))
    assert got["x.site.org"] == pytest.approx(want)
    assert got["z.com"] == pytest.approx(down([0, 4], down([0, 4], every)))


def test_address_and_markup(spark):
    row = spark.createDataFrame([("https://u@M.Shop.example.de:80/x?y", "<!DOCTYPE html><HTML class=a lang='de-AT'>")], "u string, h string")
    host, suffix = language_id.address_parts(F.col("u"))
    assert row.select(host, suffix, language_id.markup_language(F.col("h"))).first()[:] == ("m.shop.example.de", "de", "de")


# --- op8 ----------------------------------------------------------------------------------------

def test_mixing(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame in (docs, awkward):
        rows = [tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()]
        for share in (0.1, 0.6, 1.7, 5.0):
            got = sorted(((r["doc_id"], r["epoch"]) for r in mixing.mix(frame, budget_share=share).collect()), key=str)
            assert got == brute.mix(rows, mixing.LANGUAGE_WEIGHTS, share)
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_to_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    total = sum(len(brute.words(r["text"])) for r in docs.collect())
    used = mixed.agg(F.sum("n_tokens")).first()[0]
    assert 0.5 * total * 0.6 < used <= total * 0.6


# --- op9 ----------------------------------------------------------------------------------------

def substring_rows(docs):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(substring.repeated_passages(docs)).collect()}


def test_repeated_passages(spark, awkward, empty):
    assert substring_rows(awkward) == brute.substring(pairs())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert substring_rows(docs) == brute.substring(sf_docs(spark))
    assert substring.repeated_passages(empty).count() == 0


def test_repeated_passages_spans_and_hot_keys(spark, awkward, monkeypatch):
    found = substring.repeated_passages(awkward).collect()
    texts = brute.one_per_id(pairs())
    for r in found:
        w = brute.words(texts[r["doc_id"]])
        gone = {i for s in r["spans"] for i in range(s["begin"], s["end"])}
        assert r["kept_text"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    monkeypatch.setattr(substring, "HOT", 1)  # every repeated key takes the path of hot ones
    assert substring_rows(awkward) == brute.substring(pairs())


# --- op10 ---------------------------------------------------------------------------------------

def test_benchmark_hits(spark, awkward, empty):
    rng = random.Random(8)
    base = awkward_rows()[0][1].split()
    items = [(1, " ".join(base[5:30])), (2, " ".join(base[100:112]).upper()), (3, "one two"), (4, None), (5, ""), (None, "one two"),
             (6, sentence(rng, 30)), (3, "w " * 12), (7, "zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
                  for d, n, hit, ids in brute.benchmark_hits(pairs(), items))
    for block in (1 << 20, 60):  # one block, several blocks
        found = decontaminate.find_benchmark(awkward, bench, block_bytes=block)
        got = sorted((str(r[0]), *r[1:]) for r in decontaminate.digest(found).collect())
        assert got == want
    assert decontaminate.find_benchmark(empty, bench).count() == 0
    assert decontaminate.find_benchmark(awkward, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_decontaminated_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    hits = {d: hit for d, _, hit, _ in brute.benchmark_hits(sf_docs(spark), items)}
    assert any(hits.values())
    texts = dict(sf_docs(spark))
    for r in decontaminate.decontaminate(docs, bench).collect():
        want = brute.cut_benchmark(texts[r["doc_id"]], hits[r["doc_id"]]) if hits[r["doc_id"]] else texts[r["doc_id"]]
        assert r["text"] == want and r["n_chars"] == len(want)
