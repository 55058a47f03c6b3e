"""The corpus pipeline against the plain Python versions of its stages."""

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm import line_align, mixing, queries, textkit
from tests.llm import brute
from tests.llm.test_operators import awkward_rows

SF = "/root/testdata/sf0.001"


def later_stages(rows, items):
    """Rows (doc_id, epoch) after stages 2 to 5 for rows (doc_id, text, lang, source) with ids."""
    known = {d: (lang, source) for d, _, lang, source in rows}
    deduped = brute.line_dedup([r[:2] for r in rows], most=line_align.LINE_DOCS)
    texts = {d: t for d, (t, gone) in deduped.items() if not gone or brute.words(t)}
    texts = {d: texts[d] for d, (_, component) in brute.near(list(texts.items())).items() if component == d}
    for d, _, hit, _ in brute.benchmark_hits(list(texts.items()), items):
        if hit:
            texts[d] = brute.cut_benchmark(texts[d], hit)
    return texts, brute.mix([(d, t, *known[d]) for d, t in texts.items()], mixing.LANGUAGE_WEIGHTS)


def test_pipeline_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs, SF)
    assert first.columns == corpus_pipeline.COLUMNS == docs.columns and first.count() == docs.count()
    rows = [tuple(r) for r in first.select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts, want = later_stages(rows, items)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == want
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_every_stage_takes_awkward_rows(spark):
    rows = [(*r, len(r[1] or ""), 5) for r in awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    empty = docs.limit(0)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        kept = {r["doc_id"] for r in out.collect()}
        assert out.columns[:5] == corpus_pipeline.COLUMNS and kept <= {r[0] for r in rows}, name
        assert number == 4 or len(out.columns) == 5
        if name in ("line_dedup", "ngram_join", "decontaminate"):
            assert None in kept  # rows without id pass
        assert stage(spark, empty, SF).count() == 0


def test_a_run_leaves_only_the_stages_results(spark):
    import os
    folder = textkit.shared_folder(spark)
    before = set(os.listdir(folder))
    with textkit.scratch(spark):
        kept = textkit.written(spark.range(3), keep=True)
        gone = textkit.written(spark.range(5))
        assert gone.count() == 5
    assert kept.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    got = corpus_pipeline.run(spark, SF)
    made = set(os.listdir(folder)) - before
    assert got.count() and len(made) <= 1 + 4 + 12  # four stages' tables and the lazy last stage's own


def test_registered_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mixing"]
    found = entry.queries()
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14)) and "pipeline" in found
    assert set(queries.ORACLE) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(found)
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def test_queries_match_their_sql(spark):
    import duckdb
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in queries.ORACLE.items():
        found = queries.QUERIES[name](spark, SF)
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(found.columns), name
        got = sorted((tuple(r) for r in found.select(*names).collect()), key=str)
        assert got == sorted((tuple(r) for r in want.fetchall()), key=str), name
