"""Registered queries against their SQL, and the pipeline against its operators."""

import os

import duckdb
import pytest

import corpus_pipeline
from nestql.llm import decontaminate, language_id, minhash_dedup, quality_classifier
from nestql.llm.common import table
from nestql.llm.queries import PIECE_MODEL, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert oracle_sql().keys() <= queries().keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "pieces"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    result = c.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(result.fetchall(), key=str)


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no piece model here")
def test_pipeline_keeps_what_each_operator_keeps(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        before = spark.createDataFrame(rows, docs.schema) if name != "quality" else docs
        after = stage(spark, before, SF)
        if name == "pieces":
            got = after.collect()
            assert after.columns == [*columns, "ids", "round_trip"] and len(got) == len(rows) and all(r.round_trip for r in got)
            break
        assert after.columns == columns
        if name == "quality":
            scores = quality_classifier.quality_scores(before, quality_classifier.fit(before, table(spark, SF, "labels")))
            want = {r.doc_id for r in scores.where("predicted = 1").collect()}
        elif name == "language":
            want = {r.doc_id for r in language_id.languages(before, language_id.fit(before)).where("score >= 0.3 and lang_pred <> 'und'").collect()}
        elif name == "near_dedup":
            want = {r.doc_id for r in minhash_dedup.near_duplicates(before, percent=80).where("kept").collect()}
        else:
            want = {r.doc_id for r in decontaminate.contamination(before, table(spark, SF, "benchmark")).where("not contaminated").collect()}
        rows = after.collect()
        assert sorted(r.doc_id for r in rows) == sorted(want)
        assert 0 < len(rows) <= n
        n = len(rows)


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no piece model here")
def test_pipeline_reads_its_stages_from_parquet(spark):
    files = corpus_pipeline.run(spark, SF).inputFiles()
    assert files and all("/decontamination-" in f and f.endswith(".parquet") for f in files)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.quality is not None}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in queries()["op7_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    assert len(good) > 10 and len(bad) > 10
    assert sum(p == y for _, p, y in rows) >= 0.95 * len(rows)
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)


ODD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a text without an id", None, None, None), (3, "12 34 !!", None, "s", 8),
    (4, "word " * 30_000, "en", "s", 150_000), (5, "the same text twice", "en", "s", 19), (5, "the same text twice", "en", "s", 19), (6, "the same text twice", "en", "s", 19),
]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Ids string, SCORE double, kept_id int, found_items string"
    rows = [(*r, "x", None, 1, "y") for r in ODD]
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, spark.createDataFrame(rows, schema), SF)
    kept = [tuple(r) for r in got.select(*[c for c in got.columns if c.lower() not in ("ids", "round_trip")]).collect()]
    assert {r[:5] for r in kept} <= {r[:5] for r in rows}
    if stage == "near_dedup":
        assert sorted(r[0] for r in kept if r[0] is not None) == [1, 2, 3, 4, 5] and None in {r[0] for r in kept}
    if stage in ("decontamination", "pieces"):
        assert len(kept) == len(rows)
    assert run(spark, spark.createDataFrame([], schema), SF).count() == 0
