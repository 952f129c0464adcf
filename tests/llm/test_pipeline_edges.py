"""Every stage of the pipeline, and all of them, over odd rows, clashing columns and an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, source_size long, target string, copies string, failed long, n_words string, n_hit long, items string, spans int"
REST = (1, 5, 6, "t", "c", 7, "w", 8, "i", 9)


def words(a, n):
    return " ".join(f"{chr(97 + (a * 7 + k * k) % 26)}word{a}x{k}" for k in range(n))


ROWS = [
    (1, words(1, 80), "en", "a", *REST), (2, words(1, 80), "en", "b", *REST), (3, words(3, 90), None, None, *REST), (3, words(3, 90), None, None, *REST), (4, words(4, 70), "de", "é", *REST),
    (5, None, "en", "a", *REST), (6, "", "en", "a", *REST), (7, " \n", "en", "a", *REST), (None, words(8, 60), "en", "b", *REST), (None, words(9, 60), "en", "b", *REST), (10, words(10, 40_000), "en", "b", *REST),
    (11, words(11, 60) + " " + words(99, 12), "en", "a", *REST), (12, "one two", "en", "c", *REST),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = {}
    for name, rows in (("rows", ROWS), ("empty", [])):
        d = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, KIND).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, words(99, 12)), (2, None), (3, ""), (None, "no id here at all but many more words than ten of them")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out[name] = str(d)
    return out


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_over_odd_rows(spark, sf, stage):
    docs = spark.read.parquet(f"{sf['rows']}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf["rows"])
    every = ids(docs)
    without = lambda *gone: sorted([i for i in every if i not in gone], key=repr)
    if stage == "token_output":
        assert ids(got) == every and {r.doc_id: r.n_tokens for r in got.collect()}[5] == 1
        return
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    for r in got.collect():
        assert tuple(r)[4:] == REST and any(r.text == x[1] and r.doc_id == x[0] for x in ROWS)
    want = {"quality_rules": without(5, 6, 7, 12), "near_duplicates": sorted([*without(2, 3), 3], key=repr), "benchmark_decontamination": without(11)}
    if stage in want:
        assert ids(got) == want[stage]
    else:
        assert set(ids(got)) <= set(every) and got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_over_an_empty_table(spark, sf, stage):
    docs = spark.read.parquet(f"{sf['empty']}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, sf["empty"]).count() == 0


def test_the_whole_pipeline_over_odd_rows(spark, sf):
    got = corpus_pipeline.run(spark, sf["rows"])
    assert {r.doc_id for r in got.collect()} <= {1, 3, 4, None, 10} and got.count() > 0
    assert corpus_pipeline.run(spark, sf["empty"]).count() == 0
