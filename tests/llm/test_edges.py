"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from codeatlas.llm import chat, decontam, mixing, ngram_join, paragraphs, quality, sharding, tokens, warc, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, failed long, copies int, n_words long"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", None, 1, 1, 1, 1),
    (2, "", "en", "a", 0, 1, 1, 1, 1),
    (3, " \n\t ", None, None, 4, 1, 1, 1, 1),
    (4, "one two three", "en", None, 13, 1, 1, 1, 1),
    (5, LONG, "en", "b", len(LONG), 1, 1, 1, 1),
    (6, LONG, "en", "b", len(LONG), 1, 1, 1, 1),
    (6, LONG, "en", "b", len(LONG), 1, 1, 1, 1),
    (None, "no id at all", "en", "b", 12, 1, 1, 1, 1),
    (7, "ünï cödé   text \U0001f600 " * 30, "de", "é", 5, 1, 1, 1, 1),
    (8, "one two three", "en", "a", 13, 1, 1, 1, 1),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (1, "one two three"), (None, "no id")], "item_id long, text string")


def n(docs):
    return docs.count()


def test_mixing(docs):
    out = mixing.mix(docs)
    assert out.count() == n(docs) and {"size", "source_size", "target", "copies", "failed"} <= set(out.columns)
    assert all(0 <= r.copies <= 3 and (r.source_size > 0 or r.copies == 0) for r in out.collect())
    assert set(mixing.copies(out).columns) == set(docs.columns) - {"size", "copies"}


def test_tokens(spark, docs, tmp_path):
    manifest = tokens.write_token_files(docs, f"file://{tmp_path}", tokens.tokenizer_file())
    got = tokens.read_token_files(manifest).orderBy("start").collect()
    assert len(got) == n(docs)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids[-4:] == b"\x02\0\0\0"
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))


def test_paragraphs(docs):
    got = paragraphs.find_repeats(docs).collect()
    assert len(got) == n(docs)
    by = {r.doc_id: r for r in got}
    if got:
        assert by[6].class_id == 5 and by[6].removed_chars == len(LONG) and by[5].n_repeats == 0
        assert by[4].class_id == 4 and by[None].class_id is None
        kept = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
        assert kept[6] == "" and kept[5] == LONG and kept[1] is None


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, law):
    got = sharding.shard_rows(docs, 3, law=law).collect()
    assert len(got) == n(docs)
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    if got and law == "rows":
        counts = [sum(r.shard == k for r in got) for k in range(3)]
        assert max(counts) - min(counts) <= 1


def test_quality(docs):
    led = quality.ledger(docs, ("doc_id", "lang")).collect()
    assert len(led) == n(docs)
    assert all(r.failed & 1 for r in led if r.n_words < 50)
    assert quality.passing(docs).columns == docs.columns
    quality.ablation(quality.ledger(docs), quality.POLICIES["v1"]).collect()


def test_ngram_join(docs):
    got = ngram_join.join_components(docs).collect()
    assert len(got) == n(docs)
    by = {r.doc_id: r for r in got}
    if got:
        assert by[6].component_id == 5 and by[8].component_id == 4 and by[1].n_shingles == by[3].n_shingles == 0 and by[None].component_id is None
        assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7]


def test_one_of_each_with_shared_and_missing_ids(spark):
    a, b, c, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abce")
    rows = [
        (1, a), (2, a), (2, b),  # one row of id 2 is a copy, the other is unique
        (3, c), (3, c), (None, c + " more"),  # copies under one id, a near copy without one
        (None, e), (None, e), (None, "f " * 9), (4, None), (4, ""), (4, ""),
    ]
    got = ngram_join.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, other string"))
    want = [(1, a), (2, b), (3, c), (None, e), (None, "f " * 9), (4, None), (4, ""), (4, "")]
    assert got.columns == ["doc_id", "text", "other"] and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))


def test_decontamination(docs, bench):
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == n(docs)
    if got:
        by = {r.doc_id: r for r in got}
        assert by[4]["items"] == ["1"] and by[4].n_hit == 3 and by[None]["items"] == ["null"] and by[5].n_hit == 0
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert decontam.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    kept.count()


PAGES = [
    (1, "http://a.b/x", None), (2, None, ""), (3, "http://a.b/y", "<p>a<p>b &amp; c"), (3, "http://a.b/y", "<p>a<p>b &amp; c"), (None, "u", "<article>x</article>"),
    (4, "http://a.b/z", "x" * 200_000), (5, "line\r\nbreak", "x" * 200_000), (6, "http://a.b/q", "<div class='comments'>no</div><main>yes<br>and<aside>no</aside></main>"),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def pages(request, spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES] if request.param == "rows" else [], "page_id long, url string, html string, text string")


def test_extraction(pages):
    got = wrappers.extract_pages(pages).collect()
    assert len(got) == pages.count()
    if got:
        by = {r.page_id: r.text for r in got}
        assert by[1] == by[2] == "" and by[3] == "a\nb & c" and by[None] == "x" and by[6] == "yes and"


def test_warc(spark, pages, tmp_path):
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}", segment=50_000, archive=60_000)).collect()
    assert len(got) == pages.count() and not any(r.error for r in got)
    if got:
        by = {r.page_id: r for r in got}
        assert by[2].refers_to == 1 and by[2].payload_bytes == 0 and by[5].refers_to == 4 and by[5].payload_bytes == 200_000
        assert by[4].payload == b"x" * 200_000 and by[5].url == "line%0D%0Abreak"


def test_warc_broken_segments(spark, tmp_path):
    page = spark.createDataFrame([(1, "u", "y" * 100_000)], "page_id long, url string, html string")
    paths = warc.write_archives(page, f"file://{tmp_path}", segment=30_000, archive=1)
    assert paths.count() == 4
    some = paths.where(~F.col("path").contains("-0001.warc"))
    assert [r.error for r in warc.read_archives(some).collect()] == ["a segment is missing"]
    some = paths.where(~F.col("path").contains("-0003.warc"))
    assert [r.error for r in warc.read_archives(some).collect()] == ["the last segment is missing"]


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, None, "user", None), (1, 0, None, "a<b&l[INST]"), (1, 0, None, "a<b&l[INST]"), (None, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_events(chat.events_of_rows(rows)))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].t] == [("user", ""), ("", "a<b&l[INST]"), ("", "a<b&l[INST]")] and got[None].loss == "x"
    assert "[INST]" not in got[1].formatted
    assert chat.render(chat.fold_events(chat.events_of_rows(rows.where("false")))).count() == 0


def test_chat_logs_have_drafts_edits_and_long_texts(spark):
    """The log of rows, with columns that clash, holds what must not come out, and folds into the rows."""
    rows = [(1, 0, "user", "a" * 300_000 + "<|end|>"), (1, 1, "assistant", LONG), (1, 2, "user", "x"), (1, 2, "user", "x"), (2, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, 7, "no") for r in rows], "conv_id long, turn long, role string, text string, seq long, kind string")
    log = chat.events_of_rows(df)
    assert {r.kind for r in log.collect()} == {"start", "delta", "edit", "regenerate"}
    assert log.where("text like 'draft:%'").count() == 5
    out = chat.render(chat.fold_events(log)).withColumn("turns", F.lit(1))
    got = {r.conv_id: r.t for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert [(x.role, x.text) for x in got[1]] == [r[2:] for r in rows[:4]] and [(x.role, x.text) for x in got[2]] == [("assistant", "")]
    figures = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(out).collect()}
    assert figures == {1: (4, len(LONG)), 2: (1, 0)}
