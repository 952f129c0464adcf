"""What APIs, registries, lists and paths say, row by row."""

import json

from pyspark.sql import functions as F

from codeatlas.functions import text, urls
from codeatlas.sinks import store
from codeatlas.sources import files


def test_answers_of_an_api(spark):
    rows = spark.createDataFrame([(200, 9), (404, 9), (401, 9), (403, 0), (403, 5), (500, None), (None, None)], "status int, remaining int")
    assert [r[0] for r in rows.select(urls.http_error(F.col("status"), F.col("remaining"))).collect()] == [None, "not-found", "unauthorized", "rate-limited", "unknown", "unknown", "unknown"]


def test_paths_that_name_a_repository(spark):
    cases = [
        (["o", "r"], "o/r"), (["o", "r.git", "tree", "x"], "o/r"), (["GitHub.com", "o", "r"], "o/r"), (["www.github.com", "o", "r", "y"], "o/r"), (["o%2Fr", "x"], "o/r"), (["o", "a%2Eb"], "o/a.b"),
        (["explore", "x"], "reserved"), (["API", "x"], "reserved"), (["o", "%zz"], "undecodable"), (["o"], "missing-owner-or-repo"), (["github.com", "o"], "missing-owner-or-repo"), ([], "missing-owner-or-repo"),
        (None, "missing-owner-or-repo"), (["", "r"], "missing-owner-or-repo"), (["-o", "r"], "invalid-owner"), (["o", "a+b"], "invalid-repo"), (["github.com", "explore", "x"], "explore/x"),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s array<string>").select("i", urls.repository_from_path(F.col("s")).alias("x")).select("i", "x.*").orderBy("i").collect()
    assert [r.reason or f"{r.owner}/{r.repo}" for r in got] == [want for _, want in cases]


def test_lists_of_repositories(spark):
    rows = spark.createDataFrame([("# all",), ("",), (" o/r  # first",), ("p/q",), (None,)], "value string")
    assert [r.name for r in files.repo_list(rows).collect()] == ["o/r", "p/q"]


def test_files_of_commits(spark):
    body = {"sha": "s", "files": [{"filename": "a", "status": "added", "additions": 2, "deletions": 0, "patch": "+x"}, {"filename": "b.png", "status": "modified", "additions": 0, "deletions": 0}]}
    rows = spark.createDataFrame([("r", json.dumps(body)), ("none", '{"sha": "t"}'), ("odd", "<html>")], "run_id string, body string")
    assert [tuple(r) for r in files.commit_files(rows).orderBy("ord").collect()] == [("r", "s", 0, "a", "added", 2, 0, "+x"), ("r", "s", 1, "b.png", "modified", 0, 0, None)]


def test_answers_of_registries(spark):
    cases = [
        ("npm", "a", {"description": " d ", "keywords": ["x", 5, None, "y"]}, " d ", ["x", "y"]), ("npm", "b", {"description": 7, "keywords": "x"}, None, []), ("npm", "c", {}, None, []),
        ("pypi", "d", {"info": {"summary": " s", "keywords": "x, y  z,"}}, " s", ["x", "y", "z"]), ("pypi", "e", {"info": {"summary": "  ", "keywords": ["x"]}}, None, []), ("pypi", "f", {"info": None}, None, []),
    ]
    rows = [(r, n, json.dumps(b)) for r, n, b, _, _ in cases] + [("npm", "g", "<html>"), ("pypi", "h", None)]
    got = {r.name: (r.description, r.keywords) for r in files.registry(spark.createDataFrame(rows, "registry string, name string, body string")).collect()}
    assert got == {n: (d, k) for _, n, _, d, k in cases} | {"g": (None, []), "h": (None, [])}


def test_descriptions_of_the_first_dependencies(spark):
    deps = [("r", i, "npm", f"p{i}", "extra") for i in range(5)] + [("s", 9, "pypi", "p1", "extra"), (None, 1, "npm", "p1", "extra"), ("r", 5, "npm", None, "extra")]
    deps = spark.createDataFrame(deps, "run_id string, ord int, registry string, name string, _n string")
    known = spark.createDataFrame([("npm", "p1", "one", ["k"]), ("npm", "p1", None, ["z"]), ("npm", "p2", "", []), ("npm", "p4", "four", [])], "registry string, name string, description string, keywords array<string>")
    got = {(r.run_id, r.ord): r for r in files.enriched(deps, known, 3).collect()}
    assert len(got) == 8 and all(r._n == "extra" for r in got.values())
    skipped = "Description lookup skipped: more than 3 external dependencies were declared in this repository."
    gap = lambda name, of: f'Could not fetch a description for "{name}" from the {of} registry.'
    assert [(got["r", i].description, got["r", i].enrichment_gap) for i in range(6)] == [(None, gap("p0", "npm")), ("one", None), (None, gap("p2", "npm")), (None, skipped), (None, skipped), (None, skipped)]
    assert (got["r", 1].keywords, got["r", 1].description_source, got["r", 2].keywords, got["r", 4].keywords) == (["k"], "npm", [], None)
    assert got["s", 9].enrichment_gap == gap("p1", "PyPI") and got[None, 1].description == "one"
    assert files.enriched(deps.limit(0), known).count() == 0
    tied = spark.createDataFrame([("r", 1, "npm", "p4"), ("r", 2, "npm", "p4"), ("r", 2, "npm", "p4"), ("r", 3, "npm", "p4")], "run_id string, ord int, registry string, name string")
    assert sorted((r.ord, r.description) for r in files.enriched(tied, known, 2).collect() if r.description) == [(1, "four"), (2, "four"), (2, "four")]


def test_identities_of_requests(spark):
    rows = spark.createDataFrame([("1.2.3.4, 5.6.7.8", "Mozilla"), (" ", "examplebot/1"), (None, None)], "h string, a string")
    got = rows.select(text.first_forwarded(F.col("h")), text.is_crawler(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("1.2.3.4", False), ("unknown", True), ("unknown", True)]


def test_documents_of_older_versions(spark):
    rows = spark.createDataFrame([('{"callEdges": [1, 2]}',), ("{}",), ("broken",)], "result string")
    got = rows.select(*[F.size(c).alias(n) for n, c in store.backfilled(F.col("result")).items()]).collect()
    assert [r.callEdges for r in got] == [2, 0, 0] and all(r.behaviorNodes == 0 for r in got)
