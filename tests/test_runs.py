"""Runs from requests to stored documents and histories, and what happens to them the second time."""

import json

from pyspark.sql import functions as F

from codeatlas.plans import history, runs
from codeatlas.sinks.store import Store

FILES = [
    ("web", "package.json", json.dumps({"name": "meteo", "main": "./src/station.js", "dependencies": {"axios": "1"}})),
    ("web", "src/station.ts", "import axios from 'axios';\nimport { rain } from './gauge/rain';\nexport function report() { return rain(axios.get('/now')); }\n"),
    ("web", "src/gauge/rain.ts", "export function rain(x) { return x; }\n"),
    ("tool", "pyproject.toml", '[project]\nname = "tide"\ndependencies = ["requests"]\n[project.scripts]\ntide = "tide.cli:go"\n'),
    ("tool", "tide/__init__.py", ""),
    ("tool", "tide/cli.py", "import requests\nfrom .moon import phase\n\ndef go():\n    return phase()\n"),
    ("tool", "tide/moon.py", "def phase():\n    return 0\n"),
    ("rust", "main.rs", "fn main() {}\n"),
]
REQUESTS = [("web", "o", "meteo", "a1"), ("tool", "o", "tide", "b1"), ("rust", "o", "iron", "c1")]
LANGUAGES = [("web", "TypeScript", 90), ("web", "CSS", 10), ("tool", "Python", 50), ("rust", "Rust", 9)]


def test_from_request_to_document(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}")
    files = spark.createDataFrame(FILES, "run_id string, path string, text string")
    request = lambda rows: spark.createDataFrame(rows, "run_id string, owner string, name string, commit_sha string")
    languages = spark.createDataFrame(LANGUAGES, "run_id string, language string, bytes long")
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    commits = spark.createDataFrame([("tool", 0, "b1", "use tides", "A", "a", "2024-01-01T10:00:00Z")], "run_id string, ord long, sha string, message string, author_name string, author_login string, authored_at string")
    patch = "@@ -1 +1,2 @@\n import requests\n+import numpy\n"
    changed = spark.createDataFrame([("tool", "b1", 0, "tide/models/cli.py", "modified", 1, 0, patch)], "run_id string, sha string, ord long, file_path string, status string, additions long, deletions long, patch string")
    areas = spark.createDataFrame([("tool", 0, "tide", "tide", "x")], "run_id string, ord long, path string, name string, id string")

    stored = {r.run_id: r for r in runs.refresh(store, request(REQUESTS), files, languages, commits, changed, areas, at(1)).collect()}
    assert {k: r.status for k, r in stored.items()} == {"web": "completed", "tool": "completed", "rust": "failed"}
    assert "o/iron's primary language is Rust (100% of classified source)" in stored["rust"].error_message and stored["rust"].result is None
    assert stored["rust"].analyzer_version == "dispatch-v1:unsupported" and stored["web"].analyzer_version == "dispatch-v1:js-ts-v1"
    web, tool = json.loads(stored["web"].result), json.loads(stored["tool"].result)
    assert list(web) == ["snapshot", *runs.DOCUMENT] == list(tool) and web["snapshot"] == {"owner": "o", "name": "meteo", "commitSha": "a1"}
    assert [d["name"] for d in web["externalDependencies"]] == ["axios"] and [d["name"] for d in tool["externalDependencies"]] == ["requests"]
    assert {c["name"] for c in web["callableSignatures"]} == {"report", "rain"} and tool["callableSignatures"] == []
    entries = {(r.repo_id, r.computed_through_sha): json.loads(r.entries) for r in store.read("history_cache").collect()}
    assert sorted(len(e) for e in entries.values()) == [0, 0, 1]

    # the second time nothing is analysed; a new commit of one repository is
    monkeypatch.setattr(runs.build, "manifest_rows", lambda files: (_ for _ in ()).throw(AssertionError("analysed again")))
    again = runs.refresh(store, request(REQUESTS), files, languages, commits, changed, areas, at(2))
    assert sorted((r.run_id, r.id) for r in again.collect()) == sorted((k, r.id) for k, r in stored.items())
    assert {r.computed_at.day for r in store.read("history_cache").collect()} == {1}
    # a failing history leaves the analysis and the entries of before
    monkeypatch.undo()
    monkeypatch.setattr(history, "build", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    newer = runs.refresh(store, request([("rust", "o", "iron", "c2")]), files, languages, commits, changed, areas, at(3))
    assert [(r.status, r.commit_sha) for r in newer.collect()] == [("failed", "c2")] and store.read("analysis_runs").count() == 4
    assert {r.computed_at.day for r in store.read("history_cache").collect()} == {1}
    assert sorted(r.name for r in runs.stale(store, F.lit("2024-01-03 12:00:00").cast("timestamp")).collect()) == ["meteo", "tide"]
