import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from codeatlas.plans import build
from codeatlas.sinks import versions
from codeatlas.sinks.store import Store
from codeatlas.sources import files, manifests
from codeatlas.sources.js_facts import File
from codeatlas.streaming.history import stream_facts

JS = {
    "package.json": json.dumps({"name": "x", "main": "./src/index.js", "bin": {"x": "src/cli.ts"}, "dependencies": {"react": "^19", "axios": "1"}, "devDependencies": {"axios": "2", "jest": "30"}}),
    "tsconfig.json": '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}}',
    "src/index.ts": "export { helper as tool } from './lib/helper';\nexport * from './more';\nimport data from '@/data/store';\nimport missing from './nowhere';\nimport './x.css';\n",
    "src/more.ts": "export const more = 1;\nexport function extra() { return more; }\n",
    "src/cli.ts": "import { helper } from './lib/helper';\nimport fs from 'fs';\nexport function run() { const v = helper(); fs.readFileSync(v); }\n",
    "src/lib/helper.ts": "export function helper() { return inner(); }\nfunction inner() { return fetch('/x'); }\n",
    "src/data/store.ts": "import axios from 'axios';\nexport default function load() { return axios.get('/y'); }\n",
    "src/ui/App.tsx": "import { useState } from 'react';\nimport { helper } from '../lib/helper';\nexport function App() {\n const [v, setV] = useState(0);\n function onClick() { setV(v + 1); helper(); }\n return <b onClick={onClick}>{v} it's</b>;\n}\n",
    "tests/lib/helper.test.ts": "import { helper } from '../../src/lib/helper';\n",
    "tests/orphan.test.ts": "test('x', () => {});\n",
    "node_modules/z/index.js": "export const z = 1;\n",
}
PY = {
    "pyproject.toml": '[project]\nname = "my-tool"\ndependencies = ["requests>=2", "PyYAML"]\n[project.scripts]\ntool = "my_tool.main:go"\n',
    "my_tool/__init__.py": "from .main import go\n__all__ = ['go', 'Other']\n",
    "my_tool/main.py": "import requests\nfrom . import util\nfrom .util import one, two\nfrom .gone import x\n\ndef go():\n    pass\n\nif __name__ == '__main__':\n    go()\n",
    "my_tool/util.py": "def one(): pass\n",
    "my_tool/broken.py": "import os\ndef (:\n",
    "tests/test_util.py": "from my_tool.util import one\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("r1", p, t) for p, t in JS.items()] + [("r2", p, t) for p, t in PY.items()]
    return build.analyze(spark.createDataFrame(rows, "run_id string, path string, text string"))


def test_js_relationships_and_gaps(tables):
    t = tables["js"]
    rel = {(r.from_id, r.to_id) for r in t["relationships"].collect()}
    assert {("src/index.ts", "src/lib/helper.ts"), ("src/index.ts", "src/data/store.ts"), ("src/index.ts", "src/more.ts"), ("tests/lib/helper.test.ts", "src/lib/helper.ts")} <= rel
    said = {r.description for r in t["gaps"].collect()}
    assert "could not resolve './nowhere'" in said and any("orphan" in s for s in said) and not any("css" in s for s in said)


def test_js_entries_surface_tests_and_dependencies(tables):
    t = tables["js"]
    assert {(r.kind, r.file_path) for r in t["entry_points"].collect()} == {("library", "src/index.ts"), ("cli", "src/cli.ts")}
    assert {(r.name, r.file_path) for r in t["public_contracts"].collect()} == {("tool", "src/lib/helper.ts"), ("more", "src/more.ts"), ("extra", "src/more.ts")}
    assert [(r.test_path, r.implementation_path, r.certainty) for r in t["test_relationships"].collect()] == [("tests/lib/helper.test.ts", "src/lib/helper.ts", "detected")]
    deps = {r.name: (r.scope, len(r.evidence)) for r in t["external_dependencies"].collect()}
    assert deps == {"react": ("direct", 1), "axios": ("direct", 1), "jest": ("dev", 0)}


def test_js_behavior(tables):
    t = tables["js"]
    name = {r.id: r.name for r in t["callables"].collect()} | {r.id: r.name for r in t["behavior_nodes"].collect()}
    edges = {(r.type, name[r.source], name[r.target]) for r in t["behavior_edges"].collect()}
    assert {("CALL", "run", "helper"), ("DATA_FLOW", "helper", "run"), ("CALL", "helper", "inner"), ("IO", "inner", "fetch"), ("IO", "run", "fs"), ("IO", "load", "axios"), ("STATE_WRITE", "onClick", "v"), ("STATE_READ", "onClick", "v"), ("EVENT", "App", "onClick")} <= edges
    scores = {name[r.function_id]: r for r in t["function_importance"].collect()}
    assert "STATE_CONTROLLER" in scores["onClick"].roles and "EVENT_HANDLER" in scores["onClick"].roles and "BOUNDARY" in scores["inner"].roles


def test_areas_and_reading_path(tables):
    a = {r.area: r for r in tables["js"]["areas"].collect()}
    assert a["src/ui"].responsibility == "Presentational React components" and a["tests/lib"].responsibility == "Tests" if "tests/lib" in a else a["tests"].responsibility == "Tests"
    path = [r.file_path for r in tables["js"]["start_here"].orderBy("place").collect()]
    assert path[0] == "src/cli.ts" and path[1] == "src/lib/helper.ts" and len(path) <= 7


def test_python(tables):
    t = tables["py"]
    assert {(r.from_id, r.to_id) for r in t["relationships"].collect()} == {("my_tool/__init__.py", "my_tool/main.py"), ("my_tool/main.py", "my_tool/util.py"), ("tests/test_util.py", "my_tool/util.py")}
    assert {(r.kind, r.file_path) for r in t["entry_points"].collect()} == {("cli", "my_tool/main.py"), ("library", "my_tool/__init__.py")}
    assert [(r.name, r.certainty) for r in t["public_contracts"].orderBy("ord").collect()] == [("go", "detected"), ("Other", "detected")]
    deps = {r.name: (len(r.evidence), r.gap) for r in t["external_dependencies"].collect()}
    assert deps["requests"] == (1, None) and deps["PyYAML"][0] == 0 and deps["PyYAML"][1]
    said = " ".join(r.description for r in t["gaps"].collect())
    assert "gone" in said or "'x'" in said and "broken" in said
    assert [(r.test_path, r.implementation_path) for r in t["test_relationships"].collect()] == [("tests/test_util.py", "my_tool/util.py")]


def test_scanner():
    f = File("a.tsx", "const re = /['\"]/g; const s = `a ${fn('x')} import z from 'z'`;\n// import n from 'n'\nexport default () => <p title='q'>Don't {go()}</p>;\n")
    assert f.imports() == [] and [c["callee"] for c in f.calls()] == ["fn", "go"]
    assert [e["is_default"] for e in f.exports()] == [True]


def test_exported_variables():
    code = (
        "export const a = 1, b = async () => { x, y }, {c, d: e} = z;\nexport let q: number\nexport const r =\n  async function() {}\n"
        "export const long: Map<string, number> = new Map([[1,2]]), s = 3\nfoo, bar\nexport const t: () => " + "A | " * 100 + "B = async () => 1;\n"
    )
    got = [(e["name"], e["is_async"]) for e in File("a.ts", code).exports()]
    assert got == [("a", False), ("b", True), ("c", False), ("e", False), ("q", False), ("r", True), ("long", False), ("s", False), ("t", True)]


def test_re_exports_of_any_depth(spark):
    """Chains are followed to their end, and rings end."""
    rows = [("r", "package.json", '{"main": "src/f0.ts"}')] + [("r", f"src/f{k}.ts", f"export * from './f{k + 1}';\n") for k in range(11)]
    rows += [("r", "src/f11.ts", "export * from './f0';\nexport const deep = 1;\n")]
    t = build.analyze(spark.createDataFrame(rows, "run_id string, path string, text string"))["js"]
    assert [(r.name, r.file_path) for r in t["public_contracts"].collect()] == [("deep", "src/f11.ts")]


def test_archives_of_many_entries(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for k in range(450):
            info = tarfile.TarInfo(f"top/d{k}")
            info.type = tarfile.DIRTYPE
            t.addfile(info)
    df = spark.createDataFrame([("a", bytearray(out.getvalue()))], "run_id string, content binary")
    assert files.archive_entries(df).where("type = 'directory'").count() == 450


def test_large_archives_are_not_opened(spark):
    df = spark.createDataFrame([("a", bytearray(b"x" * 101))], "run_id string, content binary")
    entries = files.archive_entries(df, most=100)
    assert [tuple(r) for r in files.breaches(entries).collect()] == [("a", "compressed-too-large")] and files.extracted(entries)[0].count() == 0


def test_archives_are_read_from_a_folder(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("top/a.py")
        info.size = 5
        t.addfile(info, io.BytesIO(b"x = 1"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.tgz").write_bytes(out.getvalue())
    (tmp_path / "b.tar.gz").write_bytes(bytes(5000))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    entries = files.archive_entries(files.archives(spark, str(tmp_path), most=1000))
    assert {(r.run_id.rsplit("/", 1)[1], r.type) for r in entries.collect()} == {("a.tgz", "file"), ("b.tar.gz", "compressed")}
    assert [r.code for r in files.breaches(entries).collect()] == ["compressed-too-large"] and [r.path for r in files.extracted(entries)[0].collect()] == ["a.py"]


def test_versions_of_a_schema(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 6)], "id long, n int").write.parquet(f"{tmp_path}/v1")
    spark.createDataFrame([(2, 7, "x"), (3, 8, None)], "id long, n long, s string").write.parquet(f"{tmp_path}/v2")
    spark.createDataFrame([], "id long, n long, s string, t string, u int").write.parquet(f"{tmp_path}/v3")
    given = [
        (3, f"{tmp_path}/v3", "id long, n long, s string, t string, u int", {"t": F.concat("s", F.lit("!"))}),
        (1, f"{tmp_path}/v1", "id long, n int", {}),
        (2, f"{tmp_path}/v2", "id long, n long, s string", {"s": F.col("n").cast("string")}),
    ]
    every = sorted(map(tuple, versions.read_versions(spark, given).collect()))
    assert every == [(1, 5, "5", "5!", None, 1), (2, 6, "6", "6!", None, 1), (2, 7, "x", "x!", None, 2), (3, 8, None, None, None, 2)]
    assert sorted(map(tuple, versions.read_versions(spark, given, ["id"]).collect())) == [every[0], every[2], every[3]]
    with pytest.raises(ValueError):
        versions.read_versions(spark, [*given, given[0]])
    with pytest.raises(ValueError):
        versions.read_versions(spark, [given[2], (9, f"{tmp_path}/v1", "id long, n int", {})])


def test_alias_sources():
    got = manifests.aliases({"vite.config.ts": "export default { resolve: { alias: { '@': path.resolve(__dirname, 'src'), bad: x() } } }", "tsconfig.json": '{"compilerOptions": {"paths": {"@": ["other"], "lib/*": ["packages/lib/*"]}}}'})
    by = {r[0]: r[1:3] for r in got}
    assert by["@"] == ("src", "exact") and by["@/"] == ("src", "prefix") and by["lib/"] == ("packages/lib", "prefix") and by["bad"][1] == "gap"


def test_archives(spark):
    def tar(entries):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in entries:
                info = tarfile.TarInfo(name)
                if data is None:
                    info.type, info.linkname = tarfile.SYMTYPE, "x"
                    t.addfile(info)
                else:
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        return bytearray(out.getvalue())

    df = spark.createDataFrame([("a", tar([("top/a.py", b"x = 1"), ("top/link", None)])), ("b", tar([("top/../../etc", b"x")])), ("c", bytearray(b"no"))], "run_id string, content binary")
    entries = files.archive_entries(df)
    ok, skipped = files.extracted(entries)
    assert [(r.run_id, r.path, r.text) for r in ok.collect()] == [("a", "a.py", "x = 1")] and [r.path for r in skipped.collect()] == ["link"]
    assert [tuple(r) for r in files.breaches(entries).collect()] == [("b", "unsafe-entry")]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    at = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp"))
    s.upsert_repos(at([("Octo", "repo", "2024-01-01 00:00:00"), ("octo", "Repo", "2024-01-02 00:00:00")], "owner string, name string, created_at string"))
    doc = json.dumps({"snapshot": {"isPrivate": False, "description": ""}, "entryPoints": [1], "structuralAreas": [{"name": "."}, {"name": "src"}]})
    run = "repo_id long, commit_sha string, analyzer_version string, status string, result string, error_message string, created_at string"
    s.save_runs(at([(2, "a", "v", "completed", doc, None, "2024-01-03 00:00:00")], run))
    again = s.save_runs(at([(2, "a", "v", "failed", None, "x", "2024-01-04 00:00:00"), (2, "b", "v", "failed", None, "x", "2024-01-04 00:00:00")], run))
    assert sorted((r.commit_sha, r.status) for r in again.collect()) == [("a", "completed"), ("b", "failed")]
    assert s.latest_run("octo", "Repo").first().commit_sha == "b" and s.latest_run("OCTO", "repo").count() == 0
    asked = spark.createDataFrame([("Octo", "repo")], "owner string, name string")
    assert s.find_ignoring_case(asked).first().id == 2  # runs count more than the exact spelling
    s.adopt_canonical(asked.withColumn("created_at", F.lit("2024-01-05").cast("timestamp")))
    assert sorted((r.owner, r.name) for r in s.read("repos").collect()) == [("Octo", "repo"), ("octo", "Repo")]
    assert s.claim(1, "last_analysis_requested_at", "2024-01-01 00:00:00") == 0 and s.claim(1, "last_analysis_requested_at", "2024-01-01 00:00:20") == 40
    assert s.claim_submission("ip", "2024-01-01 00:00:00") == 0 and s.claim_submission("ip", "2024-01-01 00:00:04") == 6
    facts = s.index_facts().first()
    assert facts.status == "failed" and s.migrate(["b.sql", "a.sql"], "2024-01-01") == ["a.sql", "b.sql"] and s.migrate(["a.sql"], "2024-01-01") == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = {"sha": "s", "files": [{"filename": "src/db/m.ts", "status": "modified", "additions": 1, "deletions": 0, "patch": "+x"}]}
    (tmp_path / "in" / "a.json").write_text(json.dumps({"run_id": "r", "body": json.dumps(body)}))
    where = spark.createDataFrame([("r", 0, ".", ".", "p:.")], "run_id string, ord long, path string, name string, id string")
    stream_facts(spark, str(tmp_path / "in"), where, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["data-flow"]
