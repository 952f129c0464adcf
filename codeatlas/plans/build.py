"""A whole analysis: files of many repositories in, fact tables out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import materialize
from ..sources import files as sources
from ..sources import manifests
from . import areas, extract, importance, start_here

ROOT_FILES = [
    "package.json", "pyproject.toml", "setup.cfg", "setup.py", "tsconfig.json", "jsconfig.json", ".babelrc", "babel.config.json",
    *(n for names, _ in manifests.BUNDLERS for n in names),
]
_MANIFEST = "run_id string, kind string, o int, name string, value string, scope string"


def _manifest_rows(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in groups:
        rows = []
        for run_id, part in g.groupby("run_id"):
            files = {}
            for packed in part["files"]:
                files |= {f["path"]: f["text"] for f in packed}
            m = manifests.package_json(files.get("package.json", ""))
            if m:
                rows.append((run_id, "js-manifest", 0, None, None, None))
            for field in ("exports", "main", "module"):
                target = manifests.export_target(m.get(field))
                if target:
                    rows.append((run_id, "js-entry", 0, field, target, None))
            binary = m.get("bin")
            for k, v in enumerate([binary] if isinstance(binary, str) else list(binary.values()) if isinstance(binary, dict) else []):
                rows.append((run_id, "js-entry", k, "bin", str(v), None))
            for k, (name, version, scope) in enumerate(manifests.js_dependencies(m)):
                rows.append((run_id, "js-dep", k, name, version, scope))
            for k, (pattern, target, kind, source) in enumerate(manifests.aliases(files)):
                rows.append((run_id, f"alias-{kind}", k, pattern, target, source))
            for k, (kind, name, value, scope) in enumerate(manifests.python_config(files)):
                rows.append((run_id, f"py-{kind}", k, name, value, scope))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MANIFEST.split(", ")]).astype({"o": "int32"})


def manifest_rows(files: DataFrame) -> DataFrame:
    """What the root's manifests and alias configurations say, per run: (run_id, kind, o, name, value, scope)."""
    root = files.where(F.col("path").isin(*ROOT_FILES) | (~F.col("path").contains("/") & F.col("path").rlike(r"^tsconfig.*\.json$")))
    packed = root.groupBy("run_id").agg(F.collect_list(F.struct("path", "text")).alias("files"))  # a few dozen small files
    return materialize(packed.mapInPandas(_manifest_rows, _MANIFEST), "manifests")


def analyze_js(files: DataFrame, manifest: DataFrame, project: str = "js-ts") -> dict[str, DataFrame]:
    """Fact tables of the JavaScript and TypeScript files of all runs. files (run_id, path, text)."""
    f = materialize(sources.js_files(files).withColumn("project_id", F.lit(project)), "js-files")
    facts = extract.parse(f, "js")
    t = {k: materialize(extract.table(facts, k, extract.JS), k) for k in extract.JS}
    alias = manifest.where(F.col("kind").startswith("alias-")).select("run_id", F.col("name").alias("pattern"), F.col("value").alias("target"), F.substring("kind", 7, 20).alias("match_type"), F.col("o").alias("rank"))
    resolved = materialize(extract.js_resolved(t["import"], f, alias), "resolved")
    plain = materialize(extract.js_resolved(t["import"], f), "resolved")  # the call graph and tests know no aliases
    rel = materialize(extract.js_relationships(resolved), "relationships")
    named, bound = materialize(extract.callables(t["callable"]), "callables"), materialize(extract.named_imports(plain), "bound")
    call, flow = extract.call_graph(t["call"], named, bound)
    states, state_edges = extract.react_state(t["hook"], t["call"], t["ident"], named)
    events = extract.react_events(t["handler"], named, bound)
    effects = extract.react_effects(t["hook"], t["call"], states, named, bound)
    nodes, io = extract.boundaries(t["ident"], resolved, named)
    edges, place = None, 0
    for part in (call.withColumn("id", F.concat(F.lit("js-ts-behavior-call-"), "id")), flow, state_edges, events, effects, io):
        part = part.withColumn("part", F.lit(place))
        edges, place = part if edges is None else edges.unionByName(part), place + 1
    edges = materialize(extract.windows.numbered(edges.withColumnRenamed("ord", "o"), ["run_id"], [F.col("part"), F.col("o"), F.col("id")], "ord").drop("part", "o"), "edges")
    behavior = materialize(states.unionByName(nodes), "nodes")
    declared = manifest.where("kind = 'js-entry'").select("run_id", F.col("name").alias("field"), "o", F.col("value").alias("target"))
    framework = extract.next_entry_points(t["export"], t["flag"])
    entries = materialize(extract.js_entry_points(declared, f, t["flag"], rel, framework), "entries")
    surface = materialize(extract.js_surface(entries, t["export"], f), "surface")
    tests, test_gaps = extract.js_tests(f, plain, entries)
    refs = resolved.where("verdict = 'external'").select("run_id", F.col("ord").alias("o"), paths.package_name(F.col("specifier")).alias("name"), "file_path", "line")
    deps = manifest.where("kind = 'js-dep'").select("run_id", "o", "name", F.col("value").alias("version"), "scope")
    deps = extract.external_dependencies(deps, refs, lambda c: c, project, "npm")
    broken = facts.where("kind = 'gap'").select("run_id", F.lit("unknown").alias("certainty"), F.get_json_object("data", "$.description").alias("description"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    config = manifest.where("kind = 'alias-gap'").select("run_id", F.lit("unsupported").alias("certainty"), F.col("value").alias("description"), F.col("scope").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    gaps = config.unionByName(extract.js_import_gaps(resolved)).unionByName(test_gaps).unionByName(broken)
    react = t["component"].select("run_id", F.col("file_path").alias("path"), "name", "line")
    return {
        "files": f, "relationships": rel, "entry_points": entries, "public_contracts": surface, "callables": named, "call_edges": call, "behavior_nodes": behavior, "behavior_edges": edges,
        "test_relationships": tests, "external_dependencies": deps, "gaps": gaps, "components": react,
    }


def analyze_py(files: DataFrame, manifest: DataFrame, project: str = "python") -> dict[str, DataFrame]:
    """Fact tables of the Python files of all runs."""
    f = materialize(sources.py_files(files).withColumn("project_id", F.lit(project)), "py-files")
    facts = extract.parse(f, "py")
    imports, surface = (materialize(extract.table(facts, k, extract.PY), k) for k in ("import", "surface"))
    rel, external, gaps = extract.py_relationships(imports, f)
    rel = materialize(rel, "relationships")
    scripts = manifest.where("kind = 'py-script'").select("run_id", "o", F.col("value").alias("target"))
    names = manifest.where("kind = 'py-name'").select("run_id", "name")
    entries = materialize(extract.py_entry_points(scripts, surface, names, f, rel), "entries")
    contracts = extract.py_surface(entries, surface)
    tests, test_gaps = extract.py_tests(f, rel)
    deps = manifest.where("kind = 'py-dependency'").select("run_id", "o", "name", F.col("value").alias("version"), "scope")
    refs = external.select("run_id", F.col("ord").alias("o"), F.col("package").alias("name"), "file_path", "line")
    deps = extract.external_dependencies(deps, refs, paths.python_name, project, "pypi")
    broken = surface.where("not parsed").select("run_id", F.lit("unknown").alias("certainty"), F.concat(F.lit("'"), "file_path", F.lit("' is not valid Python; imports were read line by line")).alias("description"), "file_path", F.lit(None).cast("int").alias("start_line"))
    return {"files": f, "relationships": rel, "entry_points": entries, "public_contracts": contracts, "test_relationships": tests, "external_dependencies": deps, "gaps": gaps.unionByName(test_gaps).unionByName(broken)}


def views(tables: dict[str, DataFrame], language: str) -> dict[str, DataFrame]:
    """tables with areas, start_here and (for JavaScript) function_importance."""
    is_test, is_tooling = (paths.is_js_test, paths.is_js_tooling) if language == "js" else (paths.is_py_test, paths.is_py_tooling)
    contracts = tables["public_contracts"].select("run_id", "ord", "id", "file_path", "kind")
    special = tables["components"].select("run_id", "path") if language == "js" else None
    a = areas.build(tables["files"], tables["entry_points"], contracts, tables["test_relationships"], tables["relationships"], tables["gaps"].where("file_path is not null"), is_test, is_tooling, special)
    a = materialize(a, "areas")
    out = dict(tables) | {"areas": a}
    out["start_here"] = start_here.build(tables["files"], tables["entry_points"], tables["relationships"], a, tables["test_relationships"])
    if language == "js":
        out["function_importance"] = importance.function_importance(tables["callables"], tables["behavior_edges"], tables["behavior_nodes"], tables["entry_points"])
    return out


def analyze(files: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """{'js': tables, 'py': tables} of files (run_id, path, text) of any number of runs."""
    m = manifest_rows(files)
    return {"js": views(analyze_js(files, m), "js"), "py": views(analyze_py(files, m), "py")}


def status(start: DataFrame, area_rows: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, status): completed if a run has areas, a reading path and entry points, else partial."""
    n = lambda df, name: df.groupBy("run_id").agg((F.count(F.lit(1)) > 0).alias(name))
    j = runs.select("run_id").join(n(start, "s"), "run_id", "left").join(n(area_rows, "a"), "run_id", "left").join(n(entries, "e"), "run_id", "left")
    return j.select("run_id", F.when(F.coalesce(F.col("s") & F.col("a") & F.col("e"), F.lit(False)), F.lit("completed")).otherwise(F.lit("partial")).alias("status"))
