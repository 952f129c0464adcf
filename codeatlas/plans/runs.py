"""A run from start to end: which repositories need one, their analysis as one JSON document each, what is stored, and the history that follows.

Many repositories pass at once: keys are looked up by an anti-join before anything is read, all that remain go through one plan, and a repository that can't be analysed is a stored row
with a message, not a failed job.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_stale
from ..operators import resolve
from ..session import keep, materialize, scratch
from ..sinks.store import Store
from . import build, history, views

log = logging.getLogger(__name__)

VERSIONS = {"js-ts": "js-ts-v1", "python": "python-v1"}
#: Tables of a document, and the columns that order their rows.
DOCUMENT = {
    "entryPoints": "entry_points", "publicContracts": "public_contracts", "relationships": "relationships", "testRelationships": "test_relationships", "externalDependencies": "external_dependencies",
    "gaps": "gaps", "structuralAreas": "areas", "startHere": "start_here", "callableSignatures": "callables", "callEdges": "call_edges", "behaviorNodes": "behavior_nodes",
    "behaviorEdges": "behavior_edges", "functionImportance": "function_importance",
}


def due(store: Store, requests: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with repo_id and analyzer_version, of which those without a stored run). requests (run_id, owner, name, commit_sha); languages (run_id, language, bytes)."""
    chosen = views.language_shares(languages)
    known = chosen.where(F.col("analyzer").isin(*VERSIONS))
    version = views.analyzer_version(known, VERSIONS).select("run_id", F.col("version").alias("analyzer_version"))
    ids = store.read("repos").select(F.col("id").alias("repo_id"), "owner", "name")
    asked = requests.join(ids, ["owner", "name"]).join(version, "run_id", "left").withColumn("analyzer_version", F.coalesce("analyzer_version", F.lit("dispatch-v1:unsupported")))
    return asked, resolve.without(asked, store.read("analysis_runs"), ["repo_id", "commit_sha", "analyzer_version"])


def _rows(df: DataFrame, name: str) -> DataFrame:
    """(run_id, field, item, o): rows as JSON, with their place in their own order."""
    order = F.col("ord").cast("long") if "ord" in df.columns else F.col("place").cast("long") if "place" in df.columns else F.lit(0).cast("long")
    return df.select("run_id", F.lit(name).alias("field"), order.alias("o"), F.to_json(F.struct(*[c for c in df.columns if c not in ("run_id", "text")])).alias("item"))


def documents(tables: dict[str, dict[str, DataFrame]], runs: DataFrame) -> DataFrame:
    """(run_id, status, result): every run's tables of all languages as one JSON document, fields in the order of DOCUMENT and present even if empty. runs (run_id, owner, name, commit_sha).

    Rows of a language follow those of the one before it. A document is one value, as it is stored as one."""
    parts = [_rows(t[name], field).withColumn("l", F.lit(k)) for field, name in DOCUMENT.items() for k, t in enumerate(tables.values()) if name in t]
    every = reduce(DataFrame.unionByName, parts)
    packed = every.groupBy("run_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "o", "item"))), lambda x: x["item"]).alias("items"), F.count(F.lit(1)).alias("n"))
    wide = packed.groupBy("run_id").pivot("field", list(DOCUMENT)).agg(F.first("items"))
    j = runs.select("run_id", "owner", "name", "commit_sha").join(wide, "run_id", "left")
    size = lambda f: F.coalesce(F.size(f), F.lit(0)) > 0

    def field(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":['), F.coalesce(F.array_join(F.col(name), ","), F.lit("")), F.lit("]"))

    snapshot = F.to_json(F.struct("owner", "name", F.col("commit_sha").alias("commitSha")))
    result = F.concat(F.lit('{"snapshot":'), snapshot, F.lit(","), F.concat_ws(",", *map(field, DOCUMENT)), F.lit("}"))
    met = size("structuralAreas") & size("startHere") & size("entryPoints")
    return j.select("run_id", F.when(met, F.lit("completed")).otherwise(F.lit("partial")).alias("status"), result.alias("result"))


def analyze_and_store(store: Store, requests: DataFrame, files: DataFrame, languages: DataFrame, now: Column) -> DataFrame:
    """The stored rows of all requests (run_id, owner, name, commit_sha), with run_id; those that have a run already are neither read nor analysed again.

    files (run_id, path, text); languages (run_id, language, bytes), from which analyzers are chosen. A repository without a supported language gets a failed row with the reason."""
    store.upsert_repos(requests.select("owner", "name").distinct().withColumn("created_at", now))
    with scratch():
        asked, new = due(store, requests, languages)
        asked, new = materialize(asked, "asked"), materialize(new, "due")
        none = F.col("analyzer_version") == "dispatch-v1:unsupported"
        able = new.where(~none)
        key = ("run_id", "repo_id", "commit_sha", "analyzer_version")
        named = languages.join(new.where(none).select("run_id", F.concat_ws("/", "owner", "name").alias("repository")), "run_id", "right")
        failed = new.where(none).select(*key).join(views.unsupported_message(named), "run_id", "left").select(*key, F.lit("failed").alias("status"), F.lit(None).cast("string").alias("result"), F.col("message").alias("error_message"))
        rows = failed
        if able.take(1):
            uses = lambda v: able.where(F.col("analyzer_version").contains(VERSIONS[v])).select("run_id")
            own = files.join(able.select("run_id"), "run_id", "left_semi")
            manifest = build.manifest_rows(own)
            tables = {
                "js": build.views(build.analyze_js(own.join(uses("js-ts"), "run_id", "left_semi"), manifest), "js"),
                "py": build.views(build.analyze_py(own.join(uses("python"), "run_id", "left_semi"), manifest), "py"),
            }
            done = documents(tables, able).join(able.select(*key), "run_id").select(*key, "status", "result", F.lit(None).cast("string").alias("error_message"))
            rows = rows.unionByName(done)
        store.save_runs(rows.drop("run_id").withColumn("created_at", now))
        log.info("analysed %d of %d repositories", new.count(), asked.count())
        found = store.read("analysis_runs").join(asked.select(*key), list(key[1:]))
        return keep(materialize(found, "runs"))


def refresh(store: Store, requests: DataFrame, files: DataFrame, languages: DataFrame, commits: DataFrame, commit_files: DataFrame, areas: DataFrame, now: Column) -> DataFrame:
    """analyze_and_store(), then the history of the repositories whose newest run is another one than before. commits, commit_files and areas are those of plans.history, by run_id.

    The analysis stands, whatever happens to the history: a failure there is logged, and the entries stored before stay."""
    before = materialize(store.latest_runs().select("repo_id", F.col("id").alias("before")), "latest")
    stored = analyze_and_store(store, requests, files, languages, now)
    try:
        latest = store.latest_runs().select("repo_id", F.col("id").alias("after"))
        moved = latest.join(before, "repo_id", "left").where(~F.col("before").eqNullSafe(F.col("after"))).select("repo_id")
        fresh = materialize(stored.select("run_id", "repo_id", "commit_sha").join(moved, "repo_id", "left_semi"), "fresh")
        of = lambda df: df.join(fresh.select("run_id"), "run_id", "left_semi")
        found = history.build(of(commits), of(commit_files), of(areas))
        each = F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*[c for c in found.columns if c != "run_id"])).alias("item"))))
        packed = found.groupBy("run_id").agg(F.concat(F.lit("["), F.array_join(F.transform(each, lambda x: x["item"]), ","), F.lit("]")).alias("entries"))
        rows = fresh.join(packed, "run_id", "left").select("repo_id", F.col("commit_sha").alias("computed_through_sha"), F.coalesce("entries", F.lit("[]")).alias("entries"), now.alias("computed_at"))
        store.save_history(rows)
    except Exception:
        log.exception("the history couldn't be computed; what was stored stays")
    return stored


def stale(store: Store, now: Column) -> DataFrame:
    """Repositories (owner, name) whose newest run is a day old or more: those that a request would have analysed anew in the background."""
    old = store.latest_runs().where(is_stale(F.col("created_at"), now)).select(F.col("repo_id").alias("id"))
    return store.read("repos").join(old, "id", "left_semi").select("owner", "name")
