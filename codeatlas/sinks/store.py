"""The run store as Parquet tables, with key merges.

A table is a folder of versions; a merge writes the next version and then renames a new pointer file over the old one, so a reader sees one version or the other, and a lost
executor or driver leaves the old one in place. One writer at a time: conflicts of writers are for a table format to settle, which this isn't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve, windows

SCHEMAS = {
    "repos": "id long, owner string, name string, created_at timestamp, last_analysis_requested_at timestamp, last_history_requested_at timestamp",
    "analysis_runs": "id long, repo_id long, commit_sha string, analyzer_version string, status string, result string, error_message string, created_at timestamp",
    "history_cache": "id long, repo_id long, computed_through_sha string, entries string, computed_at timestamp",
    "submission_rate_limits": "identifier string, last_submitted_at timestamp",
    "schema_migrations": "filename string, applied_at timestamp",
}
STATUSES = ("completed", "partial", "failed")
LATER_ARRAYS = ("externalDependencies", "callableSignatures", "callEdges", "behaviorNodes", "behaviorEdges", "functionImportance")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/_current")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def read(self, table: str) -> DataFrame:
        path, fs, jvm = self._pointer(table)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[table])
        stream = fs.open(path)
        version = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{version}")

    def write(self, table: str, rows: DataFrame) -> None:
        path, fs, _ = self._pointer(table)
        version = f"v-{uuid.uuid4().hex}"
        cols = [x.strip().split(" ") for x in SCHEMAS[table].split(",")]
        rows.select(*[F.col(c).cast(t).alias(c) for c, t in cols]).write.parquet(f"{self.root}/{table}/{version}")
        # the new pointer is written beside the old one and renamed over it, so there is a whole one at any time
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        beside = hadoop.Path(f"{self.root}/{table}/_next-{version}")
        out = fs.create(beside, False)
        out.write(bytearray(version.encode()))
        out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(path), overwrite)

    def _numbered(self, table: str, new: DataFrame, order: list[str]) -> DataFrame:
        """Ids after the largest one, in order; a first load may be as large as the table, so it is numbered over all tasks."""
        top = self.read(table).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
        return windows.numbered_global(new.drop("id"), [F.col(c) for c in order], "id", top + 1)

    # --- runs

    def save_runs(self, runs: DataFrame) -> DataFrame:
        """Adds runs (repo_id, commit_sha, analyzer_version, status, result, error_message, created_at) whose key is new, and returns the stored rows of all keys given.
        Stored runs never change."""
        bad = runs.where(~F.col("status").isin(*STATUSES))
        if bad.take(1):
            raise ValueError("unknown status")
        key = ["repo_id", "commit_sha", "analyzer_version"]
        new = resolve.without(resolve.first_wins(runs, key, [F.col("created_at")]), self.read("analysis_runs"), key)
        new = self._numbered("analysis_runs", new, ["created_at", *key])
        self.write("analysis_runs", self.read("analysis_runs").unionByName(new, allowMissingColumns=True))
        return self.read("analysis_runs").join(runs.select(*key).distinct(), key, "left_semi")

    def run_by_key(self, repo_id: int, sha: str, version: str) -> DataFrame:
        return self.read("analysis_runs").where((F.col("repo_id") == repo_id) & (F.col("commit_sha") == sha) & (F.col("analyzer_version") == version))

    def latest_run(self, owner: str, name: str) -> DataFrame:
        """The newest run of a repository in exactly this spelling, whatever its status."""
        repo = self.read("repos").where((F.col("owner") == owner) & (F.col("name") == name)).select(F.col("id").alias("repo_id"))
        return self.read("analysis_runs").join(repo, "repo_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(1)

    def latest_runs(self) -> DataFrame:
        return resolve.latest_per_key(self.read("analysis_runs"), ["repo_id"], "created_at", "id")

    def index_facts(self) -> DataFrame:
        """Per repository the facts of its newest run that decide whether it is listed: counts from the stored document, not the document."""
        r = self.latest_runs()
        v = F.try_parse_json("result")
        get = lambda path, kind: F.try_variant_get(v, path, kind)
        size = lambda path: F.coalesce(F.size(get(path, "array<variant>")), F.lit(0))
        names = F.transform(get("$.structuralAreas", "array<variant>"), lambda a: F.try_variant_get(a, "$.name", "string"))
        major = F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "."))
        repos = self.read("repos").select(F.col("id").alias("repo_id"), "owner", "name")
        return r.join(repos, "repo_id").select(
            "repo_id", "owner", "name", "status", "created_at", F.greatest(size("$.entryPoints"), F.lit(0)).alias("entry_points"), F.greatest(major, F.lit(0)).alias("major_areas"),
            F.coalesce(get("$.snapshot.isPrivate", "boolean"), F.lit(False)).alias("is_private"), F.nullif(get("$.snapshot.description", "string"), F.lit("")).alias("description"),
        )

    # --- repositories

    def upsert_repos(self, rows: DataFrame) -> DataFrame:
        """Adds (owner, name, created_at) that aren't there; returns the stored rows of all given."""
        new = resolve.without(rows.dropDuplicates(["owner", "name"]), self.read("repos"), ["owner", "name"])
        self.write("repos", self.read("repos").unionByName(self._numbered("repos", new, ["created_at", "owner", "name"]), allowMissingColumns=True))
        return self.read("repos").join(rows.select("owner", "name").distinct(), ["owner", "name"], "left_semi")

    def _ranked(self, asked: DataFrame, first: str) -> DataFrame:
        """Stored spellings of each asked (owner, name), best first. The two callers rank differently: adopting asks for the exact spelling before runs, finding
        for runs before the exact spelling."""
        ran = self.read("analysis_runs").select(F.col("repo_id").alias("id")).distinct().withColumn("_r", F.lit(1))
        r = self.read("repos").join(ran, "id", "left")
        a = asked.select(F.col("owner").alias("_o"), F.col("name").alias("_n")).distinct()
        j = r.join(a, (F.lower("owner") == F.lower("_o")) & (F.lower("name") == F.lower("_n")))
        exact, runs = ((F.col("owner") == F.col("_o")) & (F.col("name") == F.col("_n"))).desc(), F.coalesce("_r", F.lit(0)).desc()
        w = Window.partitionBy("_o", "_n").orderBy(*((exact, runs) if first == "exact" else (runs, exact)), "id")
        return j.withColumn("_k", F.row_number().over(w)).where("_k = 1")

    def find_ignoring_case(self, asked: DataFrame) -> DataFrame:
        return self._ranked(asked, "runs").drop("_r", "_o", "_n", "_k")

    def adopt_canonical(self, canonical: DataFrame) -> DataFrame:
        """Re-spells the best match of each canonical (owner, name), or adds it."""
        best = self._ranked(canonical, "exact").select("id", F.col("_o").alias("o"), F.col("_n").alias("n"))
        respelled = self.read("repos").join(best, "id", "left").withColumn("owner", F.coalesce("o", "owner")).withColumn("name", F.coalesce("n", "name")).drop("o", "n")
        self.write("repos", respelled)
        return self.upsert_repos(canonical)

    # --- history and limits

    def save_history(self, rows: DataFrame) -> None:
        """Replaces the cached entries of the repositories given (repo_id, computed_through_sha, entries, computed_at)."""
        old = self.read("history_cache")
        same = old.select("repo_id", "id")
        kept = resolve.without(old, rows, ["repo_id"])
        given = resolve.last_wins(rows, ["repo_id"], "computed_at").join(same, "repo_id", "left")
        fresh = self._numbered("history_cache", given.where("id is null").drop("id"), ["repo_id"])
        self.write("history_cache", kept.unionByName(given.where("id is not null")).unionByName(fresh))

    def history(self, owner: str, name: str) -> DataFrame:
        repo = self.read("repos").where((F.col("owner") == owner) & (F.col("name") == name)).select(F.col("id").alias("repo_id"))
        return self.read("history_cache").join(repo, "repo_id", "left_semi")

    def claim(self, repo_id: int, column: str, now: str, seconds: int = 60) -> int:
        """0 and the claim is stored, or the whole seconds that are left. column: last_analysis_requested_at or last_history_requested_at."""
        r = self.read("repos")
        left = _left(F.col(column), F.lit(now).cast("timestamp"), seconds)
        found = r.where(F.col("id") == repo_id).select(left.alias("left")).first()
        if found is None:
            raise KeyError(repo_id)
        if found[0] == 0:
            mine = F.col("id") == repo_id
            self.write("repos", r.withColumn(column, F.when(mine, F.lit(now).cast("timestamp")).otherwise(F.col(column))))
        return found[0]

    def claim_submission(self, identifier: str, now: str, seconds: int = 10) -> int:
        r = self.read("submission_rate_limits")
        found = r.where(F.col("identifier") == identifier).select(_left(F.col("last_submitted_at"), F.lit(now).cast("timestamp"), seconds).alias("left")).first()
        if found is None or found[0] == 0:
            mine = self.spark.range(1).select(F.lit(identifier).alias("identifier"), F.lit(now).cast("timestamp").alias("last_submitted_at"))
            self.write("submission_rate_limits", r.where(F.col("identifier") != identifier).unionByName(mine))
            return 0
        return found[0]

    def migrate(self, files: list[str], now: str) -> list[str]:
        """Records the migrations that aren't recorded yet, in order of name; returns them."""
        done = {x[0] for x in self.read("schema_migrations").select("filename").collect()}
        new = [f for f in sorted(files) if f not in done]
        if new:
            rows = self.spark.createDataFrame([(f,) for f in new], "filename string").withColumn("applied_at", F.lit(now).cast("timestamp"))
            self.write("schema_migrations", self.read("schema_migrations").unionByName(rows))
        return new


def _left(last: Column, now: Column, seconds: int) -> Column:
    micros = F.unix_micros(last) + seconds * 1_000_000 - F.unix_micros(now)
    return F.when(last.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(micros / 1_000_000))).cast("int")


def backfilled(result: Column) -> dict[str, Column]:
    """Arrays that older documents lack, as empty ones, by name."""
    v = F.try_parse_json(result)
    return {name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")) for name in LATER_ARRAYS}


def document(df: DataFrame) -> DataFrame:
    """Every row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("result"))


def is_indexable(facts: DataFrame, fixtures: str | None = None) -> DataFrame:
    """Rows of index_facts() that are complete, public, not empty and no fixtures: `fixtures` is a pattern of owner/name, by default none."""
    rows = facts.where("status = 'completed' and not is_private and entry_points > 0 and major_areas > 0")
    return rows if fixtures is None else rows.where(~F.concat_ws("/", "owner", "name").rlike(fixtures))
