"""Source files, archives and API payloads as tables."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, urls
from ..operators import windows

# Limits of an acquisition.
MAX_COMPRESSED, MAX_EXTRACTED, MAX_FILES = 50 << 20, 300 << 20, 20_000

KINDS = (
    ("file", tarfile.TarInfo.isfile), ("directory", tarfile.TarInfo.isdir), ("symbolic link", tarfile.TarInfo.issym), ("hard link", tarfile.TarInfo.islnk),
    ("device", tarfile.TarInfo.isdev),
)


def scan(spark: SparkSession, root: str, run_id: str, extensions: list[str]) -> DataFrame:
    """(run_id, path, text) of the files below a root with one of the extensions; pruned by name before a byte is read."""
    glob = "*.{" + ",".join(extensions) + "}"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://"))
    path = F.regexp_replace("path", "^file:/+", "/")
    return f.select(F.lit(run_id).alias("run_id"), paths.relative_to(path, base).alias("path"), F.decode("content", "UTF-8").alias("text"))


def js_files(files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript files that aren't excluded, with file_ord in path order."""
    f = files.where(paths.extension(F.col("path")).isin(*paths.JS_EXTENSIONS) & ~paths.is_js_excluded(F.col("path")))
    return _ordered(f)


def py_files(files: DataFrame) -> DataFrame:
    return _ordered(files.where((paths.extension(F.col("path")) == "py") & ~paths.is_py_excluded_by_directory(F.col("path"))))


def _ordered(f: DataFrame) -> DataFrame:
    """Paths are numbered alone, and over all tasks: a large repository's texts never meet in one."""
    n = windows.numbered_split(f.select("run_id", "path"), ["run_id"], [F.expr("collate(path, 'UNICODE')"), F.col("path")], "file_ord", 0)
    return f.join(n, ["run_id", "path"])


def archives(spark: SparkSession, root: str, most: int = MAX_COMPRESSED) -> DataFrame:
    """(run_id, content) of the gzip tarballs below a root, a partition's worth at a time; run_id is the path. Of one that is larger than `most` no byte is read: its content is null."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tgz,tar.gz}").load(root)
    small = f.where(F.col("length") <= most).select(F.col("path").alias("run_id"), "content")
    return small.unionByName(f.where(F.col("length") > most).select(F.col("path").alias("run_id"), F.lit(None).cast("binary").alias("content")))


def archive_entries(archives: DataFrame, most: int = MAX_COMPRESSED) -> DataFrame:
    """(run_id, ord, path, type, size, text) of gzip tarballs (run_id, content): the first path segment is stripped. An unreadable archive gives one row of type 'error',
    one of more than `most` bytes, or without content, a row of type 'compressed' with its size if known, and isn't opened."""
    schema = pa.schema([("run_id", pa.string()), ("ord", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("text", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, content in zip(batch["run_id"].to_pylist(), batch["content"], strict=True):
                rows = []
                size = len(content.as_buffer()) if content.is_valid else None
                if size is None or size > most:
                    yield table([(run_id, -1, "", "compressed", size, None)])
                    continue
                try:
                    with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:gz") as tar:
                        for k, m in enumerate(tar):
                            kind = next((name for name, is_ in KINDS if is_(m)), "other")
                            data = tar.extractfile(m).read().decode("utf-8", "replace") if m.isfile() and m.size <= MAX_EXTRACTED else None
                            rows.append((run_id, k, m.name.partition("/")[2], kind, m.size, data))
                            if len(rows) >= 200:
                                yield table(rows)
                                rows = []
                except (tarfile.TarError, OSError, EOFError) as e:
                    rows.append((run_id, -1, str(e), "error", 0, None))
                if rows:
                    yield table(rows)

    return archives.select("run_id", "content").mapInArrow(run, "run_id string, ord long, path string, type string, size long, text string")


def breaches(entries: DataFrame, most_bytes: int = MAX_EXTRACTED, most_files: int = MAX_FILES) -> DataFrame:
    """(run_id, code): the first limit that an archive breaks, in order of its entries; runs without one give no row."""
    p = F.col("path")
    unsafe = p.startswith("/") | F.array_contains(F.split(p, "/"), "..")
    total = F.sum(F.when(F.col("type") == "file", F.col("size")).otherwise(0)).over(windows.running(["run_id"], [F.col("ord")]))
    n = F.sum(F.when(F.col("type") == "file", 1).otherwise(0)).over(windows.running(["run_id"], [F.col("ord")]))
    rules = [("compressed-too-large", F.col("type") == "compressed"), ("unsafe-entry", unsafe), ("too-many-files", n > most_files), ("extracted-too-large", total > most_bytes)]
    return windows.first_breach(entries.drop("text"), ["run_id"], [F.col("ord")], rules).select("run_id", "code")


def extracted(entries: DataFrame, broken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files (run_id, path, text), skipped (run_id, ord, path, type)) of archives that break no limit: entries that are neither files nor directories are skipped. broken: breaches() of other limits."""
    sound = entries.join(breaches(entries) if broken is None else broken, "run_id", "left_anti")
    return sound.where("type = 'file'").select("run_id", "path", "text"), sound.where("type not in ('file', 'directory', 'error')").select("run_id", "ord", "path", "type")


def repositories(payloads: DataFrame) -> DataFrame:
    """Repository heads of API payloads (run_id, status, remaining, body): owner, name, default_branch, description, or the error. Private ones read as not found."""
    schema = "name string, private boolean, default_branch string, description string, html_url string, owner struct<login:string>"
    b = F.from_json("body", schema)
    error = F.coalesce(urls.http_error(F.col("status"), F.col("remaining")), F.when(F.coalesce(b["private"], F.lit(False)), F.lit("not-found")))
    ok = lambda c: F.when(error.isNull(), c)
    return payloads.select("run_id", error.alias("error"), ok(b["owner"]["login"]).alias("owner"), ok(b["name"]).alias("name"), ok(b["default_branch"]).alias("default_branch"), ok(b["description"]).alias("description"), ok(b["html_url"]).alias("url"))


def languages(payloads: DataFrame) -> DataFrame:
    """(run_id, language, bytes) of payloads (run_id, body) that map languages to bytes."""
    return payloads.select("run_id", F.explode(F.from_json("body", "map<string,bigint>")).alias("language", "bytes"))


def commits(payloads: DataFrame) -> DataFrame:
    """Commit rows of listing payloads (run_id, page, body): ord follows pages and places."""
    schema = "array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>,author:struct<login:string>>>"
    c = payloads.select("run_id", "page", F.posexplode(F.from_json("body", schema)).alias("pos", "c"))
    c = windows.numbered(c, ["run_id"], [F.col("page"), F.col("pos")], "ord", 0)
    return c.select("run_id", "ord", "c.sha", "c.commit.message", F.col("c.commit.author.name").alias("author_name"), F.col("c.author.login").alias("author_login"), F.col("c.commit.author.date").alias("authored_at"))


def commit_files(payloads: DataFrame) -> DataFrame:
    """Changed files of detail payloads (run_id, body); a commit without files gives no rows."""
    schema = "sha string, files array<struct<filename:string,status:string,additions:int,deletions:int,patch:string>>"
    b = F.from_json("body", schema)
    f = payloads.select("run_id", b["sha"].alias("sha"), F.posexplode(b["files"]).alias("ord", "f"))
    return f.select("run_id", "sha", F.col("ord").cast("long").alias("ord"), F.col("f.filename").alias("file_path"), "f.status", "f.additions", "f.deletions", "f.patch")


def registry(payloads: DataFrame) -> DataFrame:
    """(registry, name, description, keywords) of registry payloads (registry, name, body). Values of other types than text, unreadable bodies and blank summaries of PyPI give a null description and no keywords."""
    v = F.try_parse_json("body")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    texts = F.filter(F.try_variant_get(v, "$.keywords", "array<variant>"), lambda k: F.schema_of_variant(k) == "STRING")
    npm = F.transform(texts, lambda k: F.try_variant_get(k, "$", "string"))
    pypi = F.filter(F.split(text("$.info.keywords"), r"[,\s]+"), lambda k: k != "")
    is_npm, summary = F.col("registry") == "npm", text("$.info.summary")
    description = F.when(is_npm, text("$.description")).otherwise(F.when(summary.rlike(r"\S"), summary))
    return payloads.select("registry", "name", description.alias("description"), F.coalesce(F.when(is_npm, npm).otherwise(pypi), F.array().cast("array<string>")).alias("keywords"))


def enriched(deps: DataFrame, metadata: DataFrame, most: int = 100) -> DataFrame:
    """Dependencies (run_id, ord, registry, name, ...) with description, description_source, keywords and enrichment_gap; of a run the first `most` are looked up.

    The number of the last one looked up is found from the first `most` rows of each task, so a run of any size is never sorted as a whole; rows of one ord are looked up or left together. Of several answers for a name
    one with a description counts, the largest."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))
    last = deps.select("run_id", "ord", n.alias("_n")).where(F.col("_n") <= most).groupBy(F.col("run_id").alias("_run")).agg(F.max("ord").alias("_last"))
    answers = metadata.groupBy("registry", "name").agg(F.max(F.struct("description", "keywords")).alias("_m"))
    seen = F.col("ord") <= F.col("_last")
    j = deps.join(last, F.col("run_id").eqNullSafe(F.col("_run")), "left").join(answers, ["registry", "name"], "left")
    found = F.when(seen, F.nullif(F.col("_m.description"), F.lit("")))
    label = F.when(F.col("registry") == "npm", F.lit("npm")).otherwise(F.lit("PyPI"))
    # The sentences of gaps.
    skipped = F.lit(f"Description lookup skipped: more than {most} external dependencies were declared in this repository.")
    missing = F.concat(F.lit('Could not fetch a description for "'), F.coalesce("name", F.lit("")), F.lit('" from the '), label, F.lit(" registry."))
    gap = F.when(~F.coalesce(seen, F.lit(False)), skipped).when(found.isNull(), missing)
    return j.select(*deps.columns, found.alias("description"), F.when(found.isNotNull(), F.col("registry")).alias("description_source"), F.when(seen, F.col("_m.keywords")).alias("keywords"), gap.alias("enrichment_gap"))


def repo_list(lines: DataFrame) -> DataFrame:
    """Names of a list file (value): comments and blanks are dropped."""
    name = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(name.alias("name")).where("name <> ''")
