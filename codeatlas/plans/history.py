"""Commit history: patches to facts, facts to entries.

commits (run_id, ord, sha, message, author_name, author_login, authored_at) in the order of the listing; commit_files (run_id, sha, ord,
file_path, status, additions, deletions, patch); areas (run_id, ord, path, name, id). Everything is expressions, joins and windows; the one
sequential pass, the nesting of JSON objects in a patch, is a fold over the lines of a single file's patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import resolve, windows

# What a changed line means.
SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
IGNORED_KEYS = ["name", "version", "description", "main", "module", "types", "scripts", "license", "private", "author", "repository", "engines"]
SPEC = r"^(?:[\^~<>=*]|\d|v\d|x(?:\.|$)|latest$|next$|workspace:|npm:|file:|link:|git[+:]|github:)"
OBJECT_OPEN, OBJECT_CLOSE = r'^\s*(?:"([^"]*)":\s*)?\{\s*$', r"^\s*\},?\s*$"
KINDS = ["architecture", "dependency", "data-flow"]
KIND_LABELS = {"architecture": "architecture-related", "dependency": "dependency", "data-flow": "data-layer"}


def patch_lines(patch: Column) -> Column:
    """array<struct<sign, body>> of the changed lines."""
    changed = F.filter(F.split(patch, "\n"), lambda x: F.substring(x, 1, 1).isin("+", "-"))
    return F.transform(changed, lambda x: F.struct(F.substring(x, 1, 1).alias("sign"), F.substring(x, 2, 2**30).alias("body")))


def json_patch_lines(patch: Column) -> Column:
    """array<struct<sign, body, enclosing array<string>>>: each changed line with the keys of the objects that enclose it in the hunk, outermost first; an
    object without a key is null. Old and new side nest on their own."""
    strings = "array<string>"
    start = F.struct(F.array().cast(strings).alias("old"), F.array().cast(strings).alias("new"), F.array().cast("array<struct<sign:string,body:string,enclosing:array<string>>>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        sign, body = F.substring(line, 1, 1), F.substring(line, 2, 2**30)
        opens, closes = body.rlike(OBJECT_OPEN), body.rlike(OBJECT_CLOSE)
        key = F.when(body.rlike(r'^\s*"'), F.regexp_extract(body, OBJECT_OPEN, 1))
        nested = lambda s: F.when(opens, F.concat(s, F.array(key))).when(closes, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
        none = F.array().cast(strings)
        hunk, note = line.startswith("@@"), line.startswith("\\")
        own = F.when(sign == "+", a["new"]).otherwise(a["old"])
        row = F.struct(sign.alias("sign"), body.alias("body"), own.alias("enclosing"))
        return F.struct(
            F.when(hunk, none).when(note | (sign == "+"), a["old"]).otherwise(nested(a["old"])).alias("old"),
            F.when(hunk, none).when(note | (sign == "-"), a["new"]).otherwise(nested(a["new"])).alias("new"),
            F.when(~hunk & sign.isin("+", "-"), F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(F.split(patch, "\n"), start, step)["out"]


def _fact(files: DataFrame, kind: str, kind_ord: int, certainty: str, line: Column, description: Column, area: Column) -> DataFrame:
    return files.select(
        "run_id", "sha", F.col("ord").alias("file_ord"), F.lit(kind_ord).alias("kind_ord"), line.cast("int").alias("line_ord"),
        F.lit(kind).alias("kind"), F.lit(certainty).alias("certainty"), description.alias("description"), "file_path", area.cast("string").alias("area_name"),
    )


def dependency_facts(files: DataFrame) -> DataFrame:
    """Facts of changed manifests, by what kind of manifest it is."""
    f = files.where(paths.is_manifest(F.col("file_path")))
    p, none = F.col("file_path"), F.lit(None)
    has = F.coalesce(F.col("patch"), F.lit("")) != ""
    unread = p.rlike(r"(^|/)(pnpm-lock\.yaml|yarn\.lock)$")
    npm, package, poetry = p.rlike(r"(^|/)package-lock\.json$"), p.rlike(r"(^|/)package\.json$"), p.rlike(r"(^|/)poetry\.lock$")
    changed = lambda why: F.concat(p, F.lit(f" changed ({why})"))
    unknown = _fact(f.where(~has), "dependency", 0, "unknown", F.lit(0), changed("diff too large to inspect"), none)
    unknown = unknown.unionByName(_fact(f.where(has & unread), "dependency", 0, "unknown", F.lit(0), changed("lockfile contents not inspected"), none))
    # npm lockfiles: distinct packages among the changed lines
    lock = f.where(has & npm).withColumn("l", json_patch_lines(F.col("patch")))
    own = lambda x: F.when(x["body"].rlike(OBJECT_OPEN) & x["body"].rlike(r'^\s*"'), F.regexp_extract(x["body"], OBJECT_OPEN, 1))
    keys = lambda x: F.filter(F.concat(x["enclosing"], F.array(own(x))), lambda k: k.startswith("node_modules/"))
    lock = lock.withColumn("e", F.transform("l", lambda x: F.struct(F.get(F.reverse(keys(x)), F.lit(0)).alias("entry"), F.coalesce(F.exists(x["enclosing"], lambda k: k == ""), F.lit(False)).alias("root"))))
    lock = lock.withColumn("n", F.size(F.array_distinct(F.filter(F.transform("e", lambda x: x["entry"]), lambda k: k.isNotNull()))))
    lock = lock.withColumn("more", F.exists("e", lambda x: x["entry"].isNull() & ~x["root"]))
    said = F.concat(F.when(F.col("more"), F.lit("at least ")).otherwise(F.lit("")), text.plural(F.col("n"), "package"), F.lit(" changed in "), p)
    counted = _fact(lock.where("n > 0"), "dependency", 0, "inferred", F.lit(0), said, none)
    counted = counted.unionByName(_fact(lock.where("n = 0"), "dependency", 0, "unknown", F.lit(0), changed("no package entries identified in the diff"), none))
    # all other manifests: a name per changed line
    plain = F.transform(patch_lines(F.col("patch")), lambda x: F.struct(x["sign"].alias("sign"), x["body"].alias("body"), F.array().cast("array<string>").alias("enclosing")))
    rest = f.where(has & ~unread & ~npm).withColumn("l", F.when(package, json_patch_lines(F.col("patch"))).otherwise(plain))
    rest = rest.select("run_id", "sha", "ord", "file_path", F.posexplode("l").alias("line", "x"))
    body, inside = F.col("x.body"), F.col("x.enclosing")
    pair = r'^\s*"([^"]+)":\s*"([^"]+)"\s*,?\s*$'
    key, spec = F.regexp_extract(body, pair, 1), F.regexp_extract(body, pair, 2)
    visible = F.size(inside) > 0
    section = (F.size(inside) == 1) & F.coalesce(F.element_at(inside, -1).isin(*SECTIONS), F.lit(False))
    from_package = F.when(body.rlike(pair) & ~key.isin(*IGNORED_KEYS) & F.when(visible, section).otherwise(spec.rlike(SPEC)), key)
    word = F.regexp_extract(body, r"^\s*([A-Za-z0-9][A-Za-z0-9_.-]*)", 1)
    locked = F.regexp_extract(body, r'^\s*name\s*=\s*"([^"]+)"', 1)
    name = F.when(package, from_package).when(poetry, F.when(locked != "", locked)).otherwise(F.when(F.length(word) > 1, word))
    rest = rest.withColumn("name", name).where("name is not null")
    said = F.concat("name", F.when(F.col("x.sign") == "+", F.lit(" added in ")).otherwise(F.lit(" removed from ")), p)
    return unknown.unionByName(counted).unionByName(_fact(rest, "dependency", 0, "inferred", F.col("line"), said, none))


def import_specifier(body: Column) -> Column:
    """The module that a changed line imports; null if it imports none. Python only relative ones."""
    rules = [r"import\s[\s\S]*?from\s+['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"^\s*from\s+(\.[\w.]*)\s+import", r"^\s*import\s+(\.[\w.]*)"]
    return F.coalesce(*[F.when(body.rlike(r), F.regexp_extract(body, r, 1)) for r in rules])


def _in_area(df: DataFrame, path: str, areas: DataFrame, by: list[str], out: str) -> DataFrame:
    """df with out_name and out_id of the area of a path, per run."""
    keys = F.concat(F.array(F.lit(".")), resolve.path_prefixes(F.col(path)))
    tried = df.select("run_id", *by, F.explode(keys).alias("_p"))
    a = areas.select("run_id", F.col("path").alias("_p"), F.col("ord").alias("_o"), F.col("name").alias("_n"), F.col("id").alias("_i"))
    best = tried.join(a, ["run_id", "_p"]).groupBy("run_id", *by).agg(F.max(F.struct(F.length("_p").alias("n"), (-F.col("_o")).alias("o"), "_n", "_i")).alias("_b"))
    return df.join(best, ["run_id", *by], "left").withColumn(f"{out}_name", F.col("_b._n")).withColumn(f"{out}_id", F.col("_b._i")).drop("_b")


def architecture_facts(files: DataFrame, areas: DataFrame) -> DataFrame:
    """Changed relative imports that cross areas."""
    f = files.where(F.coalesce(F.col("patch"), F.lit("")) != "").select("run_id", "sha", "ord", "file_path", F.posexplode(patch_lines(F.col("patch"))).alias("line", "x"))
    f = f.withColumn("spec", import_specifier(F.col("x.body"))).withColumn("target", paths.resolve_relative(F.col("file_path"), F.col("spec"))).where("target <> ''")
    by = ["sha", "ord", "line"]
    f = _in_area(_in_area(f, "file_path", areas, by, "a"), "target", areas, by, "b").where("a_id is not null and b_id is not null and a_id <> b_id")
    said = F.concat("a_name", F.when(F.col("x.sign") == "+", F.lit(" now depends on ")).otherwise(F.lit(" no longer depends on ")), "b_name")
    return _fact(f, "architecture", 1, "inferred", F.col("line"), said, F.col("a_name"))


def data_facts(files: DataFrame, areas: DataFrame) -> DataFrame:
    """Changed files below a directory that is named like a data layer."""
    f = _in_area(files.where(paths.is_data_layer(F.col("file_path"))), "file_path", areas, ["sha", "ord"], "a")
    return _fact(f, "data-flow", 2, "inferred", F.lit(0), F.concat(F.lit("Data-layer file changed: "), "file_path"), F.col("a_name"))


def facts(files: DataFrame, areas: DataFrame) -> DataFrame:
    """All facts; in a commit they stand in order of (file_ord, kind_ord, line_ord)."""
    return dependency_facts(files).unionByName(architecture_facts(files, areas)).unionByName(data_facts(files, areas))


def entries(commits: DataFrame, found: DataFrame) -> DataFrame:
    """History entries: runs of commits with facts that share day and primary area, newest listing first.

    A commit's primary area is the area most of its facts name (the first seen wins ties), else its first fact's file. Commits without facts are dropped first, so
    they don't break a run. An entry's kind goes by priority, not by count.
    """
    order = F.struct("file_ord", "kind_ord", "line_ord")
    per = found.groupBy("run_id", "sha").agg(
        F.array_sort(F.collect_list(F.struct("file_ord", "kind_ord", "line_ord", "kind", "certainty", "description", "file_path", "area_name"))).alias("facts"),
        F.min_by("file_path", order).alias("first_path"),
    )
    named = found.where("area_name is not null").groupBy("run_id", "sha", "area_name").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    w = Window.partitionBy("run_id", "sha").orderBy(F.desc("n"), "o")
    area = named.withColumn("r", F.row_number().over(w)).where("r = 1").select("run_id", "sha", "area_name")
    c = commits.join(per, ["run_id", "sha"]).join(area, ["run_id", "sha"], "left")
    c = c.withColumn("key", F.concat(text.day_key(F.col("authored_at")), F.lit("::"), F.coalesce("area_name", "first_path", F.lit("repository"))))
    c = windows.islands(c, ["run_id"], [F.col("ord")], F.col("key"))
    g = c.groupBy("run_id", "island").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "sha", "message", "author_name", "author_login", "authored_at"))), lambda x: x.dropFields("ord")).alias("commits"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "facts"))), lambda x: x["facts"])).alias("all"),
        F.max("authored_at").alias("occurred_at"),
    )
    kinds = F.array(*map(F.lit, KINDS))
    kind = F.get(F.filter(kinds, lambda k: F.exists("all", lambda f: f["kind"] == k)), F.lit(0))
    g = g.withColumn("kind", kind).withColumn("of_kind", F.filter("all", lambda f: f["kind"] == F.col("kind"))).withColumn("lead", F.element_at("of_kind", 1))
    label = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])[F.col("kind")]
    n, m = F.size("of_kind"), F.size("commits")
    noticed = F.concat(F.lit("Detected "), n.cast("string"), F.lit(" "), label, F.lit(" change"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" across "), text.plural(m, "commit"), F.lit("."))
    return g.select(
        "run_id", F.col("island").alias("ord"), F.element_at("commits", 1)["sha"].alias("id"), "kind",
        text.title_first(F.col("lead.description")).alias("title"), text.title_first(F.col("lead.description")).alias("summary"),
        F.array_distinct(F.transform("all", lambda f: text.title_first(f["description"]))).alias("what_changed"), noticed.alias("why_noticed"),
        F.array_distinct(F.filter(F.transform("all", lambda f: f["area_name"]), lambda a: a.isNotNull())).alias("affected_areas"),
        "occurred_at", "commits", F.col("lead.file_path").alias("primary_file_path"),
        F.transform("all", lambda f: F.struct(f["kind"], f["certainty"], f["description"], f["file_path"], f["area_name"])).alias("facts"),
    )


def build(commits: DataFrame, files: DataFrame, areas: DataFrame) -> DataFrame:
    return entries(commits, facts(files, areas))


def listing(commits: DataFrame, since: Column, most: int = 200) -> DataFrame:
    """Commits of the last days in order, `most` per run, with `truncated`: whether there were more. Null authors become 'Unknown' with the epoch's date."""
    c = commits.withColumn("author_name", F.coalesce("author_name", F.lit("Unknown"))).withColumn("authored_at", F.coalesce("authored_at", F.lit("1970-01-01T00:00:00.000Z")))
    c = c.where(F.col("authored_at") >= since).withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")))
    more = c.groupBy("run_id").agg((F.count(F.lit(1)) > most).alias("truncated"))
    return c.where(F.col("_n") <= most).drop("_n").join(more, "run_id")


def display_author(commits: Column, occurred_at: Column) -> Column:
    """The author of the commit at the entry's time, else of the first."""
    at = F.filter(commits, lambda c: c["authored_at"] == occurred_at)
    return F.coalesce(F.get(at, F.lit(0))["author_name"], F.get(commits, F.lit(0))["author_name"])


def bucketed(found: DataFrame, now: Column) -> DataFrame:
    """Entries with their bucket and the order of buckets, which is that of first appearance."""
    b = found.withColumn("bucket", text.recency_bucket(F.to_timestamp("occurred_at"), now))
    return b.withColumn("bucket_ord", F.min("ord").over(Window.partitionBy("run_id", "bucket")))
