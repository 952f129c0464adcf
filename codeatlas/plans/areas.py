"""Structural areas: how files group into directories, what an area is responsible for, and how areas depend on each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.categories import NON_PRIMARY, entry_label
from ..operators import resolve

#: Files beyond which an area is split, and the depth at which grouping begins. Fixed values.
MAX_FILES, FIRST_DEPTH = 10, 2


def subdivide(files: DataFrame, path: str = "path", run: str = "run_id", cap: bool = True) -> DataFrame:
    """files with `area`: the directory of two segments, taken one segment deeper as long as it holds more than MAX_FILES files and at
    least one of them lies deeper.

    Files that share a name at some depth share it at every smaller one, so a directory's count doesn't depend on how the others were split: all depths
    of a file are counted at once, and its area is its name at the first depth that stays whole. One aggregate and one join, no loop.
    """
    p = F.col(path)
    # one deeper than the file's own directory, where files directly in a directory that was split are counted by themselves
    depths = F.sequence(F.lit(FIRST_DEPTH), F.greatest(F.lit(FIRST_DEPTH), F.size(paths.directories(p)) + 1))
    tried = files.select(run, path, F.explode(depths).alias("_d"))
    tried = tried.withColumn("_name", paths.area_at_depth(p, F.col("_d"), cap)).withColumn("_deeper", paths.area_at_depth(p, F.col("_d") + 1, cap) != F.col("_name"))
    split = tried.groupBy(run, "_d", "_name").agg(((F.count(F.lit(1)) > MAX_FILES) & F.bool_or("_deeper")).alias("_split"))
    whole = tried.select(run, path, "_d", "_name").distinct().join(split.where("not _split"), [run, "_d", "_name"])
    area = whole.groupBy(run, path).agg(F.min_by("_name", "_d").alias("area"))
    return files.join(area, [run, path], "left")


def kept_together(areas: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, area) of areas that are whole only because they are test roots."""
    last = F.element_at(F.split("area", "/"), -1)
    inside = files.join(areas.select("run_id", "area").distinct().where(last.isin(*paths.TEST_ROOTS)), ["run_id", "area"])
    free = subdivide(inside.select(F.concat_ws("\u0001", "run_id", "area").alias("run_id"), "path"), cap=False)
    g = free.groupBy("run_id").agg(F.count_distinct("area").alias("n")).where("n > 1")
    parts = F.split("run_id", "\u0001")
    return g.select(parts[0].alias("run_id"), parts[1].alias("area"))


def contradictions(entries: DataFrame, relationships: DataFrame, is_test) -> DataFrame:
    """(run_id, root, why) of directories that are named like tests, but hold an entry point or are depended on from outside.

    entries (run_id, ord, file_path, kind); relationships (run_id, ord, from_id, to_id)."""
    f = F.col("file_path")
    first = entries.where((F.col("kind") != "test") & paths.is_under_test_root(f)).select(
        "run_id", paths.test_root(f).alias("root"), "ord", F.concat(F.lit("'"), f, F.lit("' is detected as a "), F.lower(entry_label(F.col("kind")))).alias("why")
    )
    a, b = F.col("from_id"), F.col("to_id")
    second = relationships.where(paths.is_under_test_root(b) & ~paths.is_under_test_root(a) & ~is_test(a)).select(
        "run_id", paths.test_root(b).alias("root"), "ord", F.concat(F.lit("'"), a, F.lit("', outside any test directory, depends on '"), b, F.lit("'")).alias("why")
    )
    both = first.withColumn("s", F.lit(0)).unionByName(second.withColumn("s", F.lit(1)))
    return both.groupBy("run_id", "root").agg(F.min_by("why", F.struct("s", "ord")).alias("why"))


def build(files: DataFrame, entries: DataFrame, contracts: DataFrame, tests: DataFrame, relationships: DataFrame, gaps: DataFrame, is_test, is_tooling, special: DataFrame | None = None) -> DataFrame:
    """A row per area: (run_id, project_id, area, id, file_count, responsibility, rationale, production_file_paths, entry_point_ids, contract_ids,
    test_relationship_ids, gap_count, direct_dependency_ids, direct_dependent_ids).

    files (run_id, project_id, path); entries and contracts (run_id, ord, id, file_path, kind); tests (run_id, ord, id, test_path, implementation_path);
    relationships (run_id, ord, from_id, to_id); gaps (run_id, file_path); special (run_id, path): files of React components.
    """
    why = contradictions(entries, relationships, is_test)
    f = subdivide(files.select("run_id", "project_id", "path").distinct())
    f = f.withColumn("root", paths.test_root(F.col("path"))).join(why, ["run_id", "root"], "left")
    tested = is_test(F.col("path")) | ((F.col("root") != "") & F.col("why").isNull())
    f = f.withColumn("is_test", tested).withColumn("support", paths.is_test_support(F.col("path"))).withColumn("tooling", is_tooling(F.col("path")))
    if special is not None:
        f = f.join(special.select("run_id", "path").distinct().withColumn("react", F.lit(True)), ["run_id", "path"], "left")
    else:
        f = f.withColumn("react", F.lit(None).cast("boolean"))
    all_of = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    a = f.groupBy("run_id", "project_id", "area").agg(
        F.count(F.lit(1)).alias("file_count"), all_of(F.col("is_test")).alias("t"), all_of(F.col("support")).alias("s"), all_of(F.col("tooling")).alias("c"), all_of(F.col("react")).alias("r"),
        F.array_sort(F.collect_list(F.when(~F.col("is_test"), F.col("path")))).alias("production_file_paths"),
    )
    responsibility = (
        F.when(F.col("r"), F.lit("Presentational React components")).when(F.col("t"), F.lit(NON_PRIMARY[0]))
        .when(F.col("s"), F.lit(NON_PRIMARY[1])).when(F.col("c"), F.lit(NON_PRIMARY[2]))
    )
    together = kept_together(a, f.select("run_id", "area", "path")).withColumn("together", F.lit(True))
    a = a.join(together, ["run_id", "area"], "left")
    rationale = F.concat(
        F.lit("Groups "), F.col("file_count").cast("string"), F.lit(" source file(s) under '"), F.col("area"),
        F.lit("'; no declared workspace, package, or source-root boundary was found, so files are grouped by directory."),
        F.when(F.col("together"), F.lit(" As a conventional test directory, its subdirectories are kept together as one area rather than split into separate ones.")).otherwise(F.lit("")),
    )
    a = a.select("run_id", "project_id", "area", area_id("project_id", "area").alias("id"), "file_count", responsibility.alias("responsibility"), rationale.alias("rationale"), "production_file_paths")
    where = f.select("run_id", "project_id", F.col("path").alias("file_path"), "area")
    ids = lambda df, name: df.join(where, ["run_id", "file_path"]).groupBy("run_id", "project_id", "area").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias(name))
    either = tests.select("run_id", "ord", "id", F.explode(F.array("test_path", "implementation_path")).alias("file_path"))
    either = either.join(where, ["run_id", "file_path"]).select("run_id", "project_id", "area", "ord", "id").distinct()
    either = either.groupBy("run_id", "project_id", "area").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("test_relationship_ids"))
    lost = gaps.join(where, ["run_id", "file_path"]).groupBy("run_id", "project_id", "area").agg(F.count(F.lit(1)).alias("gap_count"))
    out = a
    for part in (ids(entries, "entry_point_ids"), ids(contracts, "contract_ids"), either, lost):
        out = out.join(part, ["run_id", "project_id", "area"], "left")
    link = links(relationships, where)
    deps = link.groupBy("run_id", "project_id", F.col("from_area").alias("area")).agg(_ordered("to_area").alias("direct_dependency_ids"))
    back = link.groupBy("run_id", "project_id", F.col("to_area").alias("area")).agg(_ordered("from_area").alias("direct_dependent_ids"))
    out = out.join(deps, ["run_id", "project_id", "area"], "left").join(back, ["run_id", "project_id", "area"], "left")
    empty = F.array().cast("array<string>")
    for c in ("entry_point_ids", "contract_ids", "test_relationship_ids", "direct_dependency_ids", "direct_dependent_ids"):
        out = out.withColumn(c, F.coalesce(c, empty))
    return out.withColumn("gap_count", F.coalesce("gap_count", F.lit(0)))


def area_id(project: str, area: str) -> Column:
    return F.concat(F.lit("area:"), F.col(project), F.lit(":"), F.col(area))


def _ordered(area: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", area_id("project_id", area).alias("id")))), lambda x: x["id"])


def links(relationships: DataFrame, where: DataFrame) -> DataFrame:
    """(run_id, project_id, from_area, to_area, ord): links across areas, each once, in order of first sight. where: (run_id, project_id, file_path, area)."""
    a = where.select("run_id", "project_id", F.col("file_path").alias("from_id"), F.col("area").alias("from_area"))
    b = where.select("run_id", "project_id", F.col("file_path").alias("to_id"), F.col("area").alias("to_area"))
    j = relationships.select("run_id", "ord", "from_id", "to_id").join(a, ["run_id", "from_id"]).join(b, ["run_id", "project_id", "to_id"])
    return j.where("from_area <> to_area").groupBy("run_id", "project_id", "from_area", "to_area").agg(F.min("ord").alias("ord"))


def relationships_of(areas: DataFrame) -> DataFrame:
    """(run_id, from_id, to_id): the dependencies of areas on areas that exist, each once."""
    e = areas.select("run_id", F.col("id").alias("from_id"), F.explode("direct_dependency_ids").alias("to_id")).distinct()
    return e.join(areas.select("run_id", F.col("id").alias("to_id")), ["run_id", "to_id"], "left_semi").select("run_id", "from_id", "to_id")


def production_relationships(areas: DataFrame, relationships: DataFrame) -> DataFrame:
    """(run_id, from_id, to_id) from relationships between production files alone; of areas that list one file the last wins."""
    f = areas.select("run_id", F.col("id").alias("area"), F.col("ord"), F.explode("production_file_paths").alias("file_path"))
    f = resolve.last_wins(f, ["run_id", "file_path"], "ord").select("run_id", "file_path", "area")
    a, b = (f.select("run_id", F.col("file_path").alias(k), F.col("area").alias(v)) for k, v in (("from_id", "fa"), ("to_id", "ta")))
    j = relationships.select("run_id", "from_id", "to_id").join(a, ["run_id", "from_id"]).join(b, ["run_id", "to_id"])
    return j.where("fa <> ta").select("run_id", F.col("fa").alias("from_id"), F.col("ta").alias("to_id")).distinct()


def area_of_path(files: DataFrame, path: str, areas: DataFrame, by: list[str]) -> DataFrame:
    """files with the area whose directory is the longest prefix of the path ('.' holds everything). areas: (path, ord, ...)."""
    return resolve.longest_prefix(files, path, areas, "path", "ord", by)


def diagram(areas: DataFrame, edges: DataFrame, pinned: list[str] | None = None, most: int = 8) -> DataFrame:
    """Selected areas of each run, with rank and linked: the best-connected `most` (pinned ids first, 30 at most), then those among them that keep a link to another
    selected one. Runs with fewer than two areas or without edges give no rows. areas: (run_id, id, name, responsibility, entry_point_ids)."""
    from ..operators.ranking import area_order
    from pyspark.sql import Window

    most = max(1, min(most, 30))
    ends = edges.select("run_id", F.col("from_id").alias("id")).unionByName(edges.select("run_id", F.col("to_id").alias("id")))
    n = ends.groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("links"))
    a = areas.join(n, ["run_id", "id"]).withColumn("np", F.col("responsibility").isin(*NON_PRIMARY) & F.col("responsibility").isNotNull()).withColumn("entries", F.size("entry_point_ids"))
    pin = F.coalesce(F.col("id").isin(*(pinned or [""])), F.lit(False))
    w = Window.partitionBy("run_id").orderBy(pin.desc(), *area_order("np", "links", "entries", "name"))
    top = a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    kept = edges.join(top.select("run_id", F.col("id").alias("from_id")), ["run_id", "from_id"], "left_semi").join(top.select("run_id", F.col("id").alias("to_id")), ["run_id", "to_id"], "left_semi")
    live = kept.select("run_id", F.col("from_id").alias("id")).unionByName(kept.select("run_id", F.col("to_id").alias("id"))).distinct().withColumn("linked", F.lit(True))
    enough = areas.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("run_id")
    return top.join(live, ["run_id", "id"]).join(enough, "run_id", "left_semi").select("run_id", "id", "name", "links", "rank")
