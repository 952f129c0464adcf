"""The reading path of a project: at most seven places to start, in order.

Four sets of candidates are placed one after the other, each as joins and windows over all projects at once: what starts the system, what that depends on
(one frontier join per hop), large areas that nothing so far stands in, and a test. A project has seven places at most, so the frontiers stay small whatever the
size of its graph; places are numbered on from the count of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.categories import ENTRY_LABELS, NON_PRIMARY
from ..operators import ranking, resolve, windows
from ..session import discard, materialize
from . import areas as area_plan

# The number of places, the kinds of entry points that start a system or are its public face, and the sentences.
MOST = 7
STARTS, PUBLIC = ("bootstrap", "cli"), ("library", "runtime")
STARTS_WHY = "This is likely where the system starts executing; begin here to see how it boots."
PUBLIC_WHY = "This is the system's declared public entry point for consumers."
TEST_WHY = "Exercises the implementation directly; a good place to observe representative behavior."
SCHEMA = "run_id string, project_id string, place int, id string, file_path string, symbol_name string, what_it_represents string, rationale string, certainty string"

KEY = ["run_id", "project_id"]


def _items(rows: DataFrame, order: list[Column], before: DataFrame | None, room: DataFrame, what: Column, why: Column, symbol: Column | None = None) -> DataFrame:
    """Rows (KEY, file_path, certainty, area) that get places after those of `before`, as far as their project has room (KEY, cap)."""
    used = None if before is None else before.groupBy(*KEY).agg(F.count(F.lit(1)).alias("used"))
    rows = windows.numbered(rows, KEY, order, "nth").join(room, KEY)
    rows = rows.withColumn("used", F.lit(0)) if used is None else rows.join(used, KEY, "left").fillna({"used": 0})
    rows = rows.withColumn("place", (F.col("used") + F.col("nth")).cast("int")).where("place <= cap")
    symbol = F.lit(None).cast("string") if symbol is None else symbol
    return rows.select(*KEY, "place", "file_path", symbol.alias("symbol_name"), what.alias("what_it_represents"), why.alias("rationale"), "certainty", "area")


def _seeds(entries: DataFrame, room: DataFrame) -> DataFrame:
    """Entry points of the kinds that start a system or, in projects without any, of its public kinds."""
    starts = F.col("kind").isin(*STARTS)
    running = entries.where(starts).select(*KEY).distinct().withColumn("runs", F.lit(True))
    e = entries.join(running, KEY, "left").where(starts | (F.col("runs").isNull() & F.col("kind").isin(*PUBLIC)))
    label = F.create_map(*[F.lit(x) for kv in ENTRY_LABELS.items() for x in kv])[F.col("kind")]
    return _items(e, [F.col("ord").asc()], None, room, label, F.when(starts, STARTS_WHY).otherwise(PUBLIC_WHY), F.col("symbol_name"))


def _dependencies(seeds: DataFrame, links: DataFrame, where: DataFrame, room: DataFrame) -> DataFrame:
    """The seeds and what they lead to, hop by hop: within a hop by the place of the first file that leads there, then by the order of its links."""
    found = frontier = materialize(seeds, "places")
    parts = [found]
    for _ in range(MOST - 1):
        at = frontier.groupBy(*KEY, F.col("file_path").alias("from_id")).agg(F.min("place").alias("at"))
        known = found.select(*KEY, F.col("file_path").alias("to_id")).distinct()
        step = at.join(links, ["run_id", "from_id"]).join(known, [*KEY, "to_id"], "left_anti")
        step = resolve.first_wins(step, [*KEY, "to_id"], [F.col("at").asc(), F.col("o").asc()])
        step = step.withColumnRenamed("to_id", "file_path").join(where, [*KEY, "file_path"], "left").withColumn("area", F.coalesce("area", paths.area_at_depth(F.col("file_path"), 2)))
        what = F.concat(F.lit("A module directly depended on by '"), "from_id", F.lit("'"))
        why = F.coalesce("why", F.concat(F.lit("'"), "from_id", F.lit("' depends on '"), "file_path", F.lit("'.")))
        frontier = materialize(_items(step, [F.col("at").asc(), F.col("o").asc()], found, room, what, why), "places")
        if not frontier.take(1):
            break
        parts.append(frontier)
        found = found.unionByName(frontier)
    whole = materialize(found, "places")
    discard(*parts)
    return whole


def _areas(areas: DataFrame, found: DataFrame, room: DataFrame) -> DataFrame:
    """Primary areas that no place stands in, the largest first. An area's place stands in the area that its own path falls into at depth two, which may be its parent: so a
    parent is left out if one of its parts comes before it, and nothing else depends on what is added here."""
    a = areas.where(F.col("responsibility").isNull() | ~F.col("responsibility").isin(*NON_PRIMARY))
    a = windows.numbered(a, KEY, [F.col("file_count").desc(), F.expr("collate(area, 'UNICODE')").asc()], "o")
    a = a.join(found.select(*KEY, "area").distinct(), [*KEY, "area"], "left_anti").withColumn("stands_in", paths.area_at_depth(F.col("area"), 2))
    part = a.where("stands_in <> area").groupBy(*KEY, F.col("stands_in").alias("area")).agg(F.min("o").alias("part"))
    a = a.join(part, [*KEY, "area"], "left").where("part is null or part > o")
    a = a.select(*KEY, "o", F.col("area").alias("file_path"), F.col("stands_in").alias("area"), "rationale", F.lit("inferred").alias("certainty"))
    return _items(a, [F.col("o").asc()], found, room, F.concat(F.lit("Primary structural area: '"), "file_path", F.lit("'")), F.col("rationale"))


def _test(tests: DataFrame, found: DataFrame) -> DataFrame:
    """The first test whose file has no place yet, where one is free."""
    used = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("used"))
    t = tests.join(found.select(*KEY, "file_path").distinct(), [*KEY, "file_path"], "left_anti")
    t = resolve.first_wins(t, KEY, [F.col("ord").asc()])
    room = t.select(*KEY).join(used, KEY, "left").select(*KEY, F.least(F.lit(MOST), F.coalesce("used", F.lit(0)) + 1).alias("cap"))
    what = F.concat(F.lit("Test for '"), "implementation_path", F.lit("'"))
    return _items(t, [F.col("ord").asc()], found, room, what, F.coalesce("why", F.lit(TEST_WHY)))


def build(files: DataFrame, entries: DataFrame, relationships: DataFrame, areas: DataFrame, tests: DataFrame) -> DataFrame:
    """SCHEMA rows per project.

    files (run_id, project_id, path); entries (run_id, ord, file_path, symbol_name, kind, certainty); relationships (run_id, ord, from_id, to_id, certainty, why);
    areas as areas.build() gives them; tests (run_id, ord, test_path, implementation_path, certainty, why). A project with a test keeps the last place for it.
    """
    placed = area_plan.subdivide(files.select("run_id", "project_id", "path").distinct())
    where = materialize(placed.select(*KEY, F.col("path").alias("file_path"), "area"), "placed")
    t = tests.withColumnRenamed("test_path", "file_path").join(where, ["run_id", "file_path"])
    tested = t.select(*KEY).distinct().withColumn("tested", F.lit(1))
    room = materialize(where.select(*KEY).distinct().join(tested, KEY, "left").select(*KEY, (MOST - F.coalesce("tested", F.lit(0))).alias("cap")), "room")
    detected_first = [(F.col("certainty") == "detected").desc(), F.col("ord").asc()]
    links = resolve.first_wins(relationships.select("run_id", "ord", "from_id", "to_id", "certainty", "why"), ["run_id", "from_id", "to_id"], detected_first)
    links = windows.numbered(links, ["run_id", "from_id"], detected_first, "o").drop("ord")
    found = _dependencies(_seeds(entries.join(where, ["run_id", "file_path"]), room), links, where, room)
    found = materialize(found.unionByName(_areas(areas, found, room)), "places")
    out = found.unionByName(_test(t, found))
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    return out.withColumn("id", F.concat(F.lit("start-here-"), F.col("place").cast("string"))).select(*fields)


def merge(found: DataFrame) -> DataFrame:
    """The paths of a run's projects, interleaved by place, seven in all, renumbered. Projects take turns in order of their ids."""
    m = ranking.round_robin(found.withColumnRenamed("place", "idx"), ["run_id"], "project_id", "idx", MOST)
    return m.withColumn("id", F.concat(F.lit("start-here-"), F.col("place").cast("string"))).drop("idx")
