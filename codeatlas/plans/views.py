"""What pages show: rankings, counts, filters and sentences over a run's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import categories, text
from ..operators import ranking, windows
from ..session import dealt, tasks
from . import graph

LANGUAGE_NAMES = {"typescript": "TypeScript", "javascript": "JavaScript", "python": "Python"}
SEED_LABELS = {"bootstrap": "application bootstrap entry point", "cli": "command-line entry point", "library": "declared public entry point", "runtime": "conventional runtime entry point"}
GROUPS = {"JavaScript": "js-ts", "TypeScript": "js-ts", "Python": "python"}
MOST_AREAS = 3


def language_shares(languages: DataFrame, least: float = 0.1) -> DataFrame:
    """(run_id, analyzer, share) of rows (run_id, language, bytes), of `least` or more, largest first as `place`. A total of 0 gives shares of 0."""
    total = languages.groupBy("run_id").agg(F.sum("bytes").alias("total"))
    known = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.col("language")]
    g = languages.withColumn("analyzer", known).where("analyzer is not null").groupBy("run_id", "analyzer").agg(F.sum("bytes").alias("bytes")).join(total, "run_id")
    g = g.withColumn("share", F.when(F.col("total") > 0, F.col("bytes") / F.col("total")).otherwise(F.lit(0.0))).where(F.col("share") >= least)
    return windows.numbered(g, ["run_id"], [F.col("share").desc(), F.col("analyzer").asc()], "place").select("run_id", "analyzer", "share", "place")


def analyzer_version(selected: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(run_id, version) of selected analyzers: 'dispatch-v1:' and their versions, sorted; runs without one say 'unsupported'."""
    v = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])[F.col("analyzer")]
    joined = F.array_join(F.array_sort(F.collect_list(v)), "+")
    return selected.groupBy("run_id").agg(joined.alias("v")).select("run_id", F.concat(F.lit("dispatch-v1:"), F.when(F.col("v") == "", F.lit("unsupported")).otherwise(F.col("v"))).alias("version"))


def unsupported_message(languages: DataFrame, product: str = "This service") -> DataFrame:
    """(run_id, message): why no analyzer ran, with the largest language and its share. languages (run_id, repository, language, bytes), with a row of null language
    for a repository without any."""
    top = F.max_by("language", F.struct("bytes", "language"))
    g = languages.groupBy("run_id", "repository").agg(top.alias("language"), F.max("bytes").alias("top"), F.sum("bytes").alias("total"))
    pct = text.round_half_up(F.col("top") / F.col("total") * 100).cast("int").cast("string")
    some = F.concat("repository", F.lit("'s primary language is "), "language", F.lit(" ("), pct, F.lit("% of classified source)"))
    none = F.concat(F.lit("GitHub did not report any classified source for "), "repository", F.lit(" — it may be empty"))
    said = F.concat(F.lit(f"{product} currently analyzes JavaScript, TypeScript, and Python only. "), F.when(F.col("total") > 0, some).otherwise(none), F.lit(", so no supported analyzer could produce a result."))
    return g.select("run_id", said.alias("message"))


def major(areas: DataFrame) -> DataFrame:
    return areas.where(F.col("name") != ".")


def ranked_areas(areas: DataFrame) -> DataFrame:
    """Major areas with `links` and `place`. areas (run_id, name, responsibility, direct_dependency_ids, direct_dependent_ids, entry_point_ids)."""
    a = major(areas).withColumn("np", (categories.system_class(F.col("responsibility")) != "Implementation area").cast("int"))
    a = a.withColumn("links", F.size("direct_dependency_ids") + F.size("direct_dependent_ids")).withColumn("entries", F.size("entry_point_ids"))
    return windows.numbered(a, ["run_id"], ranking.area_order("np", "links", "entries", "name"), "place").drop("np", "entries")


def slugged_areas(areas: DataFrame) -> DataFrame:
    return windows.slugs(areas, ["run_id"], text.kebab_case(F.col("name")), [F.col("ord")])


def ranked_functions(callables: DataFrame, importance: DataFrame) -> DataFrame:
    i = importance.select("run_id", F.col("function_id").alias("id"), "score")
    return windows.numbered(callables.join(i, ["run_id", "id"], "left"), ["run_id"], ranking.importance_order(), "place")


def call_roots(callables: DataFrame, calls: DataFrame, entries: DataFrame, contracts: DataFrame) -> DataFrame:
    """Callables where call trees begin: what entry points and exported contracts name unambiguously, else what nothing calls, else all; sorted by name."""
    one = callables.groupBy("run_id", "file_path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").withColumnRenamed("name", "symbol_name")
    named = entries.select("run_id", "file_path", "symbol_name").unionByName(contracts.select("run_id", "file_path", "symbol_name")).where("symbol_name is not null")
    start = named.join(one, ["run_id", "file_path", "symbol_name"]).select("run_id", "id").distinct()
    found = graph.roots(callables.select("run_id", "id"), calls, start).join(callables.select("run_id", "id", "name"), ["run_id", "id"])
    return windows.numbered(found, ["run_id"], [F.expr("collate(name, 'UNICODE')"), F.col("id")], "place")


def unique_callees(calls: DataFrame, callables: DataFrame, rows: int | None = None) -> DataFrame:
    """(run_id, caller, callee, name, place): each callee of a caller once, in order of first sight as `place`; among equals the smallest callee is first.

    Calls are dealt to tasks by `rows`, the number of calls or more (counted if not given), so that a task's maps and sorts don't grow with the input, those of the join with the names neither."""
    parts = tasks(calls.count() if rows is None else rows)
    c = dealt(calls.select("run_id", F.col("source").alias("caller"), F.col("target").alias("callee"), "ord"), parts, ["run_id", "caller", "callee"])
    by_name = lambda df: df.withColumn("_deal", F.xxhash64("run_id", F.col("callee").cast("string")))
    first = by_name(c.groupBy("_deal", "run_id", "caller", "callee").agg(F.min("ord").alias("o"))).repartition(parts, "_deal")
    names = by_name(callables.select("run_id", F.col("id").alias("callee"), "name"))
    j = dealt(first.join(names, ["_deal", "run_id", "callee"]), parts, ["run_id", "caller"])
    return windows.numbered(j, ["_deal", "run_id", "caller"], [F.col("o"), F.col("callee")], "place").select("run_id", "caller", "callee", "name", "place")


def evidence_total(collections: list[DataFrame]) -> DataFrame:
    """(run_id, evidence): sizes of the evidence of nine collections; contracts and test relationships don't count."""
    out = collections[0].select("run_id", F.size("evidence").alias("n"))
    for c in collections[1:]:
        out = out.unionByName(c.select("run_id", F.size("evidence").alias("n")))
    return out.groupBy("run_id").agg(F.sum("n").cast("long").alias("evidence"))


def value_contract(flags: DataFrame) -> DataFrame:
    """status of runs from six flags (run_id, has_identity, has_project, has_area, has_start_here, traceable, has_entry): all hold, or the run is partial. A flag over no rows holds."""
    names = ["has_identity", "has_project", "has_area", "has_start_here", "traceable", "has_entry"]
    met = F.lit(True)
    for n in names:
        met = met & F.coalesce(F.col(n), F.lit(True))
    return flags.withColumn("status", F.when(met, F.lit("completed")).otherwise(F.lit("partial")))


def traceable(evidence: Column) -> Column:
    """Whether all evidence has a location; true of none."""
    return F.coalesce(F.forall(evidence, lambda e: e["location"].isNotNull()), F.lit(True))


def search(df: DataFrame, columns: list[str], needle: str, order: list[Column], most: int | None = None) -> DataFrame:
    """Rows that hold the needle in any of the columns, whatever the case; an empty needle finds all."""
    wanted = needle.strip().lower()
    hit = F.exists(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]), lambda x: x.contains(wanted))
    found = df.where(hit) if wanted else df
    found = found.orderBy(*order)
    return found.limit(most) if most else found


def dependencies(deps: DataFrame, sort: str = "name", desc: bool = False) -> DataFrame:
    """External dependencies with category, uses and `place`: by name, scope or uses over a base sorted by name; the descending order is the reverse."""
    d = deps.withColumn("category", categories.dependency_category(F.col("name"), F.col("description"), F.col("keywords")))
    d = d.withColumn("uses", F.size(F.filter("evidence", lambda e: e["kind"] == "import-reference")))
    key = {"name": F.lower("name"), "scope": F.col("scope"), "usage": F.col("uses")}[sort]
    return windows.numbered(d, ["run_id"], ranking.reverse_stable([key, F.lower("name"), F.col("ord")], desc), "place")


def used_by(evidence: Column) -> Column:
    """Files that refer to a dependency, each once, in order."""
    refs = F.filter(evidence, lambda e: e["kind"] == "import-reference")
    return F.array_distinct(F.transform(refs, lambda e: e["location"]["file_path"]))


def analysis_sources(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, languages, frameworks, manifests): sorted and distinct."""
    p = projects.groupBy("run_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("frameworks")))).alias("frameworks"))
    m = files.where(F.col("file_path").rlike(r"(^|/)(package\.json|pyproject\.toml|setup\.py|setup\.cfg)$")).groupBy("run_id").agg(F.array_sort(F.collect_set("file_path")).alias("manifests"))
    return p.join(m, "run_id", "left").withColumn("manifests", F.coalesce("manifests", F.array().cast("array<string>")))


_PART = "array<struct<type:string,text:string>>"


def _part(kind: str, value: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("type"), (F.lit(value) if isinstance(value, str) else value).cast("string").alias("text"))


def counts_line(areas: DataFrame, deps: DataFrame, gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, parts): numbers of major areas, dependencies and gaps."""
    a = major(areas).groupBy("run_id").agg(F.count(F.lit(1)).alias("a"))
    d = deps.groupBy("run_id").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("scope") == "direct").alias("p"))
    g = gaps.groupBy("run_id").agg(F.count(F.lit(1)).alias("g"))
    j = runs.select("run_id").join(a, "run_id", "left").join(d, "run_id", "left").join(g, "run_id", "left").fillna(0)
    said = F.concat_ws(
        " · ", text.plural(F.col("a"), "major area"),
        F.concat(text.plural(F.col("d"), "external dependency", "external dependencies"), F.lit(" ("), F.col("p").cast("string"), F.lit(" production)")), text.plural(F.col("g"), "recorded gap"),
    )
    more = F.when(F.col("g") > 0, F.array(_part("text", " "), _part("anchor", "View gaps"))).otherwise(F.array().cast(_PART))
    return j.select("run_id", F.concat(F.array(_part("text", said)), more).alias("parts"))


def areas_line(areas: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, parts): the three best-connected implementation areas."""
    r = ranked_areas(areas)
    live = r.where((categories.system_class(F.col("responsibility")) == "Implementation area") & (F.col("links") > 0))
    top = ranking.top_per_key(live, ["run_id"], [F.col("place")], MOST_AREAS, "k")
    named = F.transform(F.array_sort(F.collect_list(F.struct("k", "name", "links"))), lambda x: F.concat(x["name"], F.lit(" ("), x["links"].cast("string"), F.lit(")")))
    t = top.groupBy("run_id").agg(named.alias("named"))
    any_ = r.groupBy("run_id").agg((F.max("links") > 0).alias("any"))
    j = runs.select("run_id").join(any_, "run_id", "left").join(t, "run_id", "left")
    lead = F.when(F.size("named") == 1, F.lit("The area with the most detected direct relationships (depends on + imported by) is ")).otherwise(F.lit("The areas with the most detected direct relationships (depends on + imported by) are "))
    none = F.when(F.col("any").isNull(), F.lit("No major areas were identified ")).when(F.col("any"), F.lit("No direct relationships of implementation areas were detected ")).otherwise(F.lit("No direct relationships between major areas were detected "))
    parts = F.when(F.col("named").isNull(), F.array(_part("text", none), _part("certainty", "unknown"))).otherwise(F.array(_part("text", lead), _part("location", text.join_and(F.col("named"))), _part("text", ".")))
    return j.select("run_id", parts.alias("parts"))


def kind_line(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, parts): what kind of project it is; of several, one part each. projects (run_id, ord, kind, languages, reason); runs (run_id, name)."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    spoken = F.array_join(F.transform("languages", lambda x: F.coalesce(names[x], x)), "/")
    p = projects.join(runs.select("run_id", "name"), "run_id").withColumn("lang", spoken).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    subject = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(F.lit("the "), F.when(F.col("lang") != "", F.col("lang")).otherwise(F.lit("unknown-language")), F.lit(" project")))
    noun = F.when((F.col("n") == 1) & (F.col("lang") != ""), F.concat("lang", F.lit(" "), "kind")).otherwise(F.col("kind"))
    article = F.when(noun.rlike("(?i)^[aeiou]"), F.lit("an")).otherwise(F.lit("a"))
    unknown = F.concat(subject, F.when((F.col("n") == 1) & (F.col("lang") != ""), F.concat(F.lit(" ("), "lang", F.lit(")"))).otherwise(F.lit("")), F.lit(": whether it is an application or a library could not be determined"))
    known = F.concat(subject, F.lit(" is "), article, F.lit(" "), noun, F.coalesce("reason", F.lit("")))
    clause = F.when(F.col("kind") == "unknown", unknown).otherwise(known)
    clause = F.when(F.col("n") > 1, text.title_first(clause)).otherwise(clause)
    g = p.withColumn("clause", clause).groupBy("run_id").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "clause"))), lambda x: _part("group", x["clause"])).alias("g"))
    lead = F.when(F.col("n") > 1, F.array(_part("text", F.concat(F.lit("Analyzed as "), F.col("n").cast("string"), F.lit(" language projects:"))))).otherwise(F.array().cast(_PART))
    out = runs.select("run_id").join(g, "run_id", "left")
    return out.select("run_id", F.when(F.col("g").isNull(), F.array(_part("text", "No project could be identified in this repository "), _part("certainty", "unknown"))).otherwise(F.concat(lead, "g")).alias("parts"))


def entry_line(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, parts): where it starts; else how many other entry points there are. entries (run_id, ord, kind, file_path, certainty)."""
    application = F.col("kind").isin("bootstrap", "cli")
    seed = F.when(application, 0).when(F.col("kind").isin("library", "runtime"), 1)
    e = entries.withColumn("s", seed).withColumn("best", F.min("s").over(Window.partitionBy("run_id")))
    s = e.where("s = best").groupBy("run_id").agg(F.min_by(F.struct("kind", "file_path", "certainty"), "ord").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"), F.first("best").alias("best"))
    others = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("all_n"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda x: x["kind"])).alias("all_kinds"))
    labels = F.create_map(*[F.lit(x) for kv in SEED_LABELS.items() for x in kv])
    label = F.when(F.col("kinds") == 1, labels[F.col("first.kind")]).when(F.col("best") == 0, F.lit("application entry point")).otherwise(F.lit("public entry point"))
    said = F.concat(F.lit("Its "), label, F.when(F.col("n") == 1, F.lit(" is ")).otherwise(F.lit("s include ")))
    more = F.when(F.col("n") > 1, F.array(_part("text", " and "), _part("anchor", F.concat((F.col("n") - 1).cast("string"), F.lit(" more"))))).otherwise(F.array().cast(_PART))
    yes = F.concat(F.array(_part("text", said), _part("location", F.col("first.file_path")), _part("text", " "), _part("certainty", F.col("first.certainty"))), more)
    listed = F.concat(F.lit(" ("), F.array_join("all_kinds", ", "), F.lit(") "), F.when(F.col("all_n") == 1, F.lit("was")).otherwise(F.lit("were")), F.lit(" found."))
    rest = F.when(F.col("all_n") > 0, F.array(_part("text", "; "), _part("anchor", text.plural(F.col("all_n"), "other entry point")), _part("text", listed))).otherwise(F.array().cast(_PART))
    no = F.concat(F.array(_part("text", "No bootstrap, command-line, library, or runtime entry point was detected "), _part("certainty", "unknown")), rest)
    j = runs.select("run_id").join(s, "run_id", "left").join(others, "run_id", "left")
    return j.select("run_id", F.when(F.col("n").isNotNull(), yes).otherwise(no).alias("parts"))


def at_a_glance(runs: DataFrame, projects: DataFrame, entries: DataFrame, areas: DataFrame, deps: DataFrame, gaps: DataFrame) -> DataFrame:
    """(run_id, place, id, parts): the four lines at the top of a page."""
    lines = [("kind", kind_line(projects, runs)), ("entry", entry_line(entries, runs)), ("areas", areas_line(areas, runs)), ("counts", counts_line(areas, deps, gaps, runs))]
    out = None
    for k, (name, line) in enumerate(lines, 1):
        one = line.select("run_id", F.lit(k).alias("place"), F.lit(name).alias("id"), "parts")
        out = one if out is None else out.unionByName(one)
    return out


def compare_budgets(samples: DataFrame, budgets: DataFrame) -> DataFrame:
    """Exact medians of target and production per metric and profile, with whether a gating budget is broken. samples (metric, profile, side, value); budgets (metric, profile,
    budget, gate)."""
    m = ranking.exact_quantile(samples, ["metric", "profile", "side"], "value", 0.5)
    m = m.groupBy("metric", "profile").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("target", "production")])
    m = samples.select("metric", "profile").distinct().join(m, ["metric", "profile"], "left")
    j = m.join(budgets, ["metric", "profile"], "left").withColumn("delta", F.col("target") - F.col("production"))
    return j.withColumn("over_budget", F.coalesce(F.col("gate") & (F.col("target") > F.col("budget")), F.lit(False)))


def latest_version(tags: DataFrame) -> DataFrame:
    """The largest semantic version among tags such as v1.2.3, and the next patch, minor and major ones."""
    part = lambda i: F.regexp_extract("tag", r"^v?(\d+)\.(\d+)\.(\d+)$", i).try_cast("int")
    v = tags.select(F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")).alias("v")).where("v.major is not null").agg(F.max("v").alias("v"))
    say = lambda a, b, c: F.concat(F.lit("v"), F.concat_ws(".", a, b, c))
    return v.select(say(F.col("v.major"), F.col("v.minor"), F.col("v.patch")).alias("latest"), say(F.col("v.major"), F.col("v.minor"), F.col("v.patch") + 1).alias("next_patch"), say(F.col("v.major"), F.col("v.minor") + 1, F.lit(0)).alias("next_minor"), say(F.col("v.major") + 1, F.lit(0), F.lit(0)).alias("next_major"))


def skipped_gap(skipped: DataFrame, most: int = 5) -> DataFrame:
    """(run_id, description): how many archive entries were left out, with examples. skipped (run_id, ord, path, type)."""
    one = F.struct("ord", F.concat(F.lit("'"), "path", F.lit("' ("), "type", F.lit(")")).alias("said"))
    first = windows.numbered(skipped, ["run_id"], [F.col("ord")], "_i").where(F.col("_i") <= most).groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("some"))
    g = skipped.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).join(first, "run_id")
    rest = F.when(F.col("n") > most, F.concat(F.lit(", and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    count = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " tarball entry was").otherwise(" tarball entries were"))
    some = F.array_join(F.transform("some", lambda x: x["said"]), ", ")
    why = F.lit(" skipped during extraction because they weren't a regular file or directory (e.g. a symbolic link): ")
    return g.select("run_id", F.concat(count, why, some, rest, F.lit(". These paths were not analyzed.")).alias("description"))
