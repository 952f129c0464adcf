"""Views, labels and the run store over the driver's tables, each with an independent SQL form in table_queries_sql.py. What a table lacks is made from its rows by a stated rule."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text, urls
from .operators import ranking
from .plans import history, views
from .session import materialize, shared_dir, tasks
from .sinks import archives, versions
from .sinks.store import Store, is_indexable
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


# --- views


@query
def source_languages(spark, d):
    """Analyzers of a source's documents with a tenth of its characters or more: languages stand for programming languages."""
    names = F.create_map(*[F.lit(x) for kv in {"en": "TypeScript", "de": "JavaScript", "fr": "Python", "es": "Rust"}.items() for x in kv])
    langs = table(spark, d, "documents").select(F.col("source").alias("run_id"), names[F.col("lang")].alias("language"), F.col("n_chars").alias("bytes"))
    return views.language_shares(langs).select("run_id", "analyzer", F.round("share", 6).alias("share"), F.col("place").cast("long").alias("place"))


@query
def unsupported_sources(spark, d):
    """The sentence that says why nothing could be analyzed, for every source."""
    langs = table(spark, d, "documents").groupBy(F.col("source").alias("run_id"), F.col("lang").alias("language")).agg(F.sum("n_chars").alias("bytes"))
    return views.unsupported_message(langs.withColumn("repository", F.concat(F.lit("o/"), "run_id")), "It")


@query
def ranked_areas(spark, d):
    """Areas of a region: its nations, with the nations they are linked to as dependencies and their suppliers as entry points."""
    return _nation_areas(spark, d).transform(views.ranked_areas).select("run_id", "name", F.col("links").cast("long").alias("links"), F.col("place").cast("long").alias("place"))


def _nation_areas(spark, d) -> DataFrame:
    from .queries import area_links

    links, s, n = area_links(spark, d), table(spark, d, "supplier"), table(spark, d, "nation")
    to = links.where("n > 1").groupBy(F.col("from_id").alias("k")).agg(F.collect_list("to_id").alias("direct_dependency_ids"))
    by = links.where("n > 2").groupBy(F.col("to_id").alias("k")).agg(F.collect_list("from_id").alias("direct_dependent_ids"))
    e = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_list("s_suppkey").alias("entry_point_ids"))
    a = n.select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 7 == 0, F.lit(".")).otherwise(F.col("n_name")).alias("name"))
    a = a.withColumn("responsibility", _pick(F.col("k"), "Implementation modules", "Tests", "Implementation modules"))
    for x, c in ((to, "direct_dependency_ids"), (by, "direct_dependent_ids"), (e, "entry_point_ids")):
        a = a.join(x, "k", "left").withColumn(c, F.coalesce(c, F.array().cast(x.schema[c].dataType)))
    return a


@query
def area_slugs(spark, d):
    """Slugs of parts as areas of their brand, those without a letter or digit called 'area'."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 9 == 0, F.lit("--")).otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit("!"))).alias("name"))
    return views.slugged_areas(p).select("ord", "slug")


@query
def ranked_functions(spark, d):
    """Parts of a brand by score, then name; two of three have a score."""
    p = table(spark, d, "part")
    c = p.select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    i = p.where("p_partkey % 3 > 0").select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("function_id"), F.col("p_size").alias("score"))
    return views.ranked_functions(c, i).select("id", F.col("place").cast("long").alias("place"))


@query
def unique_callees(spark, d):
    """The suppliers of every customer, with their names, in the order in which line items first name them; an order's line numbers may repeat, the smallest supplier is first among equals."""
    l, o, s = (table(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    rows = l.count()
    l, o = l.repartition(tasks(rows), "l_orderkey"), o.repartition(tasks(rows), "o_orderkey")
    calls = l.join(o, l.l_orderkey == o.o_orderkey).select(F.lit("r").alias("run_id"), F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    u = views.unique_callees(calls, s.select(F.lit("r").alias("run_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), rows)
    return u.select("caller", "callee", "name", F.col("place").cast("long").alias("place"))


@query
def evidence_totals(spark, d):
    """Evidence of two collections of a customer: lines per order, and orders."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    lines = l.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("evidence")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    orders = o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.collect_list("o_orderkey").alias("evidence"))
    return views.evidence_total([lines.select(F.col("o_custkey").alias("run_id"), "evidence"), orders])


@query
def value_contract(spark, d):
    """Customers whose orders meet six conditions; one of them is unknown for those without urgent orders, and so holds."""
    o = table(spark, d, "orders")
    urgent = F.col("o_orderpriority").startswith("1-")
    f = o.groupBy(F.col("o_custkey").alias("run_id")).agg(
        (F.count(F.lit(1)) >= 3).alias("has_identity"), F.bool_or(F.col("o_orderstatus") == "F").alias("has_project"), F.bool_or(F.col("o_orderstatus") == "O").alias("has_area"),
        (F.max("o_totalprice") > 200_000).alias("has_start_here"), F.bool_and(F.when(urgent, F.col("o_totalprice") > 20_000)).alias("traceable"), (F.min("o_totalprice") < 400_000).alias("has_entry"),
    )
    return views.value_contract(f).select("run_id", "status")


@query
def skipped_gaps(spark, d):
    """Orders that are links or devices, as archive entries of a customer that were left out."""
    o = table(spark, d, "orders").where("o_orderpriority < '3'")
    kind = F.when(F.col("o_orderpriority").startswith("1-"), F.lit("symbolic link")).otherwise(F.lit("device"))
    return views.skipped_gap(o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), kind.alias("type")))


@query
def budgets(spark, d):
    """Medians of the values of even and odd users per event type against budgets."""
    e = table(spark, d, "events")
    samples = e.select(F.col("event_type").alias("metric"), F.lit("desktop").alias("profile"), F.when(F.col("user_id") % 2 == 0, F.lit("target")).otherwise(F.lit("production")).alias("side"), "value")
    known = e.select(F.col("event_type").alias("metric")).distinct().where("metric <> 'error'").select("metric", F.lit("desktop").alias("profile"), (F.length("metric") * 6.5).cast("double").alias("budget"), (F.col("metric") != "view").alias("gate"))
    c = views.compare_budgets(samples, known)
    return c.select("metric", *[F.round(x, 6).alias(x) for x in ("target", "production", "delta")], "over_budget")


@query
def latest_version(spark, d):
    """The newest version among tags made of parts, some of which are none, and the next ones."""
    k = F.col("p_partkey")
    version = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (k % 13).cast("string"), (k % 29).cast("string"))
    return views.latest_version(table(spark, d, "part").select(F.when(k % 5 == 0, F.lit("nightly")).when(k % 5 == 1, version).otherwise(F.concat(F.lit("v"), version)).alias("tag")))


@query
def dependency_order(spark, d):
    """Parts of a brand as packages, by number of line items that refer to them, downwards: the reverse of the ascending order."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    one = F.struct(F.lit("import-reference").alias("kind"), F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file_path")).alias("location"))
    refs = l.groupBy("l_partkey").agg(F.collect_list(one).alias("evidence"))
    deps = p.join(refs, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_brand").alias("run_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.lit("direct").alias("scope"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("keywords"), F.coalesce("evidence", F.array().cast(refs.schema["evidence"].dataType)).alias("evidence"))
    v = views.dependencies(deps, "usage", desc=True)
    return v.select("ord", F.col("uses").cast("long").alias("uses"), F.size(views.used_by(F.col("evidence"))).cast("long").alias("n_files"), F.col("place").cast("long").alias("place"))


@query
def search_parts(spark, d):
    """Parts whose name or brand holds 'BLUE' in any case, by key."""
    return views.search(table(spark, d, "part"), ["p_name", "p_brand"], "  BLUE ", [F.col("p_partkey")]).select("p_partkey", "p_name")


@query
def indexable_customers(spark, d):
    """Customers as repositories: those whose facts are complete, public and not empty, and whose name is no fixture."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    f = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"), F.count_if(F.col("o_totalprice") > 300_000).alias("entry_points"), F.count_if(F.col("o_totalprice") > 100_000).alias("major_areas"))
    status = F.when(F.col("s") == "F", F.lit("completed")).when(F.col("s") == "O", F.lit("partial")).otherwise(F.lit("failed"))
    facts = f.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"), "c_custkey", status.alias("status"), (F.col("c_acctbal") < 0).alias("is_private"), "entry_points", "major_areas")
    return is_indexable(facts, "7$").select("c_custkey")


# --- history


@query
def commit_listing(spark, d):
    """The newest five events of each user since a day, as commits, and whether there were more."""
    e = table(spark, d, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    commits = e.select(F.col("user_id").alias("run_id"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("ord"), "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("author_name"), at.alias("authored_at"))
    return history.listing(commits, F.lit("2024-01-20T00:00:00.000Z"), 5).select("run_id", "event_id", "author_name", "truncated")


# --- the run store


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/codeatlas/store-{uuid.uuid4().hex}")


def _runs(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("repo_id"), F.col("o_orderpriority").alias("commit_sha"), F.lit("v1").alias("analyzer_version"), F.when(F.col("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("partial")).alias("status"),
        F.concat(F.lit("{}"), F.col("o_orderkey").cast("string")).alias("result"), F.lit(None).cast("string").alias("error_message"), (F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, o_orderkey / 1000000)")).alias("created_at"),
    )


@query
def store_runs(spark, d):
    """Orders as runs of a customer, saved in two batches: a key keeps its first row. What the second save returns, and whether a row is its customer's newest."""
    s, o = _store(spark), table(spark, d, "orders")
    late = F.year("o_orderdate") >= 1997
    s.save_runs(_runs(o.where(~late)))
    got = s.save_runs(_runs(o.where(late))).select("id", F.lit(True).alias("returned"))
    latest = s.latest_runs().select("repo_id", F.col("id").alias("top"))
    stored = s.read("analysis_runs").join(got, "id", "left").join(latest, "repo_id")
    return stored.select("repo_id", "commit_sha", "status", "result", F.coalesce("returned", F.lit(False)).alias("returned"), (F.col("id") == F.col("top")).alias("is_latest"))


@query
def store_history(spark, d):
    """Cached entries of customers, of their orders by year, replaced by a later computation of some."""
    s, o = _store(spark), table(spark, d, "orders")

    def computed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("o_custkey").alias("repo_id")).agg(F.max("o_orderkey").cast("string").alias("computed_through_sha"), F.count(F.lit(1)).cast("string").alias("entries"), F.max("o_orderdate").cast("timestamp").alias("computed_at"))

    s.save_history(computed(o.where("year(o_orderdate) < 1997")))
    s.save_history(computed(o.where("o_custkey % 3 = 0")))
    return s.read("history_cache").select("repo_id", "computed_through_sha", "entries")


@query
def schema_versions(spark, d):
    """Orders as written by three versions of a schema, by year: the first lacks priority and status, the second priority; read as one, with rules for what is missing."""
    o = table(spark, d, "orders")
    root = f"{shared_dir(spark)}/codeatlas/versions-{uuid.uuid4().hex}"
    first, second = "o_orderkey long, o_totalprice double", "o_orderkey long, o_totalprice double, o_orderstatus string"
    schemas = {1: first, 2: second, 3: f"{second}, o_orderpriority string"}
    year = F.year("o_orderdate")
    batches = {1: year < 1995, 2: (year >= 1995) & (year < 1997) | (o["o_orderkey"] % 10 == 0), 3: year >= 1997}
    for n, kept in batches.items():
        o.where(kept).select(*spark.createDataFrame([], schemas[n]).columns).write.parquet(f"{root}/v{n}")
    rules = {2: {"o_orderstatus": F.when(F.col("o_totalprice") > 250_000, F.lit("F")).otherwise(F.lit("?"))}, 3: {"o_orderpriority": F.concat(F.lit("by-status-"), F.col("o_orderstatus"))}}
    return versions.read_versions(spark, [(n, f"{root}/v{n}", schemas[n], rules.get(n, {})) for n in (2, 3, 1)], ["o_orderkey"])


@query
def archive_round_trip(spark, d):
    """Pages packed as tarballs of eight and read back. Of five archives in turn the second holds a path that leads out, the third is cut short, the fourth holds a link; any may hold more
    than the limit of bytes: what each gave, and why nothing."""
    p = table(spark, d, "pages")
    run, kind = F.floor(F.col("page_id") / 8), F.floor(F.col("page_id") / 8) % 5
    odd = F.col("page_id") % 8 == 3
    path = F.concat(F.when((kind == 1) & odd, F.lit("../")).otherwise(F.lit("src/")), F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))
    type_ = F.when((kind == 3) & odd, F.lit("symbolic link")).otherwise(F.lit("file"))
    text_ = F.when(type_ == "file", F.col("html")).otherwise(F.lit("elsewhere"))
    packed = archives.tarballs(p.select(run.cast("string").alias("run_id"), F.col("page_id").alias("ord"), path.alias("path"), type_.alias("type"), F.coalesce(text_, F.lit("")).alias("text")))
    cut = F.when(F.col("run_id").cast("long") % 5 == 2, F.expr("substring(content, 1, 20)")).otherwise(F.col("content"))
    entries = materialize(files.archive_entries(packed.select("run_id", cut.alias("content"))), "entries")
    broken = files.breaches(entries, most_bytes=60_000)
    ok, skipped = files.extracted(entries, broken)
    runs = packed.select("run_id")
    got = ok.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).alias("chars"))
    left = skipped.groupBy("run_id").agg(F.min("path").alias("skipped"))
    unread = entries.where("type = 'error'").select("run_id", F.lit("unreadable").alias("unread"))
    j = runs.join(broken, "run_id", "left").join(unread, "run_id", "left").join(got, "run_id", "left").join(left, "run_id", "left")
    return j.select("run_id", F.coalesce("code", "unread").alias("code"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("chars", F.lit(0)).alias("chars"), "skipped")


# --- strings and paths


@query
def repository_urls(spark, d):
    """References to repositories made of pages, several forms in turn, with what is wrong with those that can't be read."""
    k = F.col("page_id")
    name = F.concat(F.lit("r"), k.cast("string"))
    asked = F.element_at(F.array(
        F.concat(F.lit("https://github.com/Octo/"), name, F.lit(".git")), F.concat(F.lit("octo/"), name), F.concat(F.lit("github.com/o/"), name, F.lit("/tree/main")), F.col("url"), F.concat(F.lit("-o/"), name), F.concat(F.lit("www.GitHub.com/"), name),
    ), (k % 6 + 1).cast("int"))
    r = urls.parse_repository(asked)
    return table(spark, d, "pages").select("page_id", asked.alias("asked"), r["owner"].alias("owner"), r["repo"].alias("repo"), r["reason"].alias("reason"))


def _files(spark, d) -> DataFrame:
    """Pages as source files: a directory and a name in turn."""
    k = F.col("page_id")
    path = F.concat(_pick(k, "", "src/", "tests/", "e2e/", "src/__fixtures__/", "pkg/__mocks__/a/"), _pick((k / 6).cast("long"), "a.test.ts", "test_b.py", "setup.py", "vite.config.ts", "jest.setup.mjs", "logo.SVG", "x.module.css", "conftest.py"))
    return table(spark, d, "pages").select("page_id", path.alias("path"))


@query
def path_predicates(spark, d):
    """Tests, tooling, test support, assets and end-to-end roots among such files."""
    p = F.col("path")
    flags = {"js_test": paths.is_js_test, "py_test": paths.is_py_test, "js_tooling": paths.is_js_tooling, "py_tooling": paths.is_py_tooling, "support": paths.is_test_support, "asset": paths.is_asset, "e2e": paths.is_e2e_root, "under_root": paths.is_under_test_root}
    return _files(spark, d).select("page_id", "path", *[f(p).alias(name) for name, f in flags.items()])


@query
def relative_paths(spark, d):
    """Where relative specifiers lead from a file, and names of packages."""
    f = _files(spark, d)
    s = _pick(F.col("page_id"), "./x", "../x/./y", "../../../z", "@scope/pkg/sub", "pkg/sub")
    return f.select("page_id", paths.resolve_relative(F.col("path"), s).alias("target"), F.when(~s.startswith("."), paths.package_name(s)).alias("package"), paths.relative_to(F.concat(F.lit("/repo/"), "path"), F.lit("/repo")).alias("inside"))


@query
def text_labels(spark, d):
    """Labels of parts, suppliers' initials and addresses of sources."""
    k, name = F.col("p_partkey"), F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", text.title_first(name).alias("title"), text.plural(k % 3, "entry", "entries").alias("plural"), text.count_phrase(k % 3, "gap").alias("phrase"), text.join_and(F.slice(F.array(F.lit("a"), F.lit("b"), name), F.lit(1), (k % 4).cast("int"))).alias("joined"),
        text.initials(name).alias("initials"), text.path_label(_pick(k, ".", "/a", "b/c")).alias("label"), text.last_segment(_pick(k, "a/b/", "c", "/")).alias("last"), text.lead_sentence(F.concat(F.lit(" "), F.repeat(name, (k % 9).cast("int")), F.lit(".!"))).alias("lead"),
        text.blob_url(F.lit("o"), F.lit("r"), F.lit("s"), name, F.when(k % 2 == 0, k)).alias("blob"), text.tree_url(F.lit("o"), F.lit("r"), F.lit("s"), _pick(k, ".", "src")).alias("tree"),
    )


@query
def relative_times(spark, d):
    """How long ago events were at a fixed time, in words."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").cast("timestamp")
    ago = F.floor((F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000)
    return table(spark, d, "events").select("event_id", text.relative_time(ago * (F.col("event_id") % 40)).alias("said"))


@query
def page_clamps(spark, d):
    """Asked pages, some of which can't be read or don't exist, held to those of a customer's orders."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    asked = F.when(F.col("o_custkey") % 4 == 0, F.lit("x")).otherwise((F.col("o_custkey") % 9 - 2).cast("string"))
    pages = F.ceil(F.col("n") / 4).cast("int")
    return n.select("o_custkey", ranking.clamp_page(asked, pages).cast("long").alias("page"))


@query
def registry_enrichment(spark, d):
    """A supplier's lines as dependencies, in order of order and line, described by answers of registries made of parts: one in seven has no text, one in five no fitting type, one in eleven can't be read."""
    k = F.col("p_partkey")
    registry = _pick(k, "npm", "pypi")
    text_ = F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("p_type"))
    npm = F.concat(F.lit('{"description": '), F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), text_, F.lit('"'))), F.lit(', "keywords": ["'), "p_brand", F.lit('", 7]}'))
    pypi = F.concat(F.lit('{"info": {"summary": "'), text_, F.lit('", "keywords": "'), "p_brand", F.lit(' , b,"}}'))
    body = F.when(k % 11 == 0, F.lit("<html>")).when(k % 2 == 0, npm).otherwise(pypi)
    payloads = table(spark, d, "part").select(registry.alias("registry"), F.concat(F.lit("p"), k.cast("string")).alias("name"), body.alias("body"))
    lines = table(spark, d, "lineitem")
    deps = lines.select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), _pick(F.col("l_partkey"), "npm", "pypi").alias("registry"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"))
    return files.enriched(deps, files.registry(payloads)).withColumn("keywords", F.array_join("keywords", " "))
