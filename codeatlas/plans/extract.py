"""From parsed files to fact tables. Parsing touches rows once, in Python; everything after it is joins, windows and aggregates.

files: (run_id, project_id, path, file_ord, text). All tables carry run_id and ord; ids are sequential within a run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import resolve, windows
from ..session import materialize

# What counts as a boundary.
GLOBALS = {"fetch": "http", "XMLHttpRequest": "http", "localStorage": "browser-storage", "sessionStorage": "browser-storage", "indexedDB": "browser-storage"}
PACKAGES = {
    "axios": "http", "node-fetch": "http", "fs": "filesystem", "node:fs": "filesystem", "fs/promises": "filesystem", "node:fs/promises": "filesystem", "pg": "database", "mysql2": "database",
    "mysql": "database", "mongoose": "database", "@prisma/client": "database", "knex": "database", "redis": "database", "ioredis": "database",
}
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
CONVENTIONAL = ["index", "src/index", "src/main", "main", "server", "src/server", "app", "src/app"]

JS = {
    "import": "decl string, specifier string, line int, off int, default_name string, namespace_name string, named array<array<string>>",
    "export": "name string, local_name string, from_specifier string, is_star boolean, is_default boolean, is_async boolean, line int",
    "callable": "seq int, kind string, name string, start_off int, end_off int, start_line int, end_line int, params array<array<string>>, return_type string, has_jsx boolean, top_level boolean",
    "call": "seq int, callee string, line int, off int, used boolean",
    "ident": "name string, line int, off int, is_import boolean",
    "hook": "hook string, value_name string, setter_name string, off int, line int, body_start int, body_end int, deps array<string>",
    "handler": "attr string, target string, line int, off int",
    "flag": "renders_dom boolean, use_server boolean",
    "component": "name string, line int",
}
PY = {
    "import": "form string, level int, module string, names array<string>, is_wildcard boolean, line int",
    "surface": "has_all boolean, all_names array<array<string>>, defs array<array<string>>, from_names array<array<string>>, has_main_guard boolean, parsed boolean",
}


def _js(path: str, text: str) -> Iterator[tuple[str, dict]]:
    from ..sources.js_facts import File

    f = File(path, text)
    for kind, rows in (("import", f.imports()), ("export", f.exports()), ("callable", f.callables()), ("call", f.calls()), ("ident", f.identifiers()), ("hook", f.hooks()), ("handler", f.handlers()), ("flag", [f.flags()]), ("component", f.components())):
        for r in rows:
            yield kind, r


def _py(path: str, text: str) -> Iterator[tuple[str, dict]]:
    from ..sources import py_facts

    tree = py_facts.parse(text)
    for r in py_facts.imports(text, tree):
        yield "import", r
    yield "surface", py_facts.surface(tree) | {"parsed": tree is not None}


def parse(files: DataFrame, language: str) -> DataFrame:
    """(run_id, project_id, path, file_ord, kind, seq, data): a row per syntactic item; a file that breaks the reader gives a row of kind 'gap'."""
    read = _js if language == "js" else _py

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run_id", "project_id", "path", "file_ord", "kind", "seq", "data"]
        for batch in batches:
            for run_id, project, path, ordinal, text in zip(*(batch[c].to_pylist() for c in ("run_id", "project_id", "path", "file_ord", "text")), strict=True):
                try:
                    rows = list(read(path, text or ""))
                except Exception as e:  # noqa: BLE001  a file's text must not stop a run
                    rows = [("gap", {"description": f"'{path}' could not be parsed: {type(e).__name__}"})]
                if rows:
                    kinds, data = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([run_id] * n, pa.string()), pa.array([project] * n, pa.string()), pa.array([path] * n), pa.array([ordinal] * n, pa.int64()), pa.array(kinds), pa.array(range(n), pa.int64()), pa.array([json.dumps(d) for d in data])], names)

    f = files.select("run_id", "project_id", "path", F.col("file_ord").cast("long").alias("file_ord"), "text")
    return materialize(f.mapInArrow(run, "run_id string, project_id string, path string, file_ord long, kind string, seq long, data string"), "facts")


def table(facts: DataFrame, kind: str, schemas: dict[str, str]) -> DataFrame:
    """The rows of a kind, with `ord` in order of files and places."""
    t = facts.where(F.col("kind") == kind).select("run_id", "project_id", F.col("path").alias("file_path"), "file_ord", F.col("seq").alias("place"), F.from_json("data", schemas[kind]).alias("d"))
    return windows.numbered(t.select("run_id", "project_id", "file_path", "file_ord", "place", "d.*"), ["run_id", "project_id"], [F.col("file_ord"), F.col("place")], "ord", 1)


def sequential(df: DataFrame, prefix: str, order: list[str], name: str = "id") -> DataFrame:
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    return df.withColumn(name, F.concat(F.lit(prefix), n.cast("string")))


# --- imports


def js_candidates(base: Column) -> Column:
    return F.array(base, *[F.concat(base, F.lit(f".{e}")) for e in ("ts", "tsx", "js", "jsx")], *[F.concat(base, F.lit(f"/index.{e}")) for e in ("ts", "tsx", "js", "jsx")])


def js_resolved(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports with target (a file), alias (the pattern that matched) and verdict: relationship, asset, unknown, unsupported or external. aliases (run_id, pattern, target, match_type, rank)."""
    i = imports.withColumn("_k", F.concat_ws("\u0001", "run_id", "ord", "file_path"))
    spec = F.col("specifier")
    relative = paths.is_relative(spec)
    if aliases is not None:
        lengths = F.sequence(F.lit(1), F.length("specifier"))
        tried = i.where(~relative).select("_k", "run_id", "specifier", F.explode(F.concat(F.array(F.struct(F.lit("exact").alias("t"), spec.alias("p"))), F.transform(lengths, lambda n: F.struct(F.lit("prefix").alias("t"), F.substring(spec, F.lit(1), n).alias("p"))))).alias("c"))
        a = aliases.where("match_type <> 'gap'").select("run_id", F.col("match_type").alias("_t"), F.col("pattern").alias("_p"), F.col("target").alias("_to"), "rank")
        hit = tried.join(a, (tried.run_id == a.run_id) & (tried.c.t == a._t) & (tried.c.p == a._p)).groupBy("_k").agg(F.min_by(F.struct("_p", "_to", "_t"), "rank").alias("al"))
        i = i.join(hit, "_k", "left")
    else:
        i = i.withColumn("al", F.lit(None).cast("struct<_p:string,_to:string,_t:string>"))
    rest = F.when(F.col("al._t") == "prefix", F.substr(spec, F.length("al._p") + 1)).otherwise(F.lit(""))
    base = F.when(relative, paths.resolve_relative(F.col("file_path"), spec)).when(F.col("al").isNotNull(), paths.normalize(F.concat_ws("/", F.col("al._to"), rest)))
    i = i.withColumn("_base", base)
    known = files.select("run_id", F.col("path").alias("_c")).distinct()
    tried = i.where("_base is not null").select("_k", "run_id", F.posexplode(js_candidates(F.col("_base"))).alias("_r", "_c"))
    target = tried.join(known, ["run_id", "_c"]).groupBy("_k").agg(F.min_by("_c", "_r").alias("target"))
    i = i.join(target, "_k", "left")
    verdict = (
        F.when(spec.isNull(), F.lit("unsupported")).when(relative & paths.is_asset(spec), F.lit("asset")).when(F.col("target").isNotNull(), F.lit("relationship"))
        .when(relative, F.lit("unknown")).when(paths.looks_like_alias(spec), F.lit("unsupported")).otherwise(F.lit("external"))
    )
    return i.withColumn("verdict", verdict).withColumn("alias", F.col("al._p")).drop("_k", "_base", "al")


def js_relationships(resolved: DataFrame) -> DataFrame:
    """Import relationships, one per statement: (run_id, ord, id, from_id, to_id, kind, certainty, why)."""
    r = sequential(resolved.where("verdict = 'relationship'"), "js-ts-import-", ["ord"])
    why = F.concat(F.lit("'"), "file_path", F.lit("' imports '"), "specifier", F.lit("'"), F.when(F.col("alias").isNotNull(), F.concat(F.lit(" through the alias '"), "alias", F.lit("'"))).otherwise(F.lit("")))
    return r.select("run_id", "ord", "id", F.col("file_path").alias("from_id"), F.col("target").alias("to_id"), F.lit("depends-on").alias("kind"), F.lit("detected").alias("certainty"), why.alias("why"))


def js_import_gaps(resolved: DataFrame) -> DataFrame:
    said = F.when(F.col("specifier").isNull(), F.lit("import with a specifier that can't be read")).otherwise(F.concat(F.lit("could not resolve '"), "specifier", F.lit("'")))
    return resolved.where("verdict in ('unknown', 'unsupported')").select("run_id", F.col("verdict").alias("certainty"), said.alias("description"), "file_path", F.col("line").alias("start_line"))


def py_relationships(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relationships, each target once per importer; external references; gaps) of Python imports. `src` is searched before the root if it holds files."""
    i = imports.withColumn("_k", F.concat_ws("\u0001", "run_id", "ord"))
    dirs = paths.directories(F.col("file_path"))
    base = F.when(F.col("level") > 0, F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - F.col("level") + 1, F.lit(0))))
    module = F.filter(F.split("module", r"\."), lambda s: s != "")
    has_src = files.where(F.col("path").startswith("src/")).select("run_id").distinct().withColumn("src", F.lit(True))
    i = i.join(has_src, "run_id", "left")
    roots = F.when(F.col("level") > 0, F.array(base)).when(F.col("src"), F.array(F.array(F.lit("src")), F.array().cast("array<string>"))).otherwise(F.array(F.array().cast("array<string>")))
    # `from m import n` asks for m.n, then for m; a plain import, or one without names, for m alone
    wanted = F.when((F.col("form") == "from") & (F.size("names") > 0), F.transform("names", lambda n: F.struct(n.alias("name"), F.array(F.concat(module, F.array(n)), module).alias("tries")))).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("name"), F.array(module).alias("tries")))
    )
    w = i.select("*", roots.alias("roots"), F.posexplode(wanted).alias("nth", "w"))
    forms = F.flatten(F.transform("w.tries", lambda t: F.flatten(F.transform("roots", lambda r: F.array(F.concat(F.array_join(F.concat(r, t), "/"), F.lit(".py")), F.array_join(F.concat(r, t, F.array(F.lit("__init__.py"))), "/"))))))
    tried = w.select("_k", "nth", "run_id", F.posexplode(forms).alias("_r", "_c"))
    hit = tried.join(files.select("run_id", F.col("path").alias("_c")).distinct(), ["run_id", "_c"]).groupBy("_k", "nth").agg(F.min_by("_c", "_r").alias("target"))
    w = materialize(w.join(hit, ["_k", "nth"], "left").drop("roots", "src"), "py-imports")
    r = resolve.first_wins(w.where("target is not null"), ["run_id", "file_path", "target"], [F.col("ord"), F.col("nth")])
    r = sequential(r, "python-import-", ["ord", "nth"])
    why = F.concat(F.lit("'"), "file_path", F.lit("' imports '"), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("level", F.lit(1))), lambda _: F.when(F.col("level") > 0, F.lit(".")).otherwise(F.lit(""))), ""), "module", F.lit("'"))
    rel = r.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("ord", "nth")).alias("ord"), "id", F.col("file_path").alias("from_id"), F.col("target").alias("to_id"), F.lit("depends-on").alias("kind"), F.lit("detected").alias("certainty"), why.alias("why"))
    none = w.groupBy("_k").agg(F.max("target").alias("any")).where("any is null").select("_k")
    external = w.where("level = 0 and nth = 0").join(none, "_k").select("run_id", "ord", "file_path", "line", F.element_at(F.split("module", r"\."), 1).alias("package"))
    gaps = w.where("level > 0 and target is null").select("run_id", F.lit("unknown").alias("certainty"), F.concat(F.lit("could not resolve relative import of '"), F.coalesce("w.name", "module"), F.lit("'")).alias("description"), "file_path", F.col("line").alias("start_line"))
    return rel, external, gaps


# --- callables, calls and behaviour


def callables(raw: DataFrame) -> DataFrame:
    """Named callables with ids: (run_id, ord, id, name, kind, file_path, start_off, end_off, ...)."""
    c = sequential(raw.where("name is not null"), "js-ts-callable-", ["ord"])
    unknown = F.transform("params", lambda p: F.struct(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("type_annotation"), F.when(F.get(p, F.lit(1)).isNull(), F.lit("unknown")).otherwise(F.lit("detected")).alias("certainty")))
    return c.withColumn("parameters", unknown).withColumn("return_certainty", F.when(F.col("return_type").isNull(), F.lit("unknown")).otherwise(F.lit("detected")))


def owners(points: DataFrame, named: DataFrame, off: str = "off") -> DataFrame:
    """points with `owner`, the innermost named callable of their file that holds them; points outside of all are dropped."""
    spans = named.select("run_id", "file_path", "start_off", "end_off", F.col("id").alias("owner"))
    return windows.nearest_span(points, spans, ["run_id", "file_path"], off, "start_off", "end_off", "owner").where("owner is not null")


def named_imports(resolved: DataFrame) -> DataFrame:
    """(run_id, file_path, local, imported, target): names bound by relative named imports; the last binding of a local name wins."""
    r = resolved.where((F.col("decl") == "import") & paths.is_relative(F.col("specifier")) & F.col("target").isNotNull())
    n = r.select("run_id", "file_path", "target", F.col("ord").alias("o"), F.posexplode("named").alias("p", "n"))
    n = n.select("run_id", "file_path", F.get("n", F.lit(1)).alias("local"), F.get("n", F.lit(0)).alias("imported"), "target", F.struct("o", "p").alias("v"))
    return resolve.last_wins(n, ["run_id", "file_path", "local"], "v").drop("v")


def resolve_names(uses: DataFrame, name: str, named: DataFrame, bound: DataFrame, out: str = "callable_id") -> DataFrame:
    """uses (run_id, file_path, name, ...) with the callable that the name means: unique in its file, else (absent there) unique in the file it is imported from."""
    c = named.select("run_id", "file_path", F.col("name").alias(name), "id")
    u = resolve.unique_join(uses, c, ["run_id", "file_path", name], "id", "_local")
    u = u.join(bound.withColumnRenamed("local", name), ["run_id", "file_path", name], "left")
    far = named.select("run_id", F.col("file_path").alias("target"), F.col("name").alias("imported"), "id")
    u = resolve.unique_join(u, far, ["run_id", "target", "imported"], "id", "_far")
    return u.withColumn(out, resolve.with_veto("_local", "_local_n", F.col("_far"))).drop("_local", "_local_n", "_far", "_far_n", "target", "imported")


def call_graph(calls: DataFrame, named: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(CALL edges, one per call site; DATA_FLOW edges from callee to caller where the value is used). Aliases play no part here."""
    c = resolve_names(owners(calls, named), "callee", named, bound).where("callable_id is not null")
    c = materialize(sequential(c, "js-ts-call-", ["ord"]), "calls")
    call = c.select("run_id", "ord", "id", F.col("owner").alias("source"), F.col("callable_id").alias("target"), F.lit("CALL").alias("type"), F.lit("detected").alias("certainty"), "file_path", F.col("line").alias("start_line"))
    flow = sequential(c.where("used").drop("id"), "js-ts-data-flow-", ["ord"]).select("run_id", "ord", "id", F.col("callable_id").alias("source"), F.col("owner").alias("target"), F.lit("DATA_FLOW").alias("type"), F.lit("inferred").alias("certainty"), "file_path", F.col("line").alias("start_line"))
    return call, flow


def react_state(hooks: DataFrame, calls: DataFrame, idents: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state nodes, STATE_READ and STATE_WRITE edges). Names are matched within the owner's span, without scopes."""
    s = owners(hooks.where("value_name is not null").select("run_id", "file_path", "ord", "value_name", "setter_name", "off", "line"), named)
    s = sequential(s, "js-ts-state-", ["ord"], "state_id").join(named.select("run_id", F.col("id").alias("owner"), "start_off", "end_off"), ["run_id", "owner"])
    s = materialize(s.withColumnRenamed("off", "decl_off").withColumnRenamed("line", "decl_line").withColumnRenamed("ord", "s_ord"), "states")
    inside = (F.col("off") >= F.col("start_off")) & (F.col("off") < F.col("end_off"))
    w = s.join(calls.select("run_id", "file_path", F.col("callee").alias("setter_name"), "off", "line", "ord"), ["run_id", "file_path", "setter_name"]).where(inside)
    r = s.join(idents.select("run_id", "file_path", F.col("name").alias("value_name"), "off", "line", "ord"), ["run_id", "file_path", "value_name"]).where(inside & ((F.col("off") < F.col("decl_off")) | (F.col("line") != F.col("decl_line"))))
    both = w.select("run_id", "file_path", "state_id", "off", "line", "ord", F.lit("STATE_WRITE").alias("type"), "s_ord").unionByName(r.select("run_id", "file_path", "state_id", "off", "line", "ord", F.lit("STATE_READ").alias("type"), "s_ord"))
    both = owners(both, named)
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("s_ord", F.desc("type"), "ord")).cast("string")
    e = both.select("run_id", "ord", F.concat(F.when(F.col("type") == "STATE_WRITE", F.lit("js-ts-state-write-")).otherwise(F.lit("js-ts-state-read-")), n).alias("id"), F.col("owner").alias("source"), F.col("state_id").alias("target"), "type", F.lit("detected").alias("certainty"), "file_path", F.col("line").alias("start_line"))
    e = materialize(e, "state-edges")
    used = e.groupBy("run_id", F.col("target").alias("state_id")).agg(F.count_distinct("source").alias("n"))
    nodes = s.join(used, ["run_id", "state_id"], "left").select("run_id", F.col("state_id").alias("id"), F.lit("state").alias("kind"), F.col("value_name").alias("name"), "file_path", F.when(F.col("n") > 1, F.lit("shared")).otherwise(F.lit("local")).alias("state_scope"), F.lit(None).cast("string").alias("boundary_type"))
    return nodes, e


def react_events(handlers: DataFrame, named: DataFrame, bound: DataFrame) -> DataFrame:
    """EVENT edges from the component that renders an event attribute to the callable that handles it."""
    h = resolve_names(owners(handlers.where("target is not null").select("run_id", "file_path", "ord", "off", "line", F.col("target").alias("handler")), named), "handler", named, bound).where("callable_id is not null")
    return sequential(h, "js-ts-event-", ["ord"]).select("run_id", "ord", "id", F.col("owner").alias("source"), F.col("callable_id").alias("target"), F.lit("EVENT").alias("type"), F.lit("detected").alias("certainty"), "file_path", F.col("line").alias("start_line"))


def react_effects(hooks: DataFrame, calls: DataFrame, states: DataFrame, named: DataFrame, bound: DataFrame) -> DataFrame:
    """FRAMEWORK edges of effects: from each tracked dependency (or, without one, from the owner) to each callable called inside, once per effect. Both lists are a few entries long."""
    e = owners(hooks.where("body_start is not null").select("run_id", "file_path", F.col("ord").alias("e_ord"), "off", "line", "body_start", "body_end", "deps"), named)
    c = calls.select("run_id", "file_path", "callee", F.col("off").alias("c_off"), F.col("ord").alias("c_ord"))
    inner = e.join(c, ["run_id", "file_path"]).where((F.col("c_off") >= F.col("body_start")) & (F.col("c_off") < F.col("body_end")))
    inner = resolve_names(inner, "callee", named, bound).where("callable_id is not null").select("run_id", "e_ord", F.col("callable_id").alias("target"), "c_ord")
    dep = e.select("run_id", "file_path", "e_ord", F.explode("deps").alias("name")).join(states.select("run_id", "file_path", "name", F.col("id").alias("source")), ["run_id", "file_path", "name"]).select("run_id", "e_ord", "source").distinct()
    src = e.join(dep, ["run_id", "e_ord"], "left").select("run_id", "e_ord", "file_path", "line", F.coalesce("source", "owner").alias("source"))
    j = src.join(inner.groupBy("run_id", "e_ord", "target").agg(F.min("c_ord").alias("ord")), ["run_id", "e_ord"])
    return sequential(j, "js-ts-effect-", ["e_ord", "ord", "source"]).select("run_id", "ord", "id", "source", "target", F.lit("FRAMEWORK").alias("type"), F.lit("inferred").alias("certainty"), "file_path", F.col("line").alias("start_line"))


def boundaries(idents: DataFrame, resolved: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundary nodes, IO edges): uses of global boundaries, or of names bound from boundary packages, inside callables. A node per name and run, with the type of its first use; an
    edge per callable and node."""
    kinds = F.create_map(*[F.lit(x) for kv in PACKAGES.items() for x in kv])
    names = F.concat(F.array("default_name", "namespace_name"), F.transform("named", lambda n: F.get(n, F.lit(1))))
    local = resolved.where((F.col("decl") == "import") & F.col("specifier").isin(*PACKAGES)).select("run_id", "file_path", kinds[F.col("specifier")].alias("bound"), F.explode(names).alias("name")).where("name is not null").dropDuplicates(["run_id", "file_path", "name"])
    known = F.create_map(*[F.lit(x) for kv in GLOBALS.items() for x in kv])
    u = idents.where("not is_import").join(local, ["run_id", "file_path", "name"], "left").withColumn("b", F.coalesce("bound", F.when(F.col("name").isin(*GLOBALS), known[F.col("name")]))).where("b is not null")
    u = materialize(owners(u.select("run_id", "file_path", "ord", "name", "off", "line", "b"), named), "boundary-uses")
    first = sequential(u.groupBy("run_id", "name").agg(F.min_by("b", "ord").alias("boundary_type"), F.min("ord").alias("ord")), "js-ts-boundary-", ["ord"])
    e = resolve.first_wins(u, ["run_id", "owner", "name"], [F.col("ord")]).join(first.select("run_id", "name", F.col("id").alias("target")), ["run_id", "name"])
    e = sequential(e, "js-ts-io-", ["ord"]).select("run_id", "ord", "id", F.col("owner").alias("source"), "target", F.lit("IO").alias("type"), F.lit("detected").alias("certainty"), "file_path", F.col("line").alias("start_line"))
    nodes = first.select("run_id", "id", F.lit("boundary").alias("kind"), "name", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("state_scope"), "boundary_type")
    return nodes, e


# --- entry points, surface, tests, dependencies


def next_entry_points(exports: DataFrame, flags: DataFrame) -> DataFrame:
    """Entry points by file conventions: (run_id, o, kind, file_path, symbol_name, certainty, start_line)."""
    stem = paths.strip_extension(paths.basename(F.col("file_path")))
    e = exports.withColumn("stem", stem)
    page, default = F.col("stem").isin("page", "layout"), F.col("is_default")
    kind = (
        F.when(page & default, F.lit("route")).when(page & F.col("name").isin("generateMetadata", "generateStaticParams"), F.lit("framework"))
        .when((F.col("stem") == "route") & F.col("name").isin(*HTTP_METHODS), F.lit("http-handler")).when((F.col("stem") == "middleware") & (default | (F.col("name") == "middleware")), F.lit("middleware"))
    )
    server = flags.where("use_server").select("run_id", "file_path").withColumn("srv", F.lit(True))
    e = e.join(server, ["run_id", "file_path"], "left").withColumn("kind", F.coalesce(kind, F.when(F.col("srv") & F.col("is_async"), F.lit("server-action"))))
    symbol = F.when(default, F.col("local_name")).otherwise(F.col("name"))
    return e.where("kind is not null").select("run_id", F.col("ord").alias("o"), "kind", "file_path", symbol.alias("symbol_name"), F.lit("detected").alias("certainty"), F.col("line").alias("start_line"))


def js_entry_points(declared: DataFrame, files: DataFrame, flags: DataFrame, relationships: DataFrame, framework: DataFrame) -> DataFrame:
    """Entry points in order: exports, main, module, bin, DOM bootstraps, framework; conventional index files only where there are none. A file is claimed once by the first three and
    bootstraps; bin entries don't ask. declared (run_id, field in exports/main/module/bin, o, target)."""
    base = paths.normalize(F.regexp_replace("target", r"\.(js|mjs|cjs|jsx|ts|tsx)$", ""))
    d = declared.withColumn("exact", paths.normalize(F.col("target"))).withColumn("_k", F.concat_ws("\u0001", "run_id", "field", "o"))
    tried = d.select("_k", "run_id", F.explode(F.concat(F.array("exact"), F.slice(js_candidates(base), 2, 4))).alias("path")).distinct()
    hit = tried.join(files.select("run_id", "path", "file_ord"), ["run_id", "path"]).groupBy("_k").agg(F.min_by("path", "file_ord").alias("file_path"))
    d = d.join(hit, "_k")
    rank = F.when(F.col("field") == "exports", 0).when(F.col("field") == "main", 1).when(F.col("field") == "module", 2).otherwise(3)
    d = d.select("run_id", rank.alias("r"), "o", F.when(F.col("field") == "bin", F.lit("cli")).otherwise(F.lit("library")).alias("kind"), "file_path", F.lit("detected").alias("certainty"))
    from .areas import contradictions

    none = F.lit(None).cast("string")
    other = framework.select("run_id", F.lit(5).alias("r"), "o", "kind", "file_path", "certainty", "symbol_name")
    seen = d.unionByName(other.drop("symbol_name"))
    why = contradictions(seen.select("run_id", F.col("o").alias("ord"), "file_path", "kind"), relationships, paths.is_js_test)
    boot = flags.where("renders_dom").join(files.select("run_id", F.col("path").alias("file_path"), F.col("file_ord").alias("fo")), ["run_id", "file_path"]).withColumn("root", paths.test_root(F.col("file_path")))
    boot = boot.where(~paths.is_js_test(F.col("file_path"))).join(why, ["run_id", "root"], "left").where("root = '' or why is not null")
    boot = boot.select("run_id", F.lit(4).alias("r"), F.col("fo").alias("o"), F.lit("bootstrap").alias("kind"), "file_path", F.lit("detected").alias("certainty"))
    claimed = resolve.first_wins(d.where("kind = 'library'").unionByName(boot), ["run_id", "file_path"], [F.col("r"), F.col("o")])
    bin_ = d.where("kind = 'cli'")
    # a bootstrap also yields to a bin entry's claim
    claimed = claimed.where("r < 4").unionByName(claimed.where("r = 4").join(bin_.select("run_id", "file_path").distinct(), ["run_id", "file_path"], "left_anti"))
    found = claimed.unionByName(bin_).withColumn("symbol_name", none).unionByName(other)
    order = F.array_position(F.array(*map(F.lit, CONVENTIONAL)), paths.strip_extension(F.col("path")))
    index = files.withColumn("c", order).where("c > 0").join(found.select("run_id").distinct(), "run_id", "left_anti")
    index = resolve.first_wins(index, ["run_id"], [F.col("c"), F.col("file_ord")]).select("run_id", F.lit(6).alias("r"), F.col("file_ord").alias("o"), F.lit("runtime").alias("kind"), F.col("path").alias("file_path"), F.lit("inferred").alias("certainty"), none.alias("symbol_name"))
    return _numbered_entries(found.unionByName(index), "js-ts-entry-")


def _numbered_entries(e: DataFrame, prefix: str) -> DataFrame:
    e = windows.numbered(e, ["run_id"], [F.col("r"), F.col("o"), F.col("file_path")], "ord", 1)
    return e.select("run_id", "ord", F.concat(F.lit(prefix), F.col("ord").cast("string")).alias("id"), "kind", "file_path", "symbol_name", "certainty")


def py_entry_points(scripts: DataFrame, surface: DataFrame, names: DataFrame, files: DataFrame, relationships: DataFrame) -> DataFrame:
    """Console scripts, __main__ modules, guarded modules, the package of the project's name; main.py or src/main.py only where there are none. A file is claimed once, by the
    first of these; what lies in a test suite is no __main__ or guarded module. scripts (run_id, o, target), names (run_id, name)."""
    from .areas import contradictions

    none = F.lit(None).cast("string")
    module, symbol = F.split("target", ":")[0], F.get(F.split("target", ":"), F.lit(1))
    stem = F.replace(module, F.lit("."), F.lit("/"))
    cand = F.array(*[F.concat_ws("\u0001", F.col("run_id"), F.concat(F.lit(r), stem, F.lit(x))) for r in ("src/", "") for x in (".py", "/__init__.py")])
    s = scripts.withColumn("_k", F.concat_ws("\u0001", "run_id", "o"))
    s = resolve.candidate_join(s, cand, files.select(F.concat_ws("\u0001", "run_id", "path").alias("path")), "path", ["_k"]).where("hit is not null")
    s = s.withColumn("hit", F.substring_index("hit", "\u0001", -1)).select("run_id", F.lit(0).alias("r"), "o", F.lit("cli").alias("kind"), F.col("hit").alias("file_path"), F.lit("detected").alias("certainty"), symbol.alias("symbol_name"))
    main = files.where(paths.basename(F.col("path")) == "__main__.py").select("run_id", F.lit(1).alias("r"), F.col("file_ord").alias("o"), F.lit("cli").alias("kind"), F.col("path").alias("file_path"), F.lit("detected").alias("certainty"), none.alias("symbol_name"))
    guard = surface.where("has_main_guard").select("run_id", F.lit(2).alias("r"), F.col("file_ord").alias("o"), F.lit("bootstrap").alias("kind"), "file_path", F.lit("detected").alias("certainty"), none.alias("symbol_name"))
    pack = names.withColumn("p", F.replace("name", F.lit("-"), F.lit("_"))).select("run_id", F.explode(F.array(F.concat(F.lit("src/"), "p", F.lit("/__init__.py")), F.concat("p", F.lit("/__init__.py")))).alias("path"))
    lib = files.join(pack, ["run_id", "path"], "left_semi").select("run_id", F.lit(3).alias("r"), F.col("file_ord").alias("o"), F.lit("library").alias("kind"), F.col("path").alias("file_path"), F.lit("detected").alias("certainty"), none.alias("symbol_name"))
    why = contradictions(s.select("run_id", F.col("o").alias("ord"), "file_path", "kind"), relationships, paths.is_py_test)
    suite = main.unionByName(guard).withColumn("root", paths.test_root(F.col("file_path"))).join(why, ["run_id", "root"], "left")
    suite = suite.where(~paths.is_py_test(F.col("file_path"))).where("root = '' or why is not null").drop("root", "why")
    found = resolve.first_wins(s.unionByName(suite).unionByName(lib), ["run_id", "file_path"], [F.col("r"), F.col("o")])
    index = files.where(F.col("path").isin("main.py", "src/main.py")).join(found.select("run_id").distinct(), "run_id", "left_anti")
    index = resolve.first_wins(index, ["run_id"], [F.length("path")]).select("run_id", F.lit(4).alias("r"), F.col("file_ord").alias("o"), F.lit("runtime").alias("kind"), F.col("path").alias("file_path"), F.lit("inferred").alias("certainty"), none.alias("symbol_name"))
    return _numbered_entries(found.unionByName(index), "python-entry-")


def js_surface(entries: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """Exported names of library and runtime entries, with the file that declares each; re-exports are followed until they lead to nothing new."""
    e = js_resolved(exports.withColumnRenamed("from_specifier", "specifier").withColumn("decl", F.lit("export")), files).select("run_id", "file_path", "name", "local_name", "is_star", "target", "line", "ord")
    e = materialize(e, "exports")
    level = entries.where(F.col("kind").isin("library", "runtime")).select("run_id", F.col("file_path").alias("entry"), F.col("file_path").alias("at"), F.lit(None).cast("string").alias("want"), F.lit(None).cast("string").alias("shown"))
    out = seen = None
    while True:
        j = level.join(e.withColumnRenamed("file_path", "at"), ["run_id", "at"]).where(F.col("want").isNull() | F.col("is_star") | (F.col("name") == F.col("want")))
        j = materialize(j.withColumn("shown", F.coalesce("shown", F.when(~F.col("is_star"), F.col("name")))), "surface")
        here = j.where("target is null and not is_star").select("run_id", "entry", F.col("shown").alias("name"), F.col("at").alias("file_path"), "line", "ord")
        out = here if out is None else out.unionByName(here)
        level = j.where("target is not null").select("run_id", "entry", F.col("target").alias("at"), F.when(F.col("is_star"), F.col("want")).otherwise(F.col("local_name")).alias("want"), "shown").distinct()
        if seen is not None:  # files that export each other's names lead back to what was asked already
            same = [level[c].eqNullSafe(seen[c]) for c in level.columns]
            level = level.join(seen, same, "left_anti")
        level = materialize(level, "surface-level")
        if not level.take(1):
            break
        seen = level if seen is None else seen.unionByName(level)
    c = resolve.first_wins(out, ["run_id", "entry", "name", "file_path"], [F.col("ord")])
    return windows.numbered(c, ["run_id"], [F.col("entry"), F.col("file_path"), F.col("ord")], "n").select("run_id", F.col("n").alias("ord"), F.concat(F.lit("js-ts-export-"), F.col("n").cast("string")).alias("id"), F.col("entry").alias("area_id"), "name", F.lit("export").alias("kind"), "file_path", F.col("name").alias("symbol_name"), F.col("line").alias("start_line"))


def py_surface(entries: DataFrame, surface: DataFrame) -> DataFrame:
    """Names of library entries: __all__ where it is a list (detected), else definitions and imported names (inferred), each once."""
    s = surface.join(entries.where("kind = 'library'").select("run_id", "file_path").distinct(), ["run_id", "file_path"])
    names = F.when(F.col("has_all"), F.col("all_names")).otherwise(F.concat("defs", "from_names"))
    n = s.select("run_id", "file_path", "has_all", F.posexplode(names).alias("p", "x")).select("run_id", "file_path", "has_all", "p", F.col("x")[0].alias("name"), F.col("x")[1].cast("int").alias("start_line"))
    n = resolve.first_wins(n, ["run_id", "file_path", "name"], [F.col("p")])
    n = windows.numbered(n, ["run_id"], [F.col("file_path"), F.col("p")], "ord")
    return n.select("run_id", "ord", F.concat(F.lit("python-export-"), F.col("ord").cast("string")).alias("id"), F.col("file_path").alias("area_id"), "name", F.lit("export").alias("kind"), "file_path", F.col("name").alias("symbol_name"), "start_line", F.when(F.col("has_all"), F.lit("detected")).otherwise(F.lit("inferred")).alias("certainty"))


def js_tests(files: DataFrame, resolved: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(test relationships, at most one per test; gaps): the first relative import of an implementation that is no package entry, the mirrored directory, the first implementation
    import at all, a file of the same base name."""
    f = files.select("run_id", "path", "file_ord").withColumn("t", paths.is_js_test(F.col("path")))
    tests, impl = f.where("t").select("run_id", F.col("path").alias("test_path"), F.col("file_ord").alias("ord")), f.where("not t").select("run_id", "path", "file_ord")
    i = resolved.where(paths.is_relative(F.col("specifier")) & F.col("target").isNotNull()).select("run_id", F.col("file_path").alias("test_path"), F.col("target").alias("path"), F.col("ord").alias("o"))
    i = i.join(impl.select("run_id", "path"), ["run_id", "path"], "left_semi").join(tests.select("run_id", "test_path"), ["run_id", "test_path"], "left_semi")
    first = lambda d: d.groupBy("run_id", "test_path").agg(F.min_by("path", "o").alias("hit"))
    direct = first(i.join(entries.select("run_id", F.col("file_path").alias("path")).distinct(), ["run_id", "path"], "left_anti"))
    bare = lambda c: F.regexp_replace(paths.strip_extension(c), r"\.(test|spec)$", "")
    inner = F.regexp_replace(bare(F.col("test_path")), "^(test|tests)/", "")
    mirror = tests.where(F.col("test_path").rlike("^(test|tests)/")).select("run_id", "test_path", F.explode(F.array(F.concat(F.lit("lib/"), inner), F.concat(F.lit("src/"), inner), inner)).alias("stem"))
    mirror = mirror.join(impl.withColumn("stem", paths.strip_extension(F.col("path"))), ["run_id", "stem"]).groupBy("run_id", "test_path").agg(F.min_by("path", "file_ord").alias("hit"))
    same = tests.withColumn("b", bare(paths.basename(F.col("test_path")))).join(impl.withColumn("b", paths.strip_extension(paths.basename(F.col("path")))), ["run_id", "b"]).groupBy("run_id", "test_path").agg(F.min_by("path", "file_ord").alias("hit"))
    c = resolve.priority_cascade(tests, ["run_id", "test_path"], [("import", direct), ("mirror", mirror), ("any-import", first(i)), ("name", same)], "hit")
    return _test_rows(c, "js-ts-test-")


def _test_rows(c: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    found = c.where("hit is not null")
    certainty = F.when(F.col("how").isin("import", "any-import"), F.lit("detected")).otherwise(F.lit("inferred"))
    r = windows.numbered(found.withColumnRenamed("ord", "o"), ["run_id"], [F.col("o")], "ord").select("run_id", "ord", F.concat(F.lit(prefix), F.col("ord").cast("string")).alias("id"), "test_path", F.col("hit").alias("implementation_path"), certainty.alias("certainty"), F.concat(F.lit("matched by "), "how").alias("why"))
    gaps = c.where("hit is null").select("run_id", F.lit("unknown").alias("certainty"), F.concat(F.lit("no implementation found for test '"), "test_path", F.lit("'")).alias("description"), F.col("test_path").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    return r, gaps


def py_tests(files: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(test relationships; gaps): the first implementation a test imports, else the file that its name is for."""
    f = files.select("run_id", "path", "file_ord").withColumn("t", paths.is_py_test(F.col("path")))
    tests, impl = f.where("t").select("run_id", F.col("path").alias("test_path"), F.col("file_ord").alias("ord")), f.where("not t").select("run_id", "path", "file_ord")
    i = relationships.select("run_id", F.col("from_id").alias("test_path"), F.col("to_id").alias("path"), "ord").join(impl.select("run_id", "path"), ["run_id", "path"], "left_semi")
    direct = i.groupBy("run_id", "test_path").agg(F.min_by("path", "ord").alias("hit"))
    subject = F.regexp_replace(paths.basename(F.col("test_path")), r"^test_|_test(?=\.py$)", "")
    named = tests.withColumn("b", subject).join(impl.withColumn("b", paths.basename(F.col("path"))), ["run_id", "b"]).groupBy("run_id", "test_path").agg(F.min_by("path", "file_ord").alias("hit"))
    return _test_rows(resolve.priority_cascade(tests, ["run_id", "test_path"], [("import", direct), ("name", named)], "hit"), "python-test-")


def external_dependencies(declared: DataFrame, references: DataFrame, normalize, project: str, registry: str) -> DataFrame:
    """Declared dependencies (run_id, o, name, version, scope; the first of a name wins) with the references (run_id, o, name, file_path, line) to them as evidence; unreferenced ones
    of PyPI have a gap."""
    d = resolve.first_wins(declared.withColumn("key", normalize(F.col("name"))), ["run_id", "key"], [F.col("o")])
    one = F.struct(F.col("o").alias("o"), F.lit("import-reference").alias("kind"), F.struct("file_path", F.col("line").alias("start_line")).alias("location"))
    e = references.withColumn("key", normalize(F.col("name"))).groupBy("run_id", "key").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("o")).alias("evidence"))
    j = windows.numbered(d.join(e, ["run_id", "key"], "left"), ["run_id"], [F.col("o")], "ord")
    none = F.array().cast("array<struct<kind:string,location:struct<file_path:string,start_line:int>>>")
    gap = F.when(F.col("evidence").isNull() & F.lit(registry == "pypi"), F.lit("no import of this dependency was found"))
    return j.select("run_id", "ord", F.concat(F.lit(f"{project}-external-dep-"), F.col("ord").cast("string")).alias("id"), F.lit(project).alias("project_id"), "name", F.col("version").alias("declared_version"), "scope", F.lit(registry).alias("registry"), F.coalesce("evidence", none).alias("evidence"), gap.alias("gap"))


def js_kind(has_boot: Column, has_entry_fields: Column, framework: Column, has_components: Column, has_manifest: Column) -> Column:
    """application, library or unknown, by what was found, in order."""
    return (
        F.when(has_boot, F.lit("application")).when(~has_manifest, F.lit("unknown")).when(has_entry_fields & framework.isNotNull(), F.lit("application"))
        .when(has_entry_fields & has_components, F.lit("application")).when(has_entry_fields, F.lit("library")).otherwise(F.lit("application"))
    )


def py_kind(has_boot: Column, has_library: Column) -> Column:
    return F.when(has_boot, F.lit("application")).when(has_library, F.lit("library")).otherwise(F.lit("unknown"))
