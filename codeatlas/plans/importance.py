"""Function importance: six dimensions, a weighted score, roles and reasons.

callables (run_id, ord, id, name, file_path); edges (run_id, ord, source, target, type); nodes (run_id, id, kind, state_scope, boundary_type);
entries (run_id, ord, file_path, symbol_name, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..session import materialize
from . import graph

# Fixed values.
WEIGHTS = {"reachability": 0.2, "orchestration": 0.2, "data_influence": 0.15, "state_authority": 0.15, "boundary_influence": 0.15, "structural_centrality": 0.15}
SIGNAL, MOST_REASONS = 60, 3


def _topped(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the largest value of each column in its run as top_<column>: an aggregate and a join, as a run may hold most rows."""
    tops = df.groupBy("run_id").agg(*[F.max(c).alias(f"top_{c}") for c in columns])
    return df.join(tops, "run_id")


def _unit(c: str) -> Column:
    top = F.col(f"top_{c}")
    return F.when(top > 0, F.col(c) / top).otherwise(F.lit(0.0))


def _scale(c: str) -> Column:
    top = F.col(f"top_{c}")
    return F.when(top > 0, round_half_up(F.col(c) / top * 100)).otherwise(F.lit(0)).cast("int")


def matched_entries(callables: DataFrame, entries: DataFrame) -> DataFrame:
    """(run_id, id, kinds array): entry points whose symbol names exactly one callable of their file, kinds in order."""
    one = callables.groupBy("run_id", "file_path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    e = entries.where("symbol_name is not null").select("run_id", "ord", "file_path", "symbol_name", "kind").join(one.withColumnRenamed("name", "symbol_name"), ["run_id", "file_path", "symbol_name"])
    return e.groupBy("run_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda x: x["kind"]).alias("kinds"))


def _first_of(df: DataFrame, by: list[str], order: str, *columns: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: x.dropFields(order))


def measure(callables: DataFrame, edges: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """A row per callable with raw signals and what reasons need."""
    c = callables.select("run_id", "ord", "id", "name", "file_path")
    kinds = matched_entries(c, entries)
    fn = c.select("run_id", F.col("id").alias("node"), F.col("file_path").alias("node_file"))
    nd = nodes.select("run_id", F.col("id").alias("node"), "kind", "state_scope", "boundary_type")
    every = c.select("run_id", "id").unionByName(nodes.select("run_id", "id"))
    rank = graph.pagerank(every, edges, kinds.select("run_id", "id")).withColumnRenamed("node", "id")
    reached = graph.decayed(graph.reach(edges, c)).select("run_id", F.col("src").alias("id"), F.col("dst").alias("node"), "weight")
    reached = reached.join(fn, ["run_id", "node"], "left").join(nd.select("run_id", "node", "kind"), ["run_id", "node"], "left")
    r = reached.groupBy("run_id", "id").agg(
        F.sum("weight").alias("reach_raw"), F.count("node_file").alias("reachable_functions"), F.count_distinct("node_file").alias("reachable_modules"),
        F.sum(F.when(F.col("node_file").isNull() & (F.col("kind") == "boundary"), F.col("weight")).otherwise(0.0)).alias("reach_boundary"),
    )
    out = edges.select("run_id", "ord", F.col("source").alias("id"), F.col("target").alias("node"), "type").join(c.select("run_id", "id", "file_path"), ["run_id", "id"])
    out = out.join(fn, ["run_id", "node"], "left").join(nd, ["run_id", "node"], "left")
    is_ = lambda t: F.col("type") == t
    scope = F.coalesce("state_scope", F.lit("local"))
    touch = F.when(is_("STATE_WRITE"), 1.0).when(is_("STATE_READ"), 0.35).otherwise(0.0) * F.when(scope == "shared", 1.6).otherwise(1.0)
    o = out.groupBy("run_id", "id").agg(
        F.count_distinct(F.when(F.col("node_file") != F.col("file_path"), F.col("node_file"))).alias("modules_called"), F.count_distinct("type").alias("edge_types"),
        F.count_if(is_("STATE_WRITE")).alias("writes"), F.count_if(is_("IO")).alias("io"), F.sum(touch).alias("state_raw"),
        F.transform(F.array_sort(F.collect_list(F.when(is_("STATE_WRITE"), F.struct("ord", F.col("node").alias("state_id"), scope.alias("state_scope"))))), lambda x: x.dropFields("ord")).alias("written"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(is_("IO") & F.col("boundary_type").isNotNull(), F.struct("ord", "boundary_type")))), lambda x: x["boundary_type"])).alias("boundaries"),
        F.bool_or(is_("EVENT")).alias("event_source"),
    )
    flow = edges.where("type = 'DATA_FLOW'").select("run_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("flows"))
    handled = edges.where("type = 'EVENT'").groupBy("run_id", F.col("target").alias("id")).agg(F.lit(True).alias("event_target"))
    calls = edges.where("type = 'CALL'")
    fans = graph.degrees(c, calls).select("run_id", F.col("node").alias("id"), "fan_in", "fan_out")
    ends = calls.select("run_id", F.col("source").alias("id"), F.col("target").alias("node")).unionByName(calls.select("run_id", F.col("target").alias("id"), F.col("source").alias("node")))
    across = ends.distinct().join(c.select("run_id", "id", "file_path"), ["run_id", "id"]).join(fn, ["run_id", "node"], "left")
    across = across.where("node_file is null or node_file <> file_path").groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("across"))
    m = c
    for part in (rank, r, o, flow, handled, fans, across, kinds):
        m = m.join(part, ["run_id", "id"], "left")
    zero = {k: 0 for k in ("rank", "reach_raw", "reachable_functions", "reachable_modules", "reach_boundary", "modules_called", "edge_types", "writes", "io", "state_raw", "flows", "fan_in", "fan_out", "across")}
    m = m.fillna(zero).fillna(False, ["event_source", "event_target"])
    m = m.withColumn("orchestration_raw", F.col("modules_called") + F.col("edge_types")).withColumn("data_raw", F.col("flows") + F.col("writes") + F.col("io"))
    m = m.withColumn("boundary_raw", F.col("io") + F.col("reach_boundary"))
    m = _topped(m, ["fan_in", "fan_out", "across", "rank"])
    m = m.withColumn("central_raw", _unit("fan_in") + _unit("fan_out") + _unit("across") + _unit("rank"))
    return materialize(m.drop("top_fan_in", "top_fan_out", "top_across", "top_rank"), "importance")


def score(m: DataFrame) -> DataFrame:
    """(run_id, ord, function_id, score, the six dimensions, roles, reasons) of measure()'s rows."""
    raw = {"reachability": "reach_raw", "orchestration": "orchestration_raw", "data_influence": "data_raw", "state_authority": "state_raw", "boundary_influence": "boundary_raw", "structural_centrality": "central_raw"}
    s = _topped(m, list(raw.values()))
    for name, column in raw.items():
        s = s.withColumn(name, _scale(column))
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    fires = lambda name: F.col(name) >= SIGNAL
    empty = F.array().cast("array<string>")
    kinds, bounds = F.coalesce("kinds", empty), F.coalesce("boundaries", empty)
    roles = F.array(
        F.when(F.size(kinds) > 0, F.lit("ENTRY_POINT")), F.when(fires("orchestration"), F.lit("ORCHESTRATOR")), F.when(fires("state_authority") | (F.col("writes") > 0), F.lit("STATE_CONTROLLER")),
        F.when(fires("data_influence"), F.lit("DATA_TRANSFORMER")), F.when(fires("boundary_influence") | (F.size(bounds) > 0), F.lit("BOUNDARY")),
        F.when(F.col("event_target"), F.lit("EVENT_HANDLER")), F.when(F.col("event_source"), F.lit("RENDERER")),
    )
    roles = F.filter(roles, lambda x: x.isNotNull())
    roles = F.when((F.size(roles) == 0) & (F.col("fan_in") > 0), F.array(F.lit("UTILITY"))).otherwise(roles)
    fields = ("type", "reachable_functions", "reachable_modules", "module_count", "boundary_type", "state_id", "state_scope", "entry_point_kind", "fan_in", "fan_out")
    types = dict.fromkeys(("reachable_functions", "reachable_modules", "module_count", "fan_in", "fan_out"), "bigint")

    def reason(kind: str, **values: Column) -> Column:
        return F.struct(*[(F.lit(kind) if f == "type" else values.get(f, F.lit(None))).cast(types.get(f, "string")).alias(f) for f in fields])

    some = lambda array: F.slice(array, 1, MOST_REASONS)
    none = F.array().cast("array<struct<" + ",".join(f"{f}:{types.get(f, 'string')}" for f in fields) + ">>")
    one = lambda when, r: F.when(when, F.array(r)).otherwise(none)
    written = F.coalesce("written", F.array().cast(m.schema["written"].dataType))
    reasons = F.concat(
        one(fires("reachability"), reason("HIGH_REACHABILITY", reachable_functions=F.col("reachable_functions"), reachable_modules=F.col("reachable_modules"))),
        one(fires("orchestration") & (F.col("modules_called") > 0), reason("ORCHESTRATES_MODULES", module_count=F.col("modules_called"))),
        F.transform(some(bounds), lambda b: reason("CROSSES_BOUNDARY", boundary_type=b)),
        F.transform(some(written), lambda w: reason("MUTATES_STATE", state_id=w["state_id"], state_scope=w["state_scope"])),
        F.transform(some(kinds), lambda k: reason("ENTRY_POINT", entry_point_kind=k)),
        one(fires("structural_centrality"), reason("STRUCTURAL_HUB", fan_in=F.col("fan_in"), fan_out=F.col("fan_out"))),
    )
    return s.select("run_id", "ord", F.col("id").alias("function_id"), round_half_up(total).cast("int").alias("score"), *raw, roles.alias("roles"), reasons.alias("reasons"))


def function_importance(callables: DataFrame, edges: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    return score(measure(callables, edges, nodes, entries))


# Boundaries in words.
BOUNDARY_LABELS = {
    "http": "an HTTP boundary",
    "database": "a database",
    "filesystem": "the filesystem",
    "browser-storage": "browser storage",
    "external-sdk": "an external SDK",
    "other": "an external boundary",
}


def describe(reason: Column, state_name: Column | None = None) -> Column:
    """A reason in words; state_name is the name of the state in reason.state_id, null where it isn't known."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    label = F.create_map(*[F.lit(x) for kv in BOUNDARY_LABELS.items() for x in kv])[reason["boundary_type"]]
    scope = F.when(reason["state_scope"] == "shared", "shared").otherwise("local")
    named = F.lit(None).cast("string") if state_name is None else state_name
    return (
        F.when(reason["type"] == "HIGH_REACHABILITY", text("Reachable from ", reason["reachable_functions"], " function(s) across ", reason["reachable_modules"], " module(s)."))
        .when(reason["type"] == "ORCHESTRATES_MODULES", text("Coordinates ", reason["module_count"], " other module(s) directly."))
        .when(reason["type"] == "CROSSES_BOUNDARY", text("Crosses ", label, "."))
        .when(reason["type"] == "MUTATES_STATE", text("Writes ", scope, " state", F.coalesce(F.concat(F.lit(" '"), named, F.lit("'")), F.lit("")), "."))
        .when(reason["type"] == "ENTRY_POINT", text("Reached directly as a ", F.replace(reason["entry_point_kind"], F.lit("-"), F.lit(" ")), " entry point."))
        .when(reason["type"] == "STRUCTURAL_HUB", text("Structural hub: ", reason["fan_in"], " caller(s), ", reason["fan_out"], " callee(s)."))
    )


def described(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, function_id, nth, text) of the reasons of function_importance(), with the names of states. nodes (run_id, id, name)."""
    r = scores.select("run_id", "function_id", F.posexplode("reasons").alias("nth", "reason"))
    states = nodes.select("run_id", F.col("id").alias("_state"), F.col("name").alias("_name"))
    r = r.join(states, (r.run_id == states.run_id) & (F.col("reason.state_id") == F.col("_state")), "left").drop(states.run_id)
    return r.select("run_id", "function_id", "nth", describe(F.col("reason"), F.col("_name")).alias("text"))
