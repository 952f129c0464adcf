"""Operators of the library over the driver's tables, each with an independent SQL form in queries_sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import categories, paths, text
from .operators import ranking, resolve, windows
from .plans import graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query
def history_islands(spark, d):
    """Runs of a user's events of one day and type, newest first: size, lead event and kind."""
    e = _events(spark, d)
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    i = windows.islands(e, ["user_id"], order, F.concat("day", F.lit("::"), "event_type"))
    return i.groupBy("user_id", "island").agg(
        F.concat(F.first("day"), F.lit("::"), F.first("event_type")).alias("group_key"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("lead_id"),
    ).select("user_id", F.col("island").cast("long").alias("island"), "group_key", "n", "lead_id")


@query
def islands_hot_key(spark, d):
    """Runs of all events of one type, in order of time, all events being one partition: number, size and first event."""
    i = windows.islands_split(table(spark, d, "events"), [], [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return i.groupBy(F.col("island").cast("long").alias("island")).agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@query
def numbered_global(spark, d):
    """Line items numbered without gaps over the whole table, by date and key."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return windows.numbered_global(l, order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ord")


@query
def numbered_runs(spark, d):
    """Events numbered within their type, a handful of keys that hold all rows."""
    e = table(spark, d, "events").select("event_type", "event_id", "ts")
    return windows.numbered_split(e, ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "event_type", "ord")


@query
def primary_mode(spark, d):
    """The most frequent event type per user and day; the first seen wins ties."""
    return windows.mode_first_seen(_events(spark, d), ["user_id", "day"], "event_type", "event_id")


@query
def kind_priority(spark, d):
    """The highest-ranking event type per user and day."""
    return windows.by_priority(_events(spark, d), ["user_id", "day"], "event_type", ["purchase", "signup", "click", "view", "error"])


@query
def latest_per_key(spark, d):
    """The newest event of each user with a field of its JSON properties."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "props")
    r = resolve.latest_per_key(e, ["user_id"], "ts", "event_id")
    return r.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query
def language_shares(spark, d):
    """Shares of languages, grouped by analyzer, of a tenth or more."""
    t = table(spark, d, "documents")
    total = t.agg(F.sum("n_chars").alias("total"))
    group = F.when(F.col("lang").isin("en", "de"), F.lit("germanic")).when(F.col("lang").isin("es", "fr"), F.lit("romance"))
    g = t.withColumn("analyzer", group).where("analyzer is not null").groupBy("analyzer").agg(F.sum("n_chars").cast("long").alias("n"))
    g = g.join(F.broadcast(total))  # one row
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0))
    return g.select("analyzer", "n", F.round(share, 6).alias("share")).where("share >= 0.1")


@query
def top_language_message(spark, d):
    """The largest language and its rounded share, as a sentence."""
    g = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").cast("long").alias("n"))
    t = g.agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("n"), F.sum("n").alias("total"))
    pct = text.round_half_up(F.col("n") * 100 / F.col("total")).cast("long")
    return t.select(F.concat(F.lit("No analyzer for "), "lang", F.lit(" ("), pct.cast("string"), F.lit("% of the text)")).alias("message"))


@query
def insert_or_get(spark, d):
    """Rows of a later batch are added only where their key is new; existing rows are never changed."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice")
    old = resolve.first_wins(o.where("y < 1997"), ["k"], [F.col("o_orderkey")]).select("k", "o_orderkey", F.lit("old").alias("origin"))
    new = resolve.first_wins(o.where("y >= 1997"), ["k"], [F.col("o_orderkey")]).select("k", "o_orderkey", F.lit("new").alias("origin"))
    return old.unionByName(resolve.without(new, old, ["k"]))


@query
def upsert_last(spark, d):
    """Rows of a later batch replace those with their key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return resolve.last_wins(o.withColumn("v", F.struct("y", "o_orderkey")).select("k", "o_orderkey", "o_orderpriority", "v"), ["k"], "v").select("k", "o_orderkey", "o_orderpriority")


@query
def case_insensitive_canonical(spark, d):
    """Of spellings that differ in case: the exact one first, then one with runs, then the smallest id."""
    p = table(spark, d, "part")
    variant = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.initcap("p_name")).otherwise(F.col("p_name"))
    v = p.select("p_partkey", variant.alias("spelling"), F.lower("p_name").alias("low"), (F.col("p_size") > 25).cast("int").alias("has_runs"))
    best = v.groupBy("low").agg(F.max_by(F.struct("p_partkey", "spelling"), F.struct((F.col("spelling") == F.col("low")).alias("e"), "has_runs", (-F.col("p_partkey")).alias("i"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select("low", F.col("b.p_partkey").alias("id"), F.col("b.spelling").alias("spelling"), "n")


@query
def cooldown_claims(spark, d):
    """Requests granted under a 60-minute cooldown per user, counted from the last granted one."""
    c = windows.cooldown(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3600)
    return c.select("user_id", "event_id", "granted")


@query
def remaining_seconds(spark, d):
    """Seconds until each user's next request, one hour after the last event, at a fixed time."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    left = F.unix_micros(F.col("last").cast("timestamp")) + 3_600_000_000 - F.unix_micros(F.lit("2024-01-30 23:00:00").cast("timestamp_ntz").cast("timestamp"))
    return e.select("user_id", F.greatest(F.lit(0), F.ceil(left / 1_000_000)).cast("long").alias("remaining"))


@query
def stale_runs(spark, d):
    """Orders older than a day at a fixed time, per status."""
    o = table(spark, d, "orders")
    old = text.is_stale(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return o.groupBy("o_orderstatus").agg(F.count_if(old).alias("stale"), F.count(F.lit(1)).alias("n"))


def _page_paths(spark, d):
    p = table(spark, d, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return p.select("page_id", F.regexp_replace(bare, "/+$", "").alias("path"), "url")


@query
def path_prefix_area(spark, d):
    """Each page's area: the longest directory prefix that three pages or more share."""
    p = _page_paths(spark, d)
    areas = p.select(F.explode(resolve.path_prefixes(F.col("path"))).alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    areas = areas.select("area").unionByName(spark.range(1).select(F.lit(".").alias("area"))).withColumn("o", F.lit(0))
    j = resolve.longest_prefix(p.select("page_id", "path"), "path", areas, "area", "o", ["page_id", "path"])
    return j.select("page_id", F.col("area_area").alias("area"))


@query
def alias_match(spark, d):
    """The first alias, longer patterns first, that is a prefix of a part's name."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    rules = spark.createDataFrame([("small g", True, 1), ("small", True, 2), ("red", True, 3), ("blue bolt", False, 0), ("blue", True, 4)], "pattern string, is_prefix boolean, rank int")
    m = resolve.first_rule(p, "p_name", rules, "pattern", "is_prefix", "rank", ["p_partkey"])
    return m.select("p_partkey", F.col("rule_pattern").alias("pattern"))


@query
def candidate_resolution(spark, d):
    """For each page's parent, the first of several spellings that is itself a page."""
    p = _page_paths(spark, d)
    parent = paths.strip_extension(F.col("path"))
    cand = F.array(F.concat(parent, F.lit(".html")), parent, F.concat(parent, F.lit("/index")), paths.dirname(F.col("path")))
    r = resolve.candidate_join(p.select("page_id", "path"), cand, p, "path", ["page_id"])
    return r.select("page_id", "hit", F.col("hit_rank").cast("long").alias("hit_rank"))


@query
def link_extract(spark, d):
    """Every link of every page with its place."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query
def import_classify(spark, d):
    """Links by kind: absolute path, relative, alias-like or external."""
    link = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")
    h = F.col("href")
    kind = F.when(paths.is_relative(h), F.lit("relative")).when(paths.looks_like_alias(h), F.lit("alias")).when(h.startswith("/"), F.lit("absolute")).otherwise(F.lit("external"))
    return table(spark, d, "pages").select("page_id", link).groupBy("page_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def unique_name_join(spark, d):
    """A part's name within its brand if it is unique there; if absent from the brand (never here), the type's; ambiguity vetoes."""
    p = table(spark, d, "part")
    asked = p.select("p_brand", "p_type", "p_name").distinct()
    local = resolve.unique_join(asked, p.select("p_brand", "p_name", "p_partkey"), ["p_brand", "p_name"], "p_partkey", "local")
    both = resolve.unique_join(local, p.select("p_type", "p_name", "p_partkey"), ["p_type", "p_name"], "p_partkey", "wide")
    return both.select("p_brand", "p_type", "p_name", resolve.with_veto("local", "local_n", F.col("wide")).alias("partkey"), "local_n")


@query
def priority_cascade(spark, d):
    """A supplier for each customer: in the same nation, else in the region, else none."""
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    s = s.where("s_acctbal > 2000").join(n, s.s_nationkey == n.n_nationkey)
    nation = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("supp"))
    region = s.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("supp"))
    c = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_nationkey", "n_regionkey")
    near = c.join(nation, c.c_nationkey == nation.s_nationkey).select("c_custkey", "supp")
    far = c.join(region, "n_regionkey").select("c_custkey", "supp")
    return resolve.priority_cascade(c.select("c_custkey"), ["c_custkey"], [("nation", near), ("region", far)], "supp").select("c_custkey", "supp", "how")


@query
def unmatched_gaps(spark, d):
    """Customers without an urgent order, as gap rows."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    urgent = o.where("o_orderpriority like '1-%'").select(F.col("o_custkey").alias("k"))
    gone = resolve.without(c.select(F.col("c_custkey").alias("k"), "c_name"), urgent, ["k"])
    return gone.select("k", F.lit("unknown").alias("certainty"), F.concat(F.lit("no urgent order of "), "c_name").alias("description"))


@query
def external_deps_scope(spark, d):
    """The first scope in which a part was bought: sections in order, the first wins."""
    l = table(spark, d, "lineitem")
    scope = F.when(F.col("l_returnflag") == "N", F.lit(0)).when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(2))
    label = F.element_at(F.array(F.lit("direct"), F.lit("dev"), F.lit("peer")), F.col("s") + 1)
    g = l.withColumn("s", scope).groupBy("l_partkey").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("uses"))
    return g.select("l_partkey", label.alias("scope"), "uses")


@query
def normalized_name_join(spark, d):
    """Nations by normalised name against customers' segments and names joined by number."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    left = n.select(paths.python_name(F.col("n_name")).alias("k"), "n_name")
    right = s.select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("k"), "s_suppkey")
    return left.join(right, "k", "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query
def dependency_category(spark, d):
    """Names of parts, read as packages, by category."""
    p = table(spark, d, "part")
    names = F.array(*[F.lit(x) for x in ("jest-", "vue-", "react", "eslint-", "redis", "types-", "chart ", "")])
    name = F.concat(F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")), F.when(F.col("p_partkey") % 8 == 2, F.lit("")).when(F.col("p_partkey") % 8 == 4, F.lit("")).when(F.col("p_partkey") % 8 == 1, F.lit("cli")).otherwise(F.col("p_name")))
    q = p.select(name.alias("package"), categories.dependency_category(name, F.col("p_name")).alias("category"))
    return q.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("package").alias("first_package"))


@query
def area_links(spark, d):
    """Distinct links between nations of customers and of suppliers through line items, with how many carry each."""
    l, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = l.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("from_id"), F.col("s_nationkey").alias("to_id")).agg(F.count(F.lit(1)).alias("n"))


@query
def area_rank(spark, d):
    """Nations by number of linked nations, orders and name."""
    links = area_links(spark, d)
    both = links.select(F.col("from_id").alias("k"), F.col("to_id").alias("x")).unionByName(links.select(F.col("to_id").alias("k"), F.col("from_id").alias("x")))
    linked = both.groupBy("k").agg(F.count_distinct("x").alias("links"))
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    orders = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    r = n.select(F.col("n_nationkey").alias("k"), "n_name").join(linked, "k", "left").join(orders, "k", "left").fillna(0, ["links", "orders"]).withColumn("np", F.col("k") % 5 == 0)
    w = Window.partitionBy(F.lit(0)).orderBy(*ranking.area_order("np", "links", "orders", "n_name", collate=False))  # a row per nation
    return r.select("n_name", "links", "orders", F.row_number().over(w).cast("long").alias("place"))


@query
def production_filter(spark, d):
    """Parts of brands that nothing contradicts: neither a returned line item nor a costly part (the first reason is kept)."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    j = l.join(p, l.l_partkey == p.p_partkey)
    first = j.where("l_quantity >= 50 and l_returnflag = 'R' and l_discount > 0.095").select("p_brand", F.col("l_orderkey").alias("ord"), F.concat(F.lit("returned in order "), F.col("l_orderkey").cast("string")).alias("why"))
    second = p.where("p_size >= 50 and p_retailprice > 1500").select("p_brand", F.col("p_partkey").alias("ord"), F.concat(F.lit("holds part "), F.col("p_partkey").cast("string")).alias("why"))
    _, why = resolve.uncontradicted(p.select("p_brand", "p_partkey"), "p_brand", first, second)
    brands = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return brands.join(why, "p_brand", "left").select("p_brand", "n", "why")


def _transitions(spark, d):
    """user -> next user of the same day, by time: a multigraph."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id")
    n = windows.next_split(e, ["day"], [F.col("ts"), F.col("event_id")], "user_id", "target", ["user_id"], ordered=True)
    return n.select(F.lit("r").alias("run_id"), F.col("user_id").alias("source"), "target").where("target is not null")


def _users(spark, d):
    return table(spark, d, "events").select(F.lit("r").alias("run_id"), F.col("user_id").alias("id")).distinct()


@query
def degree(spark, d):
    """Fan-in and fan-out of users with parallel edges, and distinct neighbours."""
    g = graph.degrees(_users(spark, d), _transitions(spark, d))
    return g.select("node", F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"), "neighbours")


@query
def reference_counts(spark, d):
    """1 + incoming + outgoing."""
    return graph.reference_counts(_users(spark, d), _transitions(spark, d)).select("node", "refs")


@query
def decayed_reachability(spark, d):
    """Decayed weight and number of users reached within eight hops over all transitions, and the largest distance."""
    r = graph.reach_sums(_transitions(spark, d))
    return r.select("src", "reached", F.round("weight", 6).alias("weight"), F.col("farthest").cast("long").alias("farthest"))


@query
def reach_of_purchases(spark, d):
    """The same over purchases of a day in a row: a sparser graph with longer distances."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id")
    n = windows.next_split(e, ["day"], [F.col("ts"), F.col("event_id")], "user_id", "target", ["user_id"], ordered=True).where("target is not null")
    r = graph.reach_sums(n.select(F.lit("r").alias("run_id"), F.col("user_id").alias("source"), "target"))
    return r.select("src", "reached", F.round("weight", 6).alias("weight"), F.col("farthest").cast("long").alias("farthest"))


@query
def call_chains(spark, d):
    """Chains of links between nations of a region, from customers' to suppliers', from the region's first nation three steps deep, by a recursive query."""
    links = area_links(spark, d)
    first = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("run_id")).agg(F.min("n_nationkey").alias("id"))
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    inside = links.join(n.select(F.col("n_nationkey").alias("from_id"), F.col("n_regionkey").alias("run_id")), "from_id").join(n.select(F.col("n_nationkey").alias("to_id"), F.col("n_regionkey").alias("r2")), "to_id").where("run_id = r2")
    c = graph.call_chains(inside.select("run_id", F.col("from_id").alias("source"), F.col("to_id").alias("target")), first, 3)
    return c.select("run_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "closed")


@query
def pagerank(spark, d):
    """Twenty iterations over the users' transitions."""
    return graph.pagerank(_users(spark, d), _transitions(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query
def seeded_pagerank(spark, d):
    """Teleport only to users whose first event was a sign-up."""
    first = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("t"))
    seeds = first.where("t = 'signup'").select(F.lit("r").alias("run_id"), F.col("user_id").alias("id"))
    return graph.pagerank(_users(spark, d), _transitions(spark, d), seeds).select("node", F.round("rank", 8).alias("rank"))


def _scaled(c: str):
    top = F.col(f"top_{c}")
    return F.when(top > 0, text.round_half_up(F.col(c) / top * 100)).otherwise(F.lit(0)).cast("long")


def _scores(spark, d):
    g = graph.degrees(_users(spark, d), _transitions(spark, d))
    e = table(spark, d, "events")
    kinds = e.groupBy(F.col("user_id").alias("node")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("writes"), F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "error").alias("io"),
    )
    g = g.join(kinds, "node").withColumn("state", F.col("writes") * 100 + F.col("reads") * 35)
    tops = g.groupBy("run_id").agg(*[F.max(c).alias(f"top_{c}") for c in ("neighbours", "fan_out", "state", "io")])  # one row
    g = g.join(F.broadcast(tops), "run_id")
    s = g.select("run_id", "node", "fan_in", "writes", "io", _scaled("neighbours").alias("reachability"), _scaled("fan_out").alias("orchestration"), _scaled("state").alias("state_authority"), _scaled("io").alias("boundary"))
    score = (20 * F.col("reachability") + 30 * F.col("orchestration") + 25 * F.col("state_authority") + 25 * F.col("boundary")) / 100
    return s.withColumn("score", text.round_half_up(score).cast("long"))


@query
def importance_score(spark, d):
    """Signals scaled by their maximum, rounded, weighted and rounded again."""
    return _scores(spark, d).select("node", "reachability", "orchestration", "state_authority", "boundary", "score")


@query
def roles(spark, d):
    """Roles in a fixed order, by signals that fire at 60 and above."""
    s = _scores(spark, d)
    r = F.array(
        F.when(F.col("orchestration") >= 60, F.lit("ORCHESTRATOR")), F.when(F.col("state_authority") >= 60, F.lit("STATE_CONTROLLER")), F.when(F.col("boundary") >= 60, F.lit("BOUNDARY")),
    )
    r = F.filter(r, lambda x: x.isNotNull())
    r = F.when((F.size(r) == 0) & (F.col("fan_in") > 0), F.array(F.lit("UTILITY"))).otherwise(r)
    return s.select("node", F.array_join(r, "|").alias("roles"))


@query
def reasons_topk(spark, d):
    """The first three large purchases per user and day, in order."""
    e = _events(spark, d).where("event_type = 'purchase'")
    t = ranking.top_per_key(e, ["user_id", "day"], [F.col("value").desc(), F.col("event_id").asc()], 3)
    return t.select("user_id", "day", F.col("place").cast("long").alias("place"), "event_id")


@query
def call_roots(spark, d):
    """Nations nobody links to among small links; without such, all."""
    links = area_links(spark, d).where("n >= 8")
    e = links.select(F.lit("r").alias("run_id"), F.col("from_id").alias("source"), F.col("to_id").alias("target"))
    nodes = table(spark, d, "nation").select(F.lit("r").alias("run_id"), F.col("n_nationkey").alias("id"))
    return graph.roots(nodes, e, nodes.where("false")).select("id")


@query
def neighborhood(spark, d):
    """What is one step away from each region's first nation."""
    links = area_links(spark, d)
    first = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("id"))
    e = links.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"))
    # a region's graph: the links that its first nation takes part in
    near = [e.join(first.select(F.col("id").alias(end), F.col("n_regionkey").alias("run_id")), end) for end in ("source", "target")]
    e = near[0].unionByName(near[1]).distinct()
    return graph.neighborhood(first.select(F.col("n_regionkey").alias("run_id"), "id"), e).select("run_id", "id")


@query
def round_robin_merge(spark, d):
    """Suppliers of a region, one of each nation in turn, seven in all."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    j = windows.numbered(j, ["n_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()], "idx")
    return ranking.round_robin(j, ["n_regionkey"], "n_nationkey", "idx", 7).select("n_regionkey", F.col("place").cast("long").alias("place"), "s_suppkey")


@query
def slugs(spark, d):
    """Slugs of part names within a brand; repeats are numbered."""
    p = table(spark, d, "part")
    s = windows.slugs(p, ["p_brand"], text.kebab_case(F.col("p_name")), [F.col("p_partkey")])
    return s.select("p_partkey", "slug")


@query
def paging(spark, d):
    """The third page, of fifteen rows, of parts by price and key."""
    p = table(spark, d, "part")
    return ranking.page(p, [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], 3, 15).select("p_partkey", "p_retailprice")


@query
def last_page(spark, d):
    """The last page, of forty rows, of all line items by date and key, from an index of blocks."""
    l = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pages = ranking.Pages(l, [F.col(c) for c in l.columns], 40, block_rows=5_000)
    return pages.page(ranking.page_count(pages.rows, 40)).select("l_orderkey", "l_linenumber", "l_partkey", "ord")


@query
def featured(spark, d):
    """Three pinned nations in order, then by key downwards, six in all."""
    n = table(spark, d, "nation")
    return ranking.featured(n, "n_name", ["NATION_7", "NATION_3", "NATION_99"], "n_nationkey", "n_name").select("n_name", F.col("place").cast("long").alias("place"))


@query
def dep_sort_desc(spark, d):
    """Rank of suppliers in the reverse of the ascending order by nation and name."""
    s = table(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy(*ranking.reverse_stable([F.floor("s_acctbal"), F.col("s_name"), F.col("s_suppkey")], True))
    return s.select("s_suppkey", F.row_number().over(w).cast("long").alias("place"))


@query
def median_budget(spark, d):
    """Exact medians per event type against budgets."""
    m = ranking.exact_quantile(table(spark, d, "events"), ["event_type"], "value", 0.5)
    m = table(spark, d, "events").select("event_type").distinct().join(m, "event_type", "left").select("event_type", F.round("value", 6).alias("median"))
    budget = F.create_map(*[F.lit(x) for kv in {"click": 50.0, "view": 40.0, "purchase": 60.0, "signup": 30.0}.items() for x in kv])[F.col("event_type")]
    return m.withColumn("budget", budget).withColumn("over_budget", F.coalesce(F.col("median") > F.col("budget"), F.lit(False)))


@query
def contract_flags(spark, d):
    """Whether all of an order's lines were shipped, whether any was returned, and whether it has enough of them."""
    l = table(spark, d, "lineitem")
    return l.groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_linestatus") == "F").alias("all_shipped"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), (F.count(F.lit(1)) >= 3).alias("enough"),
    ).withColumn("complete", F.col("all_shipped") & ~F.col("any_returned") & F.col("enough"))


@query
def indexable(spark, d):
    """Customers whose newest order is done, costly and not urgent."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    r = resolve.latest_per_key(o, ["o_custkey"], "o_orderdate", "o_orderkey")
    return r.where("o_orderstatus = 'F' and o_totalprice > 100000 and o_orderpriority not like '1-%'").select("o_custkey", "o_orderkey")


@query
def recency_buckets(spark, d):
    """Events by how long ago they were at a fixed time."""
    at = F.col("ts").cast("timestamp")
    b = text.recency_bucket(at, F.lit("2024-02-03 12:00:00").cast("timestamp_ntz").cast("timestamp"))
    return table(spark, d, "events").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query
def semver_max(spark, d):
    """The newest version per brand, versions made of a part's key."""
    p = table(spark, d, "part")
    v = F.struct((F.col("p_size") % 4).alias("major"), (F.col("p_partkey") % 13).alias("minor"), (F.col("p_partkey") % 29).alias("patch"))
    m = p.groupBy("p_brand").agg(F.max(v).alias("v"))
    return m.select("p_brand", F.concat(F.lit("v"), F.concat_ws(".", "v.major", "v.minor", "v.patch")).alias("version"))


@query
def skipped_examples(spark, d):
    """Per status the number of urgent orders, five examples, and how many more."""
    o = table(spark, d, "orders").where("o_orderpriority like '1-%'").select("o_orderstatus", "o_orderkey")
    n = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    first = ranking.top_per_key(o, ["o_orderstatus"], [F.col("o_orderkey")], 5)
    some = first.groupBy("o_orderstatus").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ", ").alias("some"))
    more = F.when(F.col("n") > 5, F.concat(F.lit(" and "), (F.col("n") - 5).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return n.join(some, "o_orderstatus").select("o_orderstatus", "n", F.concat("some", more).alias("examples"))


@query
def patch_lines(spark, d):
    """Lines of documents read as a patch: those in capitals at the start are removed ones, others added."""
    line = F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line")
    sign = F.when(F.col("line").rlike("^[A-M]"), F.lit("-")).when(F.col("line").rlike("^[N-Z]"), F.lit("+"))
    t = table(spark, d, "documents").select("doc_id", line).withColumn("sign", sign).where("sign is not null")
    return t.groupBy("doc_id", "sign").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).cast("long").alias("chars"))


@query
def data_layer_paths(spark, d):
    """Pages below a directory that is named like a data layer; here two-letter languages stand for it."""
    p = _page_paths(spark, d)
    path = F.replace(F.replace(F.col("path"), F.lit("/en/"), F.lit("/models/")), F.lit("/fr/"), F.lit("/Schema2/"))
    return p.select("page_id", paths.is_data_layer(path).alias("data_layer"), paths.is_manifest(F.concat(path, F.lit("/package.json"))).alias("manifest"))


@query
def test_file_predicate(spark, d):
    """Test-file and test-root predicates over pages' paths."""
    p = _page_paths(spark, d)
    path = F.concat(F.element_at(F.array(*map(F.lit, ("src/", "tests/", "pkg/__tests__/", "lib/e2e/x/"))), (F.col("page_id") % 4 + 1).cast("int")), paths.basename(F.col("path")), F.element_at(F.array(*map(F.lit, (".test.ts", ".py", ".js"))), (F.col("page_id") % 3 + 1).cast("int")))
    return p.select("page_id", paths.is_js_test(path).alias("js_test"), paths.is_py_test(path).alias("py_test"), paths.test_root(path).alias("root"))


@query
def evidence_count(spark, d):
    """Sum of list sizes over two collections per order status."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    lists = l.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    j = o.join(lists, o.o_orderkey == lists.l_orderkey, "left")
    return j.groupBy("o_orderstatus").agg(F.sum(F.coalesce(F.size("lines"), F.lit(0)) + 1).cast("long").alias("evidence"))


@query
def state_scope(spark, d):
    """A part is shared if more than one supplier delivers it."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    g = l.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return g.select("l_partkey", F.when(F.col("n") > 1, F.lit("shared")).otherwise(F.lit("local")).alias("scope"))


@query
def boundary_dedupe(spark, d):
    """The first line per supplier and part."""
    l = table(spark, d, "lineitem")
    g = l.groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"), F.count(F.lit(1)).alias("n"))
    return g.select("l_suppkey", "l_partkey", F.col("f.l_orderkey").alias("l_orderkey"), F.col("f.l_linenumber").alias("l_linenumber"), "n")


@query
def nearest_span(spark, d):
    """For each of a customer's orders the innermost 90-day window of the customer's orders of priority 1 that holds it."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderpriority")
    spans = o.where("o_orderpriority like '1-%'").select("o_custkey", F.col("t").alias("s"), (F.col("t") + 90 * 86_400_000_000).alias("e"), F.col("o_orderkey").alias("span_id"))
    n = windows.nearest_span(o.select("o_custkey", "o_orderkey", "t"), spans, ["o_custkey"], "t", "s", "e", "span_id")
    return n.select("o_orderkey", "span_id")


@query
def language_version_key(spark, d):
    """Sorted versions of each source's languages, joined."""
    t = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set(F.concat("lang", F.lit("-v1")))).alias("v"))
    return t.select("source", F.concat(F.lit("dispatch-v1:"), F.array_join("v", "+")).alias("version"))


@query
def running_limits(spark, d):
    """Where a customer's orders, in order, first break a limit of number or of sum."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    total = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(windows.running(["o_custkey"], [F.col("o_orderkey")]))
    b = windows.first_breach(o, ["o_custkey"], [F.col("o_orderkey")], [("too-many", F.col("n_so_far") > 12), ("too-large", total > 150_000_000)])
    return b.select("o_custkey", "o_orderkey", "code")


@query
def area_subdivision(spark, d):
    """Areas of pages: directories of two segments, split while they hold more than ten files and can be."""
    from .plans import areas

    nested = F.concat(F.regexp_replace("path", "([0-9])", "$1/"), F.lit("x"))  # digits of page numbers as directories
    p = _page_paths(spark, d).select(F.lit("r").alias("run_id"), nested.alias("path"), "page_id")
    return areas.subdivide(p, "path").select("page_id", "area")
