from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeatlas.functions import categories, paths, text, urls
from codeatlas.operators import ranking, resolve, windows
from codeatlas.plans import areas, graph, history, importance, start_here


def test_candidates_by_priority(spark):
    left = spark.createDataFrame([(1, "a/b"), (2, "x")], "id int, base string")
    files = spark.createDataFrame([("a/b/index.ts",), ("a/b.tsx",)], "path string")
    cand = F.array(F.col("base"), F.concat("base", F.lit(".ts")), F.concat("base", F.lit(".tsx")), F.concat("base", F.lit("/index.ts")))
    got = {r.id: r.hit for r in resolve.candidate_join(left, cand, files, "path", ["id"]).collect()}
    assert got == {1: "a/b.tsx", 2: None}


def test_longest_prefix_ties_and_exact_path(spark):
    areas_ = spark.createDataFrame([(".", 0), ("x", 1), ("src", 2), ("src/a", 3)], "path string, ord int")
    files = spark.createDataFrame([("x/f",), ("src/a/f",), ("src/b",), ("src",), ("f",)], "file string")
    got = {r.file: r.area_path for r in resolve.longest_prefix(files, "file", areas_, "path", "ord", ["file"]).collect()}
    # the root counts as one character, so it ties with 'x' and its smaller order wins; a path equal to an area isn't in it
    assert got == {"x/f": ".", "src/a/f": "src/a", "src/b": "src", "src": ".", "f": "."}


def test_ambiguity_vetoes(spark):
    left = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c")], "file string, name string")
    local = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "b", 3)], "file string, name string, id int")
    wide = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "name string, id int")
    j = resolve.unique_join(resolve.unique_join(left, local, ["file", "name"], "id", "l"), wide, ["name"], "id", "w")
    got = {r.name: r.v for r in j.select("name", resolve.with_veto("l", "l_n", F.col("w")).alias("v")).collect()}
    assert got == {"a": 1, "b": None, "c": 9}


def test_cascade_takes_one(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    t = lambda rows: spark.createDataFrame(rows, "k int, v string")
    got = {r.k: (r.v, r.how) for r in resolve.priority_cascade(left, ["k"], [("first", t([(1, "a")])), ("second", t([(1, "b"), (2, "c")]))], "v").collect()}
    assert got == {1: ("a", "first"), 2: ("c", "second"), 3: (None, "none")}


def test_first_rule(spark):
    left = spark.createDataFrame([("@/x/y",), ("@lib",), ("z",)], "s string")
    rules = spark.createDataFrame([("@/x/", True, 0), ("@/", True, 1), ("@lib", False, 2)], "p string, pre boolean, r int")
    got = {r.s: r.rule_pattern for r in resolve.first_rule(left, "s", rules, "p", "pre", "r", ["s"]).collect()}
    assert got == {"@/x/y": "@/x/", "@lib": "@lib", "z": None}


def test_cooldown_counts_from_the_last_grant(spark):
    rows = [(1, i, t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:00:40", "2024-01-01 00:01:05", "2024-01-01 00:01:50"])]
    df = spark.createDataFrame(rows, "k int, i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [(r.i, r.granted, r.remaining) for r in windows.cooldown(df, "k", "t", "i", 60).orderBy("i").collect()]
    assert got == [(0, True, 0), (1, False, 20), (2, True, 0), (3, False, 15)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "..", ".", ""]), min_size=1, max_size=6))
def test_normalize(spark, parts):
    want = []
    for p in parts:
        if p == "..":
            want = want[:-1]
        elif p not in ("", "."):
            want.append(p)
    got = spark.range(1).select(paths.normalize(F.lit("/".join(parts)))).first()[0]
    assert got == "/".join(want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12))
def test_islands(spark, keys):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)], "g int, i int, k string")
    got = [r.island for r in windows.islands(df, ["g"], [F.col("i")], F.col("k")).orderBy("i").collect()]
    want, n = [], 0
    for i, k in enumerate(keys):
        n += i == 0 or keys[i - 1] != k
        want.append(n)
    assert got == want


def test_pagerank_mass_and_parallel_edges(spark):
    nodes = spark.createDataFrame([("r", x) for x in "abc"], "run_id string, id string")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "a", "c")], "run_id string, source string, target string")
    got = {r.node: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert got["b"] > got["c"] > got["a"]


def test_reach_stops_at_eight_hops(spark):
    assert graph.max_hops() == 8
    edges = spark.createDataFrame([("r", i, i + 1) for i in range(12)], "run_id string, source int, target int")
    got = graph.reach(edges, spark.createDataFrame([("r", 0)], "run_id string, id int")).collect()
    assert sorted(r.dst for r in got) == list(range(1, 9))


def test_area_subdivision_and_test_roots(spark):
    names = [f"src/a/{i}.ts" for i in range(6)] + [f"src/a/deep/{i}.ts" for i in range(6)] + [f"pkg/tests/x{i}/f.ts" for i in range(12)] + ["readme.ts"]
    got = {r.path: r.area for r in areas.subdivide(spark.createDataFrame([("r", n) for n in names], "run_id string, path string")).collect()}
    assert got["src/a/0.ts"] == "src/a" and got["src/a/deep/0.ts"] == "src/a/deep"
    assert got["pkg/tests/x3/f.ts"] == "pkg/tests" and got["readme.ts"] == "."
    roots = spark.createDataFrame([("testing/a.ts",), ("lib/test.ts",), ("a/e2e/b/c.ts",)], "p string").select(paths.test_root(F.col("p"))).collect()
    assert [r[0] for r in roots] == ["", "", "a/e2e"]


def test_categories_and_text(spark):
    row = spark.range(1).select(
        categories.dependency_category(F.lit("@types/node")), categories.dependency_category(F.lit("vue-cli")), categories.dependency_category(F.lit("React")),
        categories.dependency_category(F.lit("x"), F.lit("A plotting library")), categories.dependency_category(F.lit("x"), F.lit("GraphQL client")),
        text.join_and(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), text.kebab_case(F.lit("  Src/My Area! ")), text.relative_time(F.lit(86_400)),
    ).first()
    assert list(row) == ["types", "cli", "framework", "dataViz", "other", "a, b and c", "src-my-area", "yesterday"]


def test_repository_urls(spark):
    df = spark.createDataFrame([("octo/repo",), ("https://github.com/octo/repo.git",), ("github.com/octo/repo/tree/x",), ("https://example.org/a/b",), ("ftp://github.com/a/b",), ("",), ("a/b/c",)], "t string")
    got = [(r.x.owner, r.x.repo, r.x.reason) for r in df.select(urls.parse_repository(F.col("t")).alias("x")).collect()]
    assert got[:3] == [("octo", "repo", None)] * 3
    assert [g[2] for g in got[3:]] == ["unsupported-host", "unsupported-scheme", "empty", "unsupported-host"]


def test_pager():
    assert ranking.page_items(1, 1) == [1]
    assert ranking.page_items(5, 10) == [1, "…", 4, 5, 6, "…", 10]
    assert ranking.page_items(3, 5) == [1, 2, 3, 4, 5]


PACKAGE = "\n".join(["@@ -1,3 +1,4 @@", ' "dependencies": {', '-"left": "^1.0.0",', '+"left": "^2.0.0",', '+"right": "~3.1.0"', " },", ' "scripts": {', '+"x": "1.0.0"', " }"])
LOCK = "\n".join(["@@ -1 +1 @@", ' "packages": {', '  "node_modules/a": {', '-   "version": "1"', '+   "version": "2"', "  },", '+  "node_modules/b": {', '+   "v": "1"', "+  }", " }"])


def test_history(spark):
    commits = spark.createDataFrame(
        [("r", i, f"c{i}", "m", "A", None, t) for i, t in enumerate(["2024-01-02T10:00:00Z", "2024-01-02T09:00:00Z", "2024-01-01T09:00:00Z", "2024-01-01T08:00:00Z"])],
        "run_id string, ord long, sha string, message string, author_name string, author_login string, authored_at string",
    )
    files = spark.createDataFrame(
        [("r", "c0", 0, "package.json", "m", 1, 1, PACKAGE), ("r", "c0", 1, "package-lock.json", "m", 1, 1, LOCK), ("r", "c0", 2, "yarn.lock", "m", 1, 1, "+x"),
         ("r", "c1", 0, "src/a/x.ts", "m", 1, 0, "@@ -1 +1 @@\n+import { y } from '../b/y';"), ("r", "c2", 0, "readme", "m", 1, 0, "+x"), ("r", "c3", 0, "src/db/m.ts", "m", 1, 0, None)],
        "run_id string, sha string, ord long, file_path string, status string, additions int, deletions int, patch string",
    )
    where = spark.createDataFrame([("r", 0, ".", ".", "p:."), ("r", 1, "src/a", "src/a", "p:a"), ("r", 2, "src/b", "src/b", "p:b")], "run_id string, ord long, path string, name string, id string")
    got = history.build(commits, files, where).orderBy("ord").collect()
    assert [e.kind for e in got] == ["dependency", "architecture", "data-flow"]
    assert got[0].what_changed == ["Left removed from package.json", "Left added in package.json", "Right added in package.json", "2 packages changed in package-lock.json", "Yarn.lock changed (lockfile contents not inspected)"]
    assert got[1].title == "Src/a now depends on src/b" and got[1].affected_areas == ["src/a"]
    assert got[2].id == "c3" and got[2].affected_areas == ["."]


def test_importance_roles(spark):
    c = spark.createDataFrame([("r", i, f"f{i}", f"n{i}", f"m{i % 2}.ts") for i in range(4)], "run_id string, ord long, id string, name string, file_path string")
    e = spark.createDataFrame([("r", 0, "f0", "f1", "CALL"), ("r", 1, "f1", "f2", "CALL"), ("r", 2, "f2", "s1", "STATE_WRITE"), ("r", 3, "f3", "b1", "IO")], "run_id string, ord long, source string, target string, type string")
    n = spark.createDataFrame([("r", "s1", "state", "shared", None), ("r", "b1", "boundary", None, "http")], "run_id string, id string, kind string, state_scope string, boundary_type string")
    ep = spark.createDataFrame([("r", 0, "m0.ts", "n0", "cli")], "run_id string, ord long, file_path string, symbol_name string, kind string")
    got = {r.function_id: r for r in importance.function_importance(c, e, n, ep).collect()}
    assert got["f0"].roles[0] == "ENTRY_POINT" and "STATE_CONTROLLER" in got["f2"].roles and "BOUNDARY" in got["f3"].roles
    assert got["f2"].state_authority == 100 and got["f3"].boundary_influence == 100
    assert [x.type for x in got["f3"].reasons if x.boundary_type] == ["CROSSES_BOUNDARY"]


def test_start_here_marks_the_parent_area(spark):
    files = spark.createDataFrame([("r", "p", f"src/components/{i}.ts") for i in range(3)] + [("r", "p", "src/x.ts"), ("r", "p", "lib/y.ts"), ("r", "p", "tests/t.ts")], "run_id string, project_id string, path string")
    none = lambda schema: spark.createDataFrame([], schema)
    rel = none("run_id string, ord long, from_id string, to_id string, certainty string, why string")
    ent = none("run_id string, ord long, file_path string, symbol_name string, kind string, certainty string")
    tests = spark.createDataFrame([("r", 0, "tests/t.ts", "src/x.ts", "detected", None)], "run_id string, ord long, test_path string, implementation_path string, certainty string, why string")
    a = spark.createDataFrame([("r", "p", "src/components", 3, None, "w"), ("r", "p", "src", 1, None, "w"), ("r", "p", "lib", 1, None, "w"), ("r", "p", "tests", 1, "Tests", "w")], "run_id string, project_id string, area string, file_count int, responsibility string, rationale string")
    got = [r.file_path for r in start_here.build(files, ent, rel, a, tests).orderBy("place").collect()]
    # 'src/components' is represented by what its own path falls into at depth two, which is 'src': the area 'src' is skipped
    assert got == ["src/components", "lib", "tests/t.ts"]


def test_first_rule_knows_prefixes_of_all_lengths(spark):
    rules = spark.createDataFrame([("x" * n + "y", True, n) for n in range(300)], "pattern string, is_prefix boolean, rank int")
    left = spark.createDataFrame([(n, "x" * n + "yz") for n in range(300)] + [(300, "x"), (301, None), (302, "")], "id int, text string")
    got = {r.id: r.rule_rank for r in resolve.first_rule(left, "text", rules, "pattern", "is_prefix", "rank", ["id"]).collect()}
    assert got == {n: n for n in range(300)} | {300: None, 301: None, 302: None}


def test_nearest_span_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    spans = [(f"k{rng.randrange(3)}", a, a + rng.randint(0, 30), f"s{i:03}") for i in range(120) for a in [rng.randrange(200)]]
    points = [(f"k{rng.randrange(4)}", rng.randrange(220), i) for i in range(300)] + [("k0", None, 300)]
    got = windows.nearest_span(
        spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(spans, "k string, lo int, hi int, id string"), ["k"], "at", "lo", "hi", "id"
    )
    want = {p: max(((lo, i) for kk, lo, hi, i in spans if kk == k and at is not None and lo <= at < hi), default=(0, None))[1] for k, at, p in points}
    assert {r.p: r.id for r in got.collect()} == want


def test_graphs_against_plain_python(spark, monkeypatch):
    """Distances, their sums and ranks of graphs with hubs, dangling nodes, targets that are no nodes, and seeds that are none."""
    import random

    rng = random.Random(6)
    edges = spark.createDataFrame([(f"r{k % 2}", rng.randrange(40), rng.randrange(44)) for k in range(150)], "run_id string, source int, target int")
    nodes = spark.createDataFrame([(f"r{k}", i) for k in range(3) for i in range(42)], "run_id string, id int")
    seeds = spark.createDataFrame([("r0", 3), ("r0", 99), ("r2", 1)], "run_id string, id int")

    pairs = {(r.run_id, r.source, r.target) for r in edges.collect()}
    counted = [(r.run_id, r.source, r.target) for r in edges.collect()]

    def near(run, a, hops):
        dist, at = {a: 0}, {a}
        for d in range(1, hops + 1):
            at = {t for r, s, t in pairs if r == run and s in at} - set(dist)
            dist |= dict.fromkeys(at, d)
        return {(run, a, b, d) for b, d in dist.items() if d}

    want = {x for r, a in {(r, a) for r, a, _ in pairs} for x in near(r, a, 3)}
    assert {tuple(r) for r in graph.reach(edges, hops=3).collect()} == want and len(want) > 500
    few = nodes.where("id < 5")
    assert {tuple(r) for r in graph.reach(edges, few, 2).collect()} == {x for r in few.collect() for x in near(r.run_id, r.id, 2)}
    sums = {(r.run_id, r.src): (r.reached, round(r.weight, 9), r.farthest) for r in graph.reach_sums(edges, hops=3).collect()}
    by = {}
    for r, a, _, d in want:
        n, w, far = by.get((r, a), (0, 0.0, 0))
        by[r, a] = (n + 1, w + 0.7 ** (d - 1), max(far, d))
    assert sums == {k: (n, round(w, 9), far) for k, (n, w, far) in by.items()}

    def ranked(seeded):
        out = {}
        for run in {r.run_id for r in nodes.collect()}:
            ids = [r.id for r in nodes.collect() if r.run_id == run]
            chosen = [i for r, i in (("r0", 3), ("r0", 99), ("r2", 1)) if r == run and i in ids] if seeded else []
            jump = {i: (i in chosen) / len(chosen) if chosen else 1 / len(ids) for i in ids}
            own = [(s, t) for r, s, t in counted if r == run]
            deg = {i: sum(s == i for s, _ in own) for i in ids}
            rank = dict.fromkeys(ids, 1 / len(ids))
            for _ in range(20):
                lost = sum(rank[i] for i in ids if not deg[i])
                got = dict.fromkeys(ids, 0.0)
                for s, t in own:
                    if t in got and s in rank:
                        got[t] += rank[s] / deg[s]
                rank = {i: 0.15 * jump[i] + 0.85 * (got[i] + lost * jump[i]) for i in ids}
            out |= {(run, i): v for i, v in rank.items()}
        return out

    monkeypatch.setattr(graph, "HUB", 3)  # most nodes are hubs, then
    for s in (None, seeds):
        got = {(r.run_id, r.node): r["rank"] for r in graph.pagerank(nodes, edges, s).collect()}
        expected = ranked(s is not None)
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codeatlas_")]
