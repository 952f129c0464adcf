"""What must not grow: broadcasts, plans run again, rows in one task."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from codeatlas import session, table_queries
from codeatlas.operators import resolve, windows
from codeatlas.plans import graph, views


def test_first_rule_does_not_broadcast_the_texts(spark, tmp_path, capsys, monkeypatch):
    # a table small enough as a file to be broadcast, and rules of unknown size
    spark.range(1000).select("id", F.concat(F.lit("@/"), F.col("id").cast("string")).alias("s")).write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    rules = spark.createDataFrame([("@/1", True, 0), ("@/", True, 1)], "p string, pre boolean, r int")
    for limit, wanted in ((10_000, "BuildRight"), (0, "SortMergeJoin")):
        monkeypatch.setattr(resolve, "BROADCAST_RULES", limit, raising=False)
        got = resolve.first_rule(left, "s", rules, "p", "pre", "r", ["id"])
        capsys.readouterr()
        got.explain()
        plan = capsys.readouterr().out
        assert wanted in plan and "BuildLeft" not in plan
        assert got.groupBy("rule_rank").count().orderBy("rule_rank").collect() == [(0, 111), (1, 889)]


def test_cooldown_broadcasts_no_requests(spark, capsys, monkeypatch):
    plans, write = [], windows.materialize

    def watched(df, name):
        df.explain()
        plans.append((name, capsys.readouterr().out))
        return write(df, name)

    monkeypatch.setattr(windows, "materialize", watched)
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    got = windows.cooldown(df, "k", "t", "i", 3600)
    assert got.where("granted").count() == 7 * 48
    rounds = [plan for name, plan in plans if name in ("granted", "jumps")]
    assert len(rounds) > 8 and all("SortMergeJoin" in plan for plan in rounds[1:]) and not [1 for plan in rounds[1:] if "BroadcastHashJoin" in plan]


def test_call_chains_read_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([("r", i, i + 1) for i in range(6)], "run_id string, source int, target int").withColumn("target", F.udf(look, "int")("target"))
    got = graph.call_chains(edges, spark.createDataFrame([("r", 0)], "run_id string, id int"), 4)
    assert sorted(len(r.path) for r in got.collect()) == [1, 2, 3, 4, 5]
    assert seen.value == 6


def test_reach_in_small_blocks_slices_and_batches(spark, monkeypatch):
    """Every cut at once, hubs on both sides; sets of a batch are gone once they are counted, and so are the hops' tables."""
    rng = random.Random(9)
    pairs = {(f"r{rng.randrange(2)}", rng.randrange(70), rng.randrange(70)) for _ in range(200)} | {("r0", i, 7) for i in range(70)} | {("r1", 5, i) for i in range(70)}
    edges = spark.createDataFrame(sorted(pairs), "run_id string, source int, target int")
    for name, value in (("SLICE", 150), ("WIDEST", 64), ("BATCH_BYTES", 1)):
        monkeypatch.setattr(graph, name, value, raising=False)
    names, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: names.append(name) or write(df, name))
    out = {}
    for r, s, t in pairs:
        out.setdefault((r, s), set()).add(t)
    want = {}
    for r, a in out:
        dist, at = {a: 0}, {a}
        for d in (1, 2):
            at = {t for s in at for t in out.get((r, s), ())} - set(dist)
            dist |= dict.fromkeys(at, d)
        if len(dist) > 1:
            want[r, a] = (len(dist) - 1, round(sum(0.7 ** (d - 1) for d in dist.values() if d), 9), max(dist.values()))
    got = graph.reach_sums(edges, hops=2)
    assert {(r.run_id, r.src): (r.reached, round(r.weight, 9), r.farthest) for r in got.collect()} == want
    assert names.count("frontier") >= 2 * (len(out) // 64)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "codeatlas"
    assert not list(folder.glob("frontier-*"))


def test_reach_moves_no_sets(spark, monkeypatch):
    """However many hops there are, a block's sets stay in its task: only its start and its counts are written. Small packs, hubs cut over several, packs in a file, runs that share a block and a pack."""
    rng = random.Random(11)
    pairs = {(f"r{r}", s, s + 1) for r in range(6) for s in range(12)} | {(f"r{r}", rng.randrange(12), rng.randrange(13)) for r in range(3) for _ in range(9)}
    pairs |= {("r6", i, 40) for i in range(40)} | {("r6", 40, i) for i in range(41)} | {("r6", 7, 50), ("r6", 60, 61)}
    edges = spark.createDataFrame(sorted(pairs), "run_id string, source int, target int")
    near, out = {}, {}
    for r, s, t in pairs:
        out.setdefault((r, s), set()).add(t)
    for r, s in out:
        dist, at = {s: 0}, {s}
        for d in range(1, 9):
            at = {t for x in at for t in out.get((r, x), ())} - set(dist)
            dist |= dict.fromkeys(at, d)
        near |= {(r, s, v): d for v, d in dist.items() if d}
    want = {}
    for (r, s, _), d in near.items():
        n, w, most = want.get((r, s), (0, 0.0, 0))
        want[r, s] = n + 1, w + 0.7 ** (d - 1), max(most, d)
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append((name, df.columns)) or write(df, name))
    for small in ({}, {"PACK": 16, "PACK_TARGETS": 3, "HELD_BYTES": 0}, {"PACK": 7, "PACK_TARGETS": 50, "HELD_BYTES": 200, "WIDEST": 64}):
        for name, value in small.items():
            monkeypatch.setattr(graph, name, value)
        written.clear()
        got = {(r.run_id, r.src): (r.reached, r.weight, r.farthest) for r in graph.reach_sums(edges, hops=8).collect()}
        assert got.keys() == want.keys() and all(got[k][::2] == want[k][::2] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
        assert [c for name, c in written if name == "frontier"] == [["at", "first", "lo", "hi", "t"], ["block", "first", "dist", "n"]]
        assert {(r.run_id, r.src, r.dst): r.dist for r in graph.reach(edges, hops=8).collect()} == near


def test_unions_end_when_nothing_lacks():
    rng = np.random.default_rng(4)
    front = rng.integers(0, 2**63, (90, 3)).astype(np.uint64) & rng.integers(0, 2**63, (90, 3)).astype(np.uint64)
    size = np.append(rng.integers(1, 60, 40), [4000, 1, 30])
    first, place = np.cumsum(size) - size, rng.integers(0, 90, int(size.sum()))
    had, done = rng.integers(0, 2**63, (len(size), 3)).astype(np.uint64), np.array([2**63, 2**64 - 1, 2**63 + 5], np.uint64)
    want = np.bitwise_or.reduceat(front[place], first, axis=0) | had
    assert (graph._met(front, place, first, had) == want).all()
    assert (graph._met(front, place, first, had, done) | done == want | done).all()
    for m in (front, front[:1], np.tile(want, (120, 1))):
        assert (graph._held(m) == np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").sum(axis=0)).all()


def test_unions_of_groups():
    rng = np.random.default_rng(3)
    for n, most in ((300, 3), (5, 9000), (1, 1)):
        front = rng.integers(0, 2**63, (40, 3)).astype(np.uint64)
        size = rng.integers(1, most + 1, n)
        first, place = np.cumsum(size) - size, rng.integers(0, 40, int(size.sum()))
        assert (graph._met(front, place, first) == np.bitwise_or.reduceat(front[place], first, axis=0)).all()


def test_unique_callees_deal_calls_by_their_number(spark, capsys, monkeypatch):
    """A task's share of the calls stays small as calls grow, also in the query, whose run is a literal."""
    monkeypatch.setattr(session, "TASK_ROWS", 500, raising=False)
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(3)}", rng.randrange(40), rng.randrange(60), i) for i in range(6000)]
    calls = spark.createDataFrame(rows, "run_id string, source int, target int, ord int")
    callables = spark.createDataFrame([(f"r{r}", i, f"f{i}") for r in range(3) for i in range(60)], "run_id string, id int, name string")
    want = {}
    for r, s, t, _ in rows:
        seen = want.setdefault((r, s), [])
        if t not in seen:
            seen.append(t)
    got = views.unique_callees(calls, callables).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.run_id, r.caller, r.callee, r.place, r.name) for r in got} == {(*k, t, i + 1, f"f{t}") for k, v in want.items() for i, t in enumerate(v)}
    assert max(Counter(r.task for r in got).values()) < len(got) / 4
    capsys.readouterr()
    table_queries.QUERIES["unique_callees"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_NUM") == 5 and "ENSURE_REQUIREMENTS" not in plan


def test_unique_callees_are_listed_with_names_and_places(spark):
    """The query returns each customer's suppliers in order, not their number only; calls of one place go by callee, whatever task they are in."""
    sf = "/root/testdata/sf0.001"
    lines, orders, names = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("lineitem", "orders", "supplier"))
    of, called, want = {r.o_orderkey: r.o_custkey for r in orders}, {r.s_suppkey: r.s_name for r in names}, {}
    for r in sorted(lines, key=lambda r: (r.l_orderkey, r.l_linenumber, r.l_suppkey)):
        if r.l_orderkey in of and r.l_suppkey in called:
            want.setdefault(of[r.l_orderkey], {}).setdefault(r.l_suppkey, called[r.l_suppkey])
    got = table_queries.QUERIES["unique_callees"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((c, k, n, i + 1) for c, v in want.items() for i, (k, n) in enumerate(v.items()))
    calls = spark.createDataFrame([("r", c, k, 5) for c in range(9) for k in (8, 3, 7, 1)] + [("r", 0, 9, 4), ("r", 0, 2, 1)], "run_id string, source int, target int, ord int")
    told = views.unique_callees(calls, spark.createDataFrame([("r", k, f"f{k}") for k in (1, 3, 7, 8, 9)], "run_id string, id long, name string")).collect()
    assert sorted((r.caller, r.place, r.callee, r.name) for r in told if r.caller < 2) == [(0, i + 1, k, f"f{k}") for i, k in enumerate((9, 1, 3, 7, 8))] + [(1, i + 1, k, f"f{k}") for i, k in enumerate((1, 3, 7, 8))]


def test_pagerank_packs_edges_into_few_rows(spark, monkeypatch):
    """A step joins a row per source, not per edge; targets close together and far apart, parallel edges, and ends that aren't nodes."""
    for pairs in ([(a, b) for a in range(20) for b in range(30)] + [(0, 1)] * 5 + [(3, 999), (999, 3)], [(0, 1), (0, 1), (0, 290), (7, 299), (299, 0), (5, 999)]):
        tables, write = [], graph.bucketed
        monkeypatch.setattr(graph, "bucketed", lambda df, keys: tables.append((keys, df.count())) or write(df, keys))
        nodes = spark.createDataFrame([("r", i) for i in range(300)], "run_id string, id int")
        edges = spark.createDataFrame([("r", s, t) for s, t in pairs], "run_id string, source int, target int")
        got = {r.node: r["rank"] for r in graph.pagerank(nodes, edges, iterations=2).collect()}
        deg, rank = Counter(s for s, _ in pairs), dict.fromkeys(range(300), 1 / 300)
        for _ in range(2):
            flow, lost = Counter(), sum(v for i, v in rank.items() if not deg[i])
            for s, t in pairs:
                if s in rank:
                    flow[t] += rank[s] / deg[s]
            rank = {i: 0.15 / 300 + 0.85 * (flow[i] + lost / 300) for i in rank}
        assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-12 for i in rank)
        assert [n for keys, n in tables if "source" in keys][0] <= len(deg)
        monkeypatch.setattr(graph, "bucketed", write)


def test_pagerank_steps_hold_blocks_not_nodes(spark, monkeypatch):
    """Every cut at once: small blocks across runs, packed rows of three edges, flows summed a few at a time; a step writes a row per block, where it wrote one per node."""
    rng = random.Random(5)
    ids = {(r, i) for r, n in (("a", 90), ("b", 1), ("c", 40)) for i in range(n)}
    pairs = [("a", rng.randrange(60), rng.randrange(95)) for _ in range(150)] + [("a", 3, 4)] * 9 + [("c", i, 0) for i in range(1, 40)] + [("c", 0, 99), ("d", 1, 2), ("a", 99, 1)]
    for name, value in (("BLOCK", 7), ("HELD", 5), ("HUB", 3)):
        monkeypatch.setattr(graph, name, value, raising=False)
    counts, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: counts.append((name, (out := write(df, name)).count())) or out)
    nodes = spark.createDataFrame(sorted(ids), "run_id string, id int")
    seeds = spark.createDataFrame([("a", 5), ("a", 94), ("c", 1), ("c", 2)], "run_id string, id int")
    got = {(r.run_id, r.node): r["rank"] for r in graph.pagerank(nodes, spark.createDataFrame(pairs, "run_id string, source int, target int"), seeds, iterations=2).collect()}
    size, deg = Counter(r for r, _ in ids), Counter((r, s) for r, s, _ in pairs)
    jump = {("a", 5): 1.0, ("c", 1): 0.5, ("c", 2): 0.5, ("b", 0): 1.0}
    rank = {x: 1 / size[x[0]] for x in ids}
    for _ in range(2):
        flow, lost = Counter(), Counter()
        for x in ids:
            lost[x[0]] += rank[x] * (not deg[x])
        for r, s, t in pairs:
            flow[r, t] += rank.get((r, s), 0.0) / deg[r, s]
        rank = {x: 0.15 * jump.get(x, 0.0) + 0.85 * (flow[x] + lost[x[0]] * jump.get(x, 0.0)) for x in ids}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-12 for x in rank)
    steps = [n for name, n in counts if name == "ranks"]
    assert steps[-1] == len(ids) and 1 < max(steps[:-1]) <= -(-len(ids) // 4)
