"""Graph operators on edge tables (run_id, source, target, ...). Parallel edges count wherever the reference semantics count them.

Loops join and write each step to the shared folder: plans stay short and a lost executor repeats one step. Graphs of every size take the same path.
"""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows
from ..session import bucketed, discard, materialize, small_batches, tasks, tidy_shuffles

#: PageRank: edges of a packed row (a block of sources with more has several), most nodes of a block, edges whose flow a task holds; rows of runs that may be broadcast.
HUB, BLOCK, HELD, BROADCAST_RUNS = 200_000, 16_384, 2_000_000, 200_000

#: Reachability: most edges and targets of a pack, bytes of a block's sets of all nodes, origins of a block, bytes of sets of a batch of blocks, and bytes of packs that a task holds in memory.
PACK, PACK_TARGETS, BLOCK_BYTES, WIDEST, BATCH_BYTES, HELD_BYTES = 65_536, 512, 192 << 20, 62 * 64, 48 << 30, 512 << 20

# Fixed values.
DECAY, MIN_WEIGHT, DAMPING, ITERATIONS = 0.7, 0.06, 0.85, 20


def max_hops(decay: float = DECAY, least: float = MIN_WEIGHT) -> int:
    """The last distance whose weight decay^(d - 1) isn't below `least`."""
    d, w = 1, 1.0
    while w * decay >= least:
        d, w = d + 1, w * decay
    return d


def degrees(nodes: DataFrame, edges: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, node, fan_in, fan_out, neighbours): parallel edges count in fans, not in distinct neighbours; a self-loop is its own neighbour."""
    ends = edges.select(run, F.col("source").alias("node"), F.col("target").alias("other"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(run, F.col("target").alias("node"), F.col("source").alias("other"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    d = ends.groupBy(run, "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count_distinct("other").alias("neighbours"))
    zero = {c: 0 for c in ("fan_in", "fan_out", "neighbours")}
    return nodes.select(run, F.col("id").alias("node")).join(d, [run, "node"], "left").fillna(zero)


def reference_counts(nodes: DataFrame, edges: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, node, refs): 1 + incoming + outgoing edges."""
    d = degrees(nodes, edges, run)
    return d.select(run, "node", (F.lit(1) + F.col("fan_in") + F.col("fan_out")).cast("long").alias("refs"))


def _matrix(sets: pa.ChunkedArray, dtype=np.uint64) -> np.ndarray:
    """A row per set, all being of one width."""
    rows = sets.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _sets(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1] * m.itemsize), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())


_ALL = np.uint64(2**64 - 1)


def _met(front: np.ndarray, place: np.ndarray, first: np.ndarray, had: np.ndarray | None = None, done: np.ndarray | None = None) -> np.ndarray:
    """The union of the rows front[place] of each group, and of what it `had`; groups begin at `first`. The k-th members of all groups are taken at once, those of the few largest groups one
    group after another. With `done` a group ends as soon as it lacks no other bits than these."""
    size = np.diff(first, append=len(place))
    rows = np.argsort(-size, kind="stable")
    size, first = size[rows], first[rows]
    out = np.zeros((len(rows), front.shape[1]), np.uint64) if had is None else had[rows]
    held, buffer, k = np.empty_like(out), np.empty_like(out), 0
    while (m := int(np.searchsorted(-size, -k, "left"))) >= 8:  # groups of more than k members
        np.take(front, place[first[:m] + k], axis=0, out=buffer[:m], mode="clip")
        out[:m] |= buffer[:m]
        k += 1
        if done is not None and k % 8 == 0 and 4 * np.count_nonzero(short := ((out[:m] | done) != _ALL).any(axis=1)) < 3 * m:
            ended, short = np.append(np.flatnonzero(~short), np.arange(m, len(rows))), np.flatnonzero(short)
            held[rows[ended]] = out[ended]
            rows, size, first, out = rows[short], size[short], first[short], out[short]
    for g in range(m):
        for lo in range(k, size[g], 512):
            out[g] |= np.bitwise_or.reduce(front[place[first[g] + lo : first[g] + min(lo + 512, size[g])]], axis=0)
            if done is not None and ((out[g] | done) == _ALL).all():
                break
    held[rows] = out
    return held


def _held(m: np.ndarray) -> np.ndarray:
    """How many rows hold each bit. Three rows of one weight become one, and one of the next weight, until two of each are left."""
    n = np.zeros(m.shape[1] * 64, np.int64)
    for lo in range(0, len(m), 4096):
        level, weight = m[lo : lo + 4096], 1
        while len(level):
            carried = []
            while k := len(level) // 3:
                a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                level = np.concatenate([odd ^ c, level[3 * k :]])
            n += weight * np.unpackbits(np.ascontiguousarray(level).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            level, weight = np.concatenate(carried) if carried else level[:0], 2 * weight
    return n


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, hi, t, n, s): edges, which come by target, as packs: targets from lo to hi, the number of sources of each, and the sources. A target's edges may be in several packs."""

    def cut(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        t, s = (np.concatenate(c).astype(np.int32) for c in zip(*parts, strict=True))
        for at in range(0, len(t), PACK):
            part = t[at : at + PACK]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(first, len(part))
            for g in range(0, len(first), PACK_TARGETS):
                mine = ends[g : g + PACK_TARGETS + 1]
                target = part[mine[:-1]]
                cols = target, np.diff(mine).astype(np.int32), s[at + mine[0] : at + mine[-1]]
                yield pa.RecordBatch.from_arrays([pa.array([int(target[0])]), pa.array([int(target[-1])]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["lo", "hi", "t", "n", "s"])

    parts, n = [], 0
    for b in batches:
        parts.append((b["t"].to_numpy(), b["s"].to_numpy()))
        n += b.num_rows
        if n >= PACK:
            yield from cut(parts)
            parts, n = [], 0
    if n:
        yield from cut(parts)


class _Pack(NamedTuple):
    lo: int
    hi: int
    t: np.ndarray
    n: np.ndarray
    s: np.ndarray


def _within(packs: list[_Pack], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(t, n, s) of the packs' targets from lo to hi, which are numbered from 0."""
    for p in packs[bisect_left(packs, lo, key=lambda p: p.hi) : bisect_right(packs, hi, key=lambda p: p.lo)]:
        i, j = np.searchsorted(p.t, [lo, hi + 1])
        ends = np.append(0, np.cumsum(p.n))[[i, j]] if i or j < len(p.t) else (0, len(p.s))
        cols = p.t[i:j], p.n[i:j], p.s[ends[0] : ends[1]]
        yield (cols[0] - lo, cols[1], cols[2] - lo) if lo else cols


def _walk(packs: list[_Pack], lo: int, hi: int, start: np.ndarray, hops: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(distance, sets before, sets after, how many nodes each origin reaches first at it) of the nodes from lo to hi, a bit per origin. What is no longer looked at: edges of sources whose sets didn't change in the last hop, targets that
    lack no origin but those that reached nothing new, which is nothing ever after."""
    size, w = hi - lo + 1, -(-len(start) // 64)
    now = np.zeros((size, w), np.uint64)
    bit = np.arange(len(start))
    now.view(np.uint8)[start - lo, bit // 8] = 1 << (bit % 8)
    after, fresh, n = np.empty_like(now), np.zeros(size, bool), np.zeros(w * 64, np.int64)
    fresh[start - lo] = True
    n[: len(start)] = 1
    done = np.packbits(n == 0, bitorder="little").view(np.uint64)
    for d in range(1, hops + 1):
        np.copyto(after, now)
        lacks = np.concatenate([((now[i : i + 4096] | done) != _ALL).any(axis=1) for i in range(0, size, 4096)])
        changed = np.zeros(size, bool)
        for t, k, s in _within(packs, lo, hi):
            some = np.repeat(lacks[t], k) & fresh[s]
            k = np.add.reduceat(some, np.cumsum(k) - k, dtype=np.int64)
            if not len(met := np.flatnonzero(k)):
                continue
            at, k = t[met], k[met]
            had = after[at]
            got = _met(now, s[some], np.cumsum(k) - k, had, done)
            after[at] = got
            changed[at] |= (got != had).any(axis=1)
        if not changed.any():
            return
        before, n = n, _held(after)
        yield d, now, after, (n - before)[: len(start)]
        done = np.packbits(n == before, bitorder="little").view(np.uint64)
        now, after, fresh = after, now, changed


def _frontiers(edges: DataFrame, origins: DataFrame | None, hops: int, run: str, kept: bool) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """(origins (run, src, block, bit), nodes (v, run, node), what is found of a batch of blocks): with `kept` (block, first, dist, v, new), `new` being the set of those origins of the block, from the
    bit `first` on, that reach v first at this distance, in tables that stay; else (block, first, dist, n), `n` being how many nodes each origin reaches first at this distance.

    Origins are cut into blocks, a task each; it walks all hops with a bit per origin and node, so sets never leave it. Edges are packed by target, and every task reads the packs of its runs as
    a stream: blocks and packs meet in a cross join without a shuffle. A task holds a block's bits twice and four bytes an edge (in a temporary file above HELD_BYTES); disk holds the packs once.
    Time grows with origins times edges. Blocks go in batches, so that those of many runs don't read the packs of all.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    node = edges.schema["target"].dataType
    with tidy_shuffles(spark):
        e = materialize(edges.select(run, F.col("source").cast(node).alias("source"), "target").dropna().distinct(), "edges")
        nodes = e.select(run, F.col("source").alias("node")).unionByName(e.select(run, F.col("target").alias("node"))).distinct()
        nodes = materialize(windows.numbered_global(nodes, [F.col(run), F.col("node")], "v", 0), "nodes")
        asked = e.select(run, F.col("source").alias("src")) if origins is None else edges.select(run, F.col("source").alias("src")).dropna().join(origins.select(run, F.col("id").alias("src")), [run, "src"], "left_semi")
        ids = windows.numbered_global(asked.distinct(), [F.col(run), F.col("src")], "o", 0)
        ids = materialize(ids.join(nodes.hint("merge"), (ids[run] == nodes[run]) & (F.col("src").cast(node) == F.col("node"))).select(ids[run], "src", "v", "o"), "origins")
        n_origins = ids.count()
        runs = materialize(nodes.groupBy(run).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "runs")
        largest = runs.agg(F.coalesce(F.max(F.col("hi") - F.col("lo") + 1), F.lit(1))).first()[0]
        width = 64 * max(1, min(-(-n_origins // (parts * 64)), WIDEST // 64, BLOCK_BYTES * 8 // largest // 64))
        n_blocks = -(-n_origins // width)
        ids = ids.join(runs, run).select(run, "src", "v", F.floor(F.col("o") / width).alias("block"), (F.col("o") % width).cast("int").alias("bit"), "lo", "hi")
        ends = nodes.select(run, F.col("node").alias("source"), F.col("v").cast("int").alias("s")).hint("merge"), nodes.select(run, F.col("node").alias("target"), F.col("v").cast("int").alias("t")).hint("merge")
        pairs = materialize(e.join(ends[0], [run, "source"]).join(ends[1], [run, "target"]).select("t", "s"), "pairs")
        discard(e)
        packed = pairs.repartitionByRange(max(parts, tasks(pairs.count())), "t", "s").sortWithinPartitions("t", "s")
        packed = materialize(packed.mapInArrow(_packs, "lo long, hi long, t binary, n binary, s binary"), "packed")
        discard(pairs)

    def begin(t: pa.Table) -> pa.Table:
        t = t.sort_by("bit")
        return pa.table({"at": t["block"].slice(0, 1), "first": t["bit"].slice(0, 1), "lo": t["lo"].slice(0, 1), "hi": t["hi"].slice(0, 1), "t": pa.array([t["v"].to_numpy().astype(np.int32).tobytes()], pa.binary())})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda x: np.frombuffer(x.as_buffer(), np.int32)
        packs, starts, n_bytes, written = [], [], 0, 0
        with tempfile.TemporaryFile() as file:
            for b in batches:
                for block, at, first, lo, hi, t, n, s in zip(*b.columns, strict=True):
                    if at.is_valid:
                        starts.append((block.as_py(), first.as_py(), lo.as_py(), hi.as_py(), ints(t)))
                        continue
                    cols = [ints(t), ints(n), ints(s)]
                    n_bytes += sum(c.nbytes for c in cols)
                    if n_bytes > HELD_BYTES:
                        cols = [slice(written + i, written + j) for i, j in pairwise(np.cumsum([0, *map(len, cols)]))]
                        written += sum(file.write(x.as_buffer()) for x in (t, n, s)) // 4
                    packs.append(_Pack(lo.as_py(), hi.as_py(), *cols))
            if written:
                file.flush()
                mapped = np.memmap(file, np.int32, "r")
                packs = [p._replace(t=mapped[p.t], n=mapped[p.n], s=mapped[p.s]) if isinstance(p.t, slice) else p for p in packs]
            packs.sort(key=lambda p: (p.lo, p.hi))
            for block, first, lo, hi, start in sorted(starts, key=lambda x: x[:2]):
                for d, before, after, n in _walk(packs, lo, hi, start, hops):
                    key = lambda k, d=d: [pa.array(np.full(k, block, np.int64)), pa.array(np.full(k, first, np.int32)), pa.array(np.full(k, d, np.int32))]
                    if not kept:
                        yield pa.RecordBatch.from_arrays([*key(1), pa.array([n.tolist()], pa.list_(pa.int64()))], ["block", "first", "dist", "n"])
                        continue
                    for i in range(0, len(after), 4096):
                        new = after[i : i + 4096] & ~before[i : i + 4096]
                        if len(v := np.flatnonzero(new.any(axis=1))):
                            yield pa.RecordBatch.from_arrays([*key(len(v)), pa.array(v + (i + lo)), _sets(new[v])], ["block", "first", "dist", "v", "new"])

    batch = max(1, BATCH_BYTES // BLOCK_BYTES)
    for b in range(0, n_blocks, batch):
        most = min(b + batch, n_blocks)
        begun = ids.where((F.col("block") >= b) & (F.col("block") < most)).groupBy("block", "lo", "hi").applyInArrow(begin, "at long, first int, lo long, hi long, t binary")
        with tidy_shuffles(spark):
            begun = materialize(begun, "frontier")
        lo, hi = begun.agg(F.min("lo"), F.max("hi")).first()
        none = {"at": F.lit(None).cast("long"), "first": F.lit(None).cast("int")}, {"n": F.lit(None).cast("binary"), "s": F.lit(None).cast("binary")}
        read = packed.where((F.col("hi") >= lo) & (F.col("lo") <= hi)).withColumns(none[0]).unionByName(begun.withColumns(none[1])).coalesce(1)
        met = read.crossJoin(spark.range(b, most, 1, most - b).withColumnRenamed("id", "block").hint("shuffle_replicate_nl")).where("at is null or at = block")
        with small_batches(spark):
            found = met.select("block", "at", "first", "lo", "hi", "t", "n", "s").mapInArrow(walk, "block long, first int, dist int, " + ("v long, new binary" if kept else "n array<long>"))
            found = materialize(found, "reached" if kept else "frontier")
        discard(begun)
        yield ids.select(run, "src", "block", "bit"), nodes, found
        if not kept:
            discard(found)
    discard(packed)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, first, dist, v, bit): which bits the sets of a row hold; sets of a batch may differ in width."""
    for b in batches:
        width = pc.binary_length(b["new"])
        for same in (b.filter(pc.equal(width, w)) for w in pc.unique(width)):
            for lo in range(0, same.num_rows, 1024):
                part = same.slice(lo, 1024)
                row, bit = np.nonzero(np.unpackbits(_matrix(pa.chunked_array([part["new"]]), np.uint8), axis=1, bitorder="little"))
                taken = part.drop_columns(["new"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bit.astype(np.int32))], [*taken.schema.names, "bit"])


def reach(edges: DataFrame, origins: DataFrame | None = None, hops: int | None = None, run: str = "run_id") -> DataFrame:
    """(run_id, src, dst, dist): nodes reached from each origin over any edge, by shortest distance, 1 to `hops`; the origin itself is left out.

    The output has a row per reached pair, which is what is asked for: pairs are spelled out at the end, from sets. For counts and sums take reach_sums, which never has them.
    """
    out = edges.select(run, F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1).alias("dist")).where("false")
    for ids, nodes, found in _frontiers(edges, origins, hops or max_hops(), run, True):
        pairs = found.mapInArrow(_bits, "block long, first int, dist int, v long, bit int").select("block", "dist", "v", (F.col("first") + F.col("bit")).alias("bit"))
        out = out.unionByName(pairs.join(nodes.select("v", F.col("node").alias("dst")).hint("merge"), "v").join(ids, ["block", "bit"]).select(run, "src", "dst", "dist"))
    return out


def reach_sums(edges: DataFrame, origins: DataFrame | None = None, hops: int | None = None, decay: float = DECAY, run: str = "run_id") -> DataFrame:
    """(run_id, src, reached, weight, farthest) of the origins that reach a node: how many, the sum of decay^(dist - 1), the largest distance.

    Sets are counted bit by bit in the tasks that hold them; only the counts are written."""
    out = edges.select(run, F.col("source").alias("src"), F.lit(0).cast("long").alias("reached"), F.lit(0.0).alias("weight"), F.lit(0).alias("farthest")).where("false")
    for ids, _, found in _frontiers(edges, origins, hops or max_hops(), run, False):
        with tidy_shuffles(edges.sparkSession):
            c = found.select("block", "first", "dist", F.posexplode("n").alias("bit", "n")).where("n > 0").withColumn("bit", F.col("first") + F.col("bit"))
            sums = decayed(c, decay).groupBy("block", "bit").agg(F.sum("n").alias("reached"), F.sum(F.col("n") * F.col("weight")).alias("weight"), F.max("dist").alias("farthest"))
            out = out.unionByName(materialize(ids.join(sums, ["block", "bit"]).select(run, "src", "reached", "weight", "farthest"), "sums"))
    return out


def decayed(reached: DataFrame, decay: float = DECAY) -> DataFrame:
    """reach() with `weight` = decay^(dist - 1), multiplied out so that sums agree bit for bit."""
    w = F.lit(1.0)
    table = [1.0]
    for _ in range(64):
        table.append(table[-1] * decay)
    for d in range(max_hops(decay), 1, -1):
        w = F.when(F.col("dist") == d, F.lit(table[d - 1])).otherwise(w)
    return reached.withColumn("weight", w)


def _doubles(a: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a, np.float64).tobytes()], pa.binary())


def _chunk(t: pa.Table) -> pa.Table:
    """A block of nodes as one row: teleports, out-degrees and first ranks of its nodes, and which runs they belong to (a run's nodes are neighbours)."""
    t = t.sort_by("v")
    q = t["q"].to_numpy()
    first = np.flatnonzero(np.diff(q, prepend=-1))
    row = {"q": q[first], "first": first.astype(np.int64), "deg": t["deg"].to_numpy(), "jump": t["jump"].to_numpy(), "rank": t["rank"].to_numpy()}
    return pa.table({"block": t["block"].slice(0, 1), **{c: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for c, a in row.items()}})


_STATE = "block long, slots int, value binary, q array<long>, lost array<double>"


def _state(chunk: dict, rank: np.ndarray, last: bool) -> pa.Table:
    """A block's shares per edge (its ranks, after the last step), and the rank that dangling nodes lose in each of its runs."""
    deg, q, first = (np.frombuffer(chunk[c], np.int64) for c in ("deg", "q", "first"))
    value = rank if last else np.divide(rank, deg, out=np.zeros(len(rank)), where=deg > 0)
    lost = np.add.reduceat(np.where(deg == 0, rank, 0.0), first)
    lists = [pa.array([q.tolist()], pa.list_(pa.int64())), pa.array([lost.tolist()], pa.list_(pa.float64()))]
    return pa.table([pa.array([chunk["block"]], pa.int64()), pa.array([chunk["slots"]], pa.int32()), _doubles(value), *lists], ["block", "slots", "value", "q", "lost"])


def _step(left: pa.Table, right: pa.Table, damping: float, last: bool) -> pa.Table:
    """A block's next ranks, from what flows to it and what its runs lose."""
    chunk = right.to_pylist()[0]
    q, first, jump = np.frombuffer(chunk["q"], np.int64), np.frombuffer(chunk["first"], np.int64), np.frombuffer(chunk["jump"])
    got, lost = np.zeros(len(jump)), np.zeros(len(q))
    for at, flow, run, x in zip(*(left[c] for c in ("at", "got", "run", "x")), strict=True):
        if not flow.is_valid:
            lost[np.searchsorted(q, run.as_py())] = x.as_py()
        elif at.is_valid:
            got[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(flow.as_buffer())
        else:
            got += np.frombuffer(flow.as_buffer())
    return _state(chunk, (1 - damping) * jump + damping * (got + np.repeat(lost, np.diff(first, append=len(jump))) * jump), last)


def _flowed(width: int, kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, at, got): what the nodes of a block get from a task's edges; without `at` all its nodes. Flows of HELD edges are summed at a time."""

    def met(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        t, flow = (np.concatenate(c) for c in zip(*held, strict=True))
        least = int(t.min())
        if int(t.max()) - least < 4 * len(t):
            got = np.bincount(t - least, flow)
            at = np.flatnonzero(got)
            got, at = got[at], at + least
        else:
            at, place = np.unique(t, return_inverse=True)
            got = np.bincount(place, flow)
        at = at.astype(np.int64)
        block = at // width
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))  # none where all flows are zero
        local, rows = (at - block * width).astype(np.int32), list(zip(cuts[:-1], cuts[1:], strict=True))
        places = pa.array([None if j - i == width else local[i:j].tobytes() for i, j in rows], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), places, pa.array([got[i:j].tobytes() for i, j in rows], pa.binary())], ["block", "at", "got"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for value, s, t in zip(b["value"], b["s"], b["t"], strict=True):
                held.append((np.frombuffer(t.as_buffer(), kind), np.frombuffer(value.as_buffer())[np.frombuffer(s.as_buffer(), np.int32)]))
                n += len(held[-1][0])
                if n >= HELD:
                    yield met(held)
                    held, n = [], 0
        if held:
            yield met(held)

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, iterations: int = ITERATIONS, damping: float = DAMPING, run: str = "run_id") -> DataFrame:
    """(run_id, node, rank) after a fixed number of iterations.

    nodes (run_id, id); edges (run_id, source, target), parallel ones counted in shares. Ranks start at 1/n. Teleport is uniform, or over the seeds
    that are nodes. A dangling node's rank goes to the teleport; what flows to targets that aren't nodes is lost.

    Nodes are numbered and cut into blocks, a row of arrays each. Edges are written once as pairs of numbers, packed by block of their source, and bucketed; a block with many has several
    rows. A step never moves or sorts edges: it deals the blocks' shares to the edges' buckets, and what flows to a block, summed in each task, is the one large shuffle: some rows per task
    and block, at most a number per edge. So nodes and edges are never rows in a step.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy_shuffles(spark):
        ids = materialize(nodes.select(run, F.col("id").alias("node")).dropna().distinct(), "ids")
        numbers = materialize(windows.numbered_global(ids, [F.col(run), F.col("node")], "v", 0), "nodes")
        size = numbers.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("q"))
        s = numbers.where("false") if seeds is None else numbers.join(seeds.select(run, F.col("id").alias("node")).distinct(), [run, "node"], "left_semi")
        s = materialize(s.select(run, "v", F.lit(1).alias("seed")), "seeds")
        runs = materialize(size.join(s.groupBy(run).agg(F.count(F.lit(1)).alias("k")), run, "left").fillna(0, ["k"]), "runs")
        n_runs, total = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        few, width = n_runs <= BROADCAST_RUNS, max(1, min(BLOCK, -(-total // (8 * parts))))
        short = total < 1 << 31
        by_run = lambda df: F.broadcast(df) if few else df
        v = F.col("v").cast("int") if short else F.col("v")
        ends = numbers.select(run, F.col("node").alias("source"), v.alias("s")).hint("merge"), numbers.select(run, F.col("node").alias("target"), v.alias("t")).hint("merge")
        flows = edges.select(run, "source", "target").dropna().join(ends[0], [run, "source"]).join(ends[1], [run, "target"], "left").select("s", "t")
        flows = materialize(flows, "flows")
        block = lambda c: F.floor(F.col(c) / width)
        slots = materialize(flows.groupBy(block("s").alias("block")).agg(F.ceil(F.count("t") / HUB).cast("int").alias("slots")), "slots")
        deg = flows.groupBy(F.col("s").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("deg"))
        jump = F.when(F.col("k") == 0, F.lit(1.0) / F.col("n")).when(F.col("seed") == 1, F.lit(1.0) / F.col("k")).otherwise(F.lit(0.0))
        base = numbers.join(by_run(runs), run).join(s.select("v", "seed").hint("merge"), "v", "left").join(deg.hint("merge"), "v", "left")
        base = base.select(block("v").alias("block"), "v", "q", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), jump.alias("jump"), (F.lit(1.0) / F.col("n")).alias("rank"))
        chunks = base.groupBy("block").applyInArrow(_chunk, "block long, q binary, first binary, deg binary, jump binary, rank binary")
        chunks = materialize(chunks.join(slots, "block", "left").fillna(0, ["slots"]), "chunks")
        begun = runs.select((F.col("q") / width).cast("long").alias("lo"), ((F.col("q") + F.col("n") - 1) / width).cast("long").alias("hi"), F.col("q").alias("run"))
        begun = materialize(begun.select("run", F.explode(F.sequence("lo", "hi")).alias("block")), "begun")
    discard(ids, s)
    kind = np.int32 if short else np.int64

    def pack(t: pa.Table) -> pa.Table:
        at, slot = t["source"][0].as_py(), t["slot"][0].as_py()
        s = (t["s"].to_numpy().astype(np.int64) - at * width).astype(np.int32)
        return pa.table({"source": [at], "slot": pa.array([slot], pa.int32()), **{c: pa.array([a.tobytes()], pa.binary()) for c, a in (("s", s), ("t", t["t"].to_numpy().astype(kind)))}})

    def start(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: (x for b in batches for c in b.to_pylist() for x in _state(c, np.frombuffer(c["rank"]), last).to_batches())

    def step(last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda left, right: _step(left, right, damping, last)

    # rows are dealt to the slots of their block by their number, which parallel edges can't unbalance
    dealt = flows.where("t is not null").withColumn("i", F.monotonically_increasing_id()).withColumn("source", block("s")).join(F.broadcast(slots.withColumnRenamed("block", "source")), "source")
    dealt = dealt.select("source", F.pmod("i", "slots").cast("int").alias("slot"), "s", "t")
    packed = dealt.groupBy("source", "slot").applyInArrow(pack, "source long, slot int, s binary, t binary")
    with small_batches(spark), bucketed(packed, ["source", "slot"]) as flows_by_source, tidy_shuffles(spark):
        discard(flows)
        state = materialize(chunks.mapInArrow(start(not iterations), _STATE), "ranks")
        for i in range(iterations):
            share = state.where("slots > 0").select(F.col("block").alias("source"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "value")
            got = flows_by_source.join(share.hint("merge"), ["source", "slot"]).select("value", "s", "t").mapInArrow(_flowed(width, kind), "block long, at binary, got binary")
            lost = state.select(F.explode(F.arrays_zip("q", "lost")).alias("l")).groupBy(F.col("l.q").alias("run")).agg(F.sum("l.lost").alias("x")).where("x <> 0")
            lost = begun.join(by_run(lost), "run").select("block", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("got"), "run", "x")
            left = got.select("*", F.lit(None).cast("long").alias("run"), F.lit(None).cast("double").alias("x")).unionByName(lost)
            last = i == iterations - 1
            before, state = state, materialize(left.groupBy("block").cogroup(chunks.groupBy("block")).applyInArrow(step(last), _STATE), "ranks")
            discard(before)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, value in zip(b["block"], b["value"], strict=True):
                rank = np.frombuffer(value.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rank)) + at.as_py() * width), pa.array(rank)], ["v", "rank"])

    with tidy_shuffles(spark):
        ranks = materialize(state.select("block", "value").mapInArrow(spelled, "v long, rank double").hint("merge").join(numbers, "v").select(run, "node", "rank"), "ranks")
    discard(numbers, runs, slots, chunks, begun, state)
    return ranks


def roots(nodes: DataFrame, edges: DataFrame, entries: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, id) where a call tree begins: the entries; in runs without any, nodes that nothing calls; without those, all nodes."""
    entries = entries.select(run, "id").distinct()
    rest = nodes.join(entries.select(run).distinct(), run, "left_anti")
    uncalled = rest.join(edges.select(run, F.col("target").alias("id")).distinct(), [run, "id"], "left_anti").select(run, "id")
    neither = rest.join(uncalled.select(run).distinct(), run, "left_anti").select(run, "id")
    return entries.unionByName(uncalled).unionByName(neither)


def neighborhood(focus: DataFrame, edges: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, id): the focus and what is one edge away, either direction."""
    f = focus.select(run, "id")
    out = edges.join(f, (edges[run] == f[run]) & (edges["source"] == f["id"]), "left_semi").select(run, F.col("target").alias("id"))
    back = edges.join(f, (edges[run] == f[run]) & (edges["target"] == f["id"]), "left_semi").select(run, F.col("source").alias("id"))
    return f.unionByName(out).unionByName(back).distinct()


def call_chains(edges: DataFrame, start: DataFrame, depth: int, run: str = "run_id") -> DataFrame:
    """(run_id, path, closed): chains from the start nodes, to a depth; a child that is already an ancestor is shown, and not expanded.

    One recursive query, whose rows are the chains themselves: bound start and depth, as their number grows with the branching. Each level is an equi-join of open chains and edges;
    distinct edges are written first, as every level runs the plan of its edges anew.
    """
    spark = edges.sparkSession
    name = f"chains_{uuid.uuid4().hex}"
    materialize(edges.select(run, F.col("source").alias("at"), F.col("target").alias("next")).distinct(), "calls").createOrReplaceTempView(f"{name}_edges")
    start.select(run, F.array("id").alias("path")).createOrReplaceTempView(f"{name}_start")
    try:
        return spark.sql(f"""
            WITH RECURSIVE chains(r, path, closed, depth) MAX RECURSION LEVEL {depth + 2} AS (
              SELECT {run}, path, false, 0 FROM {name}_start
              UNION ALL
              SELECT c.r, concat(c.path, array(e.next)), array_contains(c.path, e.next), c.depth + 1
              FROM chains c JOIN {name}_edges e ON e.{run} = c.r AND e.at = element_at(c.path, -1)
              WHERE NOT c.closed AND c.depth < {depth}
            )
            SELECT r AS {run}, path, closed FROM chains""")
    finally:
        spark.catalog.dropTempView(f"{name}_edges")
        spark.catalog.dropTempView(f"{name}_start")
