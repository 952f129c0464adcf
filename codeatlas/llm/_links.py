"""Links between similar items, from shared signatures to verified components, without pairs inside a group.

Items that share a signature are candidates. Instead of all pairs of a bucket:

1. a bucket's hub is its member that meets most others anywhere; every item is verified against the best of its hubs (pairs that short
   sketches of the sets already exclude aren't looked at further);
2. what components of those links leave apart is verified against its other hubs, a row per (hub, member);
3. of the buckets that stay mixed, those of at most SMALL members give their pairs across components;
4. larger ones are verified in square blocks: a task gets two slices of a family of mixed buckets and multiplies their feature
   matrices; it returns only the links that join components. So every candidate pair is verified, joined already, or of sizes that
   rule it out, and no link between components is lost.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, discard, materialize, maybe_broadcast, n_parts

#: Members of a bucket whose pairs are listed; members and bytes of text in a slice of a family; columns of a feature matrix that are multiplied
#: at once.
SMALL, SLICE_ROWS, SLICE_BYTES, COLUMNS = 16, 1024, 2 << 20, 2048

Features = Callable[[pa.Array], Iterable[np.ndarray]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def similar(both, na, nb, percent: int):
    """Jaccard similarity of at least percent / 100, in whole numbers."""
    return (100 * both >= percent * (na + nb - both)) & (both > 0)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets at the left with all at the right, by products of 0/1 matrices."""
    values, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    out = np.zeros((len(left), len(right)), "f4")
    sizes = [len(x) for x in (*left, *right)]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(where, minlength=len(values))
    useful = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[useful] = np.arange(len(useful))
    where = column[where]
    rows, where = rows[where >= 0], where[where >= 0]
    for lo in range(0, len(useful), COLUMNS):
        part = (where >= lo) & (where < lo + COLUMNS)
        m = np.zeros((len(sizes), min(COLUMNS, len(useful) - lo)), "f4")
        m[rows[part], where[part] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype("i8")


def _verify_star(features: Features, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            ids = batch["u"].to_pylist()
            new = [i for i in {u: i for i, u in reversed(list(enumerate(ids)))}.values() if ids[i] not in kept]
            kept.update(zip([ids[i] for i in new], features(batch["text_u"].take(pa.array(new, pa.int64()))), strict=True))
            us, vs = [], []
            for u, v, b in zip(ids, batch["v"].to_pylist(), features(batch["text_v"]), strict=True):
                a = kept[u]
                if similar(overlap(a, b), len(a), len(b), percent):
                    us.append(u)
                    vs.append(v)
            while len(kept) > 64:
                kept.popitem(last=False)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _verify_block(features: Features, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        part, ids, comps = table["part"].to_numpy(), table["id"].to_pylist(), table["comp"].to_pylist()
        us, vs = [], []
        if len(set(comps)) > 1:
            sets = list(features(table["text"].combine_chunks()))
            left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            both = intersections([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets])
            link = similar(both, size[left][:, None], size[right][None, :], percent)
            root = {c: c for c in comps}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in zip(*np.nonzero(link), strict=True):
                a, b = left[i], right[j]
                x, y = find(comps[a]), find(comps[b])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    us.append(ids[a])
                    vs.append(ids[b])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _sketched(features: Features):
    """Adds the size n of a text's set, and its sketch: the lowest 16 bits of each feature, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(features(batch["text"]))
            sketches = [np.sort(s.astype("u2")).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], pa.array([len(x) for x in sets], pa.int32()), pa.array(sketches, pa.binary())], ["id", "text", "n", "sketch"])

    return run


def _maybe_similar(percent: int):
    """Pairs (u, v) whose sketches allow the similarity. Equal features have equal bits, so counting bits in common never counts too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, np.zeros(0, "u2")
        for batch in batches:
            us, vs = [], []
            for u, v, x, y in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), batch["sketch_u"], batch["sketch_v"], strict=True):
                if u != last:
                    last, a = u, np.bincount(np.frombuffer(x.as_py(), "u2"), minlength=1 << 16)
                values, counts = np.unique(np.frombuffer(y.as_py(), "u2"), return_counts=True)
                if similar(int(np.minimum(a[values], counts).sum()), int(a.sum()), int(counts.sum()), percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _verified(pairs: DataFrame, text: DataFrame, features: Features, percent: int, name: str, sketches: bool) -> DataFrame:
    """The pairs (u, v) that are similar: sizes that rule it out go first; where few are expected to be similar, sketches sort out others. The hub
    is joined last, so that rows of a hub follow each other."""

    def joined(pairs: DataFrame, items: DataFrame, column: str) -> DataFrame:
        rows = pairs.join(items.select(F.col("id").alias("v"), F.col(column).alias(f"{column}_v")), "v")
        return rows.join(items.select(F.col("id").alias("u"), F.col(column).alias(f"{column}_u")), "u").select("u", "v", f"{column}_u", f"{column}_v")

    fit = joined(pairs, text, "n").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent).select("u", "v")
    pairs = materialize(fit, "pairs")
    if sketches:
        pairs = materialize(joined(pairs, text, "sketch").mapInArrow(_maybe_similar(percent), "u long, v long"), "maybe")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    text = text.select("id", "text").join(maybe_broadcast(ids, 2 * pairs.count()), "id", "left_semi")
    return materialize(joined(pairs, text, "text").mapInArrow(_verify_star(features, percent), "u long, v long"), name)


def link_components(signatures: DataFrame, texts: Callable[[DataFrame, int], DataFrame], features: Features, percent: int) -> DataFrame:
    """(id, root): the component of every item that is linked with another; root is its smallest id.

    signatures: (sig long, id long); similar items share one. texts(ids, n) gives (id, text) of n distinct ids, where rows may repeat. features turns a column
    of texts into their sorted sets of 64-bit features.
    """
    # the explicit filter keeps both readers of this exchange alike, so that it is made once
    s = signatures.where("sig is not null").repartition(n_parts(signatures), "sig")
    # buckets of two items or more, told by their ends without gathering them; buckets of equal content count as one
    h = F.xxhash64("id")
    ends = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 32)).alias("x"), F.sum(h.bitwiseAND(F.lit(2**32 - 1))).alias("y")]
    buckets = s.groupBy("sig").agg(*ends).where("lo < hi")
    buckets = buckets.groupBy("lo", "hi", "n", "x", "y").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("m")).select("sig", (F.col("m") * F.col("n")).alias("w"))
    members = materialize(s.join(buckets, "sig").distinct(), "members")
    degree = materialize(members.groupBy("id").agg(F.sum("w").alias("d")), "degree")
    n_items = degree.count()
    if n_items == 0:
        return members.select("id", F.col("id").alias("root"))
    text = texts(degree.select("id"), n_items).mapInArrow(_sketched(features), "id long, text string, n int, sketch binary")
    text = materialize(text, "candidates")
    if text.count() > n_items:  # rows that repeat an id
        once, text = text, materialize(text.groupBy("id").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "candidates")
        discard(once)
    weighed = members.join(maybe_broadcast(degree, n_items), "id")
    hubs = weighed.groupBy("sig").agg(F.max(F.struct("d", F.bitwise_not("id").alias("id"))).alias("top"), F.count(F.lit(1)).alias("size"))
    hubs = materialize(hubs.select("sig", F.col("top.d").alias("d"), F.bitwise_not("top.id").alias("hub"), "size"), "hubs")

    # 1. every item against the hub, of all its buckets', that meets most others
    star = members.join(hubs, "sig").where("id <> hub")
    best = star.groupBy("id").agg(F.max(F.struct("d", "hub")).alias("top")).select(F.col("top.hub").alias("u"), F.col("id").alias("v"))
    best = materialize(best, "star")
    links = _verified(best, text, features, percent, "links", sketches=False)
    comps = materialize(connected_components(links), "components")

    # 2. against the hubs of its other buckets, unless they belong together by now
    other = star.select("id", "hub").distinct().join(best.select(F.col("u").alias("hub"), F.col("v").alias("id")), ["hub", "id"], "left_anti")
    other = _with_root(_with_root(other, comps, "id", "a"), comps, "hub", "b").where("a <> b").select(F.col("hub").alias("u"), F.col("id").alias("v"))
    links = links.unionByName(_verified(materialize(other, "star"), text, features, percent, "links", sketches=True))
    comps = materialize(connected_components(links), "components")

    # 3. pairs of small buckets that stay mixed; buckets of two are settled
    left = _mixed(members.join(hubs.where((F.col("size") > 2) & (F.col("size") <= SMALL)), "sig").where("id <> hub").select("sig", "id"), comps)
    one = F.array_sort(F.collect_list(F.struct("id", "comp")))  # SMALL entries at most
    later = lambda x, i: F.transform(F.filter(F.slice("all", i + 2, SMALL), lambda y: y["comp"] != x["comp"]), lambda y: F.struct(x["id"].alias("u"), y["id"].alias("v")))
    pairs = left.groupBy("sig").agg(one.alias("all")).select(F.explode(F.flatten(F.transform("all", later))).alias("p")).select("p.*").distinct()
    pairs = materialize(pairs, "star")
    if pairs.take(1):
        links = links.unionByName(_verified(pairs, text, features, percent, "links", sketches=True))
        comps = materialize(connected_components(links), "components")

    # 4. blocks of families of large buckets that stay mixed
    left = _mixed(members.join(hubs.where(F.col("size") > SMALL), "sig").select("sig", "id", "hub"), comps)
    left = materialize(left.select("id", "comp", "hub").distinct(), "mixed")
    if not left.take(1):
        discard(members, degree, text, hubs, best, left)
        return comps.select(F.col("node").alias("id"), "root")
    families = connected_components(left.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")))
    people = left.select("id", "comp").distinct().join(families, F.col("id") == F.col("node")).select("id", "comp", F.col("root").alias("family"))
    people = materialize(people, "people")
    people = text.select("id", "text").join(maybe_broadcast(people, people.count()), "id").withColumn("bytes", F.octet_length("text"))
    people = materialize(people, "families")
    sizes = people.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / SLICE_ROWS), F.ceil(F.sum("bytes") / SLICE_BYTES)).cast("int").alias("k"), F.min("comp").alias("a"), F.max("comp").alias("b")
    ).where("a < b")
    people = people.join(sizes.select("family", "k"), "family").withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    blocks = people.withColumn("other", other).select(
        "family", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "comp", "text"
    )
    # dealt by block: without this, rows would stay where the join by family has put them, a family in one task
    blocks = blocks.repartition(n_parts(text), "family", "lo", "hi")
    more = blocks.groupBy("family", "lo", "hi").applyInArrow(_verify_block(features, percent), "u long, v long")
    every = links.unionByName(materialize(more, "links"))
    comps = materialize(connected_components(every), "components")
    discard(members, degree, text, hubs, best, left, people)
    return comps.select(F.col("node").alias("id"), "root")


def _mixed(placed: DataFrame, comps: DataFrame) -> DataFrame:
    """placed (sig, id, ...) with the item's component `comp`, of the buckets that hold more than one component."""
    placed = _with_root(placed, comps, "id", "comp")
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a < _b").select("sig")
    return placed.join(mixed, "sig")


def _with_root(df: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    """df with the component of `column`; an item without links is its own."""
    c = comps.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(c, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", column)).drop("_node", "_root")
