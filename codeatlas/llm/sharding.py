"""Sharding by balanced label propagation, with DataFrame expressions only.

Documents that belong to one group (equal texts, or any group column) are linked. They begin in shards drawn by
hash and then move towards the shard that holds most of their neighbours, as far as quotas let them: between two
shards as much may flow one way as the other way, plus the room that is free. A unit of movement is an atom, the
rows of a group that share a first shard and a slice of it, so a group too large for a shard is moved in parts.
A last pass evens the shards out with rows that have the fewest links and numbers the rows of each shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Rows in one slice of a group, at most about; a slice moves as a whole.
SLICE = 64

#: Rounds end when no more than this part of the linked weight moves.
SETTLED = 0.001

#: Rows of one bucket in the two-level running sums; no window partition is much larger.
BUCKET = 2048


def _two_level(df: DataFrame, group: list[str], order: list[Column], amount: Column, rows: int, out: str) -> DataFrame:
    """df with the sum of `amount` over all rows of its group that precede the row, in order of `order` (its first
    column a uniform hash). Rows are dealt into buckets by the hash's top bits; bucket totals are summed in a window over
    buckets, and rows only within their own bucket, so no task sees the rows of a whole group."""
    bits = max(1, min(40, math.ceil(math.log2(max(1, rows / BUCKET)))))
    d = df.withColumn("_b", F.shiftrightunsigned(order[0], 64 - bits)).withColumn("_x", amount)
    totals = d.groupBy(*group, "_b").agg(F.sum("_x").alias("_t"))
    # offsets over buckets: a row per bucket of a group, in one window per group
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    w = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_x").over(w), F.lit(0))).join(offsets, [*group, "_b"])
    return d.withColumn(out, F.col("_o") + F.col("_in")).drop("_b", "_x", "_o", "_in")


def _propagate(atoms: DataFrame, shards: int, total: int, rounds: int, slack: float) -> DataFrame:
    """atoms (ga, gb, first, slice, weight, shard) after as many rounds as move more than SETTLED of the weight. Only atoms with neighbours are given."""
    capacity = total / shards * (1 + slack)
    for r in range(rounds):
        pull = atoms.groupBy("ga", "gb", "shard").agg(F.sum("weight").alias("held"))
        # of each group: the shard that holds most (ties by hash), and what lies where
        best = pull.groupBy("ga", "gb").agg(F.max(F.struct("held", F.xxhash64("ga", "shard").alias("tie"), "shard")).alias("top"), (F.sum("held") <= total / shards / 4).alias("small"))
        held = pull.join(best, ["ga", "gb"]).select("ga", "gb", "shard", "held", "small", F.col("top.shard").alias("want"), F.col("top.held").alias("there"))
        a = atoms.join(held, ["ga", "gb", "shard"])
        a = a.withColumn("gain", F.col("there") - F.col("held") + F.col("weight")).withColumn("moves", (F.col("want") != F.col("shard")) & (F.col("gain") > 0))
        # quotas: a table of shards x shards rows at most
        flow = a.where("moves").groupBy("shard", "want").agg(F.sum("weight").alias("out"), F.coalesce(F.sum(F.when(F.col("small"), F.col("weight"))), F.lit(0)).alias("out_small"))
        back = flow.select(F.col("shard").alias("want"), F.col("want").alias("shard"), F.col("out").alias("back"))
        linked = atoms.groupBy("shard").agg(F.sum("weight").alias("load"))
        # rows without neighbours are spread evenly and give way: what is linked may fill a shard
        asked = flow.groupBy("want").agg(F.sum("out").alias("asked"))
        room = asked.join(linked.withColumnRenamed("shard", "want"), "want", "left").select("want", "asked", F.greatest(F.lit(0.0), capacity - F.coalesce("load", F.lit(0))).alias("room"))
        # small groups go first, as large ones are split in any case
        let = F.least("out", F.coalesce("back", F.lit(0))) + F.col("room") * F.col("out") / F.col("asked")
        large = F.col("out") - F.col("out_small")
        quota = flow.join(back, ["shard", "want"], "left").join(room, "want").select(
            "shard", "want",
            F.when(F.col("out_small") > 0, F.least(F.lit(1.0), let / F.col("out_small"))).otherwise(F.lit(0.0)).alias("part_small"),
            F.when(large > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), let - F.col("out_small")) / large)).otherwise(F.lit(0.0)).alias("part_large"),
        )
        a = a.join(F.broadcast(quota), ["shard", "want"], "left")  # shards x shards rows
        drawn = F.pmod(F.xxhash64("ga", "gb", "first", "slice", F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
        go = F.col("moves") & (drawn < F.when(F.col("small"), F.col("part_small")).otherwise(F.col("part_large")))
        a = materialize(a.select("ga", "gb", "first", "slice", "weight", F.when(go, F.col("want")).otherwise(F.col("shard")).alias("shard"), go.alias("went")), "atoms")
        atoms = a.drop("went")
        went, every = a.agg(F.sum(F.when(F.col("went"), F.col("weight"))), F.sum("weight")).first()
        if (went or 0) <= SETTLED * (every or 0):
            break
    return atoms


def cut(placed: DataFrame, group: list[str]) -> DataFrame:
    """(links, cut, cut_by_hash) of rows with group columns, doc_id and shard: pairs of rows of one group, those in two shards, and those that a
    placement by a hash of doc_id would part. Pairs are counted from the groups' sizes by shard, never listed. Null groups have no links; no rows give zeros."""
    shards = (placed.agg(F.max("shard")).first()[0] or 0) + 1
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    rows = placed.dropna(subset=group).select(*group, "shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).alias("drawn"))
    counts = rows.groupBy(*group, "shard", "drawn").agg(F.count(F.lit(1)).alias("n"))
    figures = [counts.groupBy(*group, *by).agg(F.sum("n").alias("n")).select(*[F.when(F.lit(c == name), pairs).alias(c) for c in ("links", "shard", "drawn")]) for name, by in (("links", []), ("shard", ["shard"]), ("drawn", ["drawn"]))]
    three = figures[0].unionByName(figures[1]).unionByName(figures[2]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("links", "shard", "drawn")])
    return three.select("links", (F.col("links") - F.col("shard")).alias("cut"), (F.col("links") - F.col("drawn")).alias("cut_by_hash"))


def shard_rows(docs: DataFrame, shards: int = 8, group: Column | None = None, law: str = "rows", rounds: int = 12, slack: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) for every row of docs.

    docs has doc_id and text; other columns are ignored. `group` is the column whose equal values link rows (default: the
    text). Null texts are empty texts, and linked with them; a row with a null group has no links. law `rows`: shards differ
    by one row at most. law `bytes`: by about the largest row. Repeated rows, of equal doc_id or not, each have their slot.
    Ties are broken by hashes of doc_id, so reruns agree. Texts are only hashed and measured, whatever their length. An empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = text if group is None else group
    # equal rows (doc_id, text) are told apart by a number, found within their key alone
    d = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(key).alias("ga"), F.xxhash64(F.lit(7919), key).alias("gb"), key.isNull().alias("alone"),
    )
    d = d.withColumn("h", F.xxhash64("doc_id", "text_crc32", F.lit(11))).withColumn("first", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).cast("int"))
    d = materialize(d, "docs")
    unit = F.lit(1) if law == "rows" else F.col("size")
    n, total = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(unit), F.lit(0))).first()
    groups = d.where("not alone").groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("n_group")).where("n_group > 1")
    groups = materialize(groups, "groups")  # so that the join below is of two plain exchanges, which adaptive execution can split
    d = materialize(d.join(groups, ["ga", "gb"], "left").withColumn("n_group", F.when(F.col("alone"), None).otherwise(F.col("n_group"))), "docs")
    d = d.withColumn("slice", F.when(F.col("n_group").isNotNull(), F.pmod(F.col("h"), F.ceil(F.col("n_group") / (SLICE * shards)))))
    linked = d.where("n_group is not null")
    atoms = linked.groupBy("ga", "gb", "first", "slice").agg(F.sum(unit).alias("weight")).withColumn("shard", F.col("first"))
    atoms = _propagate(materialize(atoms, "atoms"), shards, total, rounds, slack)
    moved = linked.join(atoms.drop("weight"), ["ga", "gb", "first", "slice"]).unionByName(d.where("n_group is null").withColumn("shard", F.col("first")))
    links = F.coalesce("n_group", F.lit(1))
    # where rows leave a shard, those of a small group stand next to each other and go together
    unit_hash = F.when((links > 1) & (links <= SLICE), F.xxhash64("ga", "gb")).otherwise(F.col("h"))
    moved = moved.select("doc_id", "size", "text_crc32", "h", "shard", links.alias("links"), unit_hash.alias("u"))
    even = _even_out(materialize(moved, "moved"), shards, law, n, total)
    numbered = _two_level(even, ["shard"], [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.lit(1), max(1, n // shards), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


def _even_out(d: DataFrame, shards: int, law: str, n: int, total: int) -> DataFrame:
    """Rows leave shards above their share, and fill the others: first rows without links, then rows of large groups, then small groups."""
    unit = F.lit(1) if law == "rows" else F.col("size")
    share = [total // shards + (k < total % shards) for k in range(shards)]
    load = dict(d.groupBy("shard").agg(F.sum(unit)).collect())  # one row per shard
    load = {k: load.get(k, 0) for k in range(shards)}
    order = sorted(range(shards), key=lambda k: (-load[k], k))
    share = {k: s for k, s in zip(order, share, strict=True)}  # fuller shards get the larger shares
    over = {k: load[k] - share[k] for k in range(shards) if load[k] > share[k]}
    if not over:
        return d
    level = F.when(F.col("links") == 1, 0).when(F.col("links") > SLICE, 1).otherwise(2)
    excess = F.create_map(*[F.lit(x) for k, v in over.items() for x in (k, v)])
    d = d.withColumn("level", level)
    by_level = d.groupBy("shard", "level").agg(F.sum(unit).alias("t"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("shard").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(by_level.withColumn("base", F.coalesce(F.sum("t").over(w), F.lit(0))).select("shard", "level", "base"))  # shards x 3 rows
    keys = [F.col("u"), F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rank = _two_level(d, ["shard", "level"], keys, unit, max(1, n // shards), "pos").join(before, ["shard", "level"])
    rank = rank.withColumn("leaves", F.col("pos") + F.col("base") + (F.lit(0) if law == "rows" else unit / 2) < F.coalesce(F.element_at(excess, F.col("shard")), F.lit(0)))
    rank = materialize(rank.drop("base", "pos", "level"), "ranked")
    stay, go = rank.where("not leaves").drop("leaves"), rank.where("leaves").drop("leaves")
    # those that leave stand on one line, cut into the lengths that the others lack
    line = _two_level(go.withColumn("all", F.lit(0)), ["all"], keys, unit, max(1, sum(over.values()) if law == "rows" else n), "pos").drop("all", "shard")
    target, at = F.lit(None).cast("int"), 0
    lacking = [(k, share[k] - load[k]) for k in range(shards) if load[k] < share[k]]
    for k, v in reversed(lacking):
        target = F.when(F.col("pos") < sum(x for j, x in lacking if j <= k), F.lit(k)).otherwise(target)
    target = F.coalesce(target, F.lit(lacking[-1][0] if lacking else 0))
    return materialize(stay.unionByName(line.withColumn("shard", target).drop("pos").select(*stay.columns)), "even")
