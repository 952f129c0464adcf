"""Passes over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize


def islands(df: DataFrame, partition: list[str], order: list[Column], key: Column) -> DataFrame:
    """df with `island`, the number (from 1) of its run of rows with an equal key."""
    w = Window.partitionBy(*partition).orderBy(*order)
    d = df.withColumn("_k", key)
    new = F.when(F.lag("_k").over(w).eqNullSafe(F.col("_k")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = d.withColumn("_new", new)
    return d.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_k", "_new")


def numbered(df: DataFrame, partition: list[str], order: list[Column], name: str = "ord", start: int = 1) -> DataFrame:
    """Gapless numbers within a partition: the sequential ids of a run."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) + (start - 1))


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """df with its keys renamed, and the condition that joins it with a table that has them; nulls are equal."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        df, on = df.withColumnRenamed(k, f"_key{i}"), on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df, on


def blocks(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """df sorted by partition and order over all tasks and written, with `_block` (the task's range, ascending) and `_pos` (the row's place in it, from 0).

    Ranges are cut anywhere, within a large partition too, so passes over `_block` are even where passes over the partition aren't. It is written because ranges come from a
    sample, and everything computed from blocks must see the same ones.
    """
    by = [*map(F.col, partition), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    found = materialize(place, "blocks")
    # an id holds the number of the task above 33 bits of the row's place
    return found.withColumn("_block", F.shiftright("_place", 33)).withColumn("_pos", F.col("_place") - F.shiftleft(F.shiftright("_place", 33), 33)).drop("_place")


def _offsets(sizes: DataFrame, what: str) -> DataFrame:
    """(_block, _before): the sums of `what` of all earlier blocks; a row per task of a sort."""
    rows, total = [], 0
    for block, size in sorted(sizes.select("_block", what).collect()):
        rows.append((block, total))
        total += size
    return F.broadcast(sizes.sparkSession.createDataFrame(rows, "_block long, _before long"))


def numbered_global(df: DataFrame, order: list[Column], name: str = "ord", start: int = 1, keep_blocks: bool = False) -> DataFrame:
    """Gapless numbers over all rows: a row's place in its block after the rows of earlier blocks. No window at all; the driver sees a count per block."""
    b = blocks(df, [], order)
    out = b.join(_offsets(b.groupBy("_block").agg(F.count(F.lit(1)).alias("_c")), "_c"), "_block").withColumn(name, F.col("_before") + F.col("_pos") + start).drop("_before")
    return out if keep_blocks else out.drop("_block", "_pos")


def numbered_split(df: DataFrame, partition: list[str], order: list[Column], name: str = "ord", start: int = 1, keep_blocks: bool = False) -> DataFrame:
    """numbered() for partitions of any size: numbers over all rows, less the first of the partition."""
    g = numbered_global(df, [*map(F.col, partition), *order], "_g", 0, keep_blocks=True)
    first, on = _keyed(g.groupBy(*partition).agg(F.min("_g").alias("_first")), partition)
    out = g.join(first, on).select(*df.columns, "_block", "_pos", (F.col("_g") - F.col("_first") + start).alias(name))
    return out if keep_blocks else out.drop("_block", "_pos")


def _shifted(columns: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row of a task with the named columns of its next row; the last row has none, and is `_open`. The task's first row is `_head`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun = None, False

        def out(b: pa.Table, after: list[pa.ChunkedArray], open_: bool) -> pa.RecordBatch:
            nonlocal begun
            marks = [pa.chunked_array([pa.array(np.full(b.num_rows, open_))]), pa.chunked_array([pa.array(np.arange(b.num_rows) < (not begun))])]
            begun = True
            return pa.Table.from_arrays([*b.columns, *after, *marks], [*b.column_names, *columns, "_open", "_head"]).combine_chunks().to_batches()[0]

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b] if last is None else [last, b])
                if t.num_rows > 1:
                    yield out(t.slice(0, t.num_rows - 1), [t[c].slice(1) for c in columns.values()], False)
                last = b.slice(b.num_rows - 1)
        if last is not None:
            yield out(pa.Table.from_batches([last]), [pa.chunked_array([pa.nulls(1, last[c].type)]) for c in columns.values()], True)

    return run


def next_split(df: DataFrame, partition: list[str], order: list[Column], value: str, name: str, kept: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """df (or its columns `kept`) with `name`, the value of the next row of its partition, null at the end. `ordered`: partitions lie side by side in the order alone, as days do in time.

    Rows are sorted over all tasks, cut anywhere, and read once; the last row of a task looks at the first one of the next task that has rows, so a row per task is all that is joined."""
    by, n = [*([] if ordered else map(F.col, partition)), *order], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.columns if kept is None else kept
    wanted = [c for c in df.columns if c in {*kept, *partition, value}]
    after = {f"_key{i}": k for i, k in enumerate(partition)} | {"_next": value}
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in wanted] + [T.StructField(a, kinds[c]) for a, c in after.items()] + [T.StructField(c, T.BooleanType()) for c in ("_open", "_head")])
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by).select(*wanted).mapInArrow(_shifted(after), schema).withColumn("_block", F.spark_partition_id())
    same = F.lit(True)
    for i, k in enumerate(partition):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    found = materialize(rows.select(*wanted, F.when(same, F.col("_next")).alias("_next"), "_open", "_head", "_block"), "next")
    heads = found.where("_head").select(*partition, F.col(value).alias("_after"), "_block")
    heads = heads.withColumn("_before", F.lag("_block").over(Window.partitionBy(F.lit(0)).orderBy("_block"))).drop("_block")  # a row per task
    heads, on = _keyed(heads, partition)
    out = found.join(F.broadcast(heads), F.col("_open") & (F.col("_block") == F.col("_before")) & on, "left")
    return out.select(*kept, F.coalesce("_next", "_after").alias(name))


def running_split(b: DataFrame, partition: list[str], name: str, value: Column, how: str = "sum") -> DataFrame:
    """blocks() with `name`, the sum or the maximum of value over the partition's rows up to each: within its block, and over the summaries of the earlier blocks of the partition.

    A window over (partition, block) reads a block of rows at most; the one over a partition's summaries a row per block."""
    f = {"sum": F.sum, "max": F.max}[how]
    v = b.withColumn("_v", value)
    inner = v.withColumn("_in", f("_v").over(Window.partitionBy(*partition, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)))
    ends = v.groupBy(*partition, "_block").agg(f("_v").alias("_end"))
    ends = ends.withColumn("_prior", f("_end").over(Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    ends, on = _keyed(ends, [*partition, "_block"])
    both = F.coalesce(F.col("_in") + F.col("_prior"), "_in", "_prior") if how == "sum" else F.greatest("_in", "_prior")
    return inner.join(ends, on).select(*b.columns, both.alias(name))


def islands_split(df: DataFrame, partition: list[str], order: list[Column], key: Column) -> DataFrame:
    """islands() for partitions of any size, by a segmented scan: runs are counted within blocks, a scan over block summaries (first and last key, runs) adds the runs of earlier blocks,
    and a block whose first key equals the last one before it continues that run."""
    b = blocks(df.withColumn("_k", key), partition, order)
    w = Window.partitionBy(*partition, "_block").orderBy("_pos")
    b = b.withColumn("_new", F.when(F.lag("_k").over(w).eqNullSafe(F.col("_k")) & (F.row_number().over(w) > 1), 0).otherwise(1))
    b = b.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = b.groupBy(*partition, "_block").agg(F.min_by(F.struct("_k"), "_pos").alias("_head"), F.max_by(F.struct("_k"), "_pos").alias("_tail"), F.max("_in").alias("_runs"))
    w = Window.partitionBy(*partition).orderBy("_block")
    s = s.withColumn("_same", (F.lag("_tail").over(w)["_k"].eqNullSafe(F.col("_head")["_k"]) & (F.row_number().over(w) > 1)).cast("int"))
    s = s.withColumn("_more", F.coalesce(F.sum(F.col("_runs") - F.col("_same")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_same"))
    s, on = _keyed(s.select(*partition, "_block", "_more"), [*partition, "_block"])
    return b.join(s, on).select(*df.columns, (F.col("_in") + F.col("_more")).alias("island"))


def slugs(df: DataFrame, partition: list[str], base: Column, order: list[Column]) -> DataFrame:
    """df with `slug`: the base, and from its second occurrence on the base with '-2', '-3', ..."""
    d = df.withColumn("_b", base)
    n = F.row_number().over(Window.partitionBy(*partition, "_b").orderBy(*order))
    return d.withColumn("_n", n).withColumn("slug", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("-"), F.col("_n").cast("string")))).drop("_b", "_n")


def first_breach(df: DataFrame, partition: list[str], order: list[Column], rules: list[tuple[str, Column]]) -> DataFrame:
    """Of each partition the first row at which a running rule is true, and the name of the first such rule there.

    Rules may use the columns n_so_far and window sums over `running(partition, order)`."""
    w = running(partition, order)
    d = df.withColumn("n_so_far", F.count(F.lit(1)).over(w))
    code = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        code = F.when(rule, F.lit(name)).otherwise(code)
    d = d.withColumn("code", code).where("code is not null")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy("n_so_far"))).where("_n = 1").drop("_n")


def running(partition: list[str], order: list[Column]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cooldown(df: DataFrame, key: str, at: str, ident: str, seconds: int) -> DataFrame:
    """(key, ident, at, granted, remaining): a request is granted if the key has no granted one in the last `seconds`; else remaining says how many
    whole seconds are left. The comparison is with the last *granted* request, so it is an orbit, not a lag.

    A key's requests are numbered in order of time and `ident`. Each points to the first one at least `seconds` later; the granted ones are those that the first one leads to. They are
    found by pointer doubling: after k rounds all grants up to the 2^k-th are marked and pointers span 2^k steps, so rounds grow with the logarithm of a key's grants. Every
    join is on (key, number), which no hot key can unbalance, and is a merge join: the tables between rounds take little room as files, so that the planner would broadcast millions of rows.
    `at` is a timestamp; rows without a key or a time are left out.
    """
    span = F.lit(max(0, seconds) * 1_000_000).cast("long")
    r = df.select(key, F.col(ident).alias("_ident"), F.col(at).alias("_at"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).dropna(subset=[key, "_t"])
    r = numbered_split(r, [key], [F.col("_t"), F.col("_ident")], "_n", keep_blocks=True)
    r = materialize(r, "requests")
    line = r.select(key, "_t", F.lit(1).alias("_kind"), "_n").unionByName(r.select(key, (F.col("_t") + span).alias("_t"), F.lit(0).alias("_kind"), "_n"))
    line = blocks(line, [key], [F.col("_t"), F.col("_kind"), F.col("_n")])
    ahead = running_split(line, [key], "_seen", F.col("_kind")).where("_kind = 0")
    jump = materialize(ahead.select(key, "_n", F.greatest(F.col("_seen") + 1, F.col("_n") + 1).alias("_next")), "jumps")
    granted = r.where("_n = 1").select(key, "_n")
    while jump.take(1):
        landed = granted.join(jump.hint("merge"), [key, "_n"]).select(key, F.col("_next").alias("_n"))
        granted = materialize(granted.unionByName(landed), "granted")
        after = jump.select(F.col(key).alias("_k"), F.col("_n").alias("_m"), F.col("_next").alias("_after"))
        before, jump = jump, materialize(jump.join(after.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("_next") == F.col("_m"))).select(key, "_n", F.col("_after").alias("_next")), "jumps")
        discard(before)
    out = r.join(granted.withColumn("granted", F.lit(True)).hint("merge"), [key, "_n"], "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
    out = running_split(out, [key], "_last", F.when(F.col("granted"), F.col("_t")), "max")
    left = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_last") + span - F.col("_t")) / 1_000_000).cast("long"))
    return out.select(key, F.col("_ident").alias(ident), F.col("_at").alias(at), "granted", F.when(F.col("granted"), F.lit(0).cast("long")).otherwise(left).alias("remaining"))


def nearest_span(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, ident: str) -> DataFrame:
    """points with `ident` of the innermost span [start, end) of the same keys that holds the point: the one that starts last (the largest ident among equals).

    Starts and points of a key are sorted onto one line and read once. A stack holds the open spans that a later point may still need: a span that ends
    no later than one that starts after it never answers again. So rows and memory grow with points and spans, never with their product.
    """
    value = points.schema[point].dataType.simpleString()
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType)
    own = [c for c in points.columns if c not in keys]
    opened = spans.select(*keys, F.col(start).cast(value).alias("_at"), F.lit(0).alias("_kind"), F.col(end).cast(value).alias("_end"), F.col(ident).alias(ident), *[none(c, points).alias(c) for c in own])
    asked = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(value).alias("_end"), none(ident, spans).alias(ident), *own)
    line = opened.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "_at", "_kind", ident)
    kept = [*keys, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []
        for batch in batches:
            rows, answers = [], []
            columns = [batch[c].to_pylist() for c in (*keys, "_at", "_kind", "_end", ident)]
            for i, (*k, at, kind, stop, name) in enumerate(zip(*columns, strict=True)):
                if k != key:
                    key, stack = k, []
                if kind:
                    while stack and at is not None and stack[-1][0] <= at:
                        stack.pop()
                    rows.append(i)
                    answers.append(stack[-1][1] if stack and at is not None else None)
                elif at is not None and stop is not None and stop > at:
                    while stack and stack[-1][0] <= stop:
                        stack.pop()
                    stack.append((stop, name))
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[some[c] for c in kept], pa.array(answers, batch[ident].type)], [*kept, ident])

    schema = T.StructType([*[points.schema[c] for c in kept], T.StructField(ident, spans.schema[ident].dataType)])
    return line.mapInArrow(run, schema)


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each key; of equally frequent ones the first seen."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    best = c.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col("_o")).alias("o"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(value), F.col("_b.n").alias("n"))


def by_priority(df: DataFrame, keys: list[str], value: str, priority: list[str]) -> DataFrame:
    """(keys, value): the value that stands first in `priority` among those present, whatever the counts."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(value))
    return df.withColumn("_p", F.when(rank > 0, rank)).where("_p is not null").groupBy(*keys).agg(F.min_by(value, "_p").alias(value))
