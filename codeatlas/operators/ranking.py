"""Sorts, limits and pages."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from . import windows


def page_count(n: int, size: int) -> int:
    return max(1, -(-n // size))


def clamp_page(page: Column, pages: Column) -> Column:
    """A page number that exists: 1 where it can't be read."""
    return F.least(F.greatest(F.coalesce(F.expr("null").cast("int") if page is None else page.try_cast("int"), F.lit(1)), F.lit(1)), F.greatest(pages, F.lit(1)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of one page. Spark keeps offset + limit rows of each partition, not a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


class Pages:
    """Any page of a sorted table by reading the blocks that hold it.

    The table is sorted once over all tasks and written by block, a folder each; counts per block are the index. A page's rows are those with consecutive numbers, so only the folders
    that its numbers fall into are read, the last page as fast as the first. `order` must tell rows apart.
    """

    def __init__(self, df: DataFrame, order: list[Column], size: int, block_rows: int = 1_000_000):
        self.spark, self.size, self.columns = df.sparkSession, size, df.columns
        g = windows.numbered_global(df, order, "_ord", 0)
        self.path = f"{shared_dir(self.spark)}/codeatlas/pages-{uuid.uuid4().hex}"
        rows = g.withColumn("_part", F.floor(F.col("_ord") / block_rows).cast("long"))
        rows.repartition("_part").write.partitionBy("_part").parquet(self.path)
        self.block_rows, self.schema = block_rows, rows.schema
        self.rows = self.spark.read.schema(rows.schema).parquet(self.path).count()

    def page(self, number: int) -> DataFrame:
        """The rows of a page with `ord` from 1; numbers that don't exist are clamped to the first or the last page."""
        first = (min(max(number, 1), page_count(self.rows, self.size)) - 1) * self.size
        last = min(first + self.size, self.rows) - 1
        parts = F.col("_part").between(first // self.block_rows, max(first, last) // self.block_rows)
        found = self.spark.read.schema(self.schema).parquet(self.path).where(parts & F.col("_ord").between(first, last))
        return found.select(*self.columns, (F.col("_ord") + 1).alias("ord"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, bins: int = 1024) -> DataFrame:
    """(keys, value): the exact quantile of each group, interpolated between the two middle values, by selection: no group's values meet in one task or state.

    Rounds narrow each group's two ranks to one value: a round counts the values of the group's present range in `bins` equal parts, with each part's least and largest value; the part that
    holds the rank is the next range. A range of one value ends its rank. Nulls and NaNs don't count. A round reads the input once and shuffles a row per group, part and task at most.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.lit(True))
    top = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array(F.floor(place).cast("long"), F.ceil(place).cast("long"))
    todo = top.select(*[F.col(k).alias(f"_{k}") for k in keys], "lo", "hi", (place - F.floor(place)).alias("_part"), F.posexplode(ranks).alias("_which", "_rank"))
    todo = materialize(todo, "ranks")
    own = [f"_{k}" for k in keys]
    done = []
    while True:
        done.append(todo.where("lo = hi").select(*own, "_part", "_which", F.col("lo").alias("_found")))
        open_ = todo.where("lo < hi")
        if not open_.take(1):
            break
        # halves first, as the width of a range may be beyond what a double holds
        step = F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)
        inside = v.join(open_, same).where("_v between lo and hi").withColumn("_bin", F.least(F.greatest(step, F.lit(0)), F.lit(bins - 1)))
        counts = inside.groupBy(*own, "_part", "_which", "_rank", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = Window.partitionBy(*own, "_which").orderBy("_bin")  # a row per part
        counts = counts.withColumn("_upto", F.sum("_c").over(w)).where("_rank >= _upto - _c and _rank < _upto")
        todo = materialize(counts.select(*own, "lo", "hi", "_part", "_which", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")), "ranks")
    found = reduce(DataFrame.unionByName, done).groupBy(*own, "_part").agg(F.max(F.when(F.col("_which") == 0, F.col("_found"))).alias("a"), F.max(F.when(F.col("_which") == 1, F.col("_found"))).alias("b"))
    mid = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("_part")) * F.col("a") + F.col("_part") * F.col("b"))
    return found.select(*[F.col(f"_{k}").alias(k) for k in keys], mid.alias(value))


def page_items(current: int, pages: int, siblings: int = 1) -> list[int | str]:
    """The numbers of a pager: the first, the last, the current one and its siblings, and '…' where more than one is left out."""
    shown = sorted({1, pages, *range(max(1, current - siblings), min(pages, current + siblings) + 1)})
    out: list[int | str] = []
    for n in shown:
        if out and n - out[-1] == 2:
            out.append(n - 1)
        elif out and n - out[-1] > 2:
            out.append("…")
        out.append(n)
    return out


def reverse_stable(order: list[Column], desc: bool) -> list[Column]:
    """The keys of a sort whose descending form is the reverse of the ascending one, ties included."""
    return [c.desc() if desc else c.asc() for c in order]


def featured(df: DataFrame, name: str, pinned: list[str], newest: str, tie: str, most: int = 6) -> DataFrame:
    """Pinned rows in their order, then the newest, `most` in all, with `place` from 1. The pinned list is a short constant."""
    rank = F.array_position(F.array(*map(F.lit, pinned)), F.col(name))
    top = df.withColumn("_pin", F.when(rank > 0, rank).otherwise(F.lit(2**31 - 1).cast("long"))).orderBy("_pin", F.desc(newest), tie).limit(most)
    w = Window.orderBy("_pin", F.desc(newest), tie)  # `most` rows
    return top.withColumn("place", F.row_number().over(w)).drop("_pin")


def area_order(non_primary: str, links: str, entries: str, name: str, collate: bool = True) -> list[Column]:
    """Implementation areas first, then by links, entry points and name."""
    last = F.expr(f"collate({name}, 'UNICODE')") if collate else F.col(name)
    return [F.col(non_primary).asc(), F.col(links).desc(), F.col(entries).desc(), last.asc()]


def importance_order(score: str = "score", name: str = "name", ordinal: str = "ord") -> list[Column]:
    return [F.coalesce(F.col(score), F.lit(0)).desc(), F.col(name).asc(), F.col(ordinal).asc()]


def round_robin(df: DataFrame, partition: list[str], list_order: str, index: str, most: int = 7) -> DataFrame:
    """Interleaves lists by index: all firsts in order of list, then all seconds, ...; `most` rows per partition, renumbered as `place`."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(index, list_order))
    return df.withColumn("place", n).where(F.col("place") <= most)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each key; the planner limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
