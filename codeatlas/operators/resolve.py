"""Ordered and guarded joins: the five ways in which names and paths are resolved.

All of them are equi-joins with a combinable aggregate (min_by, max_by, count), so they partition by the key that is looked up and
never compare every row with every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules that may be broadcast.
BROADCAST_RULES = 10_000


def candidate_join(left: DataFrame, candidates: Column, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """left with `hit`, the first of its `candidates` (an array in order of preference) that is a `key` of right, and `hit_rank`
    (from 0). Rows of left are told apart by `by`. Without a hit both are null. right's keys may repeat."""
    known = right.select(F.col(key).alias("_key")).where(F.col(key).isNotNull()).distinct()
    tried = left.select(*by, F.posexplode(candidates).alias("_rank", "_key"))
    best = tried.join(known, "_key").groupBy(*by).agg(F.min_by("_key", "_rank").alias("hit"), F.min("_rank").alias("hit_rank"))
    return left.join(best, by, "left")


def path_prefixes(path: Column, separator: str = "/") -> Column:
    """All proper directory prefixes of a path, shortest first."""
    s = F.split(path, separator)
    return F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.array_join(F.slice(s, F.lit(1), i), separator))).otherwise(F.array().cast("array<string>"))


def longest_prefix(left: DataFrame, path: str, areas: DataFrame, area_path: str, order: str, by: list[str], root: str | None = ".") -> DataFrame:
    """left with the columns of the area whose path is the longest directory prefix of `path`.

    A theta join ("starts with area + '/'") turned into an equi-join on exploded prefixes. `root` matches everything and counts as
    one character long, so it ties with areas of one character; the smallest `order` wins ties. A path equal to an area's doesn't match it.
    """
    keys = path_prefixes(F.col(path))
    keys = F.concat(F.array(F.lit(root)), keys) if root is not None else keys
    tried = left.select(*by, F.explode(keys).alias("_prefix"))
    ranked = F.struct(F.length("_prefix").alias("n"), (-F.col(order)).alias("o"), F.struct(*[areas[c] for c in areas.columns]).alias("area"))
    best = tried.join(areas, F.col("_prefix") == areas[area_path]).groupBy(*by).agg(F.max(ranked).alias("_best"))
    return left.join(best, by, "left").select(*left.columns, *[F.col(f"_best.area.{c}").alias(f"area_{c}") for c in areas.columns])


def first_rule(left: DataFrame, text: str, rules: DataFrame, pattern: str, is_prefix: str, rank: str, by: list[str]) -> DataFrame:
    """left with `rule_rank` and `rule_pattern` of the first rule, by rank, that matches: exactly, or as a prefix where is_prefix is true.

    Rules are a project's alias table, some tens of rows, and are broadcast where a count finds them few; exact rules and all prefixes of the text
    up to the longest one of a rule are looked up by equality. The texts' prefixes are many times the rows of left, and are never the side that is broadcast.
    """
    longest, n = rules.agg(F.coalesce(F.max(F.when(F.col(is_prefix), F.length(pattern))), F.lit(0)), F.count(F.lit(1))).first()
    lengths = F.sequence(F.lit(0), F.least(F.length(text), F.lit(longest)))
    prefixes = F.transform(lengths, lambda n: F.struct(F.lit(True).alias("p"), F.substring(F.col(text), F.lit(1), n).alias("k")))
    keys = F.concat(F.array(F.struct(F.lit(False).alias("p"), F.col(text).alias("k"))), prefixes)
    tried = left.select(*by, F.explode(keys).alias("_t")).select(*by, F.col("_t.p").alias("_p"), F.col("_t.k").alias("_k"))
    r = rules.select(F.col(is_prefix).alias("_p"), F.col(pattern).alias("_k"), F.col(rank).alias("_rank"))
    best = tried.join(F.broadcast(r) if n <= BROADCAST_RULES else r.hint("merge"), ["_p", "_k"]).groupBy(*by).agg(F.min("_rank").alias("rule_rank"), F.min_by("_k", "_rank").alias("rule_pattern"))
    return left.join(best, by, "left")


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """left with `out`: right's `value` for the keys if there is exactly one such row, else null; and out_n, how many there are."""
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{out}_n"), F.min(value).alias("_v"))
    return left.join(one, keys, "left").withColumn(out, F.when(F.col(f"{out}_n") == 1, F.col("_v"))).withColumn(f"{out}_n", F.coalesce(f"{out}_n", F.lit(0))).drop("_v")


def with_veto(local: str, local_n: str, fallback: Column) -> Column:
    """The local match; the fallback only where nothing local has the name (an ambiguous local name vetoes it)."""
    return F.when(F.col(local_n) == 0, fallback).otherwise(F.col(local))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`, by a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equally new ones that with the largest tie."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(*keys, "_r.*")


def priority_cascade(left: DataFrame, by: list[str], tries: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """left with `value` and `how`: from the first of the named tries (each with `by` and `value`, one row a key at most) that has one."""
    out = left
    for k, (_, t) in enumerate(tries):
        out = out.join(t.select(*by, F.col(value).alias(f"_v{k}")), by, "left")
    got = F.coalesce(*[F.col(f"_v{k}") for k in range(len(tries))])
    how = F.lit("none")
    for k in reversed(range(len(tries))):
        how = F.when(F.col(f"_v{k}").isNotNull(), F.lit(tries[k][0])).otherwise(how)
    return out.withColumn(value, got).withColumn("how", how).drop(*[f"_v{k}" for k in range(len(tries))])


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right lacks."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def uncontradicted(rows: DataFrame, root: str, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose root nothing contradicts, (root, why)): all contradictions of the first source come before those of the second; each has
    (root, ord, why), and a root keeps its first."""
    both = first.select(root, F.lit(0).alias("_s"), "ord", "why").unionByName(second.select(root, F.lit(1).alias("_s"), "ord", "why"))
    why = both.groupBy(root).agg(F.min_by("why", F.struct("_s", "ord")).alias("why"))
    return rows.join(why, root, "left_anti"), why
