"""What the operators share: paths in the folder all executors see, bounds of batches and broadcasts, components of a graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, shared_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of (id, payload) with fixed width that may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 200_000


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark)}/codeatlas/{name}-{uuid.uuid4().hex}"


def n_parts(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Batches that go to Python hold so many bytes at most (or one row), whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for narrow tables counted to be small; else the planner shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the smallest node of its component.

    Alternating large-star and small-star rounds: each keeps the components and pulls nodes towards
    their smallest neighbour, in O(log^2 n) rounds. Minima are combined before the shuffle, and a hub
    meets its edges in a plain equi-join, which adaptive execution splits if it is skewed; minima of few edges (their number is
    known) are broadcast. Null nodes and self-loops are dropped. Each round is written to the shared folder.
    """
    e = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct()
    e = materialize(e, "edges")
    seen = _fingerprint(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(maybe_broadcast(low, 2 * seen[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(maybe_broadcast(low, 2 * seen[0]), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        before, e = e, materialize(small.select("x.*").where("u <> v").distinct(), "edges")
        discard(before)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
