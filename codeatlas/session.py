"""Session settings, and tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task sorts or keeps in hash maps, where their number is known.
TASK_ROWS = 500_000


def builder(app: str = "codeatlas") -> SparkSession.Builder:
    """A builder with the settings the library counts on: UTC, adaptive execution with skew handling, Arrow."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder and a cluster
    one below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="codeatlas-")
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_codeatlas"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_kept: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("kept", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What materialize() writes within the block is removed at its end: for work whose results are written elsewhere by then."""
    tables: list[DataFrame] = []
    token = _kept.set(tables)
    try:
        yield
    finally:
        _kept.reset(token)
        discard(*tables)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that loops keep short plans and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeatlas/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (kept := _kept.get()) is not None:
        kept.append(out)
    return out


def tasks(rows: int) -> int:
    """How many tasks keep each at about TASK_ROWS rows, for repartition(): unlike the session's number, it grows with the input."""
    return max(1, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """df in `parts` tasks by `_deal`, a hash of the keys. Aggregates and windows by (_deal, keys) need no exchange then, even where a key is a literal, which Spark drops from theirs."""
    return df.withColumn("_deal", F.xxhash64(*keys)).repartition(parts, "_deal")


@contextlib.contextmanager
def bucketed(df: DataFrame, keys: list[str]) -> Iterator[DataFrame]:
    """df written in buckets of its keys, sorted, one file a bucket: joins and aggregates on the keys need no exchange of it. Table and files go at the end."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"codeatlas_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/codeatlas/{name}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    try:
        out = spark.table(name)
        yield out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        out._written_to = path
        discard(out)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within the block go as soon as it is written: for rounds that write their own results."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches that go to Python within the block are cut at 32 MB, however long their rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(32 << 20))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame) -> DataFrame:
    """Leaves a table that materialize() wrote within scratch() to the caller."""
    kept = _kept.get()
    if kept is not None:
        kept[:] = [t for t in kept if t is not df]
    return df


def discard(*tables: DataFrame) -> None:
    """Removes what materialize wrote, once all that reads it is written itself. Other tables are left alone."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
            df._written_to = None
