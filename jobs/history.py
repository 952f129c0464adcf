"""Activity history, kept up to date as events arrive.

A file stream with a checkpoint takes the files that are new. Each batch is added to the job's own table of events, by day and batch, and then the history of the days that the batch
touches is computed anew from that table and replaces these days' partitions: late events end up in the right entries, and other days aren't read. A batch that is run again
after a failure writes the same partitions with the same rows.

    output/events    day=..., batch=...: events as they came
    output/rejected  batch=...: events without an id, a user or a time, which have no place in a history
    output/entries   day=...: runs of a user's events of one type, newest first: number, type, size, summed value, leading (newest) event, first and last time

Files may bring an event again: events are told apart by day and id, and of different versions the smallest counts, whatever came first. A user or a day may hold any share of the events:
runs are found by a segmented scan over ranges that are cut anywhere.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators import windows
from codeatlas.session import scratch

log = logging.getLogger(__name__)

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
STORED = f"{EVENTS}, day string, batch long"
ENTRIES = "user_id long, entry long, event_type string, n_events long, total_value double, lead_event_id long, started timestamp_ntz, ended timestamp_ntz, day string"


def entries(events: DataFrame) -> DataFrame:
    """History entries of events (day, EVENTS...)."""
    version = F.min(F.struct("ts", "user_id", "event_type", "value")).alias("v")
    e = events.groupBy("day", "event_id").agg(version).select("day", "event_id", "v.*")
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    runs = windows.islands_split(e, ["day", "user_id"], order, F.col("event_type"))
    newest = F.struct("ts", "event_id")
    return runs.groupBy("day", "user_id", F.col("island").cast("long").alias("entry")).agg(
        F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("total_value"), F.max_by("event_id", newest).alias("lead_event_id"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
    )


def _replace(df: DataFrame, path: str, *by: str) -> int:
    """Writes df's partitions over those of the table at path; returns the rows written."""
    seen = Observation()
    rows = df.hint("rebalance", *by).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def add_batch(batch: DataFrame, number: int, output: str) -> dict:
    """One batch of the stream; the same batch again gives the same tables."""
    spark = batch.sparkSession
    rows = batch.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").withColumn("batch", F.lit(number).cast("long"))
    whole = F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("user_id").isNotNull()
    added = _replace(rows.where(whole).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), f"{output}/events", "day", "batch")
    rejected = _replace(rows.where(~whole), f"{output}/rejected", "batch")
    counts = {"batch": number, "read": added + rejected, "rejected": rejected, "entries": 0}
    if added:
        stored = spark.read.schema(STORED).parquet(f"{output}/events")
        touched = stored.where(F.col("batch") == number).select("day").distinct()
        with scratch():
            counts["entries"] = _replace(entries(stored.join(touched, "day", "left_semi")), f"{output}/entries", "day")
    log.info("batch %(batch)d: read %(read)d events, rejected %(rejected)d, wrote %(entries)d entries of the days touched", counts)
    return counts


def run(spark: SparkSession, input: str, output: str, checkpoint: str, files_per_batch: int = 1000) -> dict:
    """Takes all files at `input` (a folder, or a pattern of files or folders) that the checkpoint doesn't know, and returns what was read and written in all."""
    totals = {"batches": 0, "read": 0, "rejected": 0, "entries": 0}

    def each(batch: DataFrame, number: int) -> None:
        counts = add_batch(batch, number, output.rstrip("/"))
        totals["batches"] += 1
        for k in ("read", "rejected", "entries"):
            totals[k] += counts[k]

    log.info("reading what is new at %s", input)
    files = spark.readStream.schema(spark.read.parquet(input).schema).option("maxFilesPerTrigger", files_per_batch).parquet(input)
    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %(read)d events in %(batches)d batches, rejected %(rejected)d, wrote %(entries)d entries", totals)
    return totals


def read_entries(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{output.rstrip('/')}/entries")


if __name__ == "__main__":
    from jobs import _cli

    _cli.main("history", __doc__.split("\n")[0], run, {"input": str, "output": str, "checkpoint": str, "files_per_batch": int})
