"""An extension: commit payloads that arrive as files are classified batch by batch. The operators are those of plans.history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import history
from ..sources import files


def stream_facts(spark: SparkSession, folder: str, areas: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the facts of commit details (JSON lines with run_id and body) that arrive in `folder` to Parquet at `out`. A batch that is run again replaces itself."""
    rows = spark.readStream.schema("run_id string, body string").json(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        history.facts(files.commit_files(batch), areas).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
