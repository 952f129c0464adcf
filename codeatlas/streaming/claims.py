"""An extension: cooldowns as keyed state of a stream, with the grants of operators.windows.cooldown.

A key's state is the time of its last grant. It is dropped by an event-time timer once the cooldown is over, so state grows with the keys that are cooling down, not with all keys seen.
Requests come in order of time from batch to batch; within a batch a key's requests are sorted. One that is older than the key's last grant is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: State with timers is kept by this provider; the session needs it before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Cooldown(StatefulProcessor):
    """Rows (ident, t), t in microseconds, to rows with granted and remaining whole seconds."""

    def __init__(self, key: str, seconds: int):
        self.key, self.span = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.last.get() if self.last.exists() else None
        last, before = (kept[0], kept[0]) if kept is not None else (None, None)
        # a batch's requests of one key: Spark bounds batches
        for r in sorted(rows, key=lambda r: (r.t, r.ident)):
            ok = last is None or last + self.span <= r.t
            left = 0 if ok else max(0, -((r.t - last - self.span) // 1_000_000))
            last = r.t if ok else last
            yield Row(**{self.key: key[0], "ident": r.ident, "granted": ok, "remaining": left})
        if last != before:
            self.last.update((last,))
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def _ends(self, last: int) -> int:
        """Milliseconds at which the cooldown is over for certain."""
        return -(-(last + self.span) // 1000)

    def close(self) -> None:
        pass


def grants(requests: DataFrame, key: str, at: str, ident: str, seconds: int) -> DataFrame:
    """(key, ident, granted, remaining) of a stream of requests; `at` is a timestamp. Requests without a key or a time are left out."""
    t = F.col(at).cast("timestamp")
    kind = requests.schema[key].dataType.simpleString()
    r = requests.select(F.col(key), F.col(ident).cast("long").alias("ident"), t.alias("at"), F.unix_micros(t).alias("t")).where(F.col(key).isNotNull() & F.col("t").isNotNull())
    return r.withWatermark("at", "0 seconds").groupBy(key).transformWithState(Cooldown(key, seconds), f"{key} {kind}, ident long, granted boolean, remaining long", "Append", "EventTime")


def stream_grants(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: str = "user_id", at: str = "ts", ident: str = "event_id", seconds: int = 3600) -> StreamingQuery:
    """Appends the grants of requests in the Parquet files that are new in `folder` to Parquet at `out`, and ends."""
    found = grants(spark.readStream.schema(schema).parquet(folder), key, at, ident, seconds)
    writer = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return writer.start()  # a stream keeps the settings that it was started with
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
