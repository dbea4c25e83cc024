"""Streaming ingestion of call rows into a store, each call once, and rates of calls over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schema import CALLS_IO
from ..sources.store import Store


def ingest_calls(rows: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True, late: str | None = None, event_time: str = "ts") -> StreamingQuery:
    """Append a stream of calls_io rows to a store.

    A micro-batch is appended by an anti-join with what is stored (a call that was dropped and arrives again is new), and the manifest records the number of the last batch under
    `name` in the same swap that makes its rows visible, so a batch that is replayed after a failure is skipped. With `late`,
    rows that repeat within that time of event_time are dropped before, which keeps the joins small.
    """
    if late is not None:
        rows = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["call_hid", "name"])

    def append(batch: DataFrame, number: int) -> None:
        with store.transaction():
            if store.manifest()["streams"].get(name, -1) >= number:
                batch.write.format("noop").mode("overwrite").save()  # the state of earlier operators must still advance
                return
            fresh = batch.select(CALLS_IO.names).dropDuplicates(["call_hid", "name"]).join(store.calls_io.select("call_hid", "name"), ["call_hid", "name"], "left_anti")
            written = store.write_batch("calls_io", fresh)

            def visible(manifest: dict) -> None:
                manifest["tables"]["calls_io"].append(written)
                manifest["streams"][name] = number

            store.change(visible)

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def call_rates(rows: DataFrame, window: str = "1 hour", late: str = "1 hour", event_time: str = "ts", slide: str | None = None) -> DataFrame:
    """Calls by op and window of event time; with a stream, windows close once the watermark passes them."""
    outs = rows.where("direction = 'out'").withWatermark(event_time, late)
    return outs.groupBy(F.window(event_time, window, slide) if slide else F.window(event_time, window), "op").agg(F.count("*").alias("calls")).select("window.start", "window.end", "op", "calls")
