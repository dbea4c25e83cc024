"""Streams of call rows: each call once, replays skipped, late rows dropped."""

import datetime as dt

from pyspark.sql import functions as F

from tracelake import Store
from tracelake.operators import provenance
from tracelake.sources.schema import CALLS_IO
from tracelake.streaming import call_rates, ingest_calls


def files(spark, path, calls, start=0):
    rows = [(f"c{i}", n, d, f"cc{i}", f"r{i}{n}", f"h{i}{n}", "f", None, None, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=i)) for i in calls for n, d in (("x", "in"), ("y", "out"))]
    schema = "call_hid string, name string, direction string, call_cid string, ref_cid string, ref_hid string, op string, semantic_version string, content_version string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return schema


def test_each_call_is_stored_once(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    schema = files(spark, path, [*range(5), 3])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    ingest_calls(stream(), store, "calls", str(tmp_path / "ck")).awaitTermination(120)
    assert store.calls_io.count() == 10
    files(spark, path, range(3, 8))
    ingest_calls(stream(), store, "calls", str(tmp_path / "ck")).awaitTermination(120)
    assert store.calls_io.count() == 16 and provenance.count_calls(store).first()["calls"] == 8
    assert store.manifest()["streams"]["calls"] >= 1
    # the same input under a new checkpoint replays batch 0, which the manifest knows
    ingest_calls(stream(), store, "calls", str(tmp_path / "ck2"), late="1 day").awaitTermination(120)
    assert store.calls_io.count() == 16
    assert store.calls_io.columns == CALLS_IO.names


def test_rates_by_window(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = files(spark, path, range(0, 130, 10))
    batch = call_rates(spark.read.schema(schema).parquet(path))
    assert sorted(r["calls"] for r in batch.collect()) == [1, 6, 6]
    query = call_rates(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("calls")).first()[0] == 13
