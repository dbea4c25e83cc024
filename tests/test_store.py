"""Transactions, tombstones, locks, and bulk calls with versions, variable arguments and lists."""

import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle

from tracelake import MList, Storage, op
from tracelake.sources import shared
from tracelake.sources.store import Store
from tracelake.streaming.ingest import ingest_calls

from .test_versions import Code


@pytest.fixture
def storage(spark):
    return Storage(spark)


@pytest.fixture
def code():
    c = Code("bulk_code")
    c.run("from tracelake import op, track\n")
    cloudpickle.register_pickle_by_value(c.module)  # executors have no such module
    yield c
    cloudpickle.unregister_pickle_by_value(c.module)
    sys.modules.pop(c.module.__name__)


def calls(storage):
    return {r[0] for r in storage.store.calls_io.select("call_hid").distinct().collect()}


def halve(x):
    return x // 2


def test_dropped_calls_come_back(storage, spark, tmp_path):
    o = op(halve, returns="long")
    df = spark.createDataFrame([(8,), (9,)], "x long")
    for again in range(2):
        with storage:
            o(40)
        storage.over(o, df).collect()
        assert len(calls(storage)) == 3 and storage.hits_and_misses(o, df).where("hit").count() == 2
        storage.drop_calls(storage.store.calls_io.select("call_hid").distinct())
        assert not calls(storage) and storage.hits_and_misses(o, df).where("hit").count() == 0
        if again:
            storage.vacuum()
    assert storage.store.raw("calls_io").count() == 0
    with storage:
        o(40)
    storage.drop_calls(storage.store.calls_io.select("call_hid"))
    with storage:
        o(40)
    storage.vacuum()
    assert len(calls(storage)) == 1 and storage.store.raw("calls_io").count() == 2


def test_a_stream_brings_back_what_was_dropped(spark, tmp_path):
    first = Storage(spark)
    o = op(halve, returns="long")
    first.over(o, spark.range(1, 6).toDF("x")).collect()
    rows = first.store.calls_io
    rows.write.parquet(str(tmp_path / "in" / "a"))
    store = Store(spark)

    def feed(name):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "*"))
        ingest_calls(stream, store, name, str(tmp_path / name)).awaitTermination()

    feed("one")
    assert store.calls_io.count() == rows.count()
    gone = store.calls_io.select("call_hid").distinct().limit(2)
    store.tombstone(gone)
    assert store.calls_io.select("call_hid").distinct().count() == 3
    feed("two")
    assert store.calls_io.select("call_hid").distinct().count() == 5 and store.calls_io.count() == rows.count()


def test_a_transaction_is_one_swap_or_nothing(spark):
    store = Store(spark)
    seen = []
    row = spark.createDataFrame([("k", b"v")], "key string, value binary")
    with store.transaction():
        store.kv("sources").set(row)
        store.put_file("note", b"1")
        assert store.kv("sources").exists("k")
        reader = threading.Thread(target=lambda: seen.append(store.manifest()))
        reader.start()
        reader.join()
    assert not seen[0]["tables"]["sources"] and store.manifest()["tables"]["sources"] and store.get_file("note") == b"1"
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.kv("sources").drop(["k"])
        1 / 0
    assert store.kv("sources").exists("k") and not shared.exists(spark, f"{store.root}/_lock")


def test_locks_of_the_living_hold_and_of_the_dead_do_not(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), attempts=2, wait=0.01, stale=30)
    write = lambda at: shared.write_bytes(spark, f"{store.root}/_lock", json.dumps({"owner": "other", "at": at}).encode())
    write(time.time())
    with pytest.raises(TimeoutError):
        store.put_file("a", b"")
    write(time.time() - 31)
    store.put_file("a", b"1")
    assert store.get_file("a") == b"1" and not shared.exists(spark, f"{store.root}/_lock")
    with pytest.raises(RuntimeError), store.transaction():
        store.put_file("a", b"2")
        write(time.time())  # another writer took it
    assert store.get_file("a") == b"1"


@pytest.mark.parametrize("form", ["returns='long'", "columns=lambda x: x * {k} + A"])
def test_bulk_calls_follow_the_code(spark, code, form):
    text = "A = {a}\n@track\ndef dep(x):\n    return x * {k}{note}\n@op(" + form.replace("{k}", "{{k}}") + ")\ndef f(x):\n    return dep(x) + A\n"
    storage = Storage(spark, deps="/nowhere", on_change=lambda key, old, new, dependents: "same" not in new)
    df = spark.createDataFrame([(1,), (2,), (2,)], "x long")

    def both(k, a=0, note=""):
        m = code.run(text.format(k=k, a=a, note=note).replace("{k}", str(k)))
        bulk = sorted(r["output_0"] for r in storage.over(m.f, df).collect())
        with storage:
            single = [storage.unwrap(m.f(x)) for x in (1, 2, 2)]
        assert bulk == single == sorted(k * x + a for x in (1, 2, 2))
        return len(calls(storage))

    assert both(2) == 2
    assert both(3) == 4  # a change of meaning
    assert both(3, note="  # same") == 4
    assert both(2) == 4  # back to what was stored
    assert both(2, a=5) == 6  # a global
    versions = {r[0] for r in storage.store.calls_io.where("op = 'f'").select("semantic_version").distinct().collect()}
    assert None not in versions and len(versions) == 3
    assert storage.hits_and_misses(code.module.f, df).where("hit").count() == 3


def test_bulk_calls_find_single_calls_that_touched_less(spark, code):
    m = code.run("@track\ndef odd(x):\n    return -x\n@op(returns='long')\ndef f(x):\n    return odd(x) if x % 2 else x\n")
    storage = Storage(spark, deps="/nowhere")
    with storage:
        m.f(2)  # does not touch `odd`
    got = {r["x"]: (r["output_0"], r["call_hid"]) for r in storage.over(m.f, spark.createDataFrame([(2,), (3,)], "x long")).collect()}
    assert got[2][0] == 2 and got[3][0] == -3 and len(calls(storage)) == 2
    m = code.run("@track\ndef odd(x):\n    return 10 * x\n")
    got = {r["x"]: r["output_0"] for r in storage.over(m.f, spark.createDataFrame([(2,), (3,)], "x long")).collect()}
    assert got == {2: 2, 3: 30}


def weigh(first, *rest, scale=1, **named):
    return (first + sum(rest)) * scale + sum(named.values())


def test_bulk_variable_arguments_are_those_of_single_calls(spark, storage):
    o = op(weigh, returns="long")
    rows = [(1, [2, 3], {"b": 5}), (1, list(range(11)), {}), (1, [], {"a": 1, "z": 2}), (1, None, None)]
    df = spark.createDataFrame(rows, "first long, rest array<long>, named map<string,long>")
    out = storage.over(o, df).collect()
    assert sorted(r["output_0"] for r in out) == [1, 4, 11, 56]
    before = calls(storage)
    storage.clear_cache()
    with storage:
        single = [o(1, 2, 3, b=5), o(1, *range(11)), o(1, a=1, z=2), o(1)]
    assert calls(storage) == before and {r.hid for r in single} == {r["output_0__hid"] for r in out}
    assert {r[0] for r in storage.store.calls_io.where("name like 'rest%'").select("name").distinct().collect()} == {f"rest_{i}" for i in range(11)}
    for call in storage.get_consumers([single[0]]) + [storage.get_ref_creator(single[0])]:
        assert storage.unwrap(call.inputs) == {"first": 1, "rest_0": 2, "rest_1": 3, "scale": 1, "b": 5}


def divisors(n) -> MList[int]:
    return [d for d in range(1, n + 1) if n % d == 0]


def test_bulk_lists_have_elements_like_those_of_single_calls(spark, storage):
    o = op(divisors, returns="array<long>", output_names=["found"])
    df = spark.createDataFrame([(6,), (0,), (6,), (7,)], "n long")
    out = storage.over(o, df).collect()
    assert sorted((r["n"], r["found"]) for r in out) == [(0, []), (6, [1, 2, 3, 6]), (6, [1, 2, 3, 6]), (7, [1, 7])]
    before = calls(storage)
    other = Storage(spark)
    with other:
        single = o(6)
        o(0), o(7)
    assert calls(other) == before
    storage.clear_cache()
    with storage:
        again = o(6)
    assert again.hid == single.hid and [r.hid for r in again] == [r.hid for r in single] and storage.unwrap(again) == [1, 2, 3, 6]
    assert {r[0] for r in other.store.refs.select("hid").collect()} == {r[0] for r in storage.store.refs.select("hid").collect()}
    assert len(storage.get_consumers([again])) == 4
    # the same contents under another history
    made = storage.over(o, df.withColumnRenamed("n", "m").selectExpr("m as n", "md5(string(m)) as n__hid", "md5(string(m)) as n__cid")).collect()
    assert sorted(r["found"] for r in made) == [[], [1, 2, 3, 6], [1, 2, 3, 6], [1, 7]]
