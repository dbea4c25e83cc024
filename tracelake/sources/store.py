"""The Parquet store: append-only batches, a manifest that names the live ones, tombstones and compaction.

A batch is written first and counts only once the manifest names it. A transaction gathers its changes and swaps the manifest
once, when its outermost block ends well, so a reader sees a commit wholly or not at all and a job lost in the middle leaves
only files that nothing names. Writers hold a lock file for a whole transaction, so ids checked by an anti-join stay unique;
the lock names its owner and is renewed while it is held, so that of a dead writer is taken over. `calls_io` lies in folders by
op, which prunes scans. Batches are numbered: a tombstone hides a call in the batches before it, so a call that is dropped and
made again is seen again.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keyed, shared
from .schema import KEYS, TABLES

MAKE_LIST = "__make_list__"
FOLDERS = {"calls_io": "op"}


def label_of(op, name):
    """The edge a name belongs to: a list's elements share one edge."""
    return F.when((op == MAKE_LIST) & name.startswith("elts_"), F.lit("elts")).otherwise(name)


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None, attempts: int = 10, wait: float = 0.1, blob_limit: int = 50 << 20, blobs: bool = True, stale: float = 600.0):
        self.spark, self.in_memory = spark, root is None
        self.root = root or shared.scratch(spark, "store")
        self.attempts, self.wait, self.blob_limit, self.blobs, self.stale = attempts, wait, blob_limit, blobs, stale
        self._mutex, self._held, self._owner = threading.RLock(), 0, None
        self._pending, self._gone, self._known = None, [], {}
        if not shared.exists(spark, self._manifest_path):
            self._write_manifest({"tables": {t: [] for t in TABLES}, "files": {}, "streams": {}, "next": 1})

    # manifest and transactions

    @property
    def _manifest_path(self) -> str:
        return f"{self.root}/_manifest.json"

    def manifest(self) -> dict:
        """What is committed; within a transaction of this thread, with the changes made so far."""
        if self._pending is not None and self._writer == threading.get_ident():
            return self._pending
        return json.loads(shared.read_bytes(self.spark, self._manifest_path))

    def _write_manifest(self, content: dict) -> None:
        shared.swap_bytes(self.spark, self._manifest_path, json.dumps(content).encode())

    @property
    def _lock_path(self) -> str:
        return f"{self.root}/_lock"

    def _lock_of(self) -> dict | None:
        try:
            return json.loads(shared.read_bytes(self.spark, self._lock_path))
        except Exception:  # noqa: BLE001  gone, or not written in full yet
            return None

    def _take(self) -> bool:
        """Create the lock file, or take over one that its owner has not renewed for `stale` seconds."""
        mine = lambda: json.dumps({"owner": self._owner, "at": time.time()}).encode()
        try:
            shared.write_bytes(self.spark, self._lock_path, mine(), overwrite=False)
            return True
        except Exception:  # noqa: BLE001  Py4J wraps every Java error alike
            if not shared.exists(self.spark, self._lock_path):
                if not shared.exists(self.spark, self.root):
                    raise
                return False
        old = self._lock_of()
        if old is not None and time.time() - old["at"] < self.stale or old is None and not shared.older(self.spark, self._lock_path, self.stale):
            return False
        # of several writers only one can move the file away
        return shared.move(self.spark, self._lock_path, f"{self._lock_path}.{uuid.uuid4().hex}") and self._take()

    def _renew(self, stop: threading.Event) -> None:
        while not stop.wait(self.stale / 4):
            shared.swap_bytes(self.spark, self._lock_path, json.dumps({"owner": self._owner, "at": time.time()}).encode())

    @contextmanager
    def transaction(self):
        """One writer at a time; waits twice as long after each of `attempts` tries. Nested transactions join the outer one.

        An error undoes all of it. The manifest is only swapped by a writer that still holds the lock.
        """
        with self._mutex:
            if self._held:
                self._held += 1
                try:
                    yield self
                finally:
                    self._held -= 1
                return
            self._owner = uuid.uuid4().hex
            for attempt in range(self.attempts):
                if self._take():
                    break
                if attempt + 1 == self.attempts:
                    raise TimeoutError(f"another writer holds {self._lock_path}")
                time.sleep(self.wait * 2**attempt)
            stop = threading.Event()
            threading.Thread(target=self._renew, args=(stop,), daemon=True).start()
            try:
                before = self.manifest()
                self._pending, self._writer, self._gone, self._held = json.loads(json.dumps(before)), threading.get_ident(), [], 1
                yield self
                changed, gone = self._pending, self._gone
                if changed != before:
                    if (self._lock_of() or {}).get("owner") != self._owner:
                        raise RuntimeError(f"{self._lock_path} was taken over")
                    self._write_manifest(changed)
                    for path in gone:
                        shared.delete(self.spark, path)
            finally:
                self._held, self._pending = 0, None
                stop.set()
                if (self._lock_of() or {}).get("owner") == self._owner:
                    shared.delete(self.spark, self._lock_path)

    def change(self, edit: Callable[[dict], None]) -> None:
        with self.transaction():
            edit(self._pending)

    # reading

    def _rows(self, name: str, manifest: dict | None = None) -> DataFrame:
        """Live batches of a table with the column `batch`, tombstones not applied."""
        batches = (manifest or self.manifest())["tables"][name]
        schema = T.StructType([*TABLES[name].fields, T.StructField("batch", T.StringType())])
        key = (name, *batches)
        if key not in self._known:  # the same batches are listed once
            self._known = {k: df for k, df in self._known.items() if k[0] != name}
            base = f"{self.root}/{name}"
            read = self.spark.read.schema(schema).option("basePath", base)
            self._known[key] = read.parquet(*[f"{base}/batch={b}" for b in batches]).select(schema.names) if batches else self.spark.createDataFrame([], schema)
        return self._known[key]

    def raw(self, name: str, manifest: dict | None = None) -> DataFrame:
        return self._rows(name, manifest).select(TABLES[name].names)

    def table(self, name: str) -> DataFrame:
        manifest = self.manifest()
        if name != "calls_io" or not manifest["tables"]["tombstones"]:
            return self.raw(name, manifest)
        hidden = self.raw("tombstones", manifest).groupBy("call_hid").agg(F.max("before").alias("before"))
        number = F.substring_index("batch", "-", 1).cast("long")
        rows = self._rows(name, manifest).withColumn("batch", number)
        seen = keyed.joined(rows, hidden, "call_hid", "left").where(F.col("before").isNull() | (F.col("batch") >= F.col("before")))
        return seen.select(TABLES[name].names)

    @property
    def calls_io(self) -> DataFrame:
        return self.table("calls_io")

    @property
    def refs(self) -> DataFrame:
        return self.table("refs")

    def views(self, prefix: str = "") -> None:
        """Temporary views calls, refs, atoms, ... for SQL over the store."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(prefix + ("calls" if name == "calls_io" else name))

    def execute(self, sql: str, prefix: str = "") -> DataFrame:
        self.views(prefix)
        return self.spark.sql(sql)

    def table_names(self) -> list[str]:
        return sorted(TABLES)

    # writing

    def append(self, name: str, df: DataFrame, fresh: bool = False) -> None:
        """Add the rows whose key is new; `fresh` says that all are."""
        with self.transaction():
            if not fresh:
                df = df.dropDuplicates(KEYS[name])
                if self.manifest()["tables"][name]:
                    df = df.join(self.table(name).select(KEYS[name]), KEYS[name], "left_anti")
            batch = self.write_batch(name, df)
            self.change(lambda m: m["tables"][name].append(batch))

    def write_batch(self, name: str, df: DataFrame) -> str:
        """Write rows under the next number; they count once the manifest names the batch."""
        with self.transaction():
            batch = f"{self._pending['next']:08d}-{uuid.uuid4().hex}"
            self._pending["next"] += 1
        writer = df.select(TABLES[name].names).write.option("compression", "zstd")
        if name in FOLDERS:
            writer = writer.partitionBy(FOLDERS[name])
        writer.parquet(f"{self.root}/{name}/batch={batch}")
        return batch

    def replace(self, name: str, df: DataFrame) -> None:
        """Rewrite a table as one batch; the old batches go once the manifest names the new one."""
        with self.transaction():
            old, batch = self.manifest()["tables"][name], self.write_batch(name, df)
            self.change(lambda m: m["tables"].update({name: [batch]}))
            self._gone += [f"{self.root}/{name}/batch={b}" for b in old]

    def tombstone(self, call_hids: DataFrame) -> None:
        """Hide calls from all later reads, as far as they are stored by now."""
        with self.transaction():
            rows = call_hids.select(F.col(call_hids.columns[0]).alias("call_hid")).distinct()
            self.append("tombstones", rows.withColumn("before", F.lit(self._pending["next"]).cast("long")), fresh=True)

    def vacuum(self) -> None:
        """Compaction: each table in one batch, tombstoned calls gone for good."""
        with self.transaction():
            live = {k: list(v) for k, v in self.manifest()["tables"].items()}
            for name in TABLES:
                if name != "tombstones" and (len(live[name]) > 1 or name == "calls_io" and live["tombstones"]):
                    self.replace(name, self.table(name).dropDuplicates(KEYS[name]))
            self.change(lambda m: m["tables"].update(tombstones=[]))
            self._gone += [f"{self.root}/tombstones/batch={b}" for b in live["tombstones"]]

    # key/value tables and single files

    def kv(self, name: str) -> KeyValue:
        return KeyValue(self, name)

    def put_file(self, key: str, data: bytes) -> None:
        """A snapshot under a key; the manifest names the current one."""
        path = f"meta/{key}-{uuid.uuid4().hex}"
        shared.write_bytes(self.spark, f"{self.root}/{path}", data)
        self.change(lambda m: m["files"].update({key: path}))

    def get_file(self, key: str) -> bytes | None:
        path = self.manifest()["files"].get(key)
        return None if path is None else shared.read_bytes(self.spark, f"{self.root}/{path}")

    def put_blob(self, cid: str, data: bytes) -> str:
        """Large payloads lie beside the tables, one file each, written once."""
        if not self.blobs:
            raise ValueError(f"a payload of {len(data)} bytes is over the limit of {self.blob_limit} and this store keeps no blobs")
        path = f"blobs/{cid}"
        if not shared.exists(self.spark, f"{self.root}/{path}"):
            shared.write_bytes(self.spark, f"{self.root}/{path}", data)
        return path

    # payloads

    def encode(self, cid: str, value) -> tuple:
        """A row of atoms: typed columns first, pickle for the rest, a file for what is over the limit."""
        row = {"i": None, "d": None, "s": None, "blob": None, "path": None}
        if value is None:
            kind = "null"
        elif type(value) is bool:
            kind, row["i"] = "bool", int(value)
        elif type(value) is int and -(1 << 63) <= value < 1 << 63:
            kind, row["i"] = "int", value
        elif type(value) is float:
            kind, row["d"] = "float", value
        elif type(value) is str and len(value) * 4 <= self.blob_limit:
            kind, row["s"] = "str", value
        elif type(value) is bytes and len(value) <= self.blob_limit:
            kind, row["blob"] = "bytes", value
        else:
            kind, data = "pickle", cloudpickle.dumps(value)
            if len(data) > self.blob_limit:
                row["path"] = self.put_blob(cid, data)
            else:
                row["blob"] = data
        return (cid, kind, *(row[c] for c in ("i", "d", "s", "blob", "path")))

    def decode(self, row):
        kind = row["vtype"]
        if kind == "null":
            return None
        if kind in ("bool", "int"):
            return bool(row["i"]) if kind == "bool" else row["i"]
        if kind in ("float", "str"):
            return row["d"] if kind == "float" else row["s"]
        if kind == "json":
            return json.loads(row["s"]).get("v")
        data = bytes(row["blob"]) if row["blob"] is not None else shared.read_bytes(self.spark, f"{self.root}/{row['path']}")
        return data if kind == "bytes" else cloudpickle.loads(data)

    # the interface that frames read, shared with sources.ingest.Log

    @property
    def op_names(self) -> list[str]:
        return sorted(r["op"] for r in self.calls_io.select("op").distinct().collect())

    def signature(self, op: str) -> tuple[list[str], list[str]]:
        rows = self.calls_io.where(F.col("op") == op).select("direction", label_of(F.col("op"), F.col("name")).alias("label")).distinct().collect()
        return tuple(sorted(r["label"] for r in rows if r["direction"] == d) for d in ("in", "out"))

    def link(self, op: str, direction: str, label: str) -> DataFrame:
        """call_hid, name and ref_hid of one kind of edge."""
        name = F.col("name").startswith("elts_") if op == MAKE_LIST and label == "elts" else F.col("name") == label
        return self.calls_io.where((F.col("op") == op) & (F.col("direction") == direction) & name).select("call_hid", "name", "ref_hid")

    def elements(self, op: str, direction: str, label: str) -> DataFrame:
        """hid of all references under a label, each once."""
        return self.link(op, direction, label).select(F.col("ref_hid").alias("hid")).distinct()

    def calls(self, op: str) -> DataFrame:
        return self.calls_io.where(F.col("op") == op).select(F.col("call_hid").alias("hid")).distinct()

    def plural(self, op: str, label: str) -> bool:
        """Whether a call can have several references under this label."""
        return op == MAKE_LIST and label == "elts"

    def io(self, ops: Iterable[str] | None = None, direction: str | None = None, names=None, fields=None) -> DataFrame:
        df = self.calls_io.withColumn("label", label_of(F.col("op"), F.col("name")))
        if ops is not None:
            df = df.where(F.col("op").isin(*ops)) if list(ops) else df.where("false")
        if direction:
            df = df.where(F.col("direction") == direction)
        df = df.where(F.col("name").isin(*names)) if names is not None else df
        return df.select(*fields) if fields else df

    def edges(self, ops: Iterable[str] | None = None) -> DataFrame:
        """call_hid, op, in_hid, out_hid: each input of a call beside each of its outputs."""
        ins = self.io(ops, "in").select("call_hid", "op", F.col("ref_hid").alias("in_hid"))
        outs = self.io(ops, "out").select("call_hid", F.col("ref_hid").alias("out_hid"))
        return ins.join(outs, "call_hid").select("call_hid", "op", "in_hid", "out_hid")

    def wide(self, op: str) -> DataFrame:
        """call_hid and one column of references for each name; null where a call has no such argument."""
        rows = self.calls_io.where(F.col("op") == op)
        names = sorted(r["name"] for r in rows.select("name").distinct().collect())
        return rows.groupBy("call_hid").pivot("name", names).agg(F.first("ref_hid")) if names else rows.select("call_hid")

    def values(self, kinds=None) -> DataFrame:
        """hid, cid, vtype, i, d, s: the payload of each atom by history id."""
        return keyed.joined(self.refs.where("kind = 'atom'").select("hid", "cid"), self.table("atoms").select("cid", "vtype", "i", "d", "s"), "cid", "inner").select("hid", "cid", "vtype", "i", "d", "s")


class KeyValue:
    """A key/value table of the store."""

    def __init__(self, store: Store, name: str):
        self.store, self.name, (self.key,) = store, name, KEYS[name]

    def load_all(self) -> DataFrame:
        return self.store.table(self.name)

    def get(self, key: str):
        return self.load_all().where(F.col(self.key) == key).first()

    def mget(self, keys) -> DataFrame:
        return self.load_all().join(shared.hids(self.store.spark, keys).withColumnRenamed("hid", self.key), self.key, "left_semi")

    def exists(self, key: str) -> bool:
        return not self.load_all().where(F.col(self.key) == key).isEmpty()

    def missing(self, keys) -> DataFrame:
        """The keys without a row."""
        return shared.hids(self.store.spark, keys).withColumnRenamed("hid", self.key).join(self.load_all(), self.key, "left_anti")

    def set(self, rows: DataFrame) -> None:
        self.store.append(self.name, rows)

    def drop(self, keys) -> None:
        gone = shared.hids(self.store.spark, keys).withColumnRenamed("hid", self.key)
        self.store.replace(self.name, self.load_all().join(gone, self.key, "left_anti"))

    def keys(self) -> DataFrame:
        return self.load_all().select(self.key)

    def values(self) -> DataFrame:
        return self.load_all().drop(self.key)
