"""Shared pieces: shared-folder tables, Arrow text slices, vectorised word splitting and rolling hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none and is a local one.

    A cluster that names no folder is an error: files in a machine's own folder would be lost to the other executors.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not current.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete what `materialize` wrote so far; call it once the results that read it are written. The end of the interpreter does it too."""
    while _written:
        _remove(spark, _written.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and tkey. The pair (doc_id, tkey) tells rows apart that share a doc_id but not a text."""
    return docs.select("doc_id", "text", *extra, F.xxhash64("text").alias("tkey"))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE):
    """Cut a batch into row ranges of about `limit` bytes: (first row, end row, bytes, starts).

    starts has one offset more than the range has rows; nulls count as empty. A row is never cut.
    """
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(text.type):
        text = text.cast(pa.string())
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def space_table() -> np.ndarray:
    flags = np.ones(256, bool)
    flags[[9, 10, 11, 12, 13, 32]] = False
    return flags


def find_words(data: np.ndarray, starts: np.ndarray):
    """Starts, ends and row of every run of bytes outside \\x20 and \\x09-\\x0D; runs never cross rows."""
    inside = space_table()[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = starts[(starts > 0) & (starts < n)]
    before[edges] = False
    after[edges - 1] = False
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(starts, first, side="right") - 1


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = powers(n, BASE), powers(n, INVERSE)
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_sums(values: np.ndarray, pw: Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw(len(values))[0][: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, pw: Powers) -> np.ndarray:
    """Hashes of values[first:last]; equal spans have equal hashes wherever they stand."""
    return mix((prefix[last] - prefix[first]) * pw(len(prefix))[1][first] + (last - first).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, k: int, pw: Powers) -> np.ndarray:
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[k:] - prefix[:-k]) * pw(len(prefix))[1][:n] + np.uint64(k))


def word_hashes(data, first, last, pw: Powers) -> np.ndarray:
    return span_hashes(prefix_sums(byte_codes()[data], pw), first, last, pw)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    return _sliding(values, width, np.minimum)


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return _sliding(values, width, np.maximum)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the half-open spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def runs(flags: np.ndarray):
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
