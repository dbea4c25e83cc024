"""Folders that all executors share: cutting lineage, spilling by node, and small files through Hadoop's file systems."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set on the context; with neither, a temporary one in local mode.

    A cluster that names no folder is an error: files in a machine's own folder would be lost to the other executors.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current.isDefined():
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tracelake-")
        context.setCheckpointDir(named)
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage ended by a reliable checkpoint."""
    ensure_shared(df.sparkSession)
    return df.checkpoint()


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


_written: list[str] = []


def _keep(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(release, spark)
    _written.append(path)


def release(spark: SparkSession) -> None:
    """Delete what was spilled so far, and stores without a path; call it once the results that read them are written. The end of
    the interpreter does it too."""
    while _written:
        _forget(spark, _written.pop())


def spill(df: DataFrame, by: str | None = None, name: str = "spill") -> DataFrame:
    """df written to the shared folder and read back; with `by`, later filters on that column read only its folder."""
    spark = df.sparkSession
    path = f"{ensure_shared(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _keep(spark, path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed when the interpreter ends."""
    path = f"{ensure_shared(spark)}/{name}-{uuid.uuid4().hex}"
    _keep(spark, path)
    return path


def read_bytes(spark: SparkSession, path: str) -> bytes:
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """Without `overwrite`, fails where the file exists; that makes it a lock."""
    where, fs = _path(spark, path)
    stream = fs.create(where, overwrite)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def older(spark: SparkSession, path: str, seconds: float) -> bool:
    """Whether a file was last written more than so many seconds ago; False where there is none."""
    where, fs = _path(spark, path)
    try:
        return time.time() - fs.getFileStatus(where).getModificationTime() / 1000 > seconds
    except Exception:  # noqa: BLE001  it may go meanwhile
        return False


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file; False where it is gone already."""
    where, fs = _path(spark, path)
    try:
        return fs.rename(where, _path(spark, to)[0])
    except Exception:  # noqa: BLE001  another process moved it
        return False


def swap_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Replace a file in one step: readers see the old content or the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    new = f"{path}.{uuid.uuid4().hex}"
    write_bytes(spark, new, data)
    where, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, path))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    files.rename(where, old, options)


def hids(spark: SparkSession, values) -> DataFrame:
    """Ids as a one-column DataFrame; a DataFrame passes through under the name hid."""
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).alias("hid"))
    return spark.createDataFrame([(v,) for v in values], "hid string")
