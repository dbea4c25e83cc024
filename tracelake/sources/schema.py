"""Logical schemas of the store's tables."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


CALLS_IO = T.StructType(_strings("call_hid", "name", "direction", "call_cid", "ref_cid", "ref_hid", "op", "semantic_version", "content_version"))
ELEMENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("hid", T.StringType()), T.StructField("cid", T.StringType())])
REFS = T.StructType([*_strings("hid", "cid", "kind"), T.StructField("elems", T.ArrayType(ELEMENT))])
#: Typed columns first; blob holds what has no type of its own, path what is too large for a row.
ATOMS = T.StructType([*_strings("cid", "vtype"), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("blob", T.BinaryType()), T.StructField("path", T.StringType())])
OPS = T.StructType([*_strings("name", "nout"), T.StructField("output_names", T.ArrayType(T.StringType())), T.StructField("version", T.IntegerType()), T.StructField("structural", T.BooleanType())])
SOURCES = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
#: A call is hidden in the batches numbered below `before`.
TOMBSTONES = T.StructType([*_strings("call_hid"), T.StructField("before", T.LongType())])
TABLES = {"calls_io": CALLS_IO, "refs": REFS, "atoms": ATOMS, "ops": OPS, "sources": SOURCES, "tombstones": TOMBSTONES}
KEYS = {"calls_io": ["call_hid", "name"], "refs": ["hid"], "atoms": ["cid"], "ops": ["name"], "sources": ["key"], "tombstones": ["call_hid", "before"]}
ELTS = T.StructType(_strings("node", "hid"))
