"""Content and history ids: md5 over tagged, null-safe strings, the same in Python and as Column expressions.

A tag keeps 1, true, 1.0 and '1' apart. Doubles are written with `repr`-like text in Python and never as Column text (engines
print them differently): the Column path hashes the IEEE bytes in hex instead, and Python follows.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import struct
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def canonical(value) -> str:
    """One string for each value; different types never share one."""
    fields = getattr(value, "__content_fields__", None)
    if callable(fields) and not isinstance(value, type):
        return "o:" + type(value).__name__ + canonical(fields())
    if value is None:
        return "n:"
    if isinstance(value, (bool, np.bool_)):
        return f"b:{str(bool(value)).lower()}"
    if isinstance(value, (int, np.integer)):
        return f"i:{int(value)}"
    if isinstance(value, (float, np.floating)):
        value = float(value)
        return "f:" + ("nan" if value != value else struct.pack(">d", value + 0.0).hex())
    if isinstance(value, str):
        return "s:" + value
    if isinstance(value, (bytes, bytearray)):
        return "x:" + bytes(value).hex()
    if isinstance(value, decimal.Decimal):
        return f"d:{value.normalize():f}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "t:" + value.isoformat()
    if isinstance(value, np.ndarray):
        if value.dtype == object:
            return f"a:object{value.shape}" + canonical(value.tolist())
        return f"a:{value.dtype}{value.shape}" + hashlib.md5(np.ascontiguousarray(value).tobytes()).hexdigest()
    if type(value).__module__.startswith("pandas.") and hasattr(value, "to_numpy") and hasattr(value, "index"):
        columns = list(value.columns) if hasattr(value, "columns") else [value.name]
        return "p:" + canonical(columns) + canonical([np.asarray(value[c]) for c in columns] if hasattr(value, "columns") else value.to_numpy()) + canonical(list(value.index))
    if isinstance(value, tuple):
        return "(" + ",".join(digest(canonical(v)) for v in value) + ")"
    if isinstance(value, list):
        return "[" + ",".join(digest(canonical(v)) for v in value) + "]"
    if isinstance(value, (set, frozenset)):
        return "{" + ",".join(sorted(digest(canonical(v)) for v in value)) + "}"
    if isinstance(value, Mapping):
        return "m" + ",".join(sorted(digest(canonical(k)) + "=" + digest(canonical(v)) for k, v in value.items()))
    return "k:" + hashlib.md5(cloudpickle.dumps(value)).hexdigest()


def content_id(value) -> str:
    return digest("atom|" + canonical(value))


def fresh_id(cid: str) -> str:
    """History id of a value that no call made."""
    return digest("hid|" + cid)


def pointer_id(name: str) -> str:
    return digest("pointer|" + name)


def _inputs(ids: Mapping[str, str]) -> str:
    return ",".join(f"{k}={ids[k]}" for k in sorted(ids))


def call_history_id(op: str, version: int, hids: Mapping[str, str], semantic_version: str | None = None) -> str:
    return digest(f"call|{op}|{version}|{semantic_version or ''}|{_inputs(hids)}")


def call_content_id(op: str, version: int, cids: Mapping[str, str], semantic_version: str | None = None) -> str:
    return digest(f"content|{op}|{version}|{semantic_version or ''}|{_inputs(cids)}")


def pre_call_id(op: str, cids: Mapping[str, str]) -> str:
    return digest(f"pre|{op}|{_inputs(cids)}")


def output_id(call_hid: str, name: str) -> str:
    return digest(f"out|{call_hid}|{name}")


def list_ids(cids: Sequence[str], hids: Sequence[str]) -> tuple[str, str]:
    return digest("list|" + ",".join(cids)), digest("listh|" + ",".join(hids))


def dict_ids(cids: Mapping[str, str], hids: Mapping[str, str]) -> tuple[str, str]:
    return digest("dict|" + _inputs(cids)), digest("dicth|" + _inputs(hids))


def set_ids(cids: Sequence[str], hids: Sequence[str]) -> tuple[str, str]:
    return digest("set|" + ",".join(sorted(cids))), digest("seth|" + ",".join(sorted(hids)))


def canonical_col(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.concat(F.lit("b:"), column.cast("string"))
    elif isinstance(kind, T.IntegralType):
        text = F.concat(F.lit("i:"), column.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # the bytes of the double, through a decimal-free route: hex of its bits
        text = F.when(F.isnan(column), "f:nan").otherwise(F.concat(F.lit("f:"), _double_hex(column.cast("double"))))
    elif isinstance(kind, T.StringType):
        text = F.concat(F.lit("s:"), column)
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("x:"), F.lower(F.hex(column)))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit("t:"), column.cast("string"))
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        micros = F.date_format(column, "SSSSSS")
        text = F.concat(F.lit("t:"), F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))
    elif isinstance(kind, T.DecimalType):
        plain = column.cast("string")
        text = F.concat(F.lit("d:"), F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: F.md5(canonical_col(x, kind.elementType).cast("binary"))), ","), F.lit("]"))
    else:
        text = F.concat(F.lit("j:"), F.to_json(F.struct(column.alias("v"))))
    return F.coalesce(text, F.lit("n:"))


def _double_hex(column: Column) -> Column:
    """IEEE bits of a double as 16 hex digits, from sign, exponent and mantissa by exact arithmetic."""
    size = F.abs(column)
    power = F.floor(F.log2(size))
    # log2 may be one off next to powers of two
    power = F.when(F.pow(F.lit(2.0), power) > size, power - 1).when(F.pow(F.lit(2.0), power + 1) <= size, power + 1).otherwise(power)
    normal = power >= -1022
    mantissa = F.when(normal, (size / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**52)).otherwise(size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    exponent = F.when(normal, power + 1023).otherwise(0).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == F.lit(float("inf")), F.lit(0x7FF << 52)).otherwise(F.shiftleft(exponent, 52).bitwiseOR(mantissa))
    bits = F.when(column < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def content_id_col(column: Column, kind: T.DataType) -> Column:
    return F.md5(F.concat(F.lit("atom|"), canonical_col(column, kind)).cast("binary"))


def fresh_id_col(cid: Column) -> Column:
    return F.md5(F.concat(F.lit("hid|"), cid).cast("binary"))


def output_id_col(call_hid: Column, name: str) -> Column:
    return F.md5(F.concat(F.lit("out|"), call_hid, F.lit("|" + name)).cast("binary"))


def inputs_col(ids: Mapping[str, Column]) -> Column:
    """name=id pairs by name; a null id leaves its pair out, as an argument that is not part of the call."""
    return F.concat_ws(",", *[F.concat(F.lit(k + "="), ids[k]) for k in sorted(ids)])


def call_id_col(tag: str, op: str, version: int, inputs: Mapping[str, Column] | Column, semantic_version: str | Column | None = None) -> Column:
    """The id of a call from its inputs by name, or from `inputs_col` of them."""
    pairs = inputs if isinstance(inputs, Column) else inputs_col(inputs)
    if tag == "pre":
        return F.md5(F.concat(F.lit(f"{tag}|{op}|"), pairs).cast("binary"))
    semantic = semantic_version if isinstance(semantic_version, Column) else F.lit(semantic_version or "")
    return F.md5(F.concat(F.lit(f"{tag}|{op}|{version}|"), F.coalesce(semantic, F.lit("")), F.lit("|"), pairs).cast("binary"))


def entity_cid(kind: str, key: Column) -> Column:
    """Content id of the text 'kind:key', the form in which rows of tables become values."""
    return F.md5(F.concat(F.lit(f"atom|s:{kind}:"), key.cast("string")).cast("binary"))


def entity_hid(kind: str, key: Column) -> Column:
    return fresh_id_col(entity_cid(kind, key))
