"""Lists and dicts as values with a structure: building them from references, and taking them apart into calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.types import Type, element_type
from .model import AtomRef, Call, DictRef, ListRef, Op, Ref, wrap_atom

MAKE_LIST, MAKE_DICT, GET_ITEM, GET_KEY = (Op(n, None, structural=True, output_names=[out]) for n, out in (("__make_list__", "list"), ("__make_dict__", "dict"), ("__list_getitem__", "list_item"), ("__dict_getitem__", "dict_value")))
STRUCTURAL = {o.name: o for o in (MAKE_LIST, MAKE_DICT, GET_ITEM, GET_KEY)}


def list_ref(elements: list[Ref], hid: str | None = None) -> ListRef:
    cid, own = ids.list_ids([r.cid for r in elements], [r.hid for r in elements])
    return ListRef(cid, hid or own, elements, True)


def dict_ref(elements: dict[str, Ref], hid: str | None = None) -> DictRef:
    cid, own = ids.dict_ids({k: r.cid for k, r in elements.items()}, {k: r.hid for k, r in elements.items()})
    return DictRef(cid, hid or own, elements, True)


def set_id(elements) -> tuple[str, str]:
    """Ids of a set of references; sets have ids but are not stored element by element."""
    return ids.set_ids([r.cid for r in elements], [r.hid for r in elements])


def structural_call(op: Op, inputs: dict[str, Ref], output: Ref) -> Call:
    return Call(op, op.content_id(inputs), op.history_id(inputs), inputs, {op.output_names[0]: output})


def construct(tp: Type, value) -> tuple[Ref, list[Call]]:
    """A reference for an input value, and the calls that build it from its elements."""
    if isinstance(value, Ref):
        return value, []
    if not tp.structured:
        return wrap_atom(value), []
    inner, calls = element_type(tp), []

    def each(v):
        ref, made = construct(inner, v)
        calls.extend(made)
        return ref

    if tp.kind == "list":
        inputs = {f"elts_{i}": each(v) for i, v in enumerate(value)}
        op, out = MAKE_LIST, list_ref(list(inputs.values()))
    elif tp.kind == "dict":
        if not all(isinstance(k, str) for k in value):
            raise ValueError("the keys of a stored dict are strings")
        inputs = {k: each(v) for k, v in value.items()}
        op, out = MAKE_DICT, dict_ref(inputs)
    else:
        raise NotImplementedError(f"values of type {tp.kind} are not stored element by element")
    out = out.with_hid(ids.output_id(op.history_id(inputs), op.output_names[0]))
    return out, [*calls, structural_call(op, inputs, out)]


def destruct(value, tp: Type, hid: str) -> tuple[Ref, list[Call]]:
    """A reference with the given history for an output value, and the calls that take its elements out of it."""
    if not tp.structured:
        if isinstance(value, Ref):
            value = value.obj
        cid = ids.content_id(value)
        return AtomRef(cid, hid, value, True), []
    if tp.kind not in ("list", "dict"):
        raise NotImplementedError(f"values of type {tp.kind} are not stored element by element")
    op = GET_ITEM if tp.kind == "list" else GET_KEY
    whole, part = ("list", "i") if tp.kind == "list" else ("dict", "key")
    calls, elements = [], {}
    for key, v in enumerate(value) if tp.kind == "list" else value.items():
        at = wrap_atom(key)
        # the element's history: the item taken out of this value
        own = ids.output_id(ids.call_history_id(op.name, op.version, {whole: hid, part: at.hid}), op.output_names[0])
        element, inside = destruct(v, element_type(tp), own)
        elements[key] = (element, at)
        calls += inside
    out = list_ref([e for e, _ in elements.values()], hid) if tp.kind == "list" else dict_ref({k: e for k, (e, _) in elements.items()}, hid)
    for element, at in elements.values():
        calls.append(structural_call(op, {whole: out, part: at}, element))
    return out, calls


# the same over DataFrames


def list_cid(cids: Column) -> Column:
    """Content id of a list from the ordered array of its elements' ids."""
    return F.md5(F.concat(F.lit("list|"), F.array_join(cids, ",")).cast("binary"))


def list_hid(hids: Column) -> Column:
    return F.md5(F.concat(F.lit("listh|"), F.array_join(hids, ",")).cast("binary"))


def dict_cid(entries: Column) -> Column:
    """Content id of a dict from an array of structs (key, id)."""
    return F.md5(F.concat(F.lit("dict|"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e[0], F.lit("="), e[1])), ",")).cast("binary"))


def set_cid(cids: Column) -> Column:
    return F.md5(F.concat(F.lit("set|"), F.array_join(F.array_sort(cids), ",")).cast("binary"))


def build_lists(elements: DataFrame, key: list[str], order: list[str], cid: str = "cid", hid: str = "hid") -> DataFrame:
    """One list for each key from its elements in order: key, elems (idx, hid, cid), cid, hid."""
    entry = F.struct(F.struct(*order).alias("at"), F.col(hid).alias("hid"), F.col(cid).alias("cid"))
    rows = elements.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    parts = rows.select(*key, F.transform("x", lambda e, i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("idx"), e["hid"].alias("hid"), e["cid"].alias("cid"))).alias("elems"))
    return parts.select(*key, "elems", list_cid(F.col("elems.cid")).alias("cid"), list_hid(F.col("elems.hid")).alias("hid"))


def list_io(lists: DataFrame) -> DataFrame:
    """calls_io rows of the builder calls of lists made by build_lists."""
    pairs = lambda f: F.array_join(F.transform(F.array_sort(F.transform("elems", lambda e: F.struct(F.concat(F.lit("elts_"), e["idx"].cast("string")).alias("n"), e[f].alias("v")))), lambda p: F.concat(p["n"], F.lit("="), p["v"])), ",")
    head = lambda tag: F.lit(f"{tag}|{MAKE_LIST.name}|0||")
    made = lists.select(F.md5(F.concat(head("call"), pairs("hid")).cast("binary")).alias("call_hid"), F.md5(F.concat(head("content"), pairs("cid")).cast("binary")).alias("call_cid"), "elems", F.col("cid").alias("list_cid"))
    none = F.lit(None).cast("string")
    shape = ["call_hid", "name", "direction", "call_cid", "ref_cid", "ref_hid", F.lit(MAKE_LIST.name).alias("op"), none.alias("semantic_version"), none.alias("content_version")]
    ins = made.select("call_hid", "call_cid", F.explode("elems").alias("e")).select("call_hid", "call_cid", F.concat(F.lit("elts_"), F.col("e.idx").cast("string")).alias("name"), F.lit("in").alias("direction"), F.col("e.cid").alias("ref_cid"), F.col("e.hid").alias("ref_hid"))
    outs = made.select("call_hid", "call_cid", F.lit("list").alias("name"), F.lit("out").alias("direction"), F.col("list_cid").alias("ref_cid"), F.md5(F.concat(F.lit("out|"), F.col("call_hid"), F.lit("|list")).cast("binary")).alias("ref_hid"))
    return ins.unionByName(outs).select(*shape)
