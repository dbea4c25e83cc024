"""Growing a frame along the log: the calls that made its source elements, or that use its sink elements.

A step finds the calls by semi-joins, gives each the signature of how it connects to the frame (its op, and for each label
the variables that hold its references), and attaches the few groups of equal signature to the graph on the driver. Only
signatures and counts are collected; calls and references stay in DataFrames, written once per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import keyed
from ..sources.shared import spill
from .frame import Frame, union_all
from .graph import fresh_variable


def _able(frame: Frame, side: str, variables: list[str]) -> list[str] | None:
    """The ops that can make or use what the variables hold, where the log knows; None for all."""
    kinds = [frame.kinds(v) for v in variables]
    if any(k is None for k in kinds):
        return None
    held = set().union(*kinds)
    labels = {o: frame.log.signature(o)[side == "out"] for o in frame.log.op_names}
    return [o for o, names in labels.items() if any(frame.log.kind(o, x) in held for x in names)]


def _groups(frame: Frame, direction: str, variables: list[str]) -> DataFrame:
    """op, call_hid and signature of the calls to attach: for each label, the variables that hold the call's references.

    One pass over one side of the log: a call counts when any of its references is an end of the frame.
    """
    side, edge = ("out", "dst") if direction == "back" else ("in", "src")
    held = []
    for v in variables:
        edges = frame.in_edges(v) if direction == "back" else frame.out_edges(v)
        rows = frame.elts[v].select(F.lit(v).alias("node"), F.col("hid").alias("ref_hid"))
        if edges:
            touched = union_all(frame.pairs(e).select(F.col(edge).alias("ref_hid")) for e in edges).distinct().withColumn("inner", F.lit(True))
            rows = rows.join(touched, "ref_hid", "left").select("node", "ref_hid", F.col("inner").isNull().alias("end"))
        else:
            rows = rows.withColumn("end", F.lit(True))
        held.append(rows)
    rows = frame.log.io(_able(frame, side, variables), side, fields=("op", "call_hid", "label", "ref_hid")).join(union_all(held), "ref_hid")
    shape = rows.groupBy("op", "call_hid").agg(F.array_sort(F.collect_set(F.struct("label", "node"))).alias("signature"), F.max("end").alias("end"))
    return shape.where("end").select("op", "call_hid", "signature")


def _matches(frame: Frame, side: str, variables: list[str]) -> dict[str, tuple[str, str]] | None:
    """For each op of a log of facts, the one label and the one variable that can hold its references; None where there are several."""
    if not (hasattr(frame.log, "facts") and frame.closed) or any(frame.kinds(v) is None for v in variables):
        return None
    # functions that an earlier operator left without facts, and several functions of one op, take the general way
    if any(keyed.fact_of(frame.elts[f]) is None for f in frame.graph.ops) or len(set(frame.graph.ops.values())) < len(frame.graph.ops):
        return None
    found = {}
    for o in frame.log.op_names:
        pairs = [(x, v) for x in frame.log.signature(o)[side == "out"] for v in variables if frame.log.kind(o, x) in frame.kinds(v)]
        if len(pairs) > 1:
            return None
        if pairs:
            found[o] = pairs[0]
    return found


def _step_of_facts(frame: Frame, direction: str, side: str, matches: dict, skip_existing: bool, reuse: bool) -> Frame:
    """A step where a call's signature follows from its op: the calls are written once by their keys, and all they touch is read from there."""
    known, ends, found = {f: x for f, x in frame.elts.items() if f in frame.graph.ops}, {}, {}
    for o, (label, v) in matches.items():
        if v not in ends:
            ends[v] = frame.ends(v, "dst" if direction == "back" else "src")
        if ends[v] is None:
            continue
        group = keyed.of_facts([frame.log.facts[o].narrowed(label, ends[v])])
        if skip_existing:
            for f in known:
                group = keyed.within(group, known[f], "left_anti") if frame.graph.ops[f] == o else group
        group = keyed.kept(group)
        if not group.isEmpty():
            found[o, ((label, v),)] = group
    for (o, signature), group in sorted(found.items(), key=lambda x: x[0]):
        frame = _attach(frame, o, signature, group, side, reuse)
    return frame


def step(frame: Frame, direction: str, variables: list[str], skip_existing: bool, reuse: bool) -> Frame:
    variables = [v for v in frame.vnames if v in set(variables)]
    if not variables:
        return frame
    side = "out" if direction == "back" else "in"
    if (matches := _matches(frame, side, variables)) is not None:
        return _step_of_facts(frame, direction, side, matches, skip_existing, reuse)
    calls = _groups(frame, direction, variables)
    if skip_existing and frame.fnames:
        calls = calls.join(frame.calls_by_func().select(F.col("hid").alias("call_hid")), "call_hid", "left_anti")
    found = spill(calls.select("op", "call_hid", "signature"), by="op", name="groups")
    signatures = sorted({(r["op"], tuple((x["label"], x["node"]) for x in r["signature"])) for r in found.select("op", "signature").distinct().collect()})
    before = frame.elts
    for op, signature in signatures:
        same = F.col("signature") == F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("node")) for a, b in signature])
        group = found.where(F.col("op") == op).where(same).select(F.col("call_hid").alias("hid"))
        frame = _attach(frame, op, signature, group, side, reuse)
    return frame.pinned(n for n, x in frame.elts.items() if x is not before.get(n)) if signatures else frame


def _attach(frame: Frame, op: str, signature, group: DataFrame, side: str, reuse: bool) -> Frame:
    graph, elts = frame.graph, dict(frame.elts)
    # a node whose calls contain or are contained in the group has the group's op, so the op alone settles reuse
    f = next((n for n, o in sorted(graph.ops.items()) if o == op), None) if reuse else None
    if f is None:
        f = frame.get_new_fname(op)
    graph = graph.adding(ops={f: op}, edges=[(f, v, x) if side == "out" else (v, f, x) for x, v in signature])
    inputs, outputs = frame.log.signature(op)
    other, labels = ("in", inputs) if side == "out" else ("out", outputs)
    connected = {e[2] for e in (graph.in_edges(f) if other == "in" else graph.out_edges(f))}
    members = group.withColumnRenamed("hid", "call_hid")
    fact = keyed.fact_of(group)
    if fact is not None:
        return _attach_parts(frame, graph, elts, f, op, group, other, labels, connected, lambda d, x: fact.elements(x), reuse)
    # all that the group's calls touch, by one pass over the op's rows
    touched = frame.log.io([op], fields=("call_hid", "direction", "label", "ref_hid")).join(members, "call_hid", "left_semi")
    touched = spill(touched.select("direction", "label", F.col("ref_hid").alias("hid")).distinct(), by="label", name="touched")
    refs_of = lambda d, x: touched.where((F.col("label") == x) & (F.col("direction") == d)).select("hid")
    return _attach_parts(frame, graph, elts, f, op, group, other, labels, connected, refs_of, reuse)


def _attach_parts(frame: Frame, graph, elts: dict, f: str, op: str, group: DataFrame, other: str, labels, connected, refs_of, reuse: bool) -> Frame:
    new = {x: refs_of(other, x) for x in labels if x not in connected}
    overlaps = _overlaps({v: elts[v] for v in graph.variables} if reuse else {}, new) if new else {}
    for label, refs in new.items():
        total = overlaps.get((label, ""), 0)
        if not total:  # the op has such an argument, but no call of this group
            continue
        v = None
        if reuse:  # the first variable that contains all the references, or is not empty and contained in them
            v = next((v for v in sorted(frame.graph.variables) if overlaps.get((label, v), 0) in (total, overlaps.get(("", v), -1)) and overlaps.get((label, v))), None)
        if v is None:
            v = fresh_variable(graph.nodes, label)
            graph = graph.adding(variables=[v])
        graph = graph.adding(edges=[(v, f, label) if other == "in" else (f, v, label)])
    parts: dict[str, list[DataFrame]] = {f: [group]}
    for a, b, x in graph.in_edges(f) + graph.out_edges(f):
        parts.setdefault(a if b == f else b, []).append(refs_of("in" if b == f else "out", x))
    out = frame._with(graph, elts, frame.whole - {f})
    return out._with(elts=out._more({n: union_all(p) for n, p in parts.items()}))


def _overlaps(variables: dict[str, DataFrame], refs: dict[str, DataFrame]) -> dict[tuple[str, str], int]:
    """How many references of each label each variable holds; "" stands for all labels or all variables. One job, or where kinds
    are known one for each kind that both have."""
    kinds = {n: keyed.keys_of(x) for n, x in (variables | refs).items()}
    if all(kinds.values()):
        out = {}
        for kind in {keyed.keys_of(x).kind for x in refs.values()}:
            own = lambda sets: {n: x for n, x in sets.items() if keyed.keys_of(x).kind == kind}  # noqa: B023, E731
            held = own(variables)
            out |= _count(held, own(refs)) if held else {(x, ""): 1 for x in own(refs)}  # calls have a reference under every label
        return out
    return _count(variables, refs)


def _count(variables: dict[str, DataFrame], refs: dict[str, DataFrame]) -> dict[tuple[str, str], int]:
    sets = [keyed.keys_of(x) for x in (*variables.values(), *refs.values())]
    if all(sets) and len({repr(x.type) for x in sets}) == 1:  # keys of one kind
        variables, refs = ({n: keyed.keys_of(x).rows.select(F.col("key").alias("hid")) for n, x in part.items()} for part in (variables, refs))
    none = F.lit(None).cast("string")
    rows = [x.select("hid", F.lit(label).alias("label"), none.alias("node")) for label, x in refs.items()] + [x.select("hid", none, F.lit(v)) for v, x in variables.items()]
    by_hid = union_all(rows).groupBy("hid").agg(F.collect_set("label").alias("labels"), F.collect_set("node").alias("nodes"))
    every = lambda c: F.explode(F.concat(c, F.array(F.lit(""))))
    pairs = by_hid.select(every("labels").alias("label"), "nodes").select("label", every("nodes").alias("node"))
    return {(r["label"], r["node"]): r["count"] for r in pairs.groupBy("label", "node").count().collect()}


def expand(frame: Frame, direction: str, varnames=None, recursive: bool = False, skip_existing: bool = False, reuse: bool = True) -> Frame:
    """One step from the named variables; from all of them, repeated while nodes are added if `recursive`."""
    if varnames is not None:
        return step(frame, direction, [varnames] if isinstance(varnames, str) else list(varnames), skip_existing, reuse)
    while True:
        new = step(frame, direction, frame.vnames, skip_existing, reuse)
        if not recursive or len(new.nodes) == len(frame.nodes):
            return new
        frame = new


def expand_all(frame: Frame, skip_existing: bool = False, reuse: bool = True) -> Frame:
    """Back and forward in turn until no reference and no call is added."""
    if reuse and not skip_existing and hasattr(frame.log, "facts"):
        # each step attaches calls of elements that are no ends afterwards, so this comes to an end
        while True:
            new = expand(expand(frame, "back", None, True), "forward", None, True)
            if new is frame:
                return frame
            if any(keyed.fact_of(new.elts[f]) is None for f in new.graph.ops):
                frame = new
                break
            frame = new
    count = lambda f: f.table().select("hid").distinct().count()
    size = count(frame)
    while True:
        frame = expand(frame, "back", None, True, skip_existing, reuse)
        frame = expand(frame, "forward", None, True, skip_existing, reuse)
        new = count(frame)
        if new == size:
            return frame
        size = new
