"""Which elements can be computed from, or led to, a set of elements.

Weak: a call is reached when any of its connected references is. Strong: when all are (a relational division). Schema graphs
without cycles take one chain of joins in topological order; with cycles, rounds run until no element is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import keyed
from ..sources.shared import cut
from .frame import Frame, union_all


def _hid(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("hid").alias(name))


def wide(frame: Frame, f: str, direction: str | None, labels: list[str]) -> DataFrame:
    """call_hid and one column for each label of a function node (of one side or both); null where a call lacks it."""
    op = frame.graph.ops[f]
    fact = keyed.fact_of(frame.elts[f])
    if fact is not None:
        return fact.wide().select("call_hid", *labels)
    if hasattr(frame.log, "facts"):
        rows = frame.log.wide(op).select("call_hid", *labels)
    else:
        rows = frame.log.io([op], direction).where(F.col("label").isin(*labels)).groupBy("call_hid").pivot("label", labels).agg(F.first("ref_hid"))
    return rows if f in frame.whole else rows.join(_hid(frame.elts[f], "call_hid"), "call_hid", "left_semi")


def _strong(frame: Frame, f: str, state: dict[str, DataFrame], direction: str) -> DataFrame | None:
    edges = frame.in_edges(f) if direction == "forward" else frame.out_edges(f)
    far = 0 if direction == "forward" else 1
    labels = sorted({e[2] for e in edges})
    if not labels:
        return None
    side, op = "in" if direction == "forward" else "out", frame.graph.ops[f]
    fact = keyed.fact_of(frame.elts[f])
    if fact is not None:  # every call has every label
        for x in labels:
            found = [state[e[far]] for e in edges if e[2] == x and e[far] in state]
            if not found:
                return keyed.of_facts([fact.over(fact.rows.where("false"))])
            fact = fact.narrowed(x, keyed.union(*found) if len(found) > 1 else found[0])
        return keyed.of_facts([fact])
    reached = {x: [state[e[far]] for e in edges if e[2] == x and e[far] in state] for x in labels}
    if not any(frame.log.plural(op, x) for x in labels):
        rows = wide(frame, f, side, labels)
        total = hasattr(frame.log, "facts")
        for x in labels:
            known = union_all(reached[x]) if reached[x] else None
            if total:  # every call has every label
                rows = rows.join(_hid(known, x), x, "left_semi") if known is not None else rows.where("false")
            elif known is not None:
                rows = rows.join(_hid(known, x).distinct().withColumn("__there", F.lit(True)), x, "left").where(F.col(x).isNull() | F.col("__there")).drop("__there")
            else:
                rows = rows.where(F.col(x).isNull())
        return rows.where(F.coalesce(*labels).isNotNull()).select(F.col("call_hid").alias("hid"))
    rows = union_all(frame.log.link(op, side, x).select("call_hid", "name", "ref_hid", F.lit(x).alias("label")) for x in labels)
    if f not in frame.whole:
        rows = rows.join(_hid(frame.elts[f], "call_hid"), "call_hid", "left_semi")
    known = [d.select(F.lit(x).alias("label"), F.col("hid").alias("ref_hid")) for x in labels for d in reached[x]]
    if not known:
        return None
    rows = rows.join(union_all(known).distinct().withColumn("there", F.lit(1)), ["label", "ref_hid"], "left")
    return rows.groupBy("call_hid").agg(F.count("*").alias("needed"), F.count("there").alias("got")).where("needed = got").select(F.col("call_hid").alias("hid"))


def _weak(frame: Frame, node: str, state: dict[str, DataFrame], direction: str) -> DataFrame | None:
    edges = frame.in_edges(node) if direction == "forward" else frame.out_edges(node)
    far = 0 if direction == "forward" else 1
    parts = [frame.adjacent_by_edge(e, state[e[far]], direction) for e in edges if e[far] in state]
    return (keyed.union(*parts) if len(parts) > 1 else parts[0]) if parts else None


def _step(frame: Frame, node: str, state: dict[str, DataFrame], direction: str, how: str) -> DataFrame | None:
    if node in frame.graph.ops and how == "strong":
        return _strong(frame, node, state, direction)
    return _weak(frame, node, state, direction)


def reachable_elts(frame: Frame, initial: dict[str, DataFrame], direction: str = "forward", how: str = "strong") -> dict[str, DataFrame]:
    """Elements by node reached from the initial ones, which are included."""
    if direction not in ("forward", "back") or how not in ("strong", "weak"):
        raise ValueError("direction is forward or back, how is strong or weak")
    state = dict(initial)
    order = frame.graph.order()
    order = order if direction == "forward" else order[::-1]
    if frame.graph.acyclic:
        for node in order:
            new = _step(frame, node, state, direction, how)
            if new is not None:
                state[node] = keyed.union(state[node], new) if node in state else new if keyed.fact_of(new) else keyed.distinct(new)
                if node in frame.graph.ops:  # its references are all read from here
                    state[node] = keyed.kept(state[node])
        return state
    size = None
    while True:
        for node in order:
            new = _step(frame, node, state, direction, how)
            if new is not None:
                state[node] = (state[node].unionAll(new) if node in state else new).distinct()
        all_ = cut(union_all(x.select(F.lit(n).alias("node"), "hid") for n, x in state.items())) if state else None
        counts = {r["node"]: r["count"] for r in all_.groupBy("node").count().collect()} if state else {}
        state = {n: all_.where(F.col("node") == n).select("hid") for n in state}
        if counts == size:
            return state
        size = counts


def stream(frame: Frame, nodes, direction: str, how: str) -> Frame:
    """The sub-frame downstream (forward) or upstream (back) of the nodes' elements."""
    part = frame.select_nodes(frame.graph.reachable(nodes, direction))
    state = reachable_elts(part, {n: part.elts[n] for n in nodes}, direction, how)
    return part.select_subsets(state, trusted=True)


def _begins(part: Frame, nodes: list[str]) -> bool:
    """Whether every element of the part is a source among the nodes or computed from such: where all variables are among the nodes,
    unless a call lacks all the inputs that the part has."""
    if not (part.closed and part.graph.acyclic and part.graph.variables <= set(nodes) and all(part.in_edges(f) for f in part.graph.ops)):
        return False
    if hasattr(part.log, "facts"):  # every call has every label
        return True
    for f in part.graph.ops:
        links = union_all(part.link(e).select(F.col("call_hid").alias("hid")) for e in part.in_edges(f))
        if not keyed.joined(part.elts[f].select("hid"), links, "hid", "left_anti").isEmpty():
            return False
    return True


def midstream(frame: Frame, nodes, how: str = "strong", alone: bool = True) -> Frame:
    """What lies on paths between the nodes and is computed from those of its sources that belong to them.

    A source that no call of the part uses lies on no path; with `alone` it stays, as a row of its own in a table.
    """
    nodes = list(nodes)
    between = {n for a in nodes for b in nodes if a != b for edge in frame.graph.edges_between(a, b) for n in edge}
    part = frame.select_nodes(between or nodes)
    if alone and how == "strong" and (part.closed and between <= set(nodes) or _begins(part, nodes)):
        return part  # every element is a source among the nodes, or computed from such
    sources = {n: x for n, x in part.source_elts().items() if n in nodes}
    if between and not alone:
        sources = {n: _used(part, n, x) for n, x in sources.items()}
    return part.select_subsets(reachable_elts(part, sources, "forward", how), trusted=True)


def _used(frame: Frame, node: str, elements: DataFrame) -> DataFrame:
    """Those of a variable's elements that some call of the frame uses; calls as they are."""
    edges = frame.out_edges(node) if node in frame.graph.variables else []
    facts = [keyed.fact_of(frame.elts[f]) for _, f, _ in edges]
    if edges and all(facts):
        used = keyed.union(*(fact.elements(x) for fact, (_, _, x) in zip(facts, edges, strict=True)))
    elif edges:
        used = union_all(frame.pairs(e).select(F.col("src").alias("hid")) for e in edges)
    else:
        return elements if node in frame.graph.ops else elements.where("false")
    return keyed.within(elements, used)


def drop_unreachable(frame: Frame, direction: str = "forward", how: str = "strong") -> Frame:
    start = frame.source_elts() if direction == "forward" else frame.sink_elts()
    return frame.select_subsets(reachable_elts(frame, start, direction, how), trusted=True)
