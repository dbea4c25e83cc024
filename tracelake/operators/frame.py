"""Frames: a graph of variables and functions, and for each node the DataFrame of its elements (history ids).

A frame is immutable; every operator makes a new one whose elements are lazy semi-joins, anti-joins and unions of the old. The
graph stays on the driver (tens of nodes). Two facts are tracked so that plans stay small: `whole` names function nodes that
hold all calls of their op, and `closed` says that each call's references lie in every variable its labels connect to. Under
them, links from the log need no further restriction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import keyed, shared
from . import provenance
from .graph import Edge, Graph, fresh_function, fresh_variable
from .model import Op, Ref


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


class Frame:
    def __init__(self, log, graph: Graph, elts: dict[str, DataFrame], storage=None, whole: Iterable[str] = (), closed: bool = False):
        self.log, self.graph, self.elts, self.storage = log, graph, elts, storage
        self.whole, self.closed = frozenset(whole), closed

    def _with(self, graph: Graph | None = None, elts: dict | None = None, whole=None, closed: bool | None = None) -> Frame:
        return Frame(self.log, graph or self.graph, self.elts if elts is None else elts, self.storage, self.whole if whole is None else whole, self.closed if closed is None else closed)

    copy = _with

    # constructors

    @classmethod
    def of(cls, log, source, storage=None) -> Frame:
        """From an op, a reference, references, history ids (also as a DataFrame), or a dict of variables."""
        if isinstance(source, Op) or isinstance(source, str):
            return cls.from_op(log, source if isinstance(source, str) else source.name, storage)
        if isinstance(source, dict):
            return cls.from_vars(log, source, storage)
        return cls.from_vars(log, {"v": source}, storage)

    @classmethod
    def from_op(cls, log, op: str, storage=None) -> Frame:
        """All calls of an op, with one variable for each label."""
        inputs, outputs = log.signature(op)
        elts = {op: log.calls(op)}
        edges: set[Edge] = set()
        variables: set[str] = set()
        for direction, labels in (("in", inputs), ("out", outputs)):
            for label in labels:
                name = fresh_variable(variables | {op}, label)
                variables.add(name)
                edges.add((name, op, label) if direction == "in" else (op, name, label))
                elts[name] = log.elements(op, direction, label)
        return cls(log, Graph(frozenset(variables), ((op, op),), frozenset(edges)), elts, storage, {op}, True)

    @classmethod
    def from_vars(cls, log, variables: dict, storage=None) -> Frame:
        def ids(value):
            if isinstance(value, DataFrame):
                carries = keyed.keys_of(value) or keyed.fact_of(value)
                return keyed.distinct(value) if carries else value.select(F.col(value.columns[0]).alias("hid")).distinct()
            value = [value] if isinstance(value, (Ref, str)) else list(value)
            return shared.hids(log.spark, sorted({v.hid if isinstance(v, Ref) else v for v in value}))

        return cls(log, Graph(frozenset(variables)), {v: ids(x) for v, x in variables.items()}, storage, (), True)

    @classmethod
    def from_refs(cls, log, refs, storage=None) -> Frame:
        return cls.from_vars(log, {"v": refs}, storage)

    # navigation

    @property
    def vnames(self) -> list[str]:
        return sorted(self.graph.variables)

    @property
    def fnames(self) -> list[str]:
        return sorted(self.graph.ops)

    @property
    def nodes(self) -> list[str]:
        return self.graph.nodes

    @property
    def sources(self) -> list[str]:
        return self.graph.sources

    @property
    def sinks(self) -> list[str]:
        return self.graph.sinks

    def ops(self) -> dict[str, str]:
        return self.graph.ops

    def edges(self) -> list[Edge]:
        return sorted(self.graph.edges)

    def in_edges(self, node: str) -> list[Edge]:
        return self.graph.in_edges(node)

    def out_edges(self, node: str) -> list[Edge]:
        return self.graph.out_edges(node)

    def in_neighbors(self, node: str) -> list[str]:
        return self.graph.in_neighbors(node)

    def out_neighbors(self, node: str) -> list[str]:
        return self.graph.out_neighbors(node)

    def sort_nodes(self, nodes: Iterable[str]) -> list[str]:
        nodes = set(nodes)
        return [n for n in self.graph.order() if n in nodes]

    def table(self, nodes: Iterable[str] | None = None) -> DataFrame:
        """node and hid of all elements of the nodes."""
        nodes = self.nodes if nodes is None else list(nodes)
        if not nodes:
            return self.log.spark.createDataFrame([], "node string, hid string")
        return union_all(self.elts[n].select(F.lit(n).alias("node"), "hid") for n in nodes)

    sets = table

    def refs_by_var(self) -> DataFrame:
        return self.table(self.vnames)

    def calls_by_func(self) -> DataFrame:
        return self.table(self.fnames)

    def sizes(self, nodes: Iterable[str] | None = None) -> dict[str, int]:
        """Elements of each node, by one job."""
        nodes = self.nodes if nodes is None else list(nodes)
        return {n: 0 for n in nodes} | {r["node"]: r["count"] for r in self.table(nodes).groupBy("node").count().collect()}

    def pinned(self, nodes: Iterable[str] | None = None) -> Frame:
        """The elements (of some nodes) written to the shared folder by node: later operators start from there."""
        nodes = self.nodes if nodes is None else sorted(nodes)
        kept = shared.spill(self.table(nodes), by="node", name="elts")
        return self._with(elts=self.elts | {n: kept.where(F.col("node") == n).select("hid") for n in nodes})

    def __getitem__(self, nodes) -> Frame:
        return self.select_nodes([nodes] if isinstance(nodes, str) else list(nodes))

    # adjacency

    def link(self, edge: Edge) -> DataFrame:
        """call_hid, name and ref_hid behind one edge, not yet restricted to the frame's elements."""
        src, dst, label = edge
        f, direction = (dst, "in") if dst in self.graph.ops else (src, "out")
        return self.log.link(self.graph.ops[f], direction, label)

    def pairs(self, edge: Edge) -> DataFrame:
        """src and dst: the elements that the edge joins within the frame."""
        src, dst, _ = edge
        f, v = (dst, src) if dst in self.graph.ops else (src, dst)
        fact = keyed.fact_of(self.elts[f])
        rows = self.link(edge) if fact is None else fact.branch(edge[2]).select("call_hid", "name", "ref_hid")
        if f not in self.whole and fact is None:
            rows = rows.join(self.elts[f].withColumnRenamed("hid", "call_hid"), "call_hid", "left_semi")
        if not self.closed:
            rows = rows.join(self.elts[v].withColumnRenamed("hid", "ref_hid"), "ref_hid", "left_semi")
        return rows.select(*(F.col("ref_hid" if n == v else "call_hid").alias(side) for side, n in (("src", src), ("dst", dst))))

    def adjacent_by_edge(self, edge: Edge, hids: DataFrame, direction: str) -> DataFrame:
        """The elements at the other end of an edge: forward from its source, back from its target."""
        near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
        src, dst, label = edge
        f, v = (dst, src) if dst in self.graph.ops else (src, dst)
        if edge[0 if direction == "forward" else 1] == f:
            made = keyed.fact_of(hids)
            if made is not None:
                refs = made.elements(label)
                return refs if self._holds(v, f, label) else keyed.within(refs, self.elts[v])
        elif (made := keyed.fact_of(self.elts[f])) is not None:
            return keyed.of_facts([made.narrowed(label, hids if hids is self.elts[v] else keyed.within(hids, self.elts[v]))])
        return self.pairs(edge).join(hids.select(F.col("hid").alias(near)), near, "left_semi").select(F.col(far).alias("hid")).distinct()

    def _holds(self, variable: str, function: str, label: str) -> bool:
        """Whether a variable has all references of a function's calls under a label."""
        known = keyed.keys_of(self.elts[variable])
        return self.closed or known is not None and known.edges is not None and (self.graph.ops[function], label) in known.edges

    def adjacent(self, node: str, hids: DataFrame, direction: str = "both") -> dict[str, DataFrame]:
        """Neighbours of the elements by node, over all edges of the node."""
        found: dict[str, list[DataFrame]] = {}
        for way, edges, other in (("forward", self.out_edges(node), 1), ("back", self.in_edges(node), 0)):
            for edge in edges if direction in (way, "both") else ():
                found.setdefault(edge[other], []).append(self.adjacent_by_edge(edge, hids, way))
        return {n: union_all(parts).distinct() if len(parts) > 1 else parts[0] for n, parts in found.items()}

    def ends(self, n: str, side: str) -> DataFrame | None:
        """The elements of a node without those at one side of its edges; None where the plan alone says that none are left."""
        edges, out = self.in_edges(n) if side == "dst" else self.out_edges(n), self.elts[n]
        if not edges:
            return out
        facts = [keyed.fact_of(self.elts[e[0] if side == "dst" else e[1]]) for e in edges] if n in self.graph.variables else []
        known = keyed.keys_of(out)
        if known and known.source and any(f is known.source[0] and e[2] == known.source[1] for f, e in zip(facts, edges, strict=True)):
            return None  # all are references of the calls at the edge
        if facts and all(facts):
            for fact, e in zip(facts, edges, strict=True):
                out = keyed.within(out, fact.elements(e[2]), "left_anti")
            return out
        if self.closed and n in self.graph.ops and hasattr(self.log, "facts"):  # every call has every label
            return None
        return out.join(union_all(self.pairs(e).select(F.col(side).alias("hid")) for e in edges), "hid", "left_anti")

    def _ends(self, side: str) -> dict[str, DataFrame]:
        found = {n: self.ends(n, side) for n in self.nodes}
        return {n: self.elts[n].where("false") if x is None else x for n, x in found.items()}

    def source_elts(self) -> dict[str, DataFrame]:
        """Elements that nothing in the frame leads to, by node."""
        return self._ends("dst")

    def sink_elts(self) -> dict[str, DataFrame]:
        """Elements that lead to nothing in the frame."""
        return self._ends("src")

    # projection and restriction

    def select_nodes(self, nodes: Iterable[str]) -> Frame:
        nodes = set(nodes)
        if nodes - set(self.nodes):
            raise ValueError(f"no nodes {sorted(nodes - set(self.nodes))}")
        return self._with(self.graph.keeping(nodes), {n: x for n, x in self.elts.items() if n in nodes}, self.whole & nodes)

    def select_subsets(self, elts: dict[str, DataFrame], trusted: bool = False, closed: bool = False) -> Frame:
        """Only these elements of each node; nodes not named keep none. `trusted`: they are known to be subsets."""
        empty = self.log.spark.createDataFrame([], "hid string")
        new = {}
        for n in self.nodes:
            part = elts.get(n, empty).select("hid")
            new[n] = elts[n] if n in elts and (trusted or elts[n] is self.elts[n]) else part if n not in elts else keyed.within(keyed.distinct(elts[n]), self.elts[n])
        return self._with(elts=new, whole=frozenset(), closed=closed)

    def drop(self, nodes: Iterable[str] | str) -> Frame:
        gone = {nodes} if isinstance(nodes, str) else set(nodes)
        if gone - set(self.nodes):
            raise ValueError(f"no nodes {sorted(gone - set(self.nodes))}")
        return self.select_nodes(set(self.nodes) - gone)

    drop_node = drop_var = drop_func = drop

    def rename(self, names: dict[str, str]) -> Frame:
        """Other names for variables or functions."""
        new = {n: names.get(n, n) for n in self.nodes}
        if set(names) - set(self.nodes) or len(set(new.values())) < len(new):
            raise ValueError("names must be of nodes, and stay distinct")
        return self._with(self.graph.renaming(names), {new[n]: x for n, x in self.elts.items()}, {new[n] for n in self.whole})

    def rename_var(self, old: str, new: str) -> Frame:
        return self.rename({old: new})

    def get_new_vname(self, hint: str | None = None) -> str:
        return fresh_variable(self.nodes, hint)

    def get_new_fname(self, hint: str) -> str:
        return fresh_function(self.nodes, hint)

    def _more(self, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return self.elts | {n: keyed.union(self.elts[n], x) if n in self.elts else keyed.distinct(x) for n, x in parts.items()}

    def add_refs(self, variable: str, refs) -> Frame:
        """More elements of a variable, which may be new."""
        more = Frame.from_vars(self.log, {variable: refs}).elts[variable]
        return self._with(self.graph.adding(variables=[variable]), self._more({variable: more}))

    add_ref = add_refs

    def drop_refs(self, variable: str, refs) -> Frame:
        gone = Frame.from_vars(self.log, {variable: refs}).elts[variable]
        return self._with(elts=self.elts | {variable: self.elts[variable].join(gone, "hid", "left_anti")}, closed=False)

    drop_ref = drop_refs

    def add_calls(self, function: str, calls, with_refs: bool = True) -> Frame:
        """More calls of a function, and their references in every variable that a label connects."""
        more = Frame.from_vars(self.log, {"v": calls}).elts["v"]
        parts = {function: more}
        if with_refs:
            for edge in self.in_edges(function) + self.out_edges(function):
                v = edge[0] if edge[1] == function else edge[1]
                refs = self.link(edge).join(more.withColumnRenamed("hid", "call_hid"), "call_hid", "left_semi").select(F.col("ref_hid").alias("hid"))
                parts[v] = parts[v].unionAll(refs) if v in parts else refs
        return self._with(elts=self._more(parts), closed=self.closed and with_refs)

    add_call = add_calls

    def drop_calls(self, function: str, calls) -> Frame:
        gone = Frame.from_vars(self.log, {"v": calls}).elts["v"]
        return self._with(elts=self.elts | {function: self.elts[function].join(gone, "hid", "left_anti")}, whole=self.whole - {function})

    drop_call = drop_calls

    # invariants

    def violations(self) -> DataFrame:
        """function, label, variable, call_hid, ref_hid: references of calls that a connected variable lacks."""
        parts = []
        for edge in self.edges():
            src, dst, label = edge
            f, v = (dst, src) if dst in self.graph.ops else (src, dst)
            rows = self.link(edge).join(self.elts[f].withColumnRenamed("hid", "call_hid"), "call_hid", "left_semi")
            parts.append(rows.join(self.elts[v].withColumnRenamed("hid", "ref_hid"), "ref_hid", "left_anti").select(F.lit(f).alias("function"), F.lit(label).alias("label"), F.lit(v).alias("variable"), "call_hid", "ref_hid"))
        return union_all(parts) if parts else self.log.spark.createDataFrame([], "function string, label string, variable string, call_hid string, ref_hid string")

    def check(self) -> Frame:
        """Raises unless the graph and the elements fit together."""
        ops = self.graph.ops
        for src, dst, label in self.edges():
            if (src in ops) == (dst in ops) or not {src, dst} <= set(self.nodes):
                raise ValueError(f"edge {src} -> {dst} ({label}) does not join a variable and a function")
        if set(self.elts) != set(self.nodes):
            raise ValueError("elements and graph name different nodes")
        bad = self.violations().first()
        if bad is not None:
            raise ValueError(f"call {bad['call_hid']} of {bad['function']} has a reference under {bad['label']} that {bad['variable']} lacks")
        return self

    # set operations

    def __or__(self, other: Frame) -> Frame:
        ops = dict(self.graph.ops)
        for f, o in other.graph.ops.items():
            if ops.setdefault(f, o) != o or f in self.graph.variables:
                raise ValueError(f"{f} means different things in the two frames")
        graph = Graph(self.graph.variables | other.graph.variables, (), self.graph.edges | other.graph.edges).with_ops(ops)
        elts = {n: keyed.union(self.elts[n], other.elts[n]) if n in self.elts and n in other.elts else self.elts.get(n, other.elts.get(n)) for n in graph.nodes}
        # a function whose edges are the same wherever it stands keeps what `closed` says
        alike = all(set(x.graph.in_edges(f) + x.graph.out_edges(f)) == set(graph.in_edges(f) + graph.out_edges(f)) for x in (self, other) for f in x.graph.ops)
        same = self.closed and other.closed and alike
        out = self._with(graph, elts, self.whole | other.whole, same)
        return out if same else out.check()._with(closed=True)

    def __and__(self, other: Frame) -> Frame:
        nodes = set(self.nodes) & set(other.nodes)
        graph = self.graph.keeping(nodes)
        graph = Graph(graph.variables & other.graph.variables, (), graph.edges & other.graph.edges).with_ops({f: o for f, o in graph.functions if other.graph.ops.get(f) == o})
        elts = {n: keyed.within(self.elts[n], other.elts[n]) for n in graph.nodes}
        return self._with(graph, elts, self.whole & other.whole, self.closed and other.closed)

    def __sub__(self, other: Frame) -> Frame:
        """Without the other's elements; of the rest, what is still computed from the sources of this frame. Empty nodes go."""
        left = {n: keyed.within(x, other.elts[n], "left_anti") if n in other.elts else x for n, x in self.elts.items()}
        return self.select_subsets(left, trusted=True).drop_unreachable("forward", "strong").pinned().cleanup()

    @staticmethod
    def union(*frames: Frame) -> Frame:
        return reduce(Frame.__or__, frames)

    @staticmethod
    def intersection(*frames: Frame) -> Frame:
        return reduce(Frame.__and__, frames)

    # selection by value

    def values(self, nodes: Iterable[str] | None = None) -> DataFrame:
        """node, hid, cid, vtype, i, d, s of the variables' elements."""
        parts = [self.table([v]).join(self.log.values(self.kinds(v)), "hid") for v in (self.vnames if nodes is None else nodes)]
        return union_all(parts) if parts else self.table([]).join(self.log.values(), "hid")

    def kinds(self, variable: str) -> set[str] | None:
        """What the variable can hold, where the log knows it: only the values of these are read."""
        edges, known = self.in_edges(variable) + self.out_edges(variable), keyed.keys_of(self.elts[variable])
        if known is not None:
            return {known.kind}
        if not hasattr(self.log, "kind") or not edges:
            return None
        return {self.log.kind(self.graph.ops[a if a in self.graph.ops else b], x) for a, b, x in edges}

    def where(self, variable: str, condition: Column | str, calls: bool = True) -> Frame:
        """Only elements of one variable whose value meets a condition over i, d, s, vtype, with the calls next to them."""
        kept = self.values([variable]).where(condition).select("hid").distinct()
        elts = {variable: kept} | ({f: x for f, x in self.adjacent(variable, kept).items()} if calls else {})
        others = {n: x for n, x in self.elts.items() if n in self.graph.variables and n != variable}
        return self.select_subsets(others | elts, trusted=True)

    def _by_value(self, condition) -> Frame:
        kept = {v: self.values([v]).where(condition).select("hid").distinct() for v in self.vnames}
        return self._with_adjacent(kept)

    def _with_adjacent(self, kept: dict[str, DataFrame]) -> Frame:
        parts: dict[str, list[DataFrame]] = {}
        for v, x in kept.items():
            for f, calls in self.adjacent(v, x).items():
                parts.setdefault(f, []).append(calls)
        return self.select_subsets(kept | {f: union_all(x).distinct() for f, x in parts.items()}, trusted=True)

    def __lt__(self, scalar) -> Frame:
        """Elements with values below a number or text, in every variable, and the calls next to them."""
        if isinstance(scalar, Frame):
            raise NotImplementedError("frames have no order")
        number = F.coalesce(F.col("d"), F.col("i").cast("double"))
        return self._by_value(F.col("s") < F.lit(scalar) if isinstance(scalar, str) else number < F.lit(float(scalar)))

    def isin(self, values, by: str = "val") -> Frame:
        """Elements by value, history id (hid) or content id (cid), and the calls next to them."""
        if by == "val":
            texts, numbers = [v for v in values if isinstance(v, str)], [float(v) for v in values if isinstance(v, (int, float))]
            tests = [F.col("s").isin(*texts)] if texts else []
            tests += [F.coalesce(F.col("d"), F.col("i").cast("double")).isin(*numbers)] if numbers else []
            tests += [F.col("vtype") == "null"] if any(v is None for v in values) else []
            return self._by_value(reduce(Column.__or__, tests, F.lit(False)))
        if by not in ("hid", "cid"):
            raise ValueError("by is val, hid or cid")
        wanted = shared.hids(self.log.spark, values).distinct()
        if by == "cid":
            wanted = self.log.refs.join(wanted.withColumnRenamed("hid", "cid"), "cid", "left_semi").select("hid").distinct()
        return self._with_adjacent({v: self.elts[v].join(wanted, "hid", "left_semi") for v in self.vnames})

    def apply(self, f: Callable[[Column], Column], column: str = "s") -> DataFrame:
        """node, hid and f of the value column, which may be built-in expressions or a pandas UDF."""
        return self.values().select("node", "hid", f(F.col(column)).alias("value"))

    # merging

    def move_refs(self, source: str, target: str, refs) -> Frame:
        moved = Frame.from_vars(self.log, {"v": refs}).elts["v"].join(self.elts[source], "hid", "left_semi")
        elts = self.elts | {source: self.elts[source].join(moved, "hid", "left_anti"), target: self.elts[target].unionAll(moved).distinct()}
        return self._with(elts=elts, closed=False)

    move_ref = move_refs

    def merge_into(self, node: str, into: str) -> Frame:
        """All elements and edges of a variable become those of another."""
        new = lambda n: into if n == node else n
        graph = Graph(self.graph.variables - {node}, self.graph.functions, frozenset((new(a), new(b), x) for a, b, x in self.graph.edges))
        elts = {n: x for n, x in self.elts.items() if n != node}
        return self._with(graph, elts | {into: elts[into].unionAll(self.elts[node]).distinct()}, closed=self.closed)

    def merge_vars(self) -> Frame:
        """Merge each variable that is a strict subset of another, until none is. One aggregate tells all overlaps."""
        together = self.refs_by_var().groupBy("hid").agg(F.array_sort(F.collect_set("node")).alias("nodes")).groupBy("nodes").count().collect()
        size, both = dict.fromkeys(self.vnames, 0), {}
        for nodes, n in together:
            for a in nodes:
                size[a] += n
                for b in nodes:
                    both[a, b] = both.get((a, b), 0) + n
        out, left = self, list(self.vnames)
        found = True
        while found:
            found = next(((a, b) for a in left for b in left if a != b and both.get((a, b), 0) == size[a] < size[b]), None)
            if found:
                out = out.merge_into(*found)
                left.remove(found[0])
        return out

    def cleanup(self) -> Frame:
        """Without nodes that have no elements."""
        return self.drop([n for n, k in self.sizes().items() if not k])

    simplify = cleanup

    # deletion

    def delete_calls(self) -> None:
        """Remove the frame's calls and all that depends on them from the store."""
        provenance.drop_calls(self.log, self.calls_by_func().select("hid"), delete_dependents=True)
        if self.storage is not None:
            self.storage.clear_cache(True)

    def delete_calls_from_df(self, df: DataFrame) -> None:
        """The same for the calls in a table made by df()."""
        calls = [df.select(F.explode(F.split(c, ",")).alias("hid")) for c in df.columns if c in self.graph.ops]
        provenance.drop_calls(self.log, union_all(calls).where("hid is not null"), delete_dependents=True)
        if self.storage is not None:
            self.storage.clear_cache(True)

    # operators of their own modules

    def expand_back(self, varnames=None, recursive: bool = False, skip_existing: bool = False, reuse_existing: bool = True) -> Frame:
        return expand.expand(self, "back", varnames, recursive, skip_existing, reuse_existing)

    def expand_forward(self, varnames=None, recursive: bool = False, skip_existing: bool = False, reuse_existing: bool = True) -> Frame:
        return expand.expand(self, "forward", varnames, recursive, skip_existing, reuse_existing)

    def expand_all(self, skip_existing: bool = False, reuse_existing: bool = True) -> Frame:
        return expand.expand_all(self, skip_existing, reuse_existing)

    def reachable_elts(self, initial: dict[str, DataFrame], direction: str = "forward", how: str = "strong") -> dict[str, DataFrame]:
        return reach.reachable_elts(self, initial, direction, how)

    def downstream(self, *nodes: str, how: str = "strong") -> Frame:
        return reach.stream(self, nodes, "forward", how)

    def upstream(self, *nodes: str, how: str = "strong") -> Frame:
        return reach.stream(self, nodes, "back", how)

    def midstream(self, *nodes: str, how: str = "strong") -> Frame:
        return reach.midstream(self, nodes, how, alone=False)

    def drop_unreachable(self, direction: str = "forward", how: str = "strong") -> Frame:
        return reach.drop_unreachable(self, direction, how)

    def history(self, variable: str) -> DataFrame:
        return history.history(self, variable)

    def joint_history(self, variables: Iterable[str], how: str = "outer") -> DataFrame:
        return history.joint_history(self, variables, how)

    def df(self, *nodes: str, values: str = "objs", lazy_vars: Iterable[str] = (), include_calls: bool = True, join_how: str = "outer") -> DataFrame:
        return history.table(self, nodes, values, lazy_vars, include_calls, join_how)

    def eval(self, *nodes: str, values: str = "objs"):
        """The joint table with Python values, as pandas; for results of a driver's size."""
        return history.evaluate(self, nodes, values)

    def get_func_table(self, function: str) -> DataFrame:
        return history.func_table(self, function)

    def get_var_values(self, variable: str) -> DataFrame:
        return history.var_values(self, variable)

    def get(self, hids) -> DataFrame:
        return self.log.refs.join(shared.hids(self.log.spark, hids), "hid", "left_semi")

    def get_var_stats(self) -> DataFrame:
        return describe.var_stats(self)

    def get_func_stats(self) -> DataFrame:
        return describe.func_stats(self)

    def var_info(self, variable: str) -> DataFrame:
        return describe.var_info(self, variable)

    def edge_stats(self) -> DataFrame:
        return describe.edge_stats(self)

    def get_graph_desc(self) -> str:
        return describe.graph_text(self.graph)

    def info(self) -> str:
        return describe.info(self)

    def draw(self, verbose: bool = False, path: str | None = None) -> str:
        return describe.dot(self, verbose, path)

    def __repr__(self) -> str:
        return f"Frame with {len(self.vnames)} variables and {len(self.fnames)} functions\n{self.get_graph_desc()}"


from . import describe, expand, history, reach  # noqa: E402  they name Frame's graph only
