"""Tables of joint histories: for each element of a variable, all that it was computed from, and joins of such tables.

A cell holds a history id, or several joined by commas in sorted order where a variable gives more than one (lists, cycles,
several paths). Cells are text either way, so tables join on them. Joins are null-safe: missing parts match missing parts.

Where the graph has no cycle above a variable, few paths and single-valued labels, a history is a chain of left joins with the
wide tables of the calls. Otherwise (root, node, element) triples are closed over the graph and pivoted.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import entity_hid
from ..sources import keyed
from ..sources.shared import cut
from .frame import Frame, union_all
from .reach import midstream, wide

#: Joins of wide tables in one plan, at most; beyond it triples are closed.
PATHS = 48


def _paths(frame: Frame, variable: str) -> int | None:
    """How many nodes stand on all backward paths from a variable, or None where paths are endless or labels plural."""
    part = frame.graph.keeping(frame.graph.reachable([variable], "back"))
    if not part.acyclic or any(frame.log.plural(part.ops[f], e[2]) for f in part.ops for e in part.in_edges(f) + part.out_edges(f)):
        return None
    count: dict[str, int] = {}
    for n in part.order():
        count[n] = 1 + sum(count[e[0]] for e in part.in_edges(n))
    return count[variable]


def _chain(frame: Frame, variable: str) -> DataFrame:
    """Left joins with the calls' wide tables along every path; the columns of a node on several paths are merged at the end."""
    out, columns, todo = frame.elts[variable].select(F.col("hid").alias("0")), {variable: ["0"]}, [(variable, "0")]
    taken = 1
    while todo:
        v, at = todo.pop()
        for f, _, label in frame.in_edges(v):
            ins = frame.in_edges(f)
            made = wide(frame, f, None, sorted({label, *(e[2] for e in ins)}))
            names = [str(taken + i) for i in range(len(ins) + 1)]
            taken += len(names)
            made = made.select(F.col("call_hid").alias(names[0]), F.col(label).alias("made"), *[F.col(e[2]).alias(n) for e, n in zip(ins, names[1:], strict=True)])
            if not frame.closed:
                for (u, _, _), n in zip(ins, names[1:], strict=True):
                    made = made.join(frame.elts[u].select(F.col("hid").alias(n), F.lit(True).alias("there")), n, "left").withColumn(n, F.when(F.col("there"), F.col(n))).drop("there")
            out = out.join(made, F.col(at) == F.col("made"), "left").drop("made")
            columns.setdefault(f, []).append(names[0])
            for (u, _, _), n in zip(ins, names[1:], strict=True):
                columns.setdefault(u, []).append(n)
                todo.append((u, n))
    cells = {n: F.col(c[0]) if len(c) == 1 else F.when(F.coalesce(*c).isNotNull(), _several(c)) for n, c in columns.items()}
    return out.select(*[cells[n].alias(n) for n in frame.sort_nodes(cells)])


def _tree(frame: Frame, variable: str, merged: bool) -> bool:
    """Whether the elements of all variables above one, itself included, are just the references of whole ops of a log of facts, each
    variable made by one function at most, on few paths; unless `merged`, on one path each."""
    if not (hasattr(frame.log, "facts") and frame.closed and len(frame.in_edges(variable)) == 1):
        return False
    paths = _paths(frame, variable)
    nodes = frame.graph.reachable([variable], "back")
    if paths is None or paths > PATHS or not merged and paths > len(nodes):
        return False
    for n in nodes:
        if n in frame.graph.ops:
            if n not in frame.whole:
                return False
            continue
        known, edges = keyed.keys_of(frame.elts[n]), frame.in_edges(n)
        touching = {(frame.graph.ops[e[0] if e[0] in frame.graph.ops else e[1]], e[2]) for e in edges + frame.out_edges(n)}
        if known is None or known.edges is None or known.edges != touching or len(edges) > 1:
            return False
    return True


def _over_keys(frame: Frame, variable: str, how: str, texts=frozenset()) -> DataFrame:
    """The chain of a `_tree` over keys, from the calls that made the variable; ids (for some variables texts) are made at the end.

    With how = full_outer, what no call used gets rows of its own.
    """
    cells: dict[str, list[Column]] = {}
    taken = iter(range(1 << 30))

    def grow(f: str):
        fact = frame.log.facts[frame.graph.ops[f]].renamed(f"{next(taken)}_")
        df = fact.rows
        cells.setdefault(f, []).append(fact.call())
        for u, _, label in frame.in_edges(f):
            kind, key = fact.kind(label), fact.key(label)
            for g, _, made in frame.in_edges(u):
                inner, source = grow(g)
                other = source.key(made)
                if not keyed.like(fact.types()[label], source.types()[made]):
                    key, other = key.cast("string"), other.cast("string")
                df = df.join(inner, key == other, how)
                key = F.coalesce(key, other) if how == "full_outer" else key
            cells.setdefault(u, []).append(_cell(kind, key, u in texts))
        return df, fact

    ((f, _, label),) = frame.in_edges(variable)
    df, fact = grow(f)
    cells[variable] = [_cell(fact.kind(label), fact.key(label), variable in texts)]
    names = frame.sort_nodes(cells)
    return df.select(*[(c[0] if len(c := cells[n]) == 1 else F.when(F.coalesce(*c).isNotNull(), _several(c))).alias(n) for n in names])


def _cell(kind: str, key: Column, text: bool) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string")) if text else entity_hid(kind, key)


def _several(cells: list) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cells)))), ",")


def closure(frame: Frame, variable: str) -> DataFrame:
    """root, node, hid: all that the elements of a variable were computed from, calls included."""
    nodes = frame.graph.reachable([variable], "back")
    part = frame.graph.keeping(nodes)
    start = frame.elts[variable].select(F.col("hid").alias("root"), F.lit(variable).alias("node"), "hid")

    def step(state: dict[str, DataFrame], node: str) -> list[tuple[str, DataFrame]]:
        found = []
        for e in part.in_edges(node):
            pairs = frame.pairs(e).select(F.col("src"), F.col("dst").alias("hid"))
            found.append((e[0], state[node].join(pairs, "hid").select("root", F.col("src").alias("hid"))))
        return found

    if part.acyclic:
        state = {variable: start.select("root", "hid")}
        for node in part.order()[::-1]:
            if node in state:
                state[node] = state[node].distinct()
                for n, rows in step(state, node):
                    state[n] = state[n].unionAll(rows) if n in state else rows
        return union_all(x.select("root", F.lit(n).alias("node"), "hid") for n, x in state.items())
    seen = frontier = cut(start)
    while not frontier.isEmpty():
        state = {n: frontier.where(F.col("node") == n).select("root", "hid") for n in part.nodes}
        rows = [x.select("root", F.lit(n).alias("node"), "hid") for node in part.nodes for n, x in step(state, node)]
        frontier = cut(union_all(rows).distinct().join(seen, ["root", "node", "hid"], "left_anti"))
        seen = cut(seen.unionAll(frontier))
    return seen


def history(frame: Frame, variable: str) -> DataFrame:
    """One row for each element of a variable: columns for it and all its ancestors, calls included."""
    if _tree(frame, variable, True):
        return _over_keys(frame, variable, "left")
    paths = _paths(frame, variable)
    if paths is not None and paths <= PATHS:
        return _chain(frame, variable)
    nodes = frame.sort_nodes(frame.graph.reachable([variable], "back"))
    rows = closure(frame, variable).groupBy("root").pivot("node", nodes).agg(F.array_join(F.array_sort(F.collect_set("hid")), ","))
    return rows.select(*[F.when(F.col(n) != "", F.col(n)).alias(n) for n in nodes])


def _null_safe_join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    both = [c for c in a.columns if c in b.columns]
    if not both:  # nothing in common: an outer join keeps the rows of each, an inner join none
        return a.unionByName(b, allowMissingColumns=True) if how == "outer" else a.unionByName(b, allowMissingColumns=True).where("false")
    right = b.select(*[F.col(c).alias(f"__{c}") if c in both else F.col(c) for c in b.columns])
    joined = a.join(right, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in both]), "full_outer" if how == "outer" else "inner")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in both else F.col(c) for c in a.columns], *[c for c in b.columns if c not in both])


def joint_history(frame: Frame, variables, how: str = "outer") -> DataFrame:
    """The history tables of variables joined on all columns they share, in topological order."""
    if how not in ("outer", "inner"):
        raise ValueError("how is outer or inner")
    tables = [history(frame, v) for v in frame.sort_nodes(variables)]
    out = reduce(lambda a, b: _null_safe_join(a, b, how), tables)
    return out.select(*frame.sort_nodes(out.columns))


def root_variables(frame: Frame) -> list[str]:
    """Variables with an element that leads to nothing, by one job."""
    ends = frame.sink_elts()
    sinks = [v for v in frame.vnames if not frame.out_edges(v)]
    rest = [v for v in frame.vnames if frame.out_edges(v)]
    sinks = [v for v in sinks if frame.closed and any(f in frame.whole for f in frame.in_neighbors(v))] or []
    ask = [v for v in [*rest, *(v for v in frame.vnames if not frame.out_edges(v))] if v not in sinks]
    found = {r[0] for r in union_all(ends[v].limit(1).select(F.lit(v).alias("v")) for v in ask).collect()} if ask else set()
    return frame.sort_nodes(found | set(sinks))


def table(frame: Frame, nodes=(), values: str = "objs", lazy_vars=(), include_calls: bool = True, join_how: str = "outer") -> DataFrame:
    """The joint table over nodes: rows are (partial) computations from the sources of what lies between them.

    values: "refs" gives history ids, "objs" values; lazy_vars stay ids, and so do calls.
    """
    nodes = list(nodes) or frame.nodes
    if len(nodes) == 1:
        only = frame.elts[nodes[0]].select(F.col("hid").alias(nodes[0]))
        return only if values == "refs" or nodes[0] in frame.graph.ops else attach_values(frame, only, [nodes[0]])
    part = midstream(frame, nodes)
    if len(part.sinks) == 1 and part.sinks[0] in part.graph.variables and _tree(part, part.sinks[0], False) and set(part.nodes) == part.graph.reachable(part.sinks, "back"):
        # what is used ends in the one sink, so the tables of the other roots only add what is not
        show = [n for n in nodes if n in part.graph.variables and n not in set(lazy_vars)] if values != "refs" else []
        out = _over_keys(part, part.sinks[0], "left" if join_how == "inner" else "full_outer", frozenset(show))
        return out.select(*[c for c in out.columns if c in nodes and (include_calls or c not in frame.graph.ops)])
    roots = root_variables(part)
    if not roots:
        return frame.log.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in nodes))
    out = joint_history(part, roots, join_how)
    wanted = [c for c in out.columns if c in nodes and (include_calls or c not in frame.graph.ops)]
    out = out.select(*wanted)
    if values == "refs":
        return out
    return attach_values(frame, out, [c for c in wanted if c in frame.graph.variables and c not in set(lazy_vars)])


def attach_values(frame: Frame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids in the columns become values, by one left join each at the end of the plan.

    A variable whose atoms are all of one type gives a column of that type, else text. A cell of several gives a list as text.
    """
    plural, order = _plural(df, columns) if not hasattr(frame.log, "facts") else set(), df.columns
    for c in columns:
        value = typed(frame, c)
        if c not in plural:
            df = df.join(value.select(F.col("hid").alias(c), F.col("value").alias("__value")), c, "left").withColumn(c, F.col("__value")).drop("__value")
            continue
        cells = df.select(c).where(F.col(c).isNotNull()).distinct()
        parts = cells.select(c, F.posexplode(F.split(c, ",")).alias("at", "hid")).join(value, "hid", "left")
        lists = parts.groupBy(c).agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("value")))).alias("x"))
        many = F.concat(F.lit("["), F.array_join("x.value", ", ", "null"), F.lit("]"))
        lists = lists.select(c, F.when(F.size("x") > 1, many).otherwise(F.col("x")[0]["value"]).alias("__value"))
        df = df.join(lists, c, "left").withColumn(c, F.col("__value")).drop("__value")
    return df.select(*order)


def _plural(df: DataFrame, columns: list[str]) -> set[str]:
    if not columns:
        return set()
    found = df.agg(*[F.max(F.col(c).contains(",")).alias(c) for c in columns]).first()
    return {c for c in columns if found[c]}


def typed(frame: Frame, variable: str) -> DataFrame:
    """hid and value of a variable's elements, typed where all agree; lists and dicts are written as their elements' ids."""
    if hasattr(frame.log, "facts"):
        return frame.log.values(frame.kinds(variable)).select("hid", F.col("s").alias("value"))
    rows = frame.values([variable])
    kinds = {r[0] for r in rows.select("vtype").distinct().collect()} - {"null"}
    column = {"int": F.col("i"), "float": F.col("d"), "bool": F.col("i").cast("boolean"), "str": F.col("s")}
    value = column[next(iter(kinds))] if len(kinds) == 1 and kinds <= column.keys() else F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"))
    return rows.select("hid", value.alias("value"))


def func_table(frame: Frame, function: str) -> DataFrame:
    """call_hid and a column for each name of a function's calls; null where the reference is not in the frame."""
    op = frame.graph.ops[function]
    out = frame.log.wide(op)
    if function not in frame.whole:
        out = out.join(frame.elts[function].withColumnRenamed("hid", "call_hid"), "call_hid", "left_semi")
    if frame.closed:
        return out
    by_label = {}
    for src, dst, label in frame.in_edges(function) + frame.out_edges(function):
        by_label.setdefault(label, []).append(frame.elts[src if dst == function else dst])
    for c in [c for c in out.columns if c != "call_hid"]:
        label = "elts" if op == "__make_list__" and c.startswith("elts_") else c
        known = by_label.get(label)
        if known is None:
            out = out.withColumn(c, F.lit(None).cast("string"))
        else:
            there = union_all(known).distinct().select(F.col("hid").alias(c), F.lit(True).alias("__in"))
            out = out.join(there, c, "left").withColumn(c, F.when(F.col("__in"), F.col(c))).drop("__in")
    return out


def var_values(frame: Frame, variable: str) -> DataFrame:
    """hid and value of one variable."""
    return typed(frame, variable).join(frame.elts[variable], "hid", "left_semi")


def evaluate(frame: Frame, nodes=(), values: str = "objs") -> pd.DataFrame:
    """The joint table with Python objects, collections included; ids where values is "refs"."""
    out = table(frame, nodes, "refs").toPandas()
    if values == "refs" or frame.storage is None:
        return out
    storage = frame.storage
    for c in [c for c in out.columns if c in frame.graph.variables]:
        hids = {h for cell in out[c] if isinstance(cell, str) for h in cell.split(",")}
        storage._refs_of(set(hids) - storage._shapes.keys())
        refs = {h: storage.load_ref(h) for h in hids}
        got = dict(zip(refs, storage.unwrap(list(refs.values())), strict=True))
        got |= {h: name for h, r in refs.items() if (name := storage.pointer_of(r)) is not None}  # a named value stands by its name
        cell = lambda x: None if not isinstance(x, str) else got[x] if "," not in x else tuple(got[h] for h in x.split(","))  # noqa: B023, E731
        out[c] = pd.Series([cell(x) for x in out[c]], index=out.index, dtype=object)
    return out
