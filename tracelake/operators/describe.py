"""Counts and text about a frame: stats of nodes and edges, its graph as text and as DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import Frame, union_all
from .graph import Graph


def _with_empty(frame: Frame, counted: DataFrame, nodes: list[str], name: str, count: str) -> DataFrame:
    every = frame.log.spark.createDataFrame([(n,) for n in nodes], f"{name} string")
    return every.join(counted, name, "left").select(name, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def var_stats(frame: Frame) -> DataFrame:
    """variable and its number of values."""
    return _with_empty(frame, frame.refs_by_var().groupBy(F.col("node").alias("variable")).agg(F.count("*").alias("values")), frame.vnames, "variable", "values")


def func_stats(frame: Frame) -> DataFrame:
    """function and its number of calls."""
    return _with_empty(frame, frame.calls_by_func().groupBy(F.col("node").alias("function")).agg(F.count("*").alias("calls")), frame.fnames, "function", "calls")


def edge_stats(frame: Frame) -> DataFrame:
    """source, target, label, and how many calls and references the edge joins."""
    parts = []
    for e in frame.edges():
        call, ref = ("dst", "src") if e[1] in frame.graph.ops else ("src", "dst")
        parts.append(frame.pairs(e).select(*(F.lit(x).alias(n) for x, n in zip(e, ("source", "target", "label"), strict=True)), F.col(call).alias("call"), F.col(ref).alias("ref")))
    if not parts:
        return frame.log.spark.createDataFrame([], "source string, target string, label string, calls long, refs long")
    return union_all(parts).groupBy("source", "target", "label").agg(F.countDistinct("call").alias("calls"), F.countDistinct("ref").alias("refs"))


def var_info(frame: Frame, variable: str) -> DataFrame:
    """role (creator or consumer), function, label, and the number of its calls that touch the variable."""
    rows = edge_stats(frame.select_nodes({variable, *frame.in_neighbors(variable), *frame.out_neighbors(variable)}))
    made = F.col("target") == variable
    rows = rows.where(made | (F.col("source") == variable))
    return rows.select(F.when(made, "creator").otherwise("consumer").alias("role"), F.when(made, F.col("source")).otherwise(F.col("target")).alias("function"), "label", "calls")


def version_counts(frame: Frame) -> DataFrame:
    """function and the number of semantic versions among its calls."""
    parts = [frame.log.io([o]).join(frame.elts[f].withColumnRenamed("hid", "call_hid"), "call_hid", "left_semi").select(F.lit(f).alias("function"), "semantic_version") for f, o in frame.graph.functions]
    return union_all(parts).groupBy("function").agg(F.countDistinct("semantic_version").alias("versions"))


def graph_text(graph: Graph) -> str:
    """One line for each function: outputs @ labels = function(label=variable, ...)."""
    lines = []
    for f in [n for n in graph.order() if n in graph.ops]:
        by = {}
        for v, _, x in graph.in_edges(f):
            by.setdefault(x, []).append(v)
        ins = ", ".join(f"{x}={' | '.join(vs)}" for x, vs in sorted(by.items()))
        outs = ", ".join(f"{v}@{x}" for _, v, x in graph.out_edges(f))
        lines.append(f"{outs or '_'} = {f}({ins})")
    alone = [v for v in sorted(graph.variables) if not graph.in_edges(v) and not graph.out_edges(v)]
    return "\n".join(lines + alone)


def info(frame: Frame) -> str:
    """Sizes of all nodes, and the graph."""
    size = frame.sizes()
    lines = [f"variable {n}: {size[n]} values" for n in frame.vnames] + [f"function {n}: {size[n]} calls" for n in frame.fnames]
    return "\n".join(lines + [graph_text(frame.graph)])


def dot(frame: Frame, verbose: bool = False, path: str | None = None) -> str:
    """The graph in DOT; verbose adds sizes of nodes and edges, source and sink counts. Written to a file if a path is given."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    size = frame.sizes() if verbose else {}
    ends = {}
    if verbose:
        for kind, of in (("sources", frame.source_elts()), ("sinks", frame.sink_elts())):
            rows = union_all(x.select(F.lit(n).alias("node")) for n, x in of.items()).groupBy("node").count().collect()
            for n, k in rows:
                ends.setdefault(n, []).append(f"{k} {kind}")
    calls = {tuple(r[:3]): r["calls"] for r in edge_stats(frame).collect()} if verbose else {}
    lines = ["digraph {", "  rankdir=TB;"]
    for n in frame.nodes:
        text = [n] + ([f"{size[n]} {'calls' if n in frame.graph.ops else 'values'}", *ends.get(n, [])] if verbose else [])
        lines.append(f"  {quote(n)} [shape={'box' if n in frame.graph.ops else 'ellipse'}, label={quote(chr(10).join(text))}];")
    for e in frame.edges():
        label = e[2] + (f"\n({calls.get(e, 0)})" if verbose else "")
        lines.append(f"  {quote(e[0])} -> {quote(e[1])} [label={quote(label)}];")
    out = "\n".join([*lines, "}"])
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(out)
    return out
