"""Queries over the log as a whole: who made and who used what, transitive closures, deletion and garbage.

Each function takes a log (a Store or a Log of facts) and DataFrames of ids; none collects. Closures walk a frontier: what is
new in a round is joined with the log and freed of what is known by an anti-join, so every edge is read through a small side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import keyed
from ..sources.shared import cut


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(df.columns[0]).alias(name)).distinct()


def _calls(calls: DataFrame) -> DataFrame:
    """Calls by the name call_hid, with what is known of them."""
    return keyed.like_calls(calls.select(F.col("hid").alias("call_hid")), calls)


def creators(log, refs: DataFrame, ops=None) -> DataFrame:
    """call_hid of the calls that made any of the references."""
    if hasattr(log, "touching"):
        return _calls(log.touching(refs, ops, "out"))
    return log.io(ops, "out", fields=("call_hid", "ref_hid")).join(_one(refs, "ref_hid"), "ref_hid", "left_semi").select("call_hid").distinct()


def consumers(log, refs: DataFrame, ops=None) -> DataFrame:
    if hasattr(log, "touching"):
        return _calls(log.touching(refs, ops, "in"))
    return log.io(ops, "in", fields=("call_hid", "ref_hid")).join(_one(refs, "ref_hid"), "ref_hid", "left_semi").select("call_hid").distinct()


def _side(log, calls: DataFrame, direction: str, ops) -> DataFrame:
    return log.io(ops, direction, fields=("call_hid", "ref_hid")).join(_one(calls, "call_hid"), "call_hid", "left_semi").select("ref_hid").distinct()


def inputs_of(log, calls: DataFrame, ops=None) -> DataFrame:
    return _side(log, calls, "in", ops)


def outputs_of(log, calls: DataFrame, ops=None) -> DataFrame:
    return _side(log, calls, "out", ops)


def get_calls(log, calls: DataFrame, ops=None) -> DataFrame:
    """call_hid, op, inputs, outputs: each call asked for, with its references by name."""
    rows = log.io(ops, fields=("call_hid", "op", "name", "direction", "ref_hid")).join(_one(calls, "call_hid"), "call_hid", "left_semi")
    side = lambda d: F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.struct("name", "ref_hid")))))
    return rows.groupBy("call_hid", "op").agg(side("in").alias("inputs"), side("out").alias("outputs"))


def existing_calls(log, calls: DataFrame) -> DataFrame:
    return _one(calls, "call_hid").join(log.io(fields=["call_hid"]), "call_hid", "left_semi")


def existing_contents(log, contents: DataFrame) -> DataFrame:
    return _one(contents, "call_cid").join(log.io(fields=["call_cid"]), "call_cid", "left_semi")


def existing_refs(log, refs: DataFrame) -> DataFrame:
    return _one(refs, "ref_hid").join(log.io(fields=["ref_hid"]), "ref_hid", "left_semi")


def count_calls(log, ops=None) -> DataFrame:
    """op and its number of calls."""
    return log.io(ops, "out", fields=("op", "call_hid")).groupBy("op").agg(F.countDistinct("call_hid").alias("calls"))


def closure(log, refs: DataFrame | None, calls: DataFrame | None, back: bool, ops=None) -> tuple[DataFrame, DataFrame]:
    """(references, calls) reached from the start, the start included; ops may narrow the log."""
    spark = log.spark
    if hasattr(log, "reach") and (found := log.reach(refs, calls, back, ops)) is not None:
        return found[0], _calls(found[1])
    near, far = ("out_hid", "in_hid") if back else ("in_hid", "out_hid")
    step_of = _edges_from(log, ops, near, far) if hasattr(log, "touching") else _rows_from(log, ops, back)
    empty = lambda name: spark.createDataFrame([], f"{name} string")
    seen_refs = cut(_one(refs, "hid")) if refs is not None else empty("hid")
    seen_calls = cut(_one(calls, "call_hid")) if calls is not None else empty("call_hid")
    frontier = seen_refs
    if calls is not None:
        # what the given calls touch on the far side is where the walk goes on
        side = inputs_of(log, seen_calls, ops) if back else outputs_of(log, seen_calls, ops)
        frontier = cut(frontier.unionAll(side.select(F.col("ref_hid").alias("hid"))).distinct())
        seen_refs = frontier
    known_refs, known_calls = Rounds(seen_refs), Rounds(seen_calls)
    while not frontier.isEmpty():
        step = cut(step_of(frontier))
        known_calls.add(step.select("call_hid").distinct())
        frontier = known_refs.add(step.select(F.col("far").alias("hid")).distinct())
    return known_refs.all, known_calls.all


def _edges_from(log, ops, near: str, far: str):
    edges = log.edges(ops).select("call_hid", F.col(near).alias("near"), F.col(far).alias("far"))
    return lambda frontier: edges.join(frontier, edges.near == frontier.hid, "left_semi").select("call_hid", "far").distinct()


def _rows_from(log, ops, back: bool):
    """From references to the calls next to them and those calls' references on the far side; only calls found meet their other side."""
    sides = ("out", "in") if back else ("in", "out")
    near, far = (log.io(ops, d, fields=("call_hid", "ref_hid")) for d in sides)

    def step(frontier: DataFrame) -> DataFrame:
        calls = keyed.joined(near, frontier.select(F.col("hid").alias("ref_hid")), "ref_hid", "left_semi").select("call_hid")
        return keyed.joined(far, calls, "call_hid", "left_semi").select("call_hid", F.col("ref_hid").alias("far")).distinct()

    return step


class Rounds:
    """A growing set of ids: each round writes what is new only, and now and then the parts are written as one."""

    def __init__(self, first: DataFrame, merge: int = 8):
        self.parts, self.merge = [first], merge

    @property
    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.parts)

    def add(self, found: DataFrame) -> DataFrame:
        """Take in ids and give back those that are new."""
        new = cut(found.join(self.all, found.columns[0], "left_anti"))
        self.parts.append(new)
        if len(self.parts) > self.merge:
            self.parts = [cut(self.all)]
        return new


def dependencies(log, refs: DataFrame | None = None, calls: DataFrame | None = None, ops=None) -> tuple[DataFrame, DataFrame]:
    return closure(log, refs, calls, True, ops)


def dependents(log, refs: DataFrame | None = None, calls: DataFrame | None = None, ops=None) -> tuple[DataFrame, DataFrame]:
    return closure(log, refs, calls, False, ops)


def dependents_sql(log, refs: DataFrame, depth: int, ops=None) -> DataFrame:
    """hid of all dependents over at most `depth` calls by a recursive query; for shallow logs without cycles."""
    names = [f"tl_{x}" for x in ("edges", "start")]
    log.edges(ops).select("in_hid", "out_hid").createOrReplaceTempView(names[0])
    _one(refs, "hid").createOrReplaceTempView(names[1])
    return log.spark.sql(
        f"with recursive reach(hid, depth) as (select hid, 0 from {names[1]} union all select e.out_hid, r.depth + 1 from reach r join {names[0]} e on e.in_hid = r.hid where r.depth < {int(depth)}) select distinct hid from reach"
    )


def orphans(log) -> DataFrame:
    """hid of references that stand in no call."""
    return log.refs.select("hid").distinct().join(log.io(fields=["ref_hid"]).toDF("hid"), "hid", "left_anti")


def unreferenced(store) -> DataFrame:
    """cid of payloads that no call and no reference names."""
    atoms = store.table("atoms").select("cid").distinct()
    parts = store.refs.select(F.explode("elems").alias("e")).select(F.col("e.cid").alias("cid"))
    used = store.refs.select("cid").unionAll(parts).unionAll(store.io(fields=["ref_cid"]).toDF("cid"))
    return atoms.join(used, "cid", "left_anti")


def drop_calls(store, calls: DataFrame, delete_dependents: bool = False) -> None:
    """Tombstones for the calls and, if asked, for all calls downstream of them."""
    gone = _one(calls, "call_hid")
    if delete_dependents:
        gone = dependents(store, calls=gone)[1]
    store.tombstone(gone)


def remaining(log, calls: DataFrame, delete_dependents: bool = True, ops=None) -> DataFrame:
    """The log's rows without the calls and, if asked, without their dependents: what drop_calls would leave."""
    gone = dependents(log, calls=calls, ops=ops)[1] if delete_dependents else _one(calls, "call_hid")
    if hasattr(log, "without"):
        return log.without(gone, ops)
    return log.io(ops).join(gone, "call_hid", "left_anti")


def collect_garbage(store) -> None:
    """Rewrite refs without orphans (elements of a kept list or dict stay), then atoms without what nothing names."""
    used = store.io(fields=["ref_hid"]).toDF("hid")
    live = used.distinct()
    frontier = live
    while True:  # elements of live lists and dicts, level by level
        parts = store.refs.join(frontier, "hid", "left_semi").select(F.explode("elems").alias("e")).select(F.col("e.hid").alias("hid")).distinct()
        frontier = cut(parts.join(live, "hid", "left_anti"))
        if frontier.isEmpty():
            break
        live = cut(live.unionAll(frontier))
    with store.transaction():
        store.replace("refs", store.refs.join(live, "hid", "left_semi"))
        keep = store.table("atoms").join(unreferenced(store), "cid", "left_anti")
        store.replace("atoms", keep)
