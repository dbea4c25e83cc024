"""Frames over stored calls: tables, expansion, reachability, set operations, selection, merging."""

import pytest

from tracelake import Frame, MList, Storage, op
from tracelake.operators import provenance


@op
def inc(x: int) -> int:
    return x + 1


@op(output_names=["z"])
def add(x: int, y: int) -> int:
    return x + y


@op(output_names=["w"])
def mul(x: int, y: int) -> int:
    return x * y


@op(output_names=["v"])
def final(t: int) -> int:
    return -t


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def composition(spark):
    storage = Storage(spark)
    with storage:
        for x in range(5):
            y = inc(x)
            if x % 2 == 0:
                add(x, y)
    return storage


def test_table_of_one_op(spark):
    storage = Storage(spark)
    with storage:
        for x in range(10):
            inc(x)
    df = storage.frame(inc).df()
    assert len(df.columns) == 3 and df.columns == ["x", "inc", "var_0"]
    assert rows(df.select("x", "var_0")) == sorted(((x, x + 1) for x in range(10)), key=str)
    assert dict(df.dtypes)["x"] == "bigint"


def test_from_the_consumer(composition):
    frame = composition.frame(add).expand_all()
    df = frame.df(include_calls=False)
    assert rows(df) == sorted(((x, x + 1, 2 * x + 1) for x in (0, 2, 4)), key=str)
    assert frame.sizes() == {"add": 3, "inc": 3, "x": 3, "y": 3, "z": 3}


def test_from_the_creator(composition):
    frame = composition.frame(inc).expand_all().rename({"var_0": "y"})
    assert set(frame.nodes) == {"x", "y", "z", "inc", "add"}
    df = frame.df()
    got = rows(df.select("x", "y", "z"))
    assert got == sorted(((x, x + 1, 2 * x + 1 if x % 2 == 0 else None) for x in range(5)), key=str)
    assert df.where("add is null").count() == 2
    inner = frame.df(join_how="inner").select("x", "y", "z")
    assert inner.count() == 3
    refs = frame.df("x", "z", values="refs")
    assert refs.columns == ["x", "z"] and refs.where("length(x) = 32").count() == refs.count()
    lazy = frame.df("x", "y", lazy_vars=["y"])
    assert lazy.where("length(y) = 32").count() == 5
    py = frame.eval("x", "y")
    assert sorted(zip(py["x"], py["y"])) == [(x, x + 1) for x in range(5)]
    frame.check()


def test_branches_merge(spark):
    storage = Storage(spark)
    with storage:
        for x in range(10):
            y = inc(x)
            final(add(x, y) if x < 5 else mul(x, y))
    frame = storage.frame(inc).expand_all().merge_vars()
    df = frame.df()
    assert df.count() == 10
    end = [n for n in frame.sinks][0]
    start = frame.sources[0]
    assert rows(df.select(start, end)) == sorted(((x, -(2 * x + 1) if x < 5 else -(x * x + x)) for x in range(10)), key=str)


def test_start_from_one_result(spark):
    """A shared input is consumed within the frame, so its other consumers are not pulled in."""
    storage = Storage(spark)

    @op
    def load(seed):
        return seed * 100

    @op
    def train(data, rate):
        return data + rate

    with storage:
        data = load(1)
        models = [train(data, r) for r in (1, 2, 3)]
    frame = storage.frame(models[0]).expand_all()
    assert frame.sizes()["train"] == 1
    assert storage.frame({"model": models}).expand_back(recursive=True).sizes()["train"] == 3
    assert storage.frame(models).expand_back("v").sizes()["train"] == 3


def test_cycle_gives_cells_of_several(spark):
    storage = Storage(spark)

    @op(output_names=["data"])
    def scale(raw):
        return raw * 10

    @op(output_names=["model"])
    def fit(data):
        return data + 1

    with storage:
        a = 1
        fit(a)
        fit(scale(a))
    frame = storage.frame(fit).expand_all()
    assert frame.sizes() == {"fit": 2, "data": 2, "model": 2, "scale": 1}
    assert not frame.graph.acyclic
    df = frame.df("data", "fit", "model")
    assert rows(df.select("data", "model")) in ([("1", 2), ("[1, 10]", 11)], [("1", 2), ("[10, 1]", 11)])
    down = frame.downstream("data")
    assert down.sizes() == frame.sizes()


def test_lists_share_one_edge(spark):
    storage = Storage(spark)

    @op(output_names=["total"])
    def total(xs: MList[int]) -> int:
        return sum(xs)

    with storage:
        ys = [inc(i) for i in range(4)]
        total(ys[:2])
        total(ys)
    frame = storage.frame(total).expand_back(recursive=True)
    assert ("elts", "__make_list__", "elts") in frame.edges()
    assert frame.sizes() == {"total": 2, "xs": 2, "total_0": 2, "__make_list__": 2, "elts": 4, "inc": 4, "x": 4} or frame.sizes()["elts"] == 4
    py = frame.eval("elts", "xs")
    assert sorted(map(sorted, py["elts"])) == [[1, 2], [1, 2, 3, 4]]
    text = frame.df("elts", "xs", lazy_vars=["xs"])
    assert {r["elts"].count(",") for r in text.collect()} == {1, 3}
    assert storage.frame("__make_list__").sizes()["elts"] == 4


def test_streams(composition):
    frame = composition.frame(inc).expand_all().rename({"var_0": "y"})
    assert frame.downstream("x").sizes() == frame.sizes()
    assert frame.downstream("y", how="weak").sizes() == {"y": 5, "add": 3, "z": 3}
    assert frame.upstream("z").sizes() == {"z": 3, "add": 3, "x": 3, "y": 3, "inc": 3}
    assert frame.midstream("x", "y").sizes() == {"x": 5, "y": 5, "inc": 5}
    small = frame.select_subsets({**frame.elts, "x": frame.where("x", "i < 2", calls=False).elts["x"]})
    kept = small.downstream("x", how="strong").sizes()
    assert kept["inc"] == 2 and kept["add"] == 1
    # y is reached through inc only for these two, so weak reach from x still finds no more than their calls
    assert small.downstream("x", how="weak").sizes()["add"] == 1
    assert small.drop_unreachable().sizes()["z"] == 1  # the other y are sources now, but their x are gone


def test_set_operations(composition):
    frame = composition.frame(inc).expand_all().rename({"var_0": "y"})
    low, high = frame.where("x", "i < 3"), frame.where("x", "i >= 2")
    low, high = low.downstream("x").pinned(), high.downstream("x").pinned()
    assert (low | high).sizes() == frame.sizes()
    assert (low & high).sizes()["inc"] == 1
    assert Frame.union(low, high, frame).sizes() == frame.sizes()
    assert Frame.intersection(low, high).sizes() == (low & high).sizes()
    rest = frame - high
    assert rest.sizes()["inc"] == 2 and rest.sizes()["add"] == 1
    assert set((frame - frame).nodes) == set()
    rest.check()


def test_broken_union_is_refused(composition):
    a = composition.frame(inc)
    cut = a.select_subsets({"inc": a.elts["inc"]})
    with pytest.raises(ValueError):
        _ = cut | a.select_nodes(["inc"])._with(closed=False)


def test_selection(composition):
    frame = composition.frame(inc).expand_all().rename({"var_0": "y"})
    low = frame < 3
    assert low.sizes() == {"x": 3, "y": 2, "z": 1, "inc": 3, "add": 2}
    assert frame.isin([3, 9]).sizes()["z"] == 1
    hid = frame.elts["z"].first()["hid"]
    assert frame.isin([hid], by="hid").sizes() == {"x": 0, "y": 0, "z": 1, "inc": 0, "add": 1}
    cid = frame.get([hid]).first()["cid"]
    assert frame.isin([cid], by="cid").sizes()["z"] == 1
    doubled = frame.apply(lambda c: c * 2, "i").where("node = 'x'")
    assert sorted(r["value"] for r in doubled.collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        frame.isin([1], by="size")


def test_projection_and_names(composition):
    frame = composition.frame(inc).expand_all().rename({"var_0": "y"})
    assert set(frame[["x", "inc"]].nodes) == {"x", "inc"} and set(frame["x"].nodes) == {"x"}
    assert "z" not in frame.drop("z").nodes
    with pytest.raises(ValueError):
        frame.select_nodes(["nothing"])
    with pytest.raises(ValueError):
        frame.rename({"x": "y"})
    assert frame.df("x").count() == 5 and frame.get_var_values("x").count() == 5
    assert frame.get_new_vname("output_0") == "var_0" and frame.get_new_vname("x_train") == "x_train" and frame.get_new_fname("add") == "add_0"
    assert frame.sources == ["x"] and frame.in_neighbors("add") == ["x", "y"]
    first = frame.elts["x"].limit(1)
    assert frame.drop_refs("x", first).sizes()["x"] == 4 and frame.drop_refs("x", first).add_refs("x", first).sizes()["x"] == 5
    calls = frame.elts["add"]
    bare = frame.drop_calls("add", calls)
    assert bare.sizes()["add"] == 0 and bare.add_calls("add", calls).sizes() == frame.sizes()
    moved = frame.move_refs("x", "z", first)
    assert moved.sizes()["x"] == 4 and moved.sizes()["z"] == 4
    assert composition.frame(inc).get_func_table("inc").columns == ["call_hid", "output_0", "x"]


def test_descriptions(composition, tmp_path):
    frame = composition.frame(inc).expand_all().rename({"var_0": "y"})
    assert rows(frame.get_var_stats()) == [("x", 5), ("y", 5), ("z", 3)]
    assert rows(frame.get_func_stats()) == [("add", 3), ("inc", 5)]
    assert rows(frame.var_info("y")) == [("consumer", "add", "y", 3), ("creator", "inc", "output_0", 5)]
    assert ("x", "inc", "x", 5, 5) in rows(frame.edge_stats())
    assert "z@z = add(x=x, y=y)" in frame.get_graph_desc() and "variable x: 5 values" in frame.info()
    text = frame.draw(verbose=True, path=str(tmp_path / "g.dot"))
    assert text.startswith("digraph") and (tmp_path / "g.dot").read_text() == text and "5 calls" in text


def test_deletion(spark):
    storage = Storage(spark)
    with storage:
        for x in range(3):
            add(x, inc(x))
    frame = storage.frame(inc)
    frame.delete_calls_from_df(frame.df().limit(1))
    assert rows(provenance.count_calls(storage.store)) == [("add", 2), ("inc", 2)]
    storage.frame(inc).delete_calls()
    assert storage.store.calls_io.isEmpty()


def test_closures_agree_with_a_walk(composition):
    store = composition.store
    io = [tuple(r) for r in store.calls_io.select("call_hid", "direction", "ref_hid").collect()]
    start = store.calls_io.where("op = 'add' and direction = 'out'").select("ref_hid").limit(2)
    wanted = {r[0] for r in start.collect()}
    calls = set()
    while True:
        more = {c for c, d, r in io if d == "out" and r in wanted} - calls
        if not more:
            break
        calls |= more
        wanted |= {r for c, d, r in io if d == "in" and c in calls}
    start = composition.spark.createDataFrame([(r,) for r in [x[0] for x in start.collect()]], "hid string")
    refs, found = provenance.dependencies(store, start)
    assert {r["hid"] for r in refs.collect()} == wanted and {r["call_hid"] for r in found.collect()} == calls
    assert provenance.orphans(store).isEmpty()
