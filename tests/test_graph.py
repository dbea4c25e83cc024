"""Graph algorithms against brute force, and the rules of names."""

import itertools
import random

import pytest

from tracelake.operators.graph import Graph, adjacency_intersection, adjacency_union, condense, fresh_function, fresh_variable, path_edges, strong_components, topological


def reach(adjacency, a):
    seen, todo = {a}, [a]
    while todo:
        for b in adjacency.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(20))
def test_components_and_order(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(8)]
    adjacency = {a: sorted({rng.choice(nodes) for _ in range(rng.randint(0, 2))}) for a in nodes}
    parts = strong_components(adjacency)
    of = {n: c for c in parts for n in c}
    for a, b in itertools.product(nodes, nodes):
        assert (of[a] == of[b]) == (b in reach(adjacency, a) and a in reach(adjacency, b))
    order = topological(condense(adjacency, parts))
    for a in nodes:
        for b in adjacency[a]:
            assert order.index(of[a]) <= order.index(of[b])


def test_trails_stop_at_the_end_and_use_short_cycles():
    adjacency = {"x": ["f"], "f": ["x", "y"], "y": ["g"], "g": ["z"], "z": ["h"], "h": []}
    assert path_edges(adjacency, "x", "y") == {("x", "f"), ("f", "y")}
    assert path_edges({"x": ["f", "g"], "f": ["x"], "g": ["y"], "y": []}, "x", "y") == {("x", "f"), ("f", "x"), ("x", "g"), ("g", "y")}
    assert path_edges(adjacency, "z", "x") == set()
    with pytest.raises(ValueError):
        topological({"a": ["b"], "b": ["a"]})


def test_names():
    assert fresh_variable(set(), "output_0") == "var_0" and fresh_variable({"var_0"}, "output_3") == "var_1"
    assert fresh_variable({"X_train"}, "X_train") == "X_0" and fresh_variable({"y"}, "x") == "x"
    assert fresh_function({"f"}, "f") == "f_0" and fresh_function({"f", "f_0"}, "f") == "f_1"


def test_graph_edits():
    g = Graph(frozenset({"x", "y"}), (("f", "op"),), frozenset({("x", "f", "a"), ("f", "y", "out")}))
    assert g.order() == ["x", "f", "y"] and g.acyclic and g.sources == ["x"] and g.sinks == ["y"]
    assert g.renaming({"x": "z"}).in_edges("f") == [("z", "f", "a")]
    assert g.keeping(["x", "f"]).edges == {("x", "f", "a")}
    assert g.reachable(["y"], "back") == {"x", "f", "y"}
    assert adjacency_union({"a": ["b"]}, {"a": ["c"], "d": []}) == {"a": ["b", "c"], "d": []}
    assert adjacency_intersection({"a": ["b", "c"]}, {"a": ["c"], "d": []}) == {"a": ["c"]}
