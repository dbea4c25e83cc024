"""The schema graph of a frame and the algorithms on it; all of this is small and stays on the driver."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace

Edge = tuple[str, str, str]


@dataclass(frozen=True)
class Graph:
    """Variables, functions (name to op) and edges (source, target, label)."""

    variables: frozenset[str] = frozenset()
    functions: tuple[tuple[str, str], ...] = ()
    edges: frozenset[Edge] = frozenset()

    @property
    def ops(self) -> dict[str, str]:
        return dict(self.functions)

    @property
    def nodes(self) -> list[str]:
        return sorted(self.variables | self.ops.keys())

    def with_ops(self, ops: dict[str, str]) -> Graph:
        return replace(self, functions=tuple(sorted(ops.items())))

    def adding(self, variables: Iterable[str] = (), ops: dict[str, str] | None = None, edges: Iterable[Edge] = ()) -> Graph:
        return Graph(self.variables | set(variables), tuple(sorted((self.ops | (ops or {})).items())), self.edges | set(edges))

    def keeping(self, nodes: Iterable[str]) -> Graph:
        nodes = set(nodes)
        return Graph(self.variables & nodes, tuple((f, o) for f, o in self.functions if f in nodes), frozenset(e for e in self.edges if e[0] in nodes and e[1] in nodes))

    def renaming(self, names: dict[str, str]) -> Graph:
        new = lambda n: names.get(n, n)
        return Graph(frozenset(map(new, self.variables)), tuple(sorted((new(f), o) for f, o in self.functions)), frozenset((new(a), new(b), x) for a, b, x in self.edges))

    def in_edges(self, node: str) -> list[Edge]:
        return sorted(e for e in self.edges if e[1] == node)

    def out_edges(self, node: str) -> list[Edge]:
        return sorted(e for e in self.edges if e[0] == node)

    def in_neighbors(self, node: str) -> list[str]:
        return sorted({e[0] for e in self.in_edges(node)})

    def out_neighbors(self, node: str) -> list[str]:
        return sorted({e[1] for e in self.out_edges(node)})

    @property
    def sources(self) -> list[str]:
        return [n for n in self.nodes if not self.in_edges(n)]

    @property
    def sinks(self) -> list[str]:
        return [n for n in self.nodes if not self.out_edges(n)]

    def adjacency(self) -> dict[str, list[str]]:
        return {n: self.out_neighbors(n) for n in self.nodes}

    def reachable(self, start: Iterable[str], direction: str = "forward") -> set[str]:
        step = self.out_neighbors if direction == "forward" else self.in_neighbors
        seen, todo = set(start), list(start)
        while todo:
            for n in step(todo.pop()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def order(self) -> list[str]:
        """Nodes in topological order; members of a cycle stand together."""
        components = strong_components(self.adjacency())
        condensed = condense(self.adjacency(), components)
        return [n for c in topological(condensed) for n in sorted(c)]

    @property
    def acyclic(self) -> bool:
        return all(len(c) == 1 for c in strong_components(self.adjacency()))

    def edges_between(self, start: str, end: str) -> set[tuple[str, str]]:
        return path_edges(self.adjacency(), start, end)


def strong_components(adjacency: dict) -> list[tuple]:
    """Strongly connected components, by two passes of depth-first search (forward finishing order, then reversed edges)."""
    finished, seen = [], set()
    for root in sorted(adjacency):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(adjacency[root]))]
        while stack:
            node, rest = stack[-1]
            child = next((n for n in rest if n not in seen), None)
            if child is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(child)
                stack.append((child, iter(adjacency.get(child, ()))))
    back = defaultdict(list)
    for a, targets in adjacency.items():
        for b in targets:
            back[b].append(a)
    out, assigned = [], set()
    for root in reversed(finished):
        if root in assigned:
            continue
        group, todo = [], [root]
        assigned.add(root)
        while todo:
            n = todo.pop()
            group.append(n)
            for p in back[n]:
                if p not in assigned:
                    assigned.add(p)
                    todo.append(p)
        out.append(tuple(sorted(group)))
    return out


def condense(adjacency: dict, components: list[tuple]) -> dict[tuple, list[tuple]]:
    of = {n: c for c in components for n in c}
    return {c: sorted({of[b] for n in c for b in adjacency.get(n, ()) if of[b] != c}) for c in components}


def topological(adjacency: dict) -> list:
    """Kahn's order, smallest name first among those that are free."""
    waiting = {n: 0 for n in adjacency}
    for targets in adjacency.values():
        for b in targets:
            waiting[b] += 1
    free, out = sorted(n for n, k in waiting.items() if not k), []
    while free:
        n = free.pop(0)
        out.append(n)
        for b in adjacency[n]:
            waiting[b] -= 1
            if not waiting[b]:
                free.append(b)
        free.sort()
    if len(out) < len(adjacency):
        raise ValueError("the graph has a cycle")
    return out


def path_edges(adjacency: dict, start: str, end: str) -> set[tuple[str, str]]:
    """Edges on trails from start to end: no edge twice, nodes may repeat, a trail stops when it first arrives at end."""
    found: set[tuple[str, str]] = set()

    def walk(node, used):
        for b in adjacency.get(node, ()):
            edge = (node, b)
            if edge in used:
                continue
            if b == end:
                found.update(used, [edge])
            else:
                walk(b, used | {edge})

    walk(start, frozenset())
    return found


def adjacency_union(a: dict, b: dict) -> dict:
    return {n: sorted(set(a.get(n, ())) | set(b.get(n, ()))) for n in a.keys() | b.keys()}


def adjacency_intersection(a: dict, b: dict) -> dict:
    return {n: sorted(set(a[n]) & set(b[n])) for n in a.keys() & b.keys()}


def fresh_variable(taken: Iterable[str], hint: str | None = None) -> str:
    """A free name: the hint itself, then its first word with a number; outputs without a name become var_0, var_1, ..."""
    taken = set(taken)
    if hint and not hint.startswith("output_"):
        if hint not in taken:
            return hint
        stem = hint.split("_")[0]
    else:
        stem = "var"
    k = 0
    while f"{stem}_{k}" in taken:
        k += 1
    return f"{stem}_{k}"


def fresh_function(taken: Iterable[str], hint: str) -> str:
    taken, k, name = set(taken), 0, hint
    while name in taken:
        name, k = f"{hint}_{k}", k + 1
    return name
