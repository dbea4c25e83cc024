"""References, ops and calls, and the markers that change how an argument takes part in a call's identity."""

from __future__ import annotations

import contextvars
import functools
import inspect
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions import ids


class Ref:
    """A handle to a value: content id, history id and, when loaded, the value. References are equal when their histories are."""

    kind = "atom"

    def __init__(self, cid: str, hid: str, obj: Any = None, in_memory: bool = False):
        self.cid, self.hid, self.obj, self.in_memory = cid, hid, obj, in_memory

    def __eq__(self, other) -> bool:
        return isinstance(other, Ref) and self.hid == other.hid

    def __hash__(self) -> int:
        return hash(self.hid)

    def __repr__(self) -> str:
        shown = repr(self.obj) if self.in_memory else "..."
        return f"{type(self).__name__}({shown}, hid={self.hid[:6]})"

    def detached(self) -> Ref:
        return type(self)(self.cid, self.hid)

    def with_hid(self, hid: str) -> Ref:
        return type(self)(self.cid, hid, self.obj, self.in_memory)


class AtomRef(Ref):
    """An opaque value."""


class ListRef(Ref):
    """An ordered list of references; obj holds them."""

    kind = "list"

    def __len__(self) -> int:
        return len(self.obj)

    def __getitem__(self, at):
        return self.obj[at]

    def __iter__(self) -> Iterator[Ref]:
        return iter(self.obj)

    @property
    def shape(self) -> list:
        """Ids of the elements, without their values."""
        return [(r.cid, r.hid) for r in self.obj]


class DictRef(Ref):
    """A dict from strings to references."""

    kind = "dict"

    def __len__(self) -> int:
        return len(self.obj)

    def __getitem__(self, key: str) -> Ref:
        return self.obj[key]

    def __iter__(self):
        return iter(self.obj)

    def keys(self):
        return self.obj.keys()

    def values(self):
        return self.obj.values()

    def items(self):
        return self.obj.items()


REF_KINDS = {"atom": AtomRef, "list": ListRef, "dict": DictRef}


@dataclass(frozen=True)
class Ignore:
    """An argument that takes no part in the call's identity."""

    value: Any = None


@dataclass(frozen=True)
class NewArgDefault:
    """The default of an argument added later: a call that passes exactly this value is the call without the argument."""

    value: Any = None


@dataclass(frozen=True)
class ValuePointer:
    """A large fixed value that goes by a name; the name is stored in its place."""

    id: str
    obj: Any = None


def plain(value):
    """The value behind a marker."""
    if isinstance(value, (Ignore, NewArgDefault)):
        return plain(value.value)
    return value.obj if isinstance(value, ValuePointer) else value


def same_value(known, given) -> bool:
    """Equal and of the same type; values that answer == with anything but a plain truth value are compared by content."""
    if type(known) is not type(given):
        return False
    try:
        answer = known == given
        if isinstance(answer, bool):
            return answer
    except Exception:  # noqa: BLE001  a value may refuse comparison in any way
        pass
    return ids.content_id(known) == ids.content_id(given)


def wrap_atom(value, history_id: str | None = None) -> AtomRef:
    if isinstance(value, Ref):
        if not isinstance(value, AtomRef) or history_id is not None:
            raise ValueError("only plain values are wrapped; a reference keeps its own ids")
        return value
    if isinstance(value, ValuePointer):
        if history_id is not None:
            raise ValueError("a pointer has no history")
        own = ids.pointer_id(value.id)
        return AtomRef(own, own, value, True)
    cid = ids.content_id(value)
    return AtomRef(cid, history_id or ids.fresh_id(cid), value, True)


@dataclass(eq=False)
class Op:
    """A memoized function. `f` works on values; `columns`, where given, makes Column expressions for bulk use."""

    name: str
    f: Callable | None = None
    nout: str | int = "auto"
    output_names: list[str] | None = None
    version: int = 0
    ignore_args: tuple[str, ...] | None = None
    structural: bool = False
    columns: Callable | None = None
    returns: str | None = None
    side_effects: bool = False

    def __post_init__(self):
        if self.f is None:
            return
        functools.update_wrapper(self, self.f)
        parameters = list(inspect.signature(self.f).parameters)
        if self.output_names is not None:
            both = set(parameters) & set(self.output_names)
            if both:
                raise ValueError(f"op {self.name}: {sorted(both)} name both inputs and outputs")
        elif any(p.startswith("output_") for p in parameters):
            raise ValueError(f"op {self.name}: name its outputs, since an input begins with output_")

    @property
    def id(self) -> str:
        return self.name

    @property
    def signature(self) -> inspect.Signature:
        try:  # annotations may be texts
            return inspect.signature(self.f, eval_str=True)
        except Exception:  # noqa: BLE001  names that are not known here: such a parameter is an atom
            return inspect.signature(self.f)

    def __repr__(self) -> str:
        return f"Op({self.name}, nout={self.nout}, output_names={self.output_names}, version={self.version})"

    def detached(self) -> Op:
        return Op(self.name, None, self.nout, self.output_names, self.version, structural=self.structural)

    def output_name(self, i: int) -> str:
        return self.output_names[i] if self.output_names is not None else f"output_{i}"

    def split(self, returned) -> dict[str, Any]:
        """A function's return value as named outputs: a tuple is several, anything else is one."""
        if self.nout == "auto":
            values = returned if isinstance(returned, tuple) else (returned,)
        elif not isinstance(returned, tuple):
            raise ValueError(f"op {self.name} says nout={self.nout!r} and must return a tuple")
        elif self.nout != "var" and len(returned) != self.nout:
            raise ValueError(f"op {self.name} must return a tuple of {self.nout}")
        else:
            values = returned
        if self.output_names is not None and len(values) != len(self.output_names):
            raise ValueError(f"op {self.name} returned {len(values)} values for the outputs {self.output_names}")
        return {self.output_name(i): v for i, v in enumerate(values)}

    def return_annotations(self, n: int) -> list:
        said = self.signature.return_annotation if self.f is not None else None
        said = None if said is inspect.Signature.empty else said
        if getattr(said, "__origin__", None) is tuple:
            args = [a for a in said.__args__ if a is not Ellipsis]
            return args if len(args) == n else args[:1] * n
        return [said] * n if n == 1 else [None] * n

    def ordered(self, outputs: Mapping[str, Any]) -> tuple:
        if self.output_names is not None:
            return tuple(outputs[n] for n in self.output_names if n in outputs)
        return tuple(outputs[n] for n in sorted(outputs, key=lambda n: int(n.rpartition("_")[2])))

    def history_id(self, inputs: Mapping[str, Ref], semantic_version: str | None = None) -> str:
        return ids.call_history_id(self.name, self.version, {k: r.hid for k, r in inputs.items()}, semantic_version)

    def content_id(self, inputs: Mapping[str, Ref], semantic_version: str | None = None) -> str:
        return ids.call_content_id(self.name, self.version, {k: r.cid for k, r in inputs.items()}, semantic_version)

    def pre_call_id(self, inputs: Mapping[str, Ref]) -> str:
        return ids.pre_call_id(self.name, {k: r.cid for k, r in inputs.items()})

    def output_ids(self, call_hid: str, names) -> dict[str, str]:
        return {n: ids.output_id(call_hid, n) for n in names}

    def __call__(self, *args, **kwargs):
        storage = Context.storage()
        if storage is not None:
            return storage.call(self, args, kwargs)
        # without a store markers stand for their values
        markers = {n: plain(p.default) for n, p in self.signature.parameters.items() if isinstance(p.default, (Ignore, NewArgDefault, ValuePointer))}
        given = self.signature.bind_partial(*args).arguments if markers else {}
        rest = {n: v for n, v in markers.items() if n not in given}
        return self.f(*map(plain, args), **rest | {k: plain(v) for k, v in kwargs.items()})


@dataclass(eq=False)
class Call:
    """One execution of an op."""

    op: Op
    cid: str
    hid: str
    inputs: dict[str, Ref]
    outputs: dict[str, Ref]
    semantic_version: str | None = None
    content_version: str | None = None

    def __eq__(self, other) -> bool:
        return isinstance(other, Call) and self.hid == other.hid

    def __hash__(self) -> int:
        return hash(self.hid)

    def __repr__(self) -> str:
        return f"Call({self.op.name}, hid={self.hid[:6]})"

    def detached(self) -> Call:
        bare = lambda refs: {k: r.detached() if isinstance(r, AtomRef) else r for k, r in refs.items()}
        return Call(self.op, self.cid, self.hid, bare(self.inputs), bare(self.outputs), self.semantic_version, self.content_version)


def op(f=None, *, output_names=None, nout="auto", ignore_args=None, version=0, name=None, columns=None, returns=None, side_effects=False):
    """Declare a memoized function, bare or with options.

    `columns` takes one Column per parameter and returns one Column per output (a dict where there are several): bulk use then
    stays in the engine. `returns` is the type of the outputs in DDL form for bulk use of a Python function.
    """

    def build(g):
        names = list(output_names) if output_names is not None else None
        return Op(name or g.__name__, g, nout, names, version, tuple(ignore_args) if ignore_args else None, columns=columns, returns=returns, side_effects=side_effects)

    return build(f) if f is not None else build


class Context:
    """The store that calls go to, if any."""

    _storage: contextvars.ContextVar = contextvars.ContextVar("tracelake-storage", default=None)

    @classmethod
    def storage(cls):
        return cls._storage.get()

    @classmethod
    def set(cls, storage) -> None:
        cls._storage.set(storage)


class noop:
    """Within it, ops run as plain functions; without a context around it, it changes nothing."""

    def __enter__(self):
        storage = Context.storage()
        return None if storage is None else storage(mode="noop").__enter__()

    def __exit__(self, *error):
        storage = Context.storage()
        if storage is not None:
            storage.__exit__(*error)


@dataclass(frozen=True)
class Cells:
    """Several references or calls in one cell of a table, by history id."""

    members: tuple = field(default=())

    @classmethod
    def of(cls, members) -> Cells:
        return cls(tuple(sorted(members, key=lambda m: m.hid)))

    def __iter__(self):
        return iter(self.members)

    def __len__(self) -> int:
        return len(self.members)


def walk(f: Callable, value):
    """f on every reference in nested lists, tuples, dicts and cells, keeping the structure."""
    if isinstance(value, Ref):
        return f(value)
    if isinstance(value, Cells):
        return tuple(walk(f, v) for v in value)
    if isinstance(value, (list, tuple, set)):
        return type(value)(walk(f, v) for v in value)
    return {k: walk(f, v) for k, v in value.items()} if isinstance(value, dict) else value
