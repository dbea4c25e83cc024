"""SQL text for the ids and the call log of the test tables, for checking the catalogue in another engine."""

from __future__ import annotations

LINE = "concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as decimal(12,2))::varchar, cast(l_shipdate as date)::varchar)"
FACTS = {
    "locate_nation": ("nation", {"region": ("region", "n_regionkey")}, ("nation", "nation", "n_nationkey")),
    "register_customer": ("customer", {"nation": ("nation", "c_nationkey")}, ("customer", "customer", "c_custkey")),
    "register_supplier": ("supplier", {"nation": ("nation", "s_nationkey")}, ("supplier", "supplier", "s_suppkey")),
    "place_order": ("orders", {"customer": ("customer", "o_custkey")}, ("order", "order", "o_orderkey")),
    "ship_line": ("lineitem", {"order": ("order", "l_orderkey"), "part": ("part", "l_partkey"), "supplier": ("supplier", "l_suppkey")}, ("line", "line", LINE)),
    "label_document": ("labels", {"document": ("document", "doc_id")}, ("label", "label", "doc_id")),
    "reply": ("(select * from conversations where turn > 0)", {"previous": ("turn", "concat_ws('.', conv_id, turn - 1)")}, ("turn", "turn", "concat_ws('.', conv_id, turn)")),
    "emit_event": ("events", {"user": ("user", "user_id")}, ("event", "event", "event_id")),
}
TRADE = ("locate_nation", "register_customer", "register_supplier", "place_order", "ship_line")


def cid(kind: str, key: str) -> str:
    return f"md5('atom|s:{kind}:' || {key})"


def hid(kind: str, key: str) -> str:
    return f"md5('hid|' || {cid(kind, key)})"


def call(op: str) -> str:
    _, inputs, (_, kind, key) = FACTS[op]
    parts = " || ',' || ".join(f"'{n}=' || {hid(*inputs[n])}" for n in sorted(inputs))
    return f"md5('fact|{op}|' || {parts} || '|' || {hid(kind, key)})"


def ref(op: str, name: str) -> str:
    _, inputs, (out, kind, key) = FACTS[op]
    return hid(kind, key) if name == out else hid(*inputs[name])


def rows(op: str, *columns: str, where: str = "", distinct: bool = False) -> str:
    """A select over the table of an op."""
    return f"select {'distinct ' * distinct}{', '.join(columns)} from {FACTS[op][0]} as src{' where ' + where if where else ''}"


def wide(op: str, where: str = "") -> str:
    """call_hid under the op's name, and each reference under its own."""
    _, inputs, (out, _, _) = FACTS[op]
    return rows(op, f"{call(op)} as {op}", *[f'{ref(op, n)} as "{n}"' for n in (*inputs, out)], where=where)


def io(ops, direction: str | None = None) -> str:
    parts = []
    for op in ops:
        _, inputs, (out, _, _) = FACTS[op]
        for n in ([] if direction == "out" else sorted(inputs)) + ([] if direction == "in" else [out]):
            parts.append(rows(op, f"'{op}' as op", f"{call(op)} as call_hid", f"'{n}' as name", f"'{'in' if n in inputs else 'out'}' as direction", f"{ref(op, n)} as ref_hid"))
    return " union all ".join(parts)


def union(parts, all_: bool = True) -> str:
    return (" union all " if all_ else " union ").join(f"({p})" for p in parts)


def members(parts) -> str:
    """(node, hid) rows of a frame from (node, id expression, from and where)."""
    return union([f"select '{n}' as node, {x} as hid from {t}" for n, x, t in parts], False)
