"""Ids with the keys that they were made from.

In a log of facts an id is a hash of 'kind:key'. A DataFrame of ids (one column hid) can carry the keys and the kind, and a DataFrame
of calls the facts that they are. Set operations and joins then move keys, often 8 bytes, or columns of the source, and hash
afterwards; ids of unknown keys meet as 16 bytes. Nothing is lost where a DataFrame carries nothing: it is used as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import entity_hid
from .shared import spill


@dataclass
class Keys:
    kind: str
    #: one column, key: an integer, or the 16 bytes of the id where keys are of another type
    rows: DataFrame
    #: (op, label) pairs of whole ops whose references these are, all of them and no others
    edges: frozenset | None = None
    #: the fact and the label whose references these are
    source: tuple | None = None

    @property
    def type(self) -> T.DataType:
        return self.rows.schema["key"].dataType


def of_keys(kind: str, rows: DataFrame) -> DataFrame:
    """hid of things of a kind, from a column key."""
    if not isinstance(rows.schema["key"].dataType, T.IntegralType):
        rows = rows.select(F.unhex(entity_hid(kind, F.col("key"))).alias("key"))
    return _made(kind, rows)


def _made(kind: str, rows: DataFrame, edges=None) -> DataFrame:
    short = isinstance(rows.schema["key"].dataType, T.IntegralType)
    out = rows.select((entity_hid(kind, F.col("key")) if short else F.lower(F.hex("key"))).alias("hid"))
    out._tracelake_keys = Keys(kind, rows, edges)
    return out


def keys_of(df: DataFrame) -> Keys | None:
    return df.__dict__.get("_tracelake_keys")


def of_facts(facts: list) -> DataFrame:
    """hid of the calls of facts, of one op or several."""
    out = reduce(DataFrame.unionAll, [f.rows.select(f.call().alias("hid")) for f in facts])
    out._tracelake_facts = facts
    return out


def facts_of(df: DataFrame) -> list | None:
    return df.__dict__.get("_tracelake_facts")


def like_calls(df: DataFrame, calls: DataFrame) -> DataFrame:
    """df, which has the calls of another DataFrame."""
    if (found := facts_of(calls)) is not None:
        df._tracelake_facts = found
    return df


def fact_of(df: DataFrame):
    """The one fact whose calls these are."""
    found = facts_of(df)
    return found[0] if found and len(found) == 1 else None


def like(a: T.DataType, b: T.DataType) -> bool:
    """Whether keys of these types are short, and equal just where their texts are."""
    return all(isinstance(t, T.IntegralType) for t in (a, b))


def _both(a: DataFrame, b: DataFrame) -> tuple[Keys, Keys] | None:
    x, y = keys_of(a), keys_of(b)
    return (x, y) if x and y and x.kind == y.kind and (x.type == y.type or like(x.type, y.type)) else None


def packed(hid: Column) -> Column:
    """16 bytes for an id; null for a text that is none."""
    return F.when((F.length(hid) == 32) & (F.lower(hid) == hid), F.unhex(hid))


def whole(kind: str, rows: DataFrame, edges: frozenset | None) -> DataFrame:
    """hid, each once, of all references under the (op, label) pairs `edges`."""
    known = keys_of(of_keys(kind, rows))
    return _made(kind, known.rows.distinct(), edges)


def distinct(df: DataFrame) -> DataFrame:
    known, fact = keys_of(df), fact_of(df)
    if known:
        return df if known.source else _made(known.kind, known.rows.distinct(), known.edges)
    return of_facts([fact.once()]) if fact else df.select("hid").distinct()


def union(*sets: DataFrame) -> DataFrame:
    """All ids of the sets, each once."""
    a, *rest = sets
    for b in rest:
        both, facts = _both(a, b), (fact_of(a), fact_of(b))
        if both:
            x, y = both
            a = _made(x.kind, x.rows.unionAll(y.rows), x.edges | y.edges if x.edges and y.edges else None)
        elif all(facts) and facts[0].op == facts[1].op and facts[0].alike(facts[1]):
            x, y = (f.renamed() for f in facts)
            a = of_facts([replace(x, rows=x.rows.unionByName(y.rows), unique=False)])
        else:
            a = a.select("hid").unionAll(b.select("hid"))
    return distinct(a)


def kept(df: DataFrame) -> DataFrame:
    """Calls of a fact by keys that are written once, for several uses; others as they are."""
    fact = fact_of(df)
    if fact is None:
        return df
    own = fact.renamed()
    return of_facts([own.over(spill(own.rows, name="calls"))])


def within(a: DataFrame, b: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ids of a that are in b, or with left_anti those that are not."""
    both, fact = _both(a, b), fact_of(a)
    if both:
        x, y = both
        return _made(x.kind, x.rows.join(y.rows, "key", how))
    if fact:
        return of_facts([fact.narrowed(None, b, how)])
    return a.select("hid").join(b.select("hid"), "hid", how)


def joined(df: DataFrame, other: DataFrame, on: str, how: str) -> DataFrame:
    """A join on an id, which like all other ids of the rows is 16 bytes while it is dealt out; ids are md5 in hex."""
    packs = lambda rows: {f.name for f in rows.schema.fields if f.name == on or f.name in ("call_hid", "call_cid", "ref_cid", "ref_hid", "hid", "cid") or f.name.endswith(("__cid", "__hid"))}
    pack = lambda rows, names: rows.select(*[F.coalesce(packed(F.col(c)), F.concat(F.lit(b"\0" * 17), F.col(c).cast("binary"))).alias(c) if c in names else F.col(c) for c in rows.columns])
    a, b = packs(df), packs(other)
    out = pack(df, a).join(pack(other, b), on, how)
    text = lambda c: F.when(F.length(c) == 16, F.lower(F.hex(c))).otherwise(F.substring(c, 18, 1 << 30).cast("string"))
    return out.select(*[text(c).alias(c) if c in a | b else F.col(c) for c in out.columns])
