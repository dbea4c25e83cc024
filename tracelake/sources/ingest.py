"""Relational tables as call logs.

A `Fact` says how each row of a table is a call: which columns name its inputs and which its output. Rows become references
to texts 'kind:key'; a call observed from outside is identified by its inputs and its output. Each (op, name) pair is a branch
of its own, so a filter on op, direction or name prunes whole branches while the query is planned, and the wide table of an
op is a projection of its source without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import entity_cid, entity_hid
from . import keyed

IO = ["call_hid", "name", "direction", "call_cid", "ref_cid", "ref_hid", "op", "semantic_version", "content_version", "label"]


@dataclass
class Fact:
    op: str
    rows: DataFrame
    inputs: dict[str, tuple[str, Column]]
    output: tuple[str, str, Column]
    value: Column | None = None

    @property
    def input_names(self) -> list[str]:
        return sorted(self.inputs)

    @property
    def output_names(self) -> list[str]:
        return [self.output[0]]

    def _key(self, tag: str, of) -> Column:
        name, kind, key = self.output
        parts = [F.concat(F.lit(f"{n}="), of(*self.inputs[n])) for n in self.input_names]
        return F.md5(F.concat(F.lit(f"{tag}|{self.op}|"), F.concat_ws(",", *parts), F.lit("|"), of(kind, key)).cast("binary"))

    def wide(self) -> DataFrame:
        """call_hid and one column of history ids for each input and output."""
        name, kind, key = self.output
        columns = [entity_hid(k, c).alias(n) for n, (k, c) in self.inputs.items()] + [entity_hid(kind, key).alias(name)]
        return self.rows.select(self._key("fact", entity_hid).alias("call_hid"), *columns).distinct() if self.repeats else self.rows.select(self._key("fact", entity_hid).alias("call_hid"), *columns)

    repeats: bool = False
    #: no call stands in two rows
    unique: bool = False

    def kind(self, label: str) -> str:
        return self.inputs[label][0] if label in self.inputs else self.output[1]

    def key(self, label: str) -> Column:
        return self.inputs[label][1] if label in self.inputs else self.output[2]

    def hid(self, label: str) -> Column:
        return entity_hid(self.kind(label), self.key(label))

    def call(self) -> Column:
        return self._key("fact", entity_hid)

    def over(self, rows: DataFrame) -> Fact:
        """The same columns of other rows."""
        return replace(self, rows=rows)

    def renamed(self, prefix: str = "") -> Fact:
        """The same calls over rows of one key column for each label."""
        labels = [*self.input_names, self.output[0]]
        rows = self.rows.select(*[self.key(n).alias(prefix + n) for n in labels])
        own = lambda n: F.col(f"`{prefix + n}`")
        return Fact(self.op, rows, {n: (self.inputs[n][0], own(n)) for n in self.inputs}, (self.output[0], self.output[1], own(self.output[0])), repeats=self.repeats, unique=self.unique)

    def types(self) -> dict[str, T.DataType]:
        labels = [*self.input_names, self.output[0]]
        return dict(zip(labels, (f.dataType for f in self.rows.select(*[self.key(n).alias(n) for n in labels]).schema.fields), strict=True))

    def alike(self, other: Fact) -> bool:
        return self.types() == other.types()

    def once(self) -> Fact:
        """Each call once; rows of equal keys are one call."""
        if self.unique:
            return self
        out = self.renamed()
        return replace(out, rows=out.rows.distinct(), unique=True)

    def elements(self, label: str, edges=None) -> DataFrame:
        """hid of the references under a label, each once."""
        out = keyed.whole(self.kind(label), self.rows.select(self.key(label).alias("key")), edges)
        keyed.keys_of(out).source = (self, label)
        return out

    def narrowed(self, label: str | None, ids: DataFrame, how: str = "left_semi") -> Fact:
        """Calls by their ids, or by their references under a label: those among `ids`, each once, or with left_anti those not among them.

        Keys of the same kind meet as they are, ids of unknown keys as 16 bytes. Only columns of the source pass through the join.
        """
        known, rows = keyed.keys_of(ids), self.rows
        if label is not None and known and known.kind != self.kind(label):
            return self.over(rows.where("false")) if how == "left_semi" else self
        if label is not None and known and keyed.like(known.type, self.types()[label]):
            rows, other = rows.withColumn("__id", self.key(label).cast("long")), known.rows.select(F.col("key").cast("long").alias("__id"))
        else:
            rows = rows.withColumn("__id", F.unhex(self.call() if label is None else self.hid(label)))
            other = ids.select(keyed.packed(F.col(ids.columns[0])).alias("__id"))
        rows = self.over(rows.join(other, "__id", how))
        if how == "left_anti":
            return rows.over(rows.rows.drop("__id"))
        # equal calls have equal ids, so each is found once where the join has dealt it
        labels = [*self.input_names, self.output[0]]
        once = rows.rows.select("__id", *[self.key(n).alias(n) for n in labels]).distinct()
        return replace(self.renamed(), rows=once.select(*labels), unique=True)

    def branch(self, name: str) -> DataFrame:
        direction = "in" if name in self.inputs else "out"
        kind, key = self.inputs[name] if direction == "in" else self.output[1:]
        out = self.rows.select(
            self._key("fact", entity_hid).alias("call_hid"),
            F.lit(name).alias("name"),
            F.lit(direction).alias("direction"),
            self._key("factc", entity_cid).alias("call_cid"),
            entity_cid(kind, key).alias("ref_cid"),
            entity_hid(kind, key).alias("ref_hid"),
            F.lit(self.op).alias("op"),
            F.lit(None).cast("string").alias("semantic_version"),
            F.lit(None).cast("string").alias("content_version"),
            F.lit(name).alias("label"),
        )
        return out.distinct() if self.repeats else out

    def entries(self, names: list[str], fields: list[str]) -> DataFrame:
        """Rows of several names by one scan; the call's id is computed once for all, other fields only where asked for."""
        of = {n: self.inputs[n] if n in self.inputs else self.output[1:] for n in names}
        each = {"name": lambda n: F.lit(n), "label": lambda n: F.lit(n), "direction": lambda n: F.lit("in" if n in self.inputs else "out"), "ref_cid": lambda n: entity_cid(*of[n]), "ref_hid": lambda n: entity_hid(*of[n])}
        once = {"call_hid": lambda: self._key("fact", entity_hid), "call_cid": lambda: self._key("factc", entity_cid), "op": lambda: F.lit(self.op), "semantic_version": lambda: F.lit(None).cast("string"), "content_version": lambda: F.lit(None).cast("string")}
        inner = [c for c in fields if c in each]
        whole = [once[c]().alias(c) for c in fields if c in once]
        if len(names) == 1 or not inner:
            out = self.rows.select(*whole, *[each[c](names[0]).alias(c) for c in inner])
        else:
            out = self.rows.select(*whole, F.explode(F.array(*[F.struct(*[each[c](n).alias(c) for c in inner]) for n in names])).alias("x")).select(*[c for c in fields if c in once], *[f"x.{c}" for c in inner])
        out = out.select(*fields)
        return out.distinct() if self.repeats else out

    def atoms(self) -> DataFrame:
        _, kind, key = self.output
        return self.rows.select(entity_cid(kind, key).alias("cid"), entity_hid(kind, key).alias("hid"), F.concat(F.lit(kind + ":"), key.cast("string")).alias("s"), (self.value if self.value is not None else F.lit(None)).cast("double").alias("d"))


@dataclass
class Log:
    """A call log made of facts; the interface that frames and provenance queries read."""

    spark: SparkSession
    facts: dict[str, Fact]
    extra_atoms: list[tuple[str, DataFrame]] = field(default_factory=list)
    #: all facts that give values, where `facts` is a part of them
    known: dict[str, Fact] | None = None

    def signature(self, op: str) -> tuple[list[str], list[str]]:
        return self.facts[op].input_names, self.facts[op].output_names

    @property
    def op_names(self) -> list[str]:
        return sorted(self.facts)

    def io(self, ops=None, direction: str | None = None, names=None, fields=None) -> DataFrame:
        """Rows of the log with `label`, the edge that a name belongs to: one scan for each op, of the fields asked for."""
        fields, parts = list(fields or IO), []
        for op in self.op_names if ops is None else sorted(set(ops) & set(self.facts)):
            fact = self.facts[op]
            own = [n for n in ([] if direction == "out" else fact.input_names) + ([] if direction == "in" else fact.output_names) if names is None or n in names]
            if own:
                parts.append(fact.entries(own, fields))
        if not parts:
            first = next(iter(self.facts.values()))
            return first.entries([first.output[0]], fields).where("false")
        return reduce(DataFrame.unionAll, parts)

    @property
    def calls_io(self) -> DataFrame:
        return self.io().drop("label")

    def touching(self, ids: DataFrame, ops=None, direction: str = "in") -> DataFrame:
        """hid of the calls with a reference among the ids under a label of one side, each once."""
        found = []
        for op in self.op_names if ops is None else sorted(set(ops) & set(self.facts)):
            fact = self.facts[op]
            known = keyed.keys_of(ids)
            own = [fact.narrowed(x, ids) for x in (fact.input_names if direction == "in" else fact.output_names) if known is None or fact.kind(x) == known.kind]
            if own:
                found.append(keyed.fact_of(keyed.union(*(keyed.of_facts([f]) for f in own))))
        return keyed.of_facts(found) if found else self.spark.createDataFrame([], "hid string")

    def without(self, calls: DataFrame, ops=None) -> DataFrame:
        """Rows of the log without some calls."""
        gone, facts = keyed.facts_of(calls), dict(self.facts)
        for op in facts:
            own = calls if gone is None else keyed.of_facts(same) if (same := [f for f in gone if f.op == op]) else None
            facts[op] = facts[op] if own is None else facts[op].narrowed(None, own, "left_anti")
        return replace(self, facts=facts).io(ops)

    def reach(self, refs: DataFrame | None, calls: DataFrame | None, back: bool, ops=None) -> tuple[DataFrame, DataFrame] | None:
        """provenance.closure over keys, an op at a time from the start on; None where things of a kind lead to others of that kind."""
        order = self._order(self.op_names if ops is None else sorted(set(ops) & set(self.facts)))
        if order is None:
            return None
        found: dict[str, DataFrame] = {}
        loose, made = None, []
        if refs is not None:
            known = keyed.keys_of(refs)
            if known:
                found[known.kind] = keyed.distinct(refs)
            else:
                loose = refs.select(F.col(refs.columns[0]).alias("hid")).distinct()
        start = keyed.facts_of(calls) if calls is not None else None
        for op in order[::-1] if back else order:
            fact, own = self.facts[op], []
            near, far = (fact.output_names, fact.input_names) if back else (fact.input_names, fact.output_names)
            for x in near:
                own += [keyed.of_facts([fact.narrowed(x, ids)]) for ids in (found.get(fact.kind(x)), loose) if ids is not None]
            if calls is not None:
                given = [f for f in start if f.op == op] if start is not None else [fact.narrowed(None, calls)]
                own += [keyed.of_facts([f.once()]) for f in given]
            if own:
                step = keyed.kept(keyed.union(*own))
                made.append(keyed.fact_of(step))
                for x in far:
                    more, kind = made[-1].elements(x), fact.kind(x)
                    found[kind] = keyed.union(found[kind], more) if kind in found else more
        hids = [x.select("hid") for x in found.values()] + ([loose] if loose is not None else [])
        empty = lambda: self.spark.createDataFrame([], "hid string")
        both = reduce(DataFrame.unionAll, hids) if hids else empty()
        return both.distinct() if loose is not None and found else both, keyed.of_facts(made) if made else empty()

    def _order(self, ops) -> list[str] | None:
        """Ops so that each comes after those that make what it uses; None where there is no such order."""
        left, out = list(ops), []
        while left:
            made = {o: self.facts[o].output[1] for o in left}
            free = [o for o in left if not {k for k, _ in self.facts[o].inputs.values()} & set(made.values())]
            if not free:
                return None
            out, left = out + free, [o for o in left if o not in free]
        return out

    def link(self, op: str, direction: str, label: str) -> DataFrame:
        """call_hid, name and ref_hid of one kind of edge."""
        fact = self.facts.get(op)
        if fact is None or label not in (fact.input_names if direction == "in" else fact.output_names):
            return self.io().where("false").select("call_hid", "name", "ref_hid")
        return fact.branch(label).select("call_hid", "name", "ref_hid")

    def calls(self, op: str) -> DataFrame:
        return keyed.of_facts([self.facts[op]])

    def elements(self, op: str, direction: str, label: str) -> DataFrame:
        """hid of all references under a label, each once."""
        return self.facts[op].elements(label, frozenset([(op, label)]))

    def plural(self, op: str, label: str) -> bool:
        return False

    def wide(self, op: str) -> DataFrame:
        return self.facts[op].wide()

    def values(self, kinds=None) -> DataFrame:
        """hid, cid, vtype, i, d, s: the payload of each atom by history id, of some kinds or all."""
        atoms = [x for k, x in self._atoms.items() if kinds is None or k in kinds]
        return reduce(DataFrame.unionAll, atoms).select("hid", "cid", F.lit("str").alias("vtype"), F.lit(None).cast("long").alias("i"), "d", "s")

    def edges(self, ops=None) -> DataFrame:
        """call_hid, op, in_hid, out_hid: each input of a call beside each of its outputs, without a join."""
        parts = []
        for op in self.op_names if ops is None else ops:
            fact = self.facts[op]
            name, kind, key = fact.output
            hid = fact._key("fact", entity_hid)
            parts += [fact.rows.select(hid.alias("call_hid"), F.lit(op).alias("op"), entity_hid(k, c).alias("in_hid"), entity_hid(kind, key).alias("out_hid")) for k, c in (fact.inputs[n] for n in fact.input_names)]
        return reduce(DataFrame.unionAll, parts)

    @cached_property
    def _atoms(self) -> dict[str, DataFrame]:
        """Texts and measures by kind of thing."""
        out: dict[str, list[DataFrame]] = {}
        for f in self.known.values() if self.known else self.facts.values():
            out.setdefault(f.output[1], []).append(f.atoms())
        for kind, df in self.extra_atoms:
            out.setdefault(kind, []).append(df)
        return {k: reduce(DataFrame.unionAll, x) for k, x in out.items()}

    @property
    def atoms(self) -> DataFrame:
        """cid, hid, s (the text), d (a measure, where the source has one)."""
        return reduce(DataFrame.unionAll, self._atoms.values())

    def kind(self, op: str, label: str) -> str:
        """What a label of an op holds; all its references are texts 'kind:key'."""
        fact = self.facts[op]
        return fact.inputs[label][0] if label in fact.inputs else fact.output[1]

    @property
    def refs(self) -> DataFrame:
        return self.atoms.select("hid", "cid").distinct()


#: Below so many bytes for each core of the session a table is dealt out; above, its files have enough parts of their own.
SMALL = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one, which may be a single row group, over all cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 1 << 20 < size < SMALL * cores else df


def line_key() -> Column:
    return F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.col("l_shipdate").cast("date").cast("string"))


def facts(spark: SparkSession, sf_dir: str) -> dict[str, Fact]:
    t = lambda name: read(spark, sf_dir, name)
    c = F.col
    turns = t("conversations").where("turn > 0")
    turn = lambda at: F.concat_ws(".", c("conv_id"), at)
    made = [
        Fact("locate_nation", t("nation"), {"region": ("region", c("n_regionkey"))}, ("nation", "nation", c("n_nationkey"))),
        Fact("register_customer", t("customer"), {"nation": ("nation", c("c_nationkey"))}, ("customer", "customer", c("c_custkey")), c("c_acctbal")),
        Fact("register_supplier", t("supplier"), {"nation": ("nation", c("s_nationkey"))}, ("supplier", "supplier", c("s_suppkey")), c("s_acctbal")),
        Fact("place_order", t("orders"), {"customer": ("customer", c("o_custkey"))}, ("order", "order", c("o_orderkey")), c("o_totalprice")),
        Fact("ship_line", t("lineitem"), {"order": ("order", c("l_orderkey")), "part": ("part", c("l_partkey")), "supplier": ("supplier", c("l_suppkey"))}, ("line", "line", line_key()), c("l_extendedprice")),
        Fact("label_document", t("labels"), {"document": ("document", c("doc_id"))}, ("label", "label", c("doc_id")), c("quality").cast("double")),
        Fact("reply", turns, {"previous": ("turn", turn(c("turn") - 1))}, ("turn", "turn", turn(c("turn")))),
        Fact("emit_event", t("events"), {"user": ("user", c("user_id"))}, ("event", "event", c("event_id")), c("value")),
    ]
    return {f.op: f for f in made}


def open_log(spark: SparkSession, sf_dir: str, ops=None) -> Log:
    """The log of the driver's tables, with texts and measures for rows that no call makes (regions, parts, documents, users)."""
    every = facts(spark, sf_dir)
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def atoms(table, kind, key, value=None):
        k = F.col(key)
        return kind, table.select(entity_cid(kind, k).alias("cid"), entity_hid(kind, k).alias("hid"), F.concat(F.lit(kind + ":"), k.cast("string")).alias("s"), (F.col(value) if value else F.lit(None)).cast("double").alias("d"))

    extra = [atoms(t("region"), "region", "r_regionkey"), atoms(t("part"), "part", "p_partkey", "p_retailprice"), atoms(t("documents"), "document", "doc_id", "n_chars"), atoms(t("events").select("user_id").distinct(), "user", "user_id")]
    return Log(spark, every if ops is None else {o: every[o] for o in ops}, extra, every)
