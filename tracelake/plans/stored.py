"""Queries that go through a store: single and bulk calls, lookups, payloads, deletion, code versions and ingestion, with SQL twins."""

from __future__ import annotations

import linecache
import sys
import types

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import MList
from ..operators import provenance
from ..operators.frame import Frame
from ..operators.memo import Storage
from ..operators.model import op
from ..sources import shared
from ..sources.ingest import line_key, open_log
from ..sources.store import Store
from ..streaming.ingest import ingest_calls
from .catalogue import BUILDING, building, ids, query, table, trade
from .twins import FACTS, LINE, TRADE, call, hid, members, ref, rows, union

IO = ["call_hid", "name", "direction", "call_cid", "ref_cid", "ref_hid", "op"]


# ids of typed values and of calls, in SQL


def int_cid(x: str) -> str:
    return f"md5('atom|i:' || {x})"


def text_cid(x: str) -> str:
    return f"md5('atom|s:' || {x})"


def fresh(cid: str) -> str:
    return f"md5('hid|' || {cid})"


def made(tag: str, name: str, inputs: dict[str, str]) -> str:
    return f"md5('{tag}|{name}|0||' || " + " || ',' || ".join(f"'{n}=' || {inputs[n]}" for n in sorted(inputs)) + ")"


def output(call_hid: str, name: str) -> str:
    return f"md5('out|' || {call_hid} || '|{name}')"


def log_rows(name: str, inputs: dict[str, tuple[str, str]], outputs: dict[str, str], source: str, semantic: str = "") -> str:
    """calls_io rows of an op over the rows of `source`: inputs give (content id, history id), outputs the content id."""
    calls = {t: made(t, name, {n: x[i] for n, x in inputs.items()}) for i, t in ((0, "content"), (1, "call"))}
    parts = []
    for n in (*inputs, *outputs):
        c, h = inputs[n] if n in inputs else (outputs[n], output(calls["call"], n))
        parts.append(f"select {calls['call']} as call_hid, '{n}' as name, '{'in' if n in inputs else 'out'}' as direction, {calls['content']} as call_cid, {c} as ref_cid, {h} as ref_hid, '{name}' as op from {source}")
    return union(parts, False)


PAIRS = "(select distinct cast(l_quantity as bigint) as quantity, l_partkey as part from lineitem)"
WEIGHT = "(quantity * 10 + part)"
INPUTS = {n: (int_cid(n), fresh(int_cid(n))) for n in ("quantity", "part")}
WEIGHED = log_rows("weigh", INPUTS, {"weight": int_cid(WEIGHT)}, PAIRS)


def weigh():
    return op(lambda quantity, part: quantity * 10 + part, name="weigh", columns=lambda quantity, part: quantity * 10 + part, output_names=["weight"])


def pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity"), F.col("l_partkey").alias("part")).distinct()


@query(WEIGHED)
def q52_stored_calls(spark, sf_dir):
    storage = Storage(spark)
    storage.over(weigh(), pairs(spark, sf_dir)).count()
    return storage.store.calls_io.select(IO)


VALUES = f"(select quantity as v from {PAIRS} union select part from {PAIRS} union select {WEIGHT} from {PAIRS})"


@query(union([f"select 'atom' as kind, {int_cid('v')} as id, v as value from {VALUES}", f"select 'ref', ref_hid, null from ({WEIGHED})"], False))
def q53_stored_payloads(spark, sf_dir):
    """Payloads by content and references by history, each once."""
    storage = Storage(spark)
    storage.over(weigh(), pairs(spark, sf_dir)).count()
    atoms = storage.store.kv("atoms").load_all().select(F.lit("atom").alias("kind"), F.col("cid").alias("id"), F.col("i").alias("value"))
    return atoms.unionAll(storage.store.refs.select(F.lit("ref"), "hid", F.lit(None).cast("long")))


def nations(spark, sf_dir) -> list[str]:
    """The names of nation, a table of a driver's size, for single calls."""
    return [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]


def shout(name):
    return name.upper() + "!"


def measure(word):
    return len(word), word[:1]


SHOUTED = "(upper(n_name) || '!')"
SHOUT_IN = {"name": (text_cid("n_name"), fresh(text_cid("n_name")))}
SHOUT_OUT = output(made("call", "shout", {"name": SHOUT_IN["name"][1]}), "output_0")
MEASURE_IN = {"word": (text_cid(SHOUTED), SHOUT_OUT)}


@query(union([log_rows("shout", SHOUT_IN, {"output_0": text_cid(SHOUTED)}, "nation"), log_rows("measure", MEASURE_IN, {"size": int_cid(f"length({SHOUTED})"), "initial": text_cid(f"{SHOUTED}[1:1]")}, "nation")], False))
def q54_single_calls(spark, sf_dir):
    """Two ops called one by one, the second on what the first returned; one batch is written when the context ends."""
    storage, loud, size = Storage(spark), op(shout), op(measure, output_names=["size", "initial"])
    with storage:
        for name in nations(spark, sf_dir):
            size(loud(name))
    return storage.store.calls_io.select(IO)


@query("select distinct r_name as name, upper(r_name) || '!' as shouted, length(r_name)::bigint + 1 as size, 0::bigint as runs from region")
def q55_replayed_calls(spark, sf_dir):
    """A later session finds all calls by id, in the order asked for, and runs none; new calls would be errors."""
    path, ran = shared.scratch(spark, "replay"), []

    def heard(name):
        ran.append(name)
        return name.upper() + "!"

    loud, size = op(heard, name="shout"), op(measure, output_names=["size", "initial"])
    names = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").orderBy("r_regionkey").collect()]
    with Storage(spark, path):
        for name in names:
            size(loud(name))
    ran.clear()
    later = Storage(spark, path)
    later.allow_new_calls(False)
    with later:
        refs = [(loud(name), *size(loud(name))) for name in names]
    later.clear_cache()
    creators = [later.get_creators([r])[0].hid for r, *_ in refs]
    calls = later.mget_call(creators, in_memory=True)
    found = [(later.unwrap(c.inputs["name"]), later.unwrap(later.load_ref(r.hid)), later.unwrap(n), len(ran)) for c, (r, n, _) in zip(calls, refs, strict=True)]
    return spark.createDataFrame(sorted(set(found)), "name string, shouted string, size long, runs long")


BASKETS = "(select l_orderkey as first, list(distinct l_partkey order by l_partkey) as parts from lineitem group by 1)"
BASKET = f"""(select first, parts, list_sort([{{'n': 'parts_' || (i - 1), 'c': {int_cid('parts[i]')}, 'h': {fresh(int_cid('parts[i]'))}}} for i in range(1, len(parts) + 1)] || [{{'n': 'first', 'c': {int_cid('first')}, 'h': {fresh(int_cid('first'))}}}]) as x from {BASKETS})"""
BASKET_CALL = "md5('call|basket|0||' || array_to_string([z.n || '=' || z.h for z in x], ','))"


@query(
    union(
        [
            f"select {BASKET_CALL} as call_hid, e.n as name, 'in' as direction, e.c as ref_cid, e.h as ref_hid from (select x, unnest(x) as e from {BASKET})",
            f"select {BASKET_CALL}, 'output_0', 'out', {int_cid('first + list_sum(parts)::bigint')}, {output(BASKET_CALL, 'output_0')} from {BASKET}",
        ],
        False,
    )
)
def q56_variable_arguments(spark, sf_dir):
    """An order's parts as the variable arguments of one call."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("first")).agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    total = op(lambda first, *parts: first + sum(parts), name="basket", columns=lambda first, parts: first + F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b))
    storage = Storage(spark)
    storage.over(total, lines).count()
    return storage.store.calls_io.select("call_hid", "name", "direction", "ref_cid", "ref_hid")


def steps(n) -> MList[int]:
    return list(range(1, n + 1))


COUNTS = "(select distinct n from (select count(*)::bigint as n from lineitem group by l_orderkey))"
STEPS_CALL = made("call", "steps", {"n": fresh(int_cid("n"))})
STEPS_CID = f"md5('list|' || array_to_string([{int_cid('i')} for i in range(1, n + 1)], ','))"
STEPS_HID = output(STEPS_CALL, "output_0")
STEP_CALL = f"md5('call|__list_getitem__|0||i=' || {fresh(int_cid('(i - 1)'))} || ',list=' || {STEPS_HID})"


@query(
    union(
        [
            f"select {STEPS_HID} as list, {STEPS_CID} as list_cid, null::bigint as idx, null as item, null::bigint as value from {COUNTS}",
            f"select {STEPS_HID}, {STEPS_CID}, i - 1, {output(STEP_CALL, 'list_item')}, i from (select n, unnest(range(1, n + 1)) as i from {COUNTS})",
        ]
    )
)
def q57_list_outputs(spark, sf_dir):
    """Lists made in bulk, each element with the history of the call that takes it out."""
    storage = Storage(spark)
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("n")
    made_ = op(steps, returns="array<long>", columns=lambda n: F.sequence(F.lit(1).cast("long"), n))
    storage.over(made_, counts).count()
    lists = storage.store.refs.where("kind = 'list'").select(F.col("hid").alias("list"), F.col("cid").alias("list_cid"))
    io = storage.store.io(["__list_getitem__"], fields=["call_hid", "name", "ref_hid", "ref_cid"])
    part = lambda n, *c: io.where(F.col("name") == n).select("call_hid", *c)
    atoms = storage.store.table("atoms").select("cid", F.col("i").alias("v"))
    value = lambda c, n: atoms.select(F.col("cid").alias(c), F.col("v").alias(n))
    items = part("list", F.col("ref_hid").alias("list"), F.col("ref_cid").alias("list_cid")).join(part("i", F.col("ref_cid").alias("at")), "call_hid").join(part("list_item", F.col("ref_hid").alias("item"), F.col("ref_cid").alias("of")), "call_hid")
    items = items.join(value("at", "idx"), "at").join(value("of", "value"), "of").select("list", "list_cid", "idx", "item", "value")
    none = F.lit(None)
    return lists.select("*", none.cast("long").alias("idx"), none.cast("string").alias("item"), none.cast("long").alias("value")).unionByName(items)


KEPT = f"{PAIRS} where quantity > 10"
LATER = {"weight": (int_cid(WEIGHT), output(made("call", "weigh", {n: x[1] for n, x in INPUTS.items()}), "weight"))}


def doubled():
    return op(lambda weight: weight * 2, name="double", columns=lambda weight: weight * 2, output_names=["twice"])


def dropped(spark, sf_dir) -> Storage:
    """Two ops in a row; calls with small quantities are dropped with all that depends on them."""
    storage = Storage(spark)
    out = storage.over(weigh(), pairs(spark, sf_dir))
    storage.over(doubled(), out.select("weight", "weight__cid", "weight__hid")).count()
    low = storage.frame(weigh()).where("quantity", "i <= 10")
    storage.drop_calls(low.table(["weigh"]).select("hid"), delete_dependents=True)
    return storage


LEFT = union([log_rows("weigh", INPUTS, {"weight": int_cid(WEIGHT)}, KEPT), log_rows("double", LATER, {"twice": int_cid(f"({WEIGHT} * 2)")}, KEPT)], False)


@query(LEFT)
def q58_dropped_with_dependents(spark, sf_dir):
    return dropped(spark, sf_dir).store.calls_io.select(IO)


@query(union([f"select 'again' as stage, call_hid, name, ref_hid from ({union([LEFT, log_rows('weigh', INPUTS, {'weight': int_cid(WEIGHT)}, PAIRS)], False)})", f"select 'vacuumed', call_hid, name, ref_hid from ({LEFT})"], False))
def q59_dropped_and_made_again(spark, sf_dir):
    """Dropped calls are seen again once they are made again; after another drop and compaction they are gone."""
    storage = dropped(spark, sf_dir)
    storage.over(weigh(), pairs(spark, sf_dir)).count()
    again = shared.spill(storage.store.calls_io.select("call_hid", "name", "ref_hid"))
    low = storage.frame(weigh()).where("quantity", "i <= 10")
    low.delete_calls()
    storage.vacuum()
    return again.select(F.lit("again").alias("stage"), "*").unionAll(storage.store.raw("calls_io").select(F.lit("vacuumed"), "call_hid", "name", "ref_hid"))


LEFT_VALUES = f"(select quantity as v from {KEPT} union select part from {KEPT} union select {WEIGHT} from {KEPT} union select {WEIGHT} * 2 from {KEPT})"


@query(union([f"select 'atom' as kind, {int_cid('v')} as id from {LEFT_VALUES}", f"select 'ref', ref_hid from ({LEFT})"], False))
def q60_garbage_collected(spark, sf_dir):
    """References in no call go, then payloads that nothing names."""
    storage = dropped(spark, sf_dir)
    storage.cleanup_refs()
    return storage.store.table("atoms").select(F.lit("atom").alias("kind"), F.col("cid").alias("id")).unionAll(storage.store.refs.select(F.lit("ref"), "hid"))


def _module(name: str, text: str):
    """A module whose functions have a source, as a user's file would."""
    module = sys.modules.get(name) or types.ModuleType(name)
    sys.modules[name] = module
    cloudpickle.register_pickle_by_value(module)
    file = f"<{name} {abs(hash(text))}>"
    linecache.cache[file] = (len(text), None, text.splitlines(True), file)
    exec(compile(text, file, "exec"), module.__dict__)
    return module


CODE = "from tracelake import op, track\nBASE = {base}\n@track\ndef scaled(x):\n    return x * {by}{note}\n@op(columns=lambda part: part * {by} + {base})\ndef rate(part):\n    return scaled(part) + BASE\n"


@query(
    union(
        [f"select distinct '{stage}' as stage, p_partkey as part, p_partkey * {by} + {base} as rated, {n}::bigint as versions from part" for stage, by, base, n in (("first", 2, 0, 1), ("meaning", 3, 0, 2), ("note", 3, 0, 2), ("global", 3, 7, 3), ("back", 2, 0, 3), ("dropped", 3, 7, 2))]
    )
)
def q61_code_versions(spark, sf_dir):
    """Bulk calls after a change of meaning, one that keeps it, one of a global, a way back, and the drop of a version."""
    storage = Storage(spark, deps="/nowhere", on_change=lambda key, old, new, dependents: "note" not in new)
    parts, out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).distinct(), []

    def run(stage, by, base, note=""):
        f = _module("rated_code", CODE.format(by=by, base=base, note=note)).rate
        got = storage.over(f, parts).select("part", F.col("output_0").alias("rated"))
        count = storage.store.calls_io.agg(F.countDistinct("semantic_version").alias("versions"))
        out.append(shared.spill(got.crossJoin(count).select(F.lit(stage).alias("stage"), "*"), name="rated"))

    run("first", 2, 0)
    run("meaning", 3, 0)
    run("note", 3, 0, "  # note")
    run("global", 3, 7)
    run("back", 2, 0)
    found = storage.store.calls_io.where("name = 'output_0'")
    old = found.join(storage.store.table("atoms").select(F.col("cid").alias("ref_cid"), "i"), "ref_cid").join(storage.store.calls_io.where("name = 'part'").select("call_hid", F.col("ref_cid").alias("p")), "call_hid")
    old = old.join(storage.store.table("atoms").select(F.col("cid").alias("p"), F.col("i").alias("part")), "p").where("part > 0 and i = part * 3").select("semantic_version").first()[0]
    storage.drop_version(old)
    run("dropped", 3, 7)
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3]).unionAll(out[4]).unionAll(out[5])


@query("select distinct 'nation:' || n_nationkey as key, case when n_nationkey % 2 = 0 then 'kept' else 'missing' end as state, case when n_nationkey % 2 = 0 then length(n_name)::bigint end as size from nation")
def q62_key_values(spark, sf_dir):
    """A key/value table: rows set twice count once, dropped keys are missing."""
    store = Store(spark)
    kv = store.kv("sources")
    every = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").cast("binary").alias("value"), "n_nationkey")
    keys = every.select("key")
    for _ in range(2):
        kv.set(every.select("key", "value"))
    kv.drop(every.where("n_nationkey % 2 = 1").select("key"))
    kept = kv.mget(keys).select("key", F.lit("kept").alias("state"), F.length("value").cast("long").alias("size"))
    return kept.unionAll(kv.missing(keys).select("key", F.lit("missing"), F.lit(None).cast("long")))


@query("select name, direction, count(*)::bigint as n, count(distinct ref_cid)::bigint as contents from (" + WEIGHED + ") group by all")
def q63_sql_over_a_store(spark, sf_dir):
    storage = Storage(spark)
    storage.over(weigh(), pairs(spark, sf_dir)).count()
    return storage.execute("select name, direction, count(*) as n, count(distinct ref_cid) as contents from calls group by name, direction")


@query(
    union(
        [
            rows("ship_line", "'call' as what", f"{call('ship_line')} as id", where="l_quantity >= 45", distinct=True),
            rows("place_order", "'call'", call("place_order"), where=f"o_custkey in {BUILDING}", distinct=True),
            f"select distinct 'ref', {hid('part', 'p_partkey')} from part where p_partkey in (select l_partkey from lineitem)",
        ],
        False,
    )
)
def q64_what_exists(spark, sf_dir):
    """Of ids asked for, those the log has: calls, and parts that some call used."""
    log = trade(spark, sf_dir)
    lines = ids(table(spark, sf_dir, "lineitem").where("l_quantity >= 45"), "line", line_key())
    asked = provenance.creators(log, lines).unionAll(provenance.consumers(log, building(spark, sf_dir), ["place_order"])).unionAll(ids(table(spark, sf_dir, "part"), "part", "p_partkey").toDF("call_hid"))
    parts = provenance.existing_refs(log, ids(table(spark, sf_dir, "part"), "part", "p_partkey"))
    return provenance.existing_calls(log, asked).select(F.lit("call").alias("what"), F.col("call_hid").alias("id")).unionAll(parts.select(F.lit("ref"), "ref_hid"))


def _edges() -> list[tuple[str, str, str]]:
    return sorted({(n, o, n) for o in TRADE for n in FACTS[o][1]} | {(o, FACTS[o][2][0], FACTS[o][2][0]) for o in TRADE})


def _ends() -> tuple[list[str], list[str]]:
    edges = _edges()
    nodes = {x for a, b, _ in edges for x in (a, b)}
    return sorted(nodes - {b for _, b, _ in edges}), sorted(nodes - {a for a, _, _ in edges})


@query("select * from (values " + ", ".join(f"('edge', '{a}', '{b}', '{x}')" for a, b, x in _edges()) + ", " + ", ".join([f"('source', '{n}', '', '')" for n in _ends()[0]] + [f"('sink', '{n}', '', '')" for n in _ends()[1]] + ["('ordered', 'true', '', '')"]) + ") as t(what, a, b, label)")
def q65_frame_graph(spark, sf_dir):
    """A frame's graph: edges, ends, and whether its node order goes along all edges."""
    log = trade(spark, sf_dir)
    frame = Frame.union(*(Frame.from_op(log, o) for o in TRADE))
    place = {n: i for i, n in enumerate(frame.sort_nodes(frame.nodes))}
    found = [("edge", *e) for e in frame.edges()] + [("source", n, "", "") for n in frame.sources] + [("sink", n, "", "") for n in frame.sinks]
    found.append(("ordered", str(all(place[a] < place[b] for a, b, _ in frame.edges())).lower(), "", ""))
    return spark.createDataFrame(found, "what string, a string, b string, label string")


URGENT = "o_orderpriority = '1-URGENT'"


@query(members([("customer", ref("place_order", "customer"), "orders"), ("order", ref("place_order", "order"), f"orders where not ({URGENT})"), ("urgent", ref("place_order", "order"), f"orders where {URGENT}"), ("place_order", call("place_order"), f"orders where not ({URGENT})")]))
def q66_moved_and_dropped(spark, sf_dir):
    """Urgent orders move to a variable of their own; their calls go; a variable without elements goes too."""
    log = open_log(spark, sf_dir, ("place_order",))
    urgent = ids(table(spark, sf_dir, "orders").where(URGENT), "order", "o_orderkey")
    frame = Frame.from_op(log, "place_order").add_refs("urgent", urgent.where("false")).add_refs("none", urgent.where("false"))
    frame = frame.move_refs("order", "urgent", urgent)
    frame = frame.drop_calls("place_order", provenance.creators(log, urgent).toDF("hid"))
    return frame.cleanup().table()


@query(f"select distinct {hid('customer', 'o_custkey')} as hid, 'CUSTOMER:' || o_custkey as value from orders")
def q67_function_of_values(spark, sf_dir):
    return Frame.from_op(open_log(spark, sf_dir, ("place_order",)), "place_order")["customer"].apply(F.upper).select("hid", "value")


@query(members([("customer", ref("place_order", "customer"), "orders where o_custkey in (1, 2, 4, 5, 7)"), ("place_order", call("place_order"), "orders where o_custkey in (1, 2, 4, 5, 7)")]))
def q68_isin_values(spark, sf_dir):
    frame = Frame.from_op(open_log(spark, sf_dir, ("place_order",)), "place_order")
    return frame.isin([f"customer:{k}" for k in (1, 2, 4, 5, 7)]).table()


@query(rows("place_order", f"{ref('place_order', 'order')} as \"order\"", "'customer:' || o_custkey as customer"))
def q69_lazy_variables(spark, sf_dir):
    """A joint table with values for one variable and ids for the other."""
    return Frame.from_op(open_log(spark, sf_dir, ("place_order",)), "place_order").df("customer", "order", lazy_vars=["order"], include_calls=False)


@query(union([rows("place_order", "'place_order' as node", f"{call('place_order')} as hid", where=f"o_custkey in {BUILDING}"), rows("register_customer", "'register_customer'", call("register_customer"), where="c_mktsegment = 'BUILDING'")], False))
def q70_adjacent_calls(spark, sf_dir):
    """Calls on either side of a variable's elements."""
    log = open_log(spark, sf_dir, ("register_customer", "place_order"))
    frame = Frame.from_op(log, "register_customer") | Frame.from_op(log, "place_order")
    found = frame.adjacent("customer", building(spark, sf_dir))
    (first, a), (second, b) = sorted(found.items())
    return a.select(F.lit(first).alias("node"), "hid").unionAll(b.select(F.lit(second), "hid"))


@query(rows("emit_event", f"{call('emit_event')} as call_hid", "'event' as name", f"{ref('emit_event', 'event')} as ref_hid") + " union all " + rows("emit_event", call("emit_event"), "'user'", ref("emit_event", "user")))
def q71_streamed_calls(spark, sf_dir):
    """Call rows arrive in a stream, some twice, some after they were dropped; the store has each once."""
    store, folder = Store(spark), shared.scratch(spark, "stream")
    arriving = open_log(spark, sf_dir, ("emit_event",)).calls_io
    arriving.write.parquet(f"{folder}/in/a")
    arriving.where("name = 'event'").write.parquet(f"{folder}/in/b")

    def feed(name):
        stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in/*")
        ingest_calls(stream, store, name, f"{folder}/{name}").awaitTermination()

    feed("one")
    store.tombstone(store.calls_io.where("pmod(xxhash64(call_hid), 3) = 0").select("call_hid"))
    feed("two")
    return store.calls_io.select("call_hid", "name", "ref_hid")


@query(members([("place_order", call("place_order"), "orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice < 150000"), ("order", ref("place_order", "order"), "orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice < 150000")] + [("customer", ref("place_order", "customer"), "orders where o_custkey in (select o_custkey from orders where o_orderstatus = 'F') and o_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') and o_custkey in (select o_custkey from orders where o_totalprice < 150000)")]))
def q72_frames_of_several(spark, sf_dir):
    """What three frames have in common."""
    log, orders = open_log(spark, sf_dir, ("place_order",)), table(spark, sf_dir, "orders")
    frames = [Frame.from_vars(log, {"order": ids(orders.where(w), "order", "o_orderkey")}).expand_back("order") for w in ("o_orderstatus = 'F'", URGENT, "o_totalprice < 150000")]
    return Frame.intersection(*frames).table()
