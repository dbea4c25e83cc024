"""Queries of the catalogue by name, each with its SQL twin; every one reads its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_id_col, entity_cid, entity_hid
from ..operators import collections_, describe, provenance
from ..operators.frame import Frame
from ..operators.memo import Storage
from ..operators.model import NewArgDefault, op
from ..sources.ingest import line_key, open_log, read
from ..sources.keyed import of_keys
from .twins import FACTS, LINE, TRADE, call, cid, hid, io, members, ref, rows, union, wide

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark, sf_dir, name) -> DataFrame:
    return read(spark, sf_dir, name)


def trade(spark, sf_dir):
    return open_log(spark, sf_dir, TRADE)


def orders_and_lines(spark, sf_dir) -> Frame:
    """place_order and ship_line in one frame; their order variable is the same."""
    log = open_log(spark, sf_dir, ("place_order", "ship_line"))
    return Frame.from_op(log, "place_order") | Frame.from_op(log, "ship_line")


def ids(df: DataFrame, kind: str, key: Column | str) -> DataFrame:
    return of_keys(kind, df.select((F.col(key) if isinstance(key, str) else key).alias("key")))


def building(spark, sf_dir) -> DataFrame:
    return ids(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "customer", "c_custkey")


BUILDING = "(select c_custkey from customer where c_mktsegment = 'BUILDING')"
every = list(FACTS)


# scans and lookups


@query(union(rows(o, f"'{o}' as op", f"count(distinct {call(o)}) as calls") for o in every))
def q01_call_log_counts(spark, sf_dir):
    return provenance.count_calls(open_log(spark, sf_dir))


@query(f"select op, direction, count(*) as n from ({io(every)}) group by all")
def q02_io_rows_per_op_direction(spark, sf_dir):
    return open_log(spark, sf_dir).io().groupBy("op", "direction").agg(F.count("*").alias("n"))


@query(wide("place_order").replace("as place_order", "as call_hid"))
def q03_op_wide_table_orders(spark, sf_dir):
    return open_log(spark, sf_dir).wide("place_order")


@query(wide("ship_line").replace("as ship_line", "as call_hid"))
def q04_op_wide_table_lines(spark, sf_dir):
    return open_log(spark, sf_dir).wide("ship_line")


@query(rows("place_order", f"{call('place_order')} as call_hid", "'place_order' as op", f"'customer=' || {ref('place_order', 'customer')} as inputs", f"'order=' || {ref('place_order', 'order')} as outputs", where=f"o_custkey in {BUILDING}"))
def q05_mget_calls(spark, sf_dir):
    log = open_log(spark, sf_dir, ("place_order",))
    calls = provenance.consumers(log, building(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return provenance.get_calls(log, calls).select("call_hid", "op", text("inputs"), text("outputs"))


# provenance


@query(rows("ship_line", f"{call('ship_line')} as call_hid", where="l_quantity >= 40", distinct=True))
def q06_creators_of_lines(spark, sf_dir):
    lines = ids(table(spark, sf_dir, "lineitem").where("l_quantity >= 40"), "line", line_key())
    return provenance.creators(trade(spark, sf_dir), lines)


@query(rows("ship_line", f"{call('ship_line')} as call_hid", where="l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')", distinct=True))
def q07_consumers_of_orders(spark, sf_dir):
    return provenance.consumers(trade(spark, sf_dir), ids(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "order", "o_orderkey"))


@query(union((rows("ship_line", f"{ref('ship_line', n)} as ref_hid", where="l_returnflag = 'R'", distinct=True) for n in ("order", "part", "supplier")), False))
def q08_inputs_of_calls(spark, sf_dir):
    log = trade(spark, sf_dir)
    lines = ids(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "line", line_key())
    return provenance.inputs_of(log, provenance.creators(log, lines, ["ship_line"]))


@query(rows("place_order", f"{ref('place_order', 'order')} as ref_hid", where=f"o_custkey in {BUILDING}", distinct=True))
def q09_outputs_of_calls(spark, sf_dir):
    log = trade(spark, sf_dir)
    return provenance.outputs_of(log, provenance.consumers(log, building(spark, sf_dir), ["place_order"]))


NEEDED = "(select * from lineitem where l_returnflag = 'A' and l_quantity >= 45)"
NEEDED_ORDERS = f"(select * from orders where o_orderkey in (select l_orderkey from {NEEDED}))"
NEEDED_NATIONS = f"(select * from nation where n_nationkey in (select c_nationkey from customer where c_custkey in (select o_custkey from {NEEDED_ORDERS}) union select s_nationkey from supplier where s_suppkey in (select l_suppkey from {NEEDED})))"


@query(
    union(
        [
            f"select {hid('line', LINE)} as hid from {NEEDED}",
            f"select {hid('order', 'l_orderkey')} from {NEEDED}",
            f"select {hid('part', 'l_partkey')} from {NEEDED}",
            f"select {hid('supplier', 'l_suppkey')} from {NEEDED}",
            f"select {hid('customer', 'o_custkey')} from {NEEDED_ORDERS}",
            f"select {hid('nation', 'n_nationkey')} from {NEEDED_NATIONS}",
            f"select {hid('region', 'n_regionkey')} from {NEEDED_NATIONS}",
        ],
        False,
    )
)
def q10_dependencies_closure(spark, sf_dir):
    lines = ids(table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity >= 45"), "line", line_key())
    return provenance.dependencies(trade(spark, sf_dir), lines)[0]


@query(
    union(
        [
            f"select {hid('customer', 'c_custkey')} as hid from customer where c_mktsegment = 'BUILDING'",
            f"select {hid('order', 'o_orderkey')} from orders where o_custkey in {BUILDING}",
            f"select {hid('line', LINE)} from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in {BUILDING})",
        ],
        False,
    )
)
def q11_dependents_closure(spark, sf_dir):
    return provenance.dependents(trade(spark, sf_dir), building(spark, sf_dir))[0]


@query(
    f"""with recursive e as (select {ref("reply", "previous")} as a, {ref("reply", "turn")} as b from conversations where turn > 0),
start as (select {hid("turn", "concat_ws('.', conv_id, turn)")} as hid from conversations where turn = 0),
reach(hid) as (select hid from start union select e.b from reach join e on e.a = reach.hid) select distinct hid from reach"""
)
def q12_reply_chain_closure(spark, sf_dir):
    first = ids(table(spark, sf_dir, "conversations").where("turn = 0"), "turn", F.concat_ws(".", "conv_id", "turn"))
    return provenance.dependents(open_log(spark, sf_dir, ("reply",)), first)[0]


@query(
    union(
        [
            f"select distinct {hid('part', 'p_partkey')} as hid from part where p_partkey not in (select l_partkey from lineitem)",
            f"select distinct {hid('document', 'doc_id')} from documents where doc_id not in (select doc_id from labels)",
            f"select distinct {hid('region', 'r_regionkey')} from region where r_regionkey not in (select n_regionkey from nation)",
        ]
    )
)
def q13_orphan_refs(spark, sf_dir):
    return provenance.orphans(open_log(spark, sf_dir))


@query("select source, count(*) as rows_, count(distinct md5('atom|s:' || text)) as contents from documents group by source")
def q14_content_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = F.when(F.col("text").isNotNull(), content_id_col(F.col("text"), docs.schema["text"].dataType))
    return docs.groupBy("source").agg(F.count("*").alias("rows_"), F.countDistinct(own).alias("contents"))


# frames


SHIP, SHIP_NODES = call("ship_line"), ("order", "part", "supplier", "line", "ship_line")


def shipped(where: str = "true", names=SHIP_NODES, of=None):
    """(node, id, from) of the calls of ship_line and what they touch."""
    return [((of or {}).get(n, n), SHIP if n == "ship_line" else ref("ship_line", n), f"lineitem where {where}") for n in names]


@query(members(shipped()))
def q15_frame_from_op(spark, sf_dir):
    return Frame.from_op(open_log(spark, sf_dir, ("ship_line",)), "ship_line").table()


@query(union([rows("ship_line", f"'{n}' as node", f"count(distinct {ref('ship_line', n)}) as n") for n in ("order", "part", "supplier", "line")] + [rows("ship_line", "'ship_line' as node", f"count(distinct {SHIP}) as n")]))
def q51_frame_stats(spark, sf_dir):
    frame = Frame.from_op(open_log(spark, sf_dir, ("ship_line",)), "ship_line")
    return frame.get_var_stats().toDF("node", "n").unionAll(frame.get_func_stats().toDF("node", "n"))


@query(
    union(
        [
            rows("place_order", "'customer' as node", f"{ref('place_order', 'customer')} as hid", distinct=True),
            rows("ship_line", "'part'", ref("ship_line", "part"), distinct=True),
            rows("ship_line", "'supplier'", ref("ship_line", "supplier"), distinct=True),
            rows("ship_line", "'order'", ref("ship_line", "order"), distinct=True, where="l_orderkey not in (select o_orderkey from orders)"),
        ]
    )
)
def q16_source_elements(spark, sf_dir):
    ends = orders_and_lines(spark, sf_dir).source_elts()
    return reduce(DataFrame.unionAll, [x.select(F.lit(n).alias("node"), "hid") for n, x in ends.items()])


@query(
    union(
        [
            rows("ship_line", "'line' as node", f"{ref('ship_line', 'line')} as hid", distinct=True),
            rows("place_order", "'order'", ref("place_order", "order"), where="o_orderkey not in (select l_orderkey from lineitem)"),
        ]
    )
)
def q17_sink_elements(spark, sf_dir):
    ends = orders_and_lines(spark, sf_dir).sink_elts()
    return reduce(DataFrame.unionAll, [x.select(F.lit(n).alias("node"), "hid") for n, x in ends.items()])


@query(
    union(
        [
            rows("ship_line", "'order' as source", "'ship_line' as target", "'order' as label", f"count(distinct {SHIP}) as calls", f"count(distinct {ref('ship_line', 'order')}) as refs"),
            rows("ship_line", "'ship_line'", "'line'", "'line'", f"count(distinct {SHIP})", f"count(distinct {ref('ship_line', 'line')})"),
        ]
    )
)
def q18_induced_subframe(spark, sf_dir):
    return describe.edge_stats(orders_and_lines(spark, sf_dir)[["order", "ship_line", "line"]])


def flagged(spark, sf_dir, flag: str) -> Frame:
    """The calls that shipped lines of one flag, with all that they touch."""
    log = open_log(spark, sf_dir, ("ship_line",))
    lines = ids(table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag), "line", line_key())
    return Frame.from_vars(log, {"line": lines}).expand_back("line")


def parts(flag):
    return {n: f"select distinct {SHIP if n == 'ship_line' else ref('ship_line', n)} as hid from lineitem where l_returnflag = '{flag}'" for n in ("ship_line", "order", "part", "supplier", "line")}


@query(members(shipped("l_returnflag in ('A', 'R')")))
def q19_frame_union(spark, sf_dir):
    return (flagged(spark, sf_dir, "A") | flagged(spark, sf_dir, "R")).table()


@query(union(f"select '{n}' as node, hid from ({parts('A')[n]} intersect {parts('R')[n]})" for n in parts("A")))
def q20_frame_intersection(spark, sf_dir):
    return (flagged(spark, sf_dir, "A") & flagged(spark, sf_dir, "R")).table()


def placed(spark, sf_dir, priority: str) -> Frame:
    log = open_log(spark, sf_dir, ("place_order",))
    return Frame.from_vars(log, {"order": ids(table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority), "order", "o_orderkey")}).expand_back("order")


@query(
    union(
        [
            rows("place_order", "'customer' as node", f"{ref('place_order', 'customer')} as hid", where="o_orderpriority = '1-URGENT' and o_custkey not in (select o_custkey from orders where o_orderpriority = '5-LOW')", distinct=True),
            rows("place_order", "'place_order'", call("place_order"), where="o_orderpriority = '1-URGENT'"),
            rows("place_order", "'order'", ref("place_order", "order"), where="o_orderpriority = '1-URGENT'"),
        ]
    )
)
def q21_frame_difference(spark, sf_dir):
    """Urgent orders without the customers of low ones: a call whose customer is gone begins the rest and stays."""
    return (placed(spark, sf_dir, "1-URGENT") - placed(spark, sf_dir, "5-LOW")).table()


@query(members(shipped(names=("order", "supplier", "line", "ship_line"), of={"order": "purchase"})))
def q22_rename_and_drop(spark, sf_dir):
    return Frame.from_op(open_log(spark, sf_dir, ("ship_line",)), "ship_line").rename({"order": "purchase"}).drop("part").table()


ORDER_WIDE, LINE_WIDE = wide("place_order"), wide("ship_line")


@query(f'select o.customer, o.place_order, coalesce(o."order", l."order") as "order", l.part, l.supplier, l.ship_line, l.line from ({ORDER_WIDE}) o full join ({LINE_WIDE}) l on o."order" = l."order"')
def q23_joint_history_outer(spark, sf_dir):
    return orders_and_lines(spark, sf_dir).df(values="refs")


@query(f'select o.customer, o.place_order, o."order", l.part, l.supplier, l.ship_line, l.line from ({ORDER_WIDE}) o join ({LINE_WIDE}) l on o."order" = l."order"')
def q24_joint_history_inner(spark, sf_dir):
    return orders_and_lines(spark, sf_dir).df(values="refs", join_how="inner")


def trade_frame(spark, sf_dir) -> Frame:
    log = trade(spark, sf_dir)
    frames = [Frame.from_op(log, o) for o in TRADE]
    return Frame.union(*frames)


def cell(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_distinct([x for x in [{a}, {b}] if x is not null])), ',')"


@query(
    f"""with o as ({wide("place_order")}), l as ({wide("ship_line")}), c as ({wide("register_customer")}), s as ({wide("register_supplier")}), n as ({wide("locate_nation")})
select l.line, l.ship_line, l."order", l.part, l.supplier, o.place_order, o.customer, c.register_customer, s.register_supplier,
  {cell("c.nation", "s.nation")} as nation, {cell("cn.locate_nation", "sn.locate_nation")} as locate_nation, {cell("cn.region", "sn.region")} as region
from l join o on o."order" = l."order" join c on c.customer = o.customer join s on s.supplier = l.supplier join n cn on cn.nation = c.nation join n sn on sn.nation = s.nation"""
)
def q25_history_table_lines(spark, sf_dir):
    return trade_frame(spark, sf_dir).history("line")


@query(f'select o.customer, coalesce(o."order", l."order") as "order", l.line from ({ORDER_WIDE}) o full join ({LINE_WIDE}) l on o."order" = l."order"')
def q26_history_without_calls(spark, sf_dir):
    return orders_and_lines(spark, sf_dir).df("customer", "order", "line", values="refs", include_calls=False)


@query(f"select 'customer:' || o_custkey as customer, 'order:' || o_orderkey as \"order\", case when l_orderkey is not null then 'line:' || {LINE} end as line from orders left join lineitem on o_orderkey = l_orderkey")
def q27_values_late_join(spark, sf_dir):
    return orders_and_lines(spark, sf_dir).df("customer", "order", "line", include_calls=False)


@query(f"select {hid('document', 'd.doc_id')} as document, case when l.doc_id is not null then {hid('label', 'l.doc_id')} end as label from (select distinct doc_id from documents) d left join (select distinct doc_id from labels) l using (doc_id)")
def q28_partial_label_table(spark, sf_dir):
    log = open_log(spark, sf_dir, ("label_document",))
    docs = ids(table(spark, sf_dir, "documents"), "document", "doc_id")
    return Frame.from_vars(log, {"document": docs}).expand_forward().df("document", "label", values="refs")


SHIPPED_ORDERS = "orders where o_orderkey in (select l_orderkey from lineitem)"
SHIPPED_CUSTOMERS = f"customer where c_custkey in (select o_custkey from {SHIPPED_ORDERS})"
SHIPPED_SUPPLIERS = "supplier where s_suppkey in (select l_suppkey from lineitem)"


@query(
    members(
        [
            *shipped(),
            ("place_order", call("place_order"), SHIPPED_ORDERS),
            ("customer", ref("place_order", "customer"), SHIPPED_ORDERS),
            ("register_customer", call("register_customer"), SHIPPED_CUSTOMERS),
            ("register_supplier", call("register_supplier"), SHIPPED_SUPPLIERS),
            ("nation", ref("register_customer", "nation"), SHIPPED_CUSTOMERS),
            ("nation", ref("register_supplier", "nation"), SHIPPED_SUPPLIERS),
        ]
    )
)
def q29_expand_back_from_lines(spark, sf_dir):
    return Frame.from_op(trade(spark, sf_dir), "ship_line").expand_back(["order", "supplier"]).expand_back(["customer"]).table()


OWN = f"(select o_orderkey from orders where o_custkey in {BUILDING})"


def placed_orders(where: str = "true"):
    return [("place_order", call("place_order"), f"orders where {where}"), ("order", ref("place_order", "order"), f"orders where {where}")]


@query(members([("customer", hid("customer", "c_custkey"), "customer where c_mktsegment = 'BUILDING'"), *placed_orders(f"o_custkey in {BUILDING}"), *shipped(f"l_orderkey in {OWN}", ("ship_line", "line"))]))
def q30_expand_forward_from_customers(spark, sf_dir):
    return Frame.from_vars(trade(spark, sf_dir), {"customer": building(spark, sf_dir)}).expand_forward(recursive=True).table()


@query(members([("customer", ref("place_order", "customer"), "orders"), *placed_orders(), *shipped(names=("ship_line", "line"))]))
def q31_expand_all(spark, sf_dir):
    """Forward steps add the outputs of the calls found; their other inputs get no variable."""
    log = open_log(spark, sf_dir, ("place_order", "ship_line"))
    return Frame.from_op(log, "place_order").expand_all().table()


SMALL_ORDERS, LOW = "(select o_orderkey from orders where o_orderpriority = '1-URGENT')", "(select s_suppkey from supplier where s_acctbal < 5000)"


def restricted(spark, sf_dir) -> Frame:
    """ship_line with urgent orders and suppliers of low balance only; all parts."""
    frame = Frame.from_op(open_log(spark, sf_dir, ("ship_line",)), "ship_line")
    orders = ids(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "order", "o_orderkey")
    suppliers = ids(table(spark, sf_dir, "supplier").where("s_acctbal < 5000"), "supplier", "s_suppkey")
    return frame.select_subsets({**frame.elts, "order": orders, "supplier": suppliers})


WITHIN = [*shipped(f"l_orderkey in {SMALL_ORDERS}", ("order",)), *shipped(f"l_suppkey in {LOW}", ("supplier",))]


@query(members([*WITHIN, *shipped(names=("part",)), *shipped(f"l_orderkey in {SMALL_ORDERS} and l_suppkey in {LOW}", ("ship_line", "line"))]))
def q32_downstream_strong(spark, sf_dir):
    return restricted(spark, sf_dir).downstream("order", "supplier", "part").table()


@query(members([*WITHIN, *shipped(f"l_orderkey in {SMALL_ORDERS} or l_suppkey in {LOW}", ("ship_line", "line"))]))
def q33_downstream_weak(spark, sf_dir):
    return restricted(spark, sf_dir).downstream("order", "supplier", how="weak").table()


@query(
    union(
        [f"select 'customer' as node, {hid('customer', 'o_custkey')} as hid from orders", f"select 'place_order', {call('place_order')} from orders", f"select 'order', {hid('order', 'o_orderkey')} from orders"]
        + [f"select '{n}', {x} from lineitem where l_orderkey in (select o_orderkey from orders)" for n, x in (("ship_line", SHIP), ("line", hid("line", LINE)))],
        False,
    )
)
def q34_midstream_customer_line(spark, sf_dir):
    return trade_frame(spark, sf_dir).midstream("customer", "line").table()


# memoized execution


def _weigh():
    return op(lambda quantity, part: quantity * 10 + part, name="weigh", columns=lambda quantity, part: quantity * 10 + part, output_names=["weight"])


def _measured(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("quantity"), F.col("l_partkey").alias("part"))


PAIRS = "select distinct cast(l_quantity as bigint) as quantity, l_partkey as part{} from lineitem"
FIRST = PAIRS.format("") + " where l_returnflag = 'A'"


@query(f"select hit, count(*) as rows_, count(distinct (quantity, part)) as calls from (select *, (quantity, part) in (select (quantity, part) from ({FIRST})) as hit from (select cast(l_quantity as bigint) as quantity, l_partkey as part from lineitem)) group by hit")
def q35_memo_bulk_hits_misses(spark, sf_dir):
    storage, weigh, rows_ = Storage(spark), _weigh(), _measured(spark, sf_dir)
    storage.over(weigh, rows_.where("l_returnflag = 'A'").select("quantity", "part")).count()
    found = storage.hits_and_misses(weigh, rows_.select("quantity", "part"))
    return found.groupBy("hit").agg(F.count("*").alias("rows_"), F.countDistinct("call_hid").alias("calls"))


@query("select count(distinct l_partkey) as calls, count(*) as rows_ from lineitem")
def q36_memo_ignore_arg(spark, sf_dir):
    twice = op(lambda part, quantity: part * 2, name="twice", columns=lambda part, quantity: part * 2, ignore_args=("quantity",), output_names=["double"])
    storage = Storage(spark)
    out = storage.over(twice, _measured(spark, sf_dir).select("part", "quantity"))
    return out.agg(F.countDistinct("call_hid").alias("calls"), F.count("*").alias("rows_"))


@query("select count(distinct part) as old_calls, count(distinct part) + count(distinct (part, quantity)) filter (where quantity <> 1) as calls from (select cast(l_quantity as bigint) as quantity, l_partkey as part from lineitem)")
def q37_memo_new_default(spark, sf_dir):
    scale = op(lambda part: part, name="scale", columns=lambda part: part, output_names=["scaled"])
    later = op(lambda part, quantity=NewArgDefault(1): part * quantity, name="scale", columns=lambda part, quantity: part * quantity, output_names=["scaled"])
    storage, rows_ = Storage(spark), _measured(spark, sf_dir)
    storage.over(scale, rows_.select("part")).count()
    count = lambda name: storage.store.calls_io.agg(F.countDistinct("call_hid").alias(name))
    old = count("old_calls")  # a plan over the batches of this moment
    storage.over(later, rows_.select("part", "quantity")).count()
    both = old.select("old_calls", F.lit(None).cast("long").alias("calls")).unionAll(count("calls").select(F.lit(None).cast("long"), "calls"))
    return both.agg(F.max("old_calls").alias("old_calls"), F.max("calls").alias("calls"))


@query(f"select l_orderkey as orderkey, count(*)::bigint as n, md5('list|' || array_to_string(list(c order by k, c), ',')) as list_cid from (select l_orderkey, l_linenumber as k, {cid('line', LINE)} as c from lineitem) group by l_orderkey")
def q38_list_aggregate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("k"), entity_cid("line", line_key()).alias("cid"), entity_hid("line", line_key()).alias("hid"))
    lists = collections_.build_lists(lines, ["orderkey"], ["k", "cid"])
    return lists.select("orderkey", F.size("elems").cast("long").alias("n"), F.col("cid").alias("list_cid"))


BELOW = {
    "line": "l_extendedprice < 20000",
    "part": "l_partkey in (select p_partkey from part where p_retailprice < 20000)",
    "order": "l_orderkey in (select o_orderkey from orders where o_totalprice < 20000)",
    "supplier": "l_suppkey in (select s_suppkey from supplier where s_acctbal < 20000)",
}


@query(members([*(x for n, w in BELOW.items() for x in shipped(w, (n,))), *shipped(" or ".join(BELOW.values()), ("ship_line",))]))
def q39_less_than(spark, sf_dir):
    return (Frame.from_op(trade(spark, sf_dir), "ship_line") < 20000).table()


GONE = f"(select o_orderkey from orders where o_custkey in {BUILDING})"


@query(
    f"""select op, call_hid, name, direction, ref_hid from ({io(TRADE)}) where call_hid not in (
  select {call("place_order")} from orders where o_custkey in {BUILDING} union all select {SHIP} from lineitem where l_orderkey in {GONE})"""
)
def q40_drop_with_dependents(spark, sf_dir):
    log = trade(spark, sf_dir)
    calls = provenance.consumers(log, building(spark, sf_dir), ["place_order"])
    return provenance.remaining(log, calls).select("op", "call_hid", "name", "direction", "ref_hid")


# further operators


@query(f"select {call('place_order')} as call_hid, {ref('place_order', 'customer')} as customer, {ref('place_order', 'order')} as \"order\" from orders where o_custkey in {BUILDING}")
def q41_func_table_of_subframe(spark, sf_dir):
    frame = Frame.from_op(open_log(spark, sf_dir, ("place_order",)), "place_order")
    return frame.select_subsets({**frame.elts, "customer": building(spark, sf_dir)}).downstream("customer").get_func_table("place_order")


@query(
    union(
        [
            f"select 'creator' as role, 'place_order' as function, 'order' as label, count(distinct {call('place_order')}) as calls from orders",
            f"select 'consumer', 'ship_line', 'order', count(distinct {SHIP}) from lineitem",
        ]
    )
)
def q42_var_info(spark, sf_dir):
    return orders_and_lines(spark, sf_dir).var_info("order")


@query(members(shipped("l_returnflag = 'N'")))
def q43_upstream(spark, sf_dir):
    frame = Frame.from_op(open_log(spark, sf_dir, ("ship_line",)), "ship_line")
    lines = ids(table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'"), "line", line_key())
    return frame.select_subsets({**frame.elts, "line": lines}).upstream("line").table()


@query(members(shipped("l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O')", ("order", "ship_line"))))
def q44_isin_hids(spark, sf_dir):
    frame = Frame.from_op(open_log(spark, sf_dir, ("ship_line",)), "ship_line")
    orders = ids(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "order", "o_orderkey")
    return frame.isin(orders, by="hid").table()


@query(members([("customer", ref("place_order", "customer"), "orders"), *placed_orders()]))
def q45_merge_vars(spark, sf_dir):
    log = open_log(spark, sf_dir, ("place_order",))
    urgent = ids(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "order", "o_orderkey")
    frame = Frame.from_op(log, "place_order").add_refs("urgent", urgent)
    return frame.merge_vars().table()


@query("select quantity, part, quantity * 10 + part as weight from (select distinct cast(l_quantity as bigint) as quantity, l_partkey as part from lineitem)")
def q46_memo_bulk_values(spark, sf_dir):
    storage, weigh = Storage(spark), _weigh()
    pairs = _measured(spark, sf_dir).select("quantity", "part").distinct()
    storage.over(weigh, pairs.where("quantity <= 25")).count()
    return storage.over(weigh, pairs).select("quantity", "part", "weight")


@query("select weight, weight % 7 as rest from (select distinct cast(l_quantity as bigint) * 10 + l_partkey as weight from lineitem)")
def q47_memo_composition(spark, sf_dir):
    """The output of one op as the input of another, extracted as a joint table with typed values."""
    rest = op(lambda weight: weight % 7, name="rest_of", columns=lambda weight: weight % 7, output_names=["rest"])
    storage, weigh = Storage(spark), _weigh()
    out = storage.over(weigh, _measured(spark, sf_dir).select("quantity", "part").distinct())
    storage.over(rest, out.select("weight", "weight__cid", "weight__hid")).count()
    table_ = storage.frame(rest).expand_back(recursive=True).df("weight", "rest", include_calls=False)
    return table_.distinct()


@query(members([(n, call("emit_event") if n == "emit_event" else ref("emit_event", n), "events") for n in ("user", "event", "emit_event")]))
def q48_events_frame(spark, sf_dir):
    return Frame.from_op(open_log(spark, sf_dir, ("emit_event",)), "emit_event").table()


@query(f"select {hid('turn', "concat_ws('.', c.conv_id, c.turn)")} as turn, count(*)::bigint as ancestors from conversations c join conversations p on p.conv_id = c.conv_id and p.turn < c.turn where c.turn > 0 group by 1")
def q49_history_over_a_cycle(spark, sf_dir):
    """The reply op feeds its own variable: each turn's history is the chain before it."""
    log = open_log(spark, sf_dir, ("reply",))
    frame = Frame.from_op(log, "reply").merge_into("previous", "turn")
    from ..operators.history import closure

    rows_ = closure(frame, "turn").where("node = 'turn' and root <> hid")
    return rows_.groupBy(F.col("root").alias("turn")).agg(F.count("*").alias("ancestors"))


@query(f"select 'customer:' || o_custkey as customer, count(*) as orders from orders where o_totalprice < 100000 group by 1")
def q50_table_then_aggregate(spark, sf_dir):
    frame = Frame.from_op(open_log(spark, sf_dir, ("place_order",)), "place_order").where("order", "d < 100000").upstream("order")
    return frame.df("customer", "place_order", "order").groupBy("customer").agg(F.count("*").alias("orders"))
