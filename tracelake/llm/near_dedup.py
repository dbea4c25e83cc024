"""MinHash near-dedup with an LSH forest and exact confirmation.

Texts with equal shingle sets form one class first, so copies cost nothing later. Every class has `TREES` sorted signature
orders of `DEPTH` values. Classes that share the first `ROOT` values of an order form a region; neighbours in the order are
candidates. Depth adapts to the region: one of more than `CROWD` classes is cut by its next value, what is still larger by the
one after, and classes that agree in all values by a hash, so that no task sorts more than about `CROWD` classes of a region.
In regions of at most `NEAR` + 1 classes all are compared; in larger ones a class meets, of the `NEAR` before it, those with the
longest common prefix, measured on the values, and the region's head; heads of cut regions meet the head of the whole. What is
left there is settled exactly once the first links are confirmed: of the classes in regions that still hold several components, those
whose shingles are too rarely found in any other of them can have no link and go (counted by Spark, `ROUNDS` times, since what
goes makes others rare); the others try their nearest of another component, `HOPS` times, and what is still apart is compared
where the rarest shingles of two classes meet, which every link must.

Links can only be lost in two places, both by chance of hashing: two sets at the threshold share no region with probability
(1 - s**4)**20 (4e-7 at s = 0.85, 3e-5 at 0.8), and a 120-bit sketch that is read before full sets drops a pair at the threshold
with probability 2.7e-6 (more than 24 of 120 bits off at 0.85; 6e-7 at 0.8). Most links have other ways through their group. All others are
confirmed on full sets, first one link per class (the most promising), then every remaining candidate between different
components. README states the recall measured against an exact join.

Defined results: null or blank text has an empty set, is linked with nothing and is its own component; with fewer words than
a shingle the whole sequence is the only shingle; a null doc_id has a null component_id and is kept; rows that share a
doc_id are one document; repeated rows share their result; of equal candidates the smaller id is tried first, which changes no
result; very long texts are read whole by one task; an empty table gives an empty table; columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Powers, find_words, gram_hashes, materialize, mix, prefix_sums, record_batch, shared_dir, span_hashes, text_slices, word_hashes

TREES, DEPTH, ROOT, NEAR, ROUNDS, HOPS = 20, 6, 4, 3, 2, 2
CROWD, DEVIATIONS = 2_000, 5.5
STAR = 256
KEY = ["did", "tkey"]


def shingle_sets(data, starts, words, pw):
    """Sorted distinct shingle hashes of each row of a slice."""
    lower = data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    first, last, row = find_words(lower, starts)
    hashes = word_hashes(lower, first, last, pw)
    prefix = prefix_sums(hashes, pw)
    grams = gram_hashes(prefix, words, pw)
    edge = np.searchsorted(row, np.arange(len(starts)))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield span_hashes(prefix, np.array([a]), np.array([b]), pw)
        else:
            yield hashes[:0]


SIGNED = "did long, tkey long, doc_id long, n_shingles long, node long, regions array<long>, rests array<long>, low long, high long"


def _sign(words):
    schema = pa.schema([(c, pa.int64()) for c in ("did", "tkey", "doc_id", "n_shingles", "node")] + [("regions", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64())])
    trees, depth, root = TREES, DEPTH, ROOT
    seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    times, plus = (seeds[: trees * depth] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[trees * depth :] >> np.uint64(32)).astype(np.uint32)

    def run(batches):
        pw = Powers()
        for batch in batches:
            did, tkey, doc = (batch.column(batch.schema.get_field_index(c)) for c in ("did", "tkey", "doc_id"))
            for at, end, data, starts in text_slices(batch):
                sets = list(shingle_sets(data, starts, words, pw))
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                node = np.zeros(len(sets), np.int64)
                regions, rests = np.zeros((len(sets), trees), np.int64), np.zeros((len(sets), trees), np.int64)
                low, high = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    cut = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    node[full] = mix(np.add.reduceat(mix(every ^ np.uint64(0x5BF03635)), cut) + size[full].astype(np.uint64)).view(np.int64)
                    short = (every >> np.uint64(32)).astype(np.uint32)
                    least = np.stack([np.minimum.reduceat(short * a + b, cut) for a, b in zip(times, plus, strict=True)], axis=1).astype(np.uint64)
                    by = least.reshape(len(full), trees, depth)
                    name = np.zeros((len(full), trees), np.uint64)
                    for j in range(root):
                        name = mix(name * np.uint64(31) + by[:, :, j] + np.uint64(j))
                    regions[full] = name.view(np.int64)
                    rests[full] = ((by[:, :, root] << np.uint64(32)) | by[:, :, root + 1]).view(np.int64)
                    bits = (mix(least) & np.uint64(1)).astype(np.int64)
                    half = bits.shape[1] // 2
                    weight = np.left_shift(np.int64(1), np.arange(half))
                    low[full], high[full] = bits[:, :half] @ weight, bits[:, half:] @ weight
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees), pa.array(x.ravel()))
                yield record_batch(schema, did.slice(at, end - at), tkey.slice(at, end - at), doc.slice(at, end - at), pa.array(size), pa.array(node, mask=size == 0), lists(regions), lists(rests), low, high)

    return run


def _confirm(words, percent):
    """Rows come sorted by star and salt, the centre first; yields the links that hold on full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        pw, star, centre = Powers(), None, None
        for batch in batches:
            hub, salt, node, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "salt", "node", "text"))
            out = []
            for key, b, t in zip(zip(hub, salt, strict=True), node, text, strict=True):
                data = np.frombuffer(t.encode(), np.uint8)
                own = next(shingle_sets(data, np.array([0, len(data)]), words, pw))
                if key != star:
                    star, centre = key, own
                else:
                    both = len(centre) + len(own)
                    # every set is distinct and sorted, so equal neighbours of the merged sets are shared shingles
                    if 100 * min(len(centre), len(own)) >= percent * max(len(centre), len(own)):
                        merged = np.concatenate((centre, own))
                        merged.sort(kind="stable")
                        shared = int((merged[1:] == merged[:-1]).sum())
                        if 100 * shared >= percent * (both - shared):
                            out.append((key[0], b))
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; stars of one class are salted, its text goes once to each salt."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    leaves = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("node"), F.lit(1).alias("leaf"))
    centres = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(0).alias("leaf"))
    rows = leaves.unionByName(centres).join(texts, "node")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "leaf").mapInArrow(_confirm(words, percent), "a long, b long")


def _tokens(words):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("token", pa.int64())])

    def run(batches):
        pw = Powers()
        for batch in batches:
            node = batch.column(batch.schema.get_field_index("node"))
            for at, _, data, starts in text_slices(batch):
                sets = list(shingle_sets(data, starts, words, pw))
                size = np.array([len(s) for s in sets])
                yield record_batch(schema, node.take(pa.array(np.repeat(np.arange(len(sets)), size) + at)), np.repeat(size, size), np.concatenate(sets).view(np.int64))

    return run


def without_lonely(tokens: DataFrame, percent: int) -> DataFrame:
    """tokens without the classes of which too few shingles occur in any other class: a link needs `percent` of them shared."""
    for _ in range(ROUNDS):
        # a token of one class alone tells the class by itself, so no join is needed to count them
        alone = tokens.groupBy("token").agg(F.count("*").alias("classes"), F.min(F.struct("node", "n")).alias("x")).where("classes = 1")
        lonely = alone.groupBy("x.node").agg(F.count("*").alias("own"), F.first("x.n").alias("n")).where((F.col("n") - F.col("own")) * 100 < F.col("n") * percent).select("node")
        tokens = tokens.join(materialize(lonely, "lonely"), "node", "left_anti")
    return materialize(tokens, "tokens")


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """node, n, token, place: of each class the rarest shingles, so many that two linked classes must share one of them.

    Sets of at least `percent` similarity share at least that part of each, so they agree somewhere in the first
    n - ceil(n * percent / 100) + 1 shingles of any common order; here the rarest come first, and those of one class alone
    take places but are left out.
    """
    shared = tokens.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
    order = Window.partitionBy("node").orderBy("classes", "token")
    ranked = tokens.join(shared, "token").withColumn("rank", F.row_number().over(order)).withColumn("held", F.count("*").over(Window.partitionBy("node")))
    ranked = ranked.withColumn("place", F.col("rank") + F.col("n") - F.col("held"))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("node", "n", "token", "place")


def cut_regions(each: DataFrame, crowd: int) -> DataFrame:
    """each with `sub`, the part of its region that one task sorts: deeper and deeper prefixes of crowded regions."""
    first = lambda x: F.shiftrightunsigned(x, 32)
    whole = each.groupBy("tree", "region").agg(F.count("*").alias("n4")).where(F.col("n4") > crowd)
    inside = each.join(whole, ["tree", "region"]).groupBy("tree", "region", "rest").agg(F.count("*").alias("n6"))
    fifth = inside.groupBy("tree", "region", first(F.col("rest")).alias("fifth")).agg(F.sum("n6").alias("n5"))
    depth = inside.withColumn("fifth", first(F.col("rest"))).join(fifth, ["tree", "region", "fifth"])
    depth = materialize(depth.select("tree", "region", "rest", "n5", "n6"), "depths")
    if depth.isEmpty():
        return each.withColumn("sub", F.col("region")).withColumn("cut", F.lit(False))
    parts = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n6") / crowd))
    sub = F.when(F.col("n5").isNull(), F.col("region")).when(F.col("n5") <= crowd, F.xxhash64("region", first(F.col("rest")))).otherwise(F.xxhash64("region", "rest", F.when(F.col("n6") > crowd, parts).otherwise(0)))
    return each.join(depth, ["tree", "region", "rest"], "left").withColumn("sub", sub).withColumn("cut", F.col("n5").isNotNull()).drop("n5", "n6")


def common_prefix(rest, other):
    """How many values two orders of one region share."""
    return ROOT + (F.shiftrightunsigned(rest, 32) == F.shiftrightunsigned(other, 32)).cast("int") + (rest == other).cast("int")


def mixed_regions(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members (tree, region, node, ...) of regions with more than one component, with their comp."""
    members = members.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = members.groupBy("tree", "region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tree", "region")
    return members.join(mixed, ["tree", "region"], "left_semi")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links (a, b, comp_a, comp_b): only the components that the links touch are walked."""
    small = components(links.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").withColumn("comp", F.col("node"))
    every = comps.unionByName(new).join(small.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return materialize(every.select("node", F.coalesce("to", "comp").alias("comp")), "comps")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its component's smallest node) for every node of the edges (a, b)."""
    shared_dir(edges.sparkSession)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")).checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("other"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "other").alias("comp"), F.col("comp").alias("was"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        step = step.join(up, "comp").select("node", F.least("comp", "above").alias("comp"), "was").checkpoint()
        if step.where("comp <> was").isEmpty():
            return step.select("node", "comp")
        labels = step.select("node", "comp")


def other_component(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends belong to different components."""
    pairs = pairs.drop("comp_a", "comp_b")
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), end, "left")
    return pairs.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))


def near_groups(docs: DataFrame, words: int = 3, percent: int = 85, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept and the row key (did, tkey)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("did"), F.xxhash64("text").alias("tkey"))
    signed = materialize(base.mapInArrow(_sign(words), SIGNED), "signed")
    classes = signed.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("lo"), F.min(F.struct(*KEY)).alias("at"), F.first("regions").alias("regions"), F.first("rests").alias("rests"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    apart = (100 - percent) / 200
    slack = int(TREES * DEPTH * apart + DEVIATIONS * (TREES * DEPTH * apart * (1 - apart)) ** 0.5)
    differ = lambda x: F.bit_count(F.col("low").bitwiseXOR(x["low"])) + F.bit_count(F.col("high").bitwiseXOR(x["high"]))
    each = classes.select("node", "low", "high", F.posexplode(F.arrays_zip("regions", "rests")).alias("tree", "x")).select("node", "low", "high", "tree", F.col("x.regions").alias("region"), F.col("x.rests").alias("rest"))
    each = cut_regions(each, crowd)
    order = Window.partitionBy("tree", "sub").orderBy("rest", "node")
    me = F.struct("node", "low", "high", "rest")
    placed = each.select("*", F.row_number().over(order).alias("place"), *(F.lag(me, i).over(order).alias(f"x{i}") for i in range(1, NEAR + 1)), F.first(me).over(order).alias("x0"))
    longest = F.greatest(*(F.coalesce(common_prefix(F.col("rest"), F.col(f"x{i}.rest")), F.lit(0)) for i in range(1, NEAR + 1)))
    before = [F.when((F.col("place") <= NEAR + 1) | (common_prefix(F.col("rest"), F.col(f"x{i}.rest")) == F.col("longest")), F.col(f"x{i}")) for i in range(1, NEAR + 1)]
    near = placed.where("place > 1").withColumn("longest", longest).select("node", "low", "high", F.explode(F.array(F.col("x0"), *before)).alias("x"))
    if not each.where("cut").isEmpty():
        heads = each.where("cut").groupBy("tree", "region", "sub").agg(F.min(F.struct("rest", "node", "low", "high")).alias("h"))
        whole = heads.groupBy("tree", "region").agg(F.min("h").alias("w"))
        near = near.unionByName(heads.join(whole, ["tree", "region"]).select("h.node", "h.low", "h.high", F.struct("w.node", "w.low", "w.high", "w.rest").alias("x")))
    near = near.where("x is not null and x.node <> node").withColumn("differ", differ(F.col("x"))).where(F.col("differ") <= slack)
    pairs = materialize(near.groupBy(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).agg(F.min("differ").alias("differ")), "pairs")
    large = placed.where((F.col("place") > NEAR + 1) | F.col("cut")).select("tree", "region").distinct().join(each, ["tree", "region"])
    large = materialize(large.select("tree", "region", "sub", "rest", "node", "low", "high"), "large")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    wanted = classes.join(needed, "node", "left_semi").select("node", "at.did", "at.tkey")
    texts = materialize(base.join(wanted.hint("shuffle_hash"), KEY).select("node", "text").dropDuplicates(["node"]), "texts")
    stars = pairs.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("x.a", "b")
    links = materialize(confirm(stars, texts, words, percent), "links")
    comps = components(links)
    tested = stars.select("a", "b")

    def settle(apart, comps, tested):
        """Confirm pairs of different components (a, b, comp_a, comp_b); (components, pairs tested) after that."""
        apart = materialize(apart.select("a", "b", "comp_a", "comp_b"), "rest")
        more = materialize(confirm(apart.select("a", "b"), texts, words, percent), "links")
        tested = tested.unionByName(apart.select("a", "b"))
        return (comps, tested) if more.isEmpty() else (joined(comps, more.join(apart, ["a", "b"])), tested)

    untested = lambda df: df.join(tested, ["a", "b"], "left_anti")
    best = lambda df, *more: df.groupBy("b").agg(F.min(F.struct("differ", "a", *more)).alias("x")).select("b", *(f"x.{c}" for c in ("a", *more)))
    couple = lambda df: df.where(differ(F.col("x")) <= slack).select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"), differ(F.col("x")).alias("differ"))
    apart = pairs
    for _ in range(HOPS):  # each class's most alike candidate of another component, and then all that are left
        apart = materialize(other_component(untested(apart), comps), "apart")
        comps, tested = settle(best(apart, "comp_a", "comp_b"), comps, tested)
    comps, tested = settle(other_component(untested(apart), comps), comps, tested)
    marked = materialize(mixed_regions(large, comps), "marked")
    known = texts.join(marked.select("node").distinct(), "node", "left_semi")
    tokens = without_lonely(materialize(known.mapInArrow(_tokens(words), "node long, n int, token long"), "tokens"), percent)
    marked = materialize(marked.join(tokens.select("node").distinct(), "node", "left_semi"), "marked")
    for _ in range(HOPS):
        # the nearest class before each in the order that belongs to another component; each class tries its most alike
        turn = mixed_regions(marked, comps).withColumn("x", F.when(F.lag("comp").over(order) != F.col("comp"), F.lag(me).over(order)))
        next_ = best(couple(turn.withColumn("x", F.last("x", ignorenulls=True).over(order)).where("x is not null")))
        comps, tested = settle(other_component(untested(next_), comps), comps, tested)
    nodes = mixed_regions(marked, comps).select("node", "comp", "low", "high").distinct()
    part = materialize(prefixes(tokens, percent).join(nodes, "node"), "prefixes")
    mate = part.select("token", F.struct("node", "low", "high").alias("x"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"))
    # where the first shingle that two classes share stands, no more than what follows it can be shared
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    alike = (F.col("comp") < F.col("other")) & (most * (100 + percent) >= percent * (F.col("n") + F.col("m"))) & (differ(F.col("x")) <= slack)
    last = couple(part.join(mate, (part.token == mate.token) & alike)).select("a", "b").distinct()
    comps, _ = settle(other_component(untested(last), comps), comps, tested)
    lows = comps.join(classes.select("node", "lo"), "node")
    group = lows.groupBy("comp").agg(F.min("lo").alias("component_id"))
    final = classes.select("node", "lo").join(comps.join(group, "comp").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "lo").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.select("doc_id", "n_shingles", "node", *KEY).join(final, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"), *KEY).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
