"""Exact repeated byte strings, by threshold-bounded interval expansion on Burrows-Wheeler transforms of blocks.

One transform of a whole corpus cannot be built by many executors, so the corpus is dealt into blocks of bounded size that
cannot have a string of `length` bytes in common, and each block has a transform of its own (see bwt.py):
  1. of each `length`-byte string the smallest `gram` names its group, so equal strings are of the same group; groups of a
     single place go;
  2. the runs of strings that share their smallest gram travel once, with the bytes around them, to the group of that gram;
     within a group, equal runs are held once;
  3. groups are packed into blocks; backward extension on the block's transform, by increasing common prefix and stopping at
     `length`, tells which strings stand twice. It compares bytes: the hashes above only say where to look.
Groups of more than `hot` places (hundreds of thousands of equal passages, or texts of one short phrase) would make a block too
large for a task. In each of their runs the transform finds what the run itself repeats; over runs, Spark counts the strings by two
independent 64-bit hashes, the one step that rests on hashes.

Defined results: null text counts as empty; texts shorter than `length` lose nothing; copies of a whole text lose all of it
when it is long enough; rows with a null doc_id or the same doc_id take part like any other row; very long texts are read in
segments of `segment` string starts; an empty table gives an empty table; columns other than doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import SEP, repeated
from .common import Powers, byte_codes, covered, gram_hashes, materialize, mix, prefix_sums, record_batch, runs, sliding_max, sliding_min, text_slices

LENGTH = 400
GRAM = 100
# places in a group; a run has at most about 800 bytes for each, so a group stays under 4 MB and its transform under 300 MB
HOT = 4_000
BLOCK = 1 << 20
SEGMENT = 1 << 21
KEY = ["did", "tkey"]


def _pieces(batch, length, segment):
    """As text_slices, with the offset of the piece in its row: rows of many bytes come in segments that share length - 1 bytes."""
    for at, end, data, starts in text_slices(batch):
        if len(data) < length:
            continue
        if end - at > 1 or len(data) <= segment + length:
            yield at, end, data, starts, 0
            continue
        for offset in range(0, len(data) - length + 1, segment):
            piece = data[offset : offset + segment + length - 1]
            yield at, end, piece, np.array([0, len(piece)]), offset


def _valid(starts, n, length):
    """Which window starts lie wholly in one row."""
    ok = np.zeros(max(0, n - length + 1), bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    return ok


def _grams(data, length, gram, pw):
    g = gram_hashes(prefix_sums(byte_codes()[data], pw), gram, pw)
    return g, sliding_min(g, length - gram + 1)


def _sample(length, gram, segment):
    schema = pa.schema([("gram", pa.int64()), ("did", pa.int64()), ("tkey", pa.int64())])
    width = length - gram + 1

    def run(batches):
        pw = Powers()
        for batch in batches:
            docs, keys = (batch.column(batch.schema.get_field_index(c)) for c in KEY)
            for at, _, data, starts, _ in _pieces(batch, length, segment):
                g, least = _grams(data, length, gram, pw)
                least = np.where(_valid(starts, len(data), length), least, np.uint64(0))
                pad = np.zeros(width - 1, np.uint64)
                place = np.flatnonzero(g == sliding_max(np.concatenate((pad, least, pad)), width))
                take = pa.array(np.searchsorted(starts, place, side="right") - 1 + at)
                yield record_batch(schema, pa.array(g[place].view(np.int64)), docs.take(take), keys.take(take))

    return run


RUNS = "gram long, also long, did long, tkey long, begin int, count int, around binary"


def _hot_run(data: np.ndarray, whole: np.ndarray, also: np.ndarray, length: int):
    """(hash, second hash, begin or -1) of each string of a run, -1 where the run has it twice, and the stretches it has twice."""
    twice = repeated(np.append(data, np.uint8(SEP)), length)[: len(whole)]
    _, first = np.unique(whole, return_index=True)
    return [(int(whole[f]), int(also[f]), -1 if twice[f] else int(f)) for f in first], [(int(a), int(b)) for a, b in zip(*runs(twice), strict=True)]


def _spread(length, gram, segment):
    """Runs of strings under a repeated gram.

    A hot gram gives instead: for each string of its run a row under the string's hashes (count 0; begin -1 where the run has it
    twice), and the stretches of strings that the run has twice (count below 0).
    """
    schema = pa.schema([("gram", pa.int64()), ("also", pa.int64()), ("did", pa.int64()), ("tkey", pa.int64()), ("begin", pa.int32()), ("count", pa.int32()), ("around", pa.binary())])

    def run(batches):
        pw = Powers()
        for batch in batches:
            docs, keys, lists, hots = (batch.column(batch.schema.get_field_index(c)) for c in (*KEY, "grams", "hots"))
            for at, end, data, starts, offset in _pieces(batch, length, segment):
                least = _grams(data, length, gram, pw)[1].view(np.int64)
                out, hashes, raw = [], None, data.tobytes()
                for i in range(end - at):
                    a, b = int(starts[i]), int(starts[i + 1]) - length + 1
                    if b <= a or not lists[at + i].is_valid:
                        continue
                    own, hot = np.asarray(lists[at + i].values, np.int64), np.asarray(hots[at + i].values, bool)
                    name = least[a:b]
                    cut = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1, [len(name)]))
                    order = np.argsort(own)
                    own, hot = own[order], hot[order]
                    heads = name[cut[:-1]]
                    found = np.minimum(np.searchsorted(own, heads), len(own) - 1)
                    for j in np.flatnonzero(own[found] == heads):
                        lo, hi = int(cut[j]), int(cut[j + 1])
                        if hot[found[j]]:
                            if hashes is None:
                                hashes = [gram_hashes(prefix_sums(c[data], pw), length, pw).view(np.int64) for c in (byte_codes(), mix(byte_codes()))]
                            single, double = _hot_run(data[a + lo : a + hi + length - 1], *(h[a + lo : a + hi] for h in hashes), length)
                            out += [(h, k, at + i, offset + lo + d if d >= 0 else -1, 0, None) for h, k, d in single]
                            out += [(0, 0, at + i, offset + lo + b, b - e, None) for b, e in double]
                        else:
                            out.append((int(heads[j]), 0, at + i, offset + lo, hi - lo, raw[a + lo : a + hi + length - 1]))
                if out:
                    name, also, row, begin, count, around = zip(*out, strict=True)
                    take = pa.array(row)
                    yield record_batch(schema, list(name), list(also), docs.take(take), keys.take(take), list(begin), list(count), list(around))

    return run


def _expand(length):
    """Strings that stand twice or more in the block of their group, as spans of string starts."""
    schema = pa.schema([("did", pa.int64()), ("tkey", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def settle(block):
        """Spans of a block: a list of groups, each a dict of places by their bytes."""
        # bytes that stand alone in their group, at several places, are settled by that
        texts = [around for group in block if len(group) > 1 or len(next(iter(group.values()))) == 1 for around in group]
        data = np.frombuffer(b"".join(x + bytes([SEP]) for x in texts), np.uint8)
        twice, at, found = repeated(data, length), 0, {}
        for around in texts:
            found[around] = twice[at : at + len(around) - length + 1]
            at += len(around) + 1
        for group in block:
            for around, places in group.items():
                n = len(around) - length + 1
                # places of equal bytes settle all their strings at once
                spans = [(0, n)] if len(places) > 1 else zip(*runs(found[around]), strict=True) if around in found else ()
                for lo, hi in spans:
                    for did, key, begin in places:
                        yield did, key, begin + int(lo), begin + int(hi)

    def run(batches):
        last, group, block, held, out = None, {}, [], 0, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "begin", "did", "tkey", "around")]
            for name, begin, doc, key, around in zip(*columns, strict=True):
                if name != last:
                    if held >= BLOCK:
                        out += settle(block)
                        block, held = [], 0
                    last, group = name, {}
                    block.append(group)
                if around not in group:
                    group[around] = []
                    held += len(around)
                group[around].append((doc, key, begin))
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))
                out = []
        out += settle(block)
        if out:
            yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def _cut(length):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, copied, spans in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "copied", "spans")), strict=True):
                data = (text.as_py() or "").encode()
                n, places = len(data), []
                if n >= length and copied.as_py():
                    places = [(0, n)]
                elif spans.is_valid and len(spans.values):
                    flat = spans.values
                    begin, end = (np.asarray(flat.field(i), np.int64) for i in (0, 1))
                    places = [(int(a), int(b)) for a, b in zip(*runs(covered(begin, end - 1 + length, n)), strict=True)]
                kept, at = [], 0
                for a, b in places:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc.as_py(), n, n - len(kept), len(places), hashlib.sha256(kept).hexdigest(), [x for p in places for x in p]))
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def cut_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets: start, end, ...)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("did"), F.xxhash64("text").alias("tkey"))
    ids = base.where("text is not null").select(*KEY, "doc_id", F.xxhash64(F.reverse("text")).alias("back"))
    classes = ids.groupBy("tkey", "back").agg(F.count("*").alias("n"), F.min("did").alias("first")).where("n > 1")
    copies = materialize(ids.join(classes, ["tkey", "back"]).select(*KEY, (F.col("did") == F.col("first")).alias("stands")).distinct(), "copies")
    # one document stands for all copies of a text
    texts = base.where(F.length("text") > 0).join(copies.where("not stands").hint("shuffle_hash"), KEY, "left_anti")
    sample = texts.mapInArrow(_sample(length, gram, segment), "gram long, did long, tkey long")
    shared = sample.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > hot).alias("hot"))
    pairs = sample.dropDuplicates(["gram", *KEY]).join(shared, "gram")
    lists = materialize(pairs.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "hot")).alias("own")).select(*KEY, F.col("own.gram").alias("grams"), F.col("own.hot").alias("hots")), "grams")
    spread = base.join(lists.hint("shuffle_hash"), KEY).mapInArrow(_spread(length, gram, segment), RUNS)
    any_hot = not lists.where(F.exists("hots", lambda x: x)).isEmpty()
    if any_hot:  # three branches read it
        spread = materialize(spread, "runs")
    cold = spread.where("count > 0")
    spans = cold.repartition("gram").sortWithinPartitions("gram").select("gram", "begin", *KEY, "around").mapInArrow(_expand(length), "did long, tkey long, begin int, end int")
    if any_hot:
        strings = ["gram", "also"]
        single = spread.where("count = 0").select(*strings, *KEY, "begin")
        again = single.groupBy(*strings).agg(F.sum(F.when(F.col("begin") < 0, 2).otherwise(1)).alias("n")).where("n > 1").select(*strings)
        spans = spans.unionByName(single.where("begin >= 0").join(again, strings).select(*KEY, "begin", (F.col("begin") + 1).alias("end")))
        spans = spans.unionByName(spread.where("count < 0").select(*KEY, "begin", (F.col("begin") - F.col("count")).cast("int").alias("end")))
    found = spans.groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    marks = found.withColumn("copied", F.lit(False)).unionByName(copies.select(*KEY, F.lit(True).alias("copied")), allowMissingColumns=True)
    marks = materialize(marks.groupBy(*KEY).agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("copied").alias("copied")), "marks")
    return base.join(marks.hint("shuffle_hash"), KEY, "left").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
