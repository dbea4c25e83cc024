"""Substring dedup over word windows by relative Lempel-Ziv parsing against blocks of the corpus.

The reference is the whole corpus, cut into content-defined blocks: of each `window`-word string the smallest `gram`-word hash
names its block, and a block holds the stretches of all documents whose windows it names. Equal windows are of the same block,
so a document is parsed against every block that can hold a part of it, and against no other.
In a block documents come by doc_id and are parsed against what stands there from smaller ones: at each place the window is
looked up in the block's index, and where it is found the factor is drawn on, word by word, as far as both agree. A factor of a
window or more is a duplicate span. Windows that cross a factor's end can belong to another factor, so parsing goes on from
the first of them. Then the document's windows that were not found join the index. Words decide, not hashes.
Blocks of more than `hot` stretches (a passage in very many documents) would be too much for a task: their windows are counted by
Spark under two independent hashes, the one step that rests on hashes.

Defined results: null or empty text has no words; rows with a null doc_id are neither removed from nor used as reference;
rows that share a doc_id count as one document, repeated rows included; ties do not arise, as only smaller doc_ids count; very
long texts are split into their stretches like any other; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, byte_codes, covered, find_words, gram_hashes, keyed, materialize, mix, prefix_sums, record_batch, sliding_min, span_hashes, text_slices, word_hashes

WINDOW = 50
GRAM = 25
# stretches in a block; an index entry takes about 150 bytes and a stretch has some 26 windows
HOT = 20_000


def block_names(data, starts, window, gram, pw):
    """Per window start of the slice: block name, window hash, row and word index in its row; only windows within a row."""
    first, last, row = find_words(data, starts)
    if len(first) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = prefix_sums(word_hashes(data, first, last, pw), pw)
    names = sliding_min(gram_hashes(prefix, gram, pw), window - gram + 1)
    whole = gram_hashes(prefix, window, pw)
    ok = np.flatnonzero(row[: len(names)] == row[window - 1 :])
    begin = np.searchsorted(row, np.arange(len(starts) - 1))
    return names[ok], whole[ok], row[ok], ok - begin[row[ok]]


def _index(window, gram):
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64())])

    def run(batches):
        pw = Powers()
        for batch in batches:
            ids, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tkey"))
            for at, _, data, starts in text_slices(batch):
                name, _, row, _ = block_names(data, starts, window, gram, pw)
                if not len(name):
                    continue
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
                take = pa.array(row[new] + at)
                yield record_batch(schema, pa.array(name[new].view(np.int64)), ids.take(take), keys.take(take))

    return run


STRETCHES = "block long, also long, doc_id long, tkey long, begin int, words binary"


def _stretches(window, gram):
    """The stretches of a document in its shared blocks; of hot blocks a row for each window under its two hashes, without words."""
    schema = pa.schema([("block", pa.int64()), ("also", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("begin", pa.int32()), ("words", pa.binary())])

    def run(batches):
        pw = Powers()
        for batch in batches:
            ids, keys, lists, hots = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tkey", "blocks", "hots"))
            for at, end, data, starts in text_slices(batch):
                first, last, row = find_words(data, starts)
                name, whole, of, word = block_names(data, starts, window, gram, pw)
                if not len(name):
                    continue
                name, whole, raw, out, hot_at = name.view(np.int64), whole.view(np.int64), data.tobytes(), [], []
                begin = np.searchsorted(row, np.arange(len(starts) - 1))
                edge = np.searchsorted(of, np.arange(end - at + 1))
                for i in range(end - at):
                    lo, hi = int(edge[i]), int(edge[i + 1])
                    if lo == hi or not lists[at + i].is_valid:
                        continue
                    own, hot = np.asarray(lists[at + i].values, np.int64), np.asarray(hots[at + i].values, bool)
                    order = np.argsort(own)
                    own, hot = own[order], hot[order]
                    cut = np.concatenate(([lo], np.flatnonzero(name[lo + 1 : hi] != name[lo : hi - 1]) + lo + 1, [hi]))
                    place = np.minimum(np.searchsorted(own, name[cut[:-1]]), len(own) - 1)
                    held = own[place] == name[cut[:-1]]
                    for j in np.flatnonzero(held & ~hot[place]).tolist():
                        a, b = int(cut[j]), int(cut[j + 1])
                        w = int(begin[i] + word[a])
                        out.append((int(name[a]), at + i, int(word[a]), raw[first[w] : last[w + (b - a) + window - 2]]))
                    hot_at += [np.arange(cut[j], cut[j + 1]) for j in np.flatnonzero(held & hot[place])]
                if out:
                    block, place, start, words = zip(*out, strict=True)
                    take = pa.array(place)
                    yield record_batch(schema, list(block), [0] * len(out), ids.take(take), keys.take(take), list(start), list(words))
                if hot_at:
                    hot_at = np.concatenate(hot_at)
                    hashes = span_hashes(prefix_sums(byte_codes()[data], pw), first, last, pw)
                    also = gram_hashes(prefix_sums(mix(hashes), pw), window, pw).view(np.int64)
                    # windows are numbered by their first word, those over two rows left out
                    also = also[begin[of[hot_at]] + word[hot_at]]
                    take = pa.array(of[hot_at] + at)
                    yield record_batch(schema, pa.array(whole[hot_at]), pa.array(also), ids.take(take), keys.take(take), pa.array(word[hot_at].astype(np.int32)), pa.nulls(len(hot_at), pa.binary()))

    return run


class Block:
    """Index of a block: its windows, and where each stands first. Documents must come by doc_id."""

    def __init__(self, window: int):
        self.window, self.index, self.known, self.doc, self.waiting = window, {}, {}, None, []

    def _place(self, words, p):
        """The slot of the window at p, and what stands there: windows that only share a hash have slots of their own."""
        own = words[p : p + self.window]
        slot = hash(tuple(own))
        while (found := self.index.get(slot)) is not None:
            if found[0][found[1] : found[1] + self.window] == own:
                return slot, found
            slot += 1
        return slot, None

    def parse(self, doc: int, raw: bytes) -> list[tuple[int, int]]:
        """Factors of a window or more of a stretch, as spans of words."""
        if doc != self.doc:
            for words, p in self.waiting:
                slot, found = self._place(words, p)
                if found is None:
                    self.index[slot] = (words, p)
            self.doc, self.waiting = doc, []
        if self.known.setdefault(raw, doc) < doc:  # the very bytes stand in a smaller document
            return [(0, len(raw.split()))]
        words, p, factors = raw.split(), 0, []
        while p + self.window <= len(words):
            _, found = self._place(words, p)
            if found is None:
                self.waiting.append((words, p))
                p += 1
                continue
            other, q = found
            n, most = self.window, min(len(words) - p, len(other) - q)
            while n < most and words[p + n] == other[q + n]:
                n += 1
            factors.append((p, p + n))
            p += n - self.window + 1  # windows across the factor's end
        return factors


def _parse(window):
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches):
        last, block = None, None
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "doc_id", "tkey", "begin", "words")]
            for name, doc, key, begin, raw in zip(*columns, strict=True):
                if name != last:
                    last, block = name, Block(window)
                out += [(doc, key, begin + a, begin + b) for a, b in block.parse(doc, raw)]
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def _cut(window):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, spans, copied in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "spans", "copied")), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if n >= window and copied.as_py():
                    words = []
                elif spans.is_valid and len(spans.values):
                    drop = covered(*(np.asarray(spans.values.field(i), np.int64) for i in (0, 1)), n)
                    words = [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
                kept = b" ".join(words)
                out.append((doc.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    key = ["doc_id", "tkey"]
    base = keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    named = base.where("doc_id is not null and text is not null")
    # a copy of a document with a smaller doc_id goes as a whole and is never parsed; blocks of one text alone need no look
    ids = named.select(*key, F.xxhash64(F.reverse("text")).alias("back"))
    firsts = ids.groupBy("tkey", "back").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("tkey", "back", "first")
    copies = materialize(ids.join(firsts, ["tkey", "back"]).where("doc_id > first").select(*key).distinct(), "copies")
    index = named.join(copies.hint("shuffle_hash"), key, "left_anti").mapInArrow(_index(window, gram), "block long, doc_id long, tkey long")
    shared = index.groupBy("block").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("block", (F.col("n") > hot).alias("hot"))
    lists = index.join(shared, "block").groupBy(*key).agg(F.collect_set(F.struct("block", "hot")).alias("own"))
    lists = materialize(lists.select(*key, F.col("own.block").alias("blocks"), F.col("own.hot").alias("hots")), "blocks")
    rows = named.join(lists.hint("shuffle_hash"), key).mapInArrow(_stretches(window, gram), STRETCHES)
    stretches = rows.where("words is not null").drop("also").repartition("block").sortWithinPartitions("block", "doc_id", "begin")
    spans = stretches.mapInArrow(_parse(window), "doc_id long, tkey long, begin int, end int")
    if not lists.where(F.exists("hots", lambda x: x)).isEmpty():
        windows = rows.where("words is null").drop("words")
        earliest = windows.groupBy("block", "also").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("block", "also", "lo")
        # written, so that the join below stands alone and Spark can split a window that very many documents share
        earliest = materialize(earliest, "earliest")
        later = windows.join(earliest, ["block", "also"]).where("doc_id > lo")
        spans = spans.unionByName(later.select(*key, "begin", (F.col("begin") + window).cast("int").alias("end")))
    found = spans.groupBy(*key).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    marks = found.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True)
    return base.join(materialize(marks, "spans").hint("shuffle_hash"), key, "left").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50),
h as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from p),
m as (select h, min(doc_id) as first from h group by h),
gone as (select distinct h.doc_id, unnest(range(h.i, h.i + 50)) as i from h join m using (h) where h.doc_id > m.first),
g as (select doc_id, list(i) as gone from gone group by doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(len(g.gone), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when g.gone is null then w.words else [w.words[j] for j in range(1, len(w.words) + 1) if not list_contains(g.gone, j)] end, ' '), '')) as kept_sha256
from w left join g using (doc_id)
"""
