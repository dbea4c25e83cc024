"""Benchmark decontamination by the q-gram lemma and banded alignment.

Two strings within k edits share at least m + 1 - q - k * q of the m + 1 - q q-grams of the shorter, and all of them lie within
k diagonals of each other. Shared q-grams of a document and an item are counted in diagonal bands that overlap by half, so
every set of diagonals of that width lies in one band; bands under the lemma's bound are dropped, and the others are settled
by an alignment banded alike, which gives the edits of the best match. Items may lose `rate` of their characters (at least 1).

Texts are compared as letters in lower case (ASCII, and all letters of two bytes in UTF-8: accented Latin, Greek, Cyrillic and
others), digits and bytes of other scripts, with one space for any run of the rest.
The benchmark is a stated query set, read in blocks of at most `block_bytes` and held against all documents one block at a time:
with more than one, each block's result is written before the next is read, so that driver, plan and tasks never hold more than
one, however large the benchmark grows. It costs a scan of the documents for each block.

Defined results: null or empty texts and items match nothing; items shorter than 2 * q characters are matched exactly, as
whole words; a document has one row for each item it holds, at its best place (of equal ones the first), rows that share a
doc_id are one document and repeated rows each have theirs; a very long text is read whole by one task; without documents or
items there are no rows; other columns are ignored by `find` and kept by `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, byte_codes, gram_hashes, materialize, prefix_sums, text_slices

Q, RATE, BLOCK_BYTES, SLOTS = 12, 0.05, 4 << 20, 1 << 22


def classes() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def lower_pairs() -> np.ndarray:
    """Characters of two bytes, as one number each, to their lower case where that has two bytes as well."""
    t = np.arange(1 << 16, dtype=np.uint16)
    for code in range(0x80, 0x800):
        low = chr(code).lower().encode()
        if len(low) == 2:
            t[int.from_bytes(chr(code).encode(), "big")] = int.from_bytes(low, "big")
    return t


LOWER = lower_pairs()


def normalised(data: np.ndarray, starts: np.ndarray):
    """Normalised bytes with one space before and behind each row, the place each came from, and the rows' new starts."""
    n = len(starts) - 1
    table = classes()
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF))
    if len(lead):
        pair = LOWER[data[lead].astype(np.uint16) << np.uint16(8) | data[lead + 1]]
        data = data.copy()
        data[lead], data[lead + 1] = (pair >> np.uint16(8)).astype(np.uint8), (pair & np.uint16(255)).astype(np.uint8)
    # a space stands between rows: row i begins behind i + 1 of them
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(starts))
    at = np.arange(len(data)) + row + 1
    padded[at] = table[data]
    origin = np.zeros(len(padded), np.int64)
    origin[at] = np.arange(len(data))
    bounds = starts + np.arange(n + 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[bounds] = True
    new = np.cumsum(keep) - 1
    return padded[keep], origin[keep], new[bounds]


class Index:
    """A block of items: their q-gram hashes, sorted, with item and place; a table of slots tells most misses at once."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, rate: float):
        pw = Powers()
        self.ids, self.texts, self.q = [i for i, _ in items], [t for _, t in items], q
        self.edits = [0 if len(t) < 2 * q else max(1, int(rate * len(t))) for t in self.texts]
        hashes, item, place = [], [], []
        for i, t in enumerate(self.texts):
            h = gram_hashes(prefix_sums(byte_codes()[np.frombuffer(t, np.uint8)], pw), q, pw)
            hashes.append(h)
            item.append(np.full(len(h), i))
            place.append(np.arange(len(h)))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (item, place))
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(self.hashes % np.uint64(SLOTS)).astype(np.int64)] = True
        self.width = np.array([e + 1 for e in self.edits], np.int64)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.least = np.maximum(size + 1 - q - q * np.array(self.edits, np.int64), 1)


def banded(item: bytes, text: bytes, edits: int, low: int, high: int):
    """Least edits of item against any part of text that starts on the diagonals low..high; (edits, end) or None."""
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    diagonals = np.arange(low - edits, high + edits + 1)
    n, m, far = len(diagonals), len(b), len(a) + len(b)
    step = np.arange(n)
    row = np.where((diagonals >= 0) & (diagonals <= m), 0, far)
    for i, c in enumerate(a, 1):
        j = diagonals + i  # columns of this row
        inside = (j >= 1) & (j <= m)
        same = np.zeros(n, bool)
        same[inside] = b[j[inside] - 1] == c
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(np.where(j >= 0, new, far) - step) + step
        row = np.where((j >= 0) & (j <= m), new, far)
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return int(row[best]), int(diagonals[best] + len(a))


def matches(data: np.ndarray, starts: np.ndarray, index: Index, pw: Powers):
    """(row, item, edits, first byte, end byte) of the best match of each item in each row of a slice."""
    text, origin, bounds = normalised(data, starts)
    q = index.q
    grams = gram_hashes(prefix_sums(byte_codes()[text], pw), q, pw)
    maybe = np.flatnonzero(index.slots[(grams % np.uint64(SLOTS)).astype(np.int64)]) if len(index.hashes) else np.zeros(0, np.int64)
    lo, hi = (np.searchsorted(index.hashes, grams[maybe], side=s) for s in ("left", "right"))
    count = hi - lo
    maybe, lo, count = maybe[count > 0], lo[count > 0], count[count > 0]
    if not len(maybe):
        return []
    entry = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    place = np.repeat(maybe, count)
    item, diagonal = index.item[entry], place - index.place[entry]
    row = np.searchsorted(bounds, place, side="right") - 1
    band = diagonal // index.width[item]
    key = (row * len(index.texts) + item << 32) + band + (1 << 31)
    key, n = np.unique(np.concatenate((key, key - 1)), return_counts=True)
    pair, band = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
    enough = np.flatnonzero(n >= index.least[pair % len(index.texts)])
    found = zip((pair[enough] // len(index.texts)).tolist(), (pair[enough] % len(index.texts)).tolist(), band[enough].tolist(), strict=True)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    raw = text.tobytes()
    for r, i, b in found:
        if best.get((r, i), (1,))[0] == 0:
            continue
        t, k, w = index.texts[i], index.edits[i], int(index.width[i])
        lo, hi = max(int(bounds[r]), b * w - k), min(int(bounds[r + 1]) + 1, (b + 2) * w + len(t) + k)
        at = raw.find(t, lo, hi)
        if at >= 0:
            got = (0, at, at + len(t))
        else:
            aligned = banded(t, raw[lo:hi], k, b * w - lo, (b + 2) * w - 1 - lo) if k else None
            if aligned is None:
                continue
            got = (aligned[0], max(lo, lo + aligned[1] - len(t)), lo + aligned[1])
        if (r, i) not in best or got < best[r, i]:
            best[r, i] = got
    return [(r, i, k, int(origin[min(a + 1, len(origin) - 1)] - starts[r]), int(origin[max(b - 2, 0)] - starts[r]) + 1) for (r, i), (k, a, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark's items, normalised and padded with a space on both sides, in blocks of bounded size."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null and item_id is not null").orderBy("item_id", "text")
    for i, text in rows.toLocalIterator():
        data = np.frombuffer(text.encode(), np.uint8)
        own = b" " + normalised(data, np.array([0, len(data)]))[0].tobytes().strip() + b" "
        if len(own) < 3:
            continue
        if block and held + len(own) > block_bytes:
            yield block
            block, held = [], 0
        block.append((i, own))
        held += len(own)
    if block:
        yield block


def _find(items, q, rate):
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches):
        pw = Powers()
        # items too short for the lemma have a gram length of their own
        indexes = [Index([x for x in items if len(x[1]) >= 2 * q], q, rate)] + [Index([x for x in items if len(x[1]) == n], n, rate) for n in sorted({len(x[1]) for x in items if len(x[1]) < 2 * q})]
        for batch in batches:
            docs, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tkey"))
            for at, _, data, starts in text_slices(batch):
                out = [(r, index.ids[i], *rest) for index in indexes for r, i, *rest in matches(data, starts, index, pw)]
                if out:
                    row, item, edits, begin, end = zip(*out, strict=True)
                    take = pa.array([r + at for r in row])
                    yield pa.RecordBatch.from_arrays([docs.take(take).cast(pa.int64()), keys.take(take), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], schema=schema)

    return run


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, tkey, item_id, edits, begin, end (UTF-8 bytes): each document and item it holds, at its best place."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tkey")).where("text is not null")
    kind = "doc_id long, tkey long, item_id long, edits int, begin int, end int"
    out = None
    for block, last in _with_last(blocks(benchmark, block_bytes)):
        found = rows.mapInArrow(_find(block, q, rate), kind)
        found = found if last else materialize(found, "found")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], kind) if out is None else out


def _with_last(items):
    """Each item with whether it is the last one."""
    held = None
    for item in items:
        if held is not None:
            yield held, False
        held = item
    if held is not None:
        yield held, True


def _clean(items, q, rate, names):
    def run(batches):
        pw = Powers()
        indexes = [Index([y for y in items if len(y[1]) >= 2 * q], q, rate)] + [Index([y for y in items if len(y[1]) == n], n, rate) for n in sorted({len(y[1]) for y in items if len(y[1]) < 2 * q})]
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, _, data, starts in text_slices(batch):
                for index in indexes:
                    for r, *_ in matches(data, starts, index, pw):
                        keep[at + r] = False
            yield batch.filter(pa.array(keep)).select(names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold an item, one pass for each block of the benchmark."""
    for block, last in _with_last(blocks(benchmark, block_bytes)):
        docs = docs.mapInArrow(_clean(block, q, rate, docs.columns), docs.schema)
        docs = docs if last else materialize(docs, "clean")
    return docs
