"""Language ID by a byte convolutional network, trained in numpy.

Filters of several widths over one-hot bytes, max pooling over a window of fixed length, softmax. Every byte of every text
goes through the network: a text is cut into windows of `WINDOW` bytes (the last padded with 0), and a text's scores are its
windows' scores weighted by their bytes. Learning uses at most `per_lang` documents of each language (default 800, the
documented bound of the sample; windows evenly spread over the text, at most `WINDOWS_EACH` of each), chosen by a hash of the
doc_id; documents whose crc32(doc_id as text) mod 5 is 0, or whose doc_id is null, are never learned from.

Defined results: null text, or text without a letter, is `und` with score 0; where nothing can be learned, all is `und`; of equal
scores the language first by code point wins; repeated rows and equal texts have equal results; very long texts are read whole,
window by window; an empty table gives an empty table; other columns are ignored by `predict` and kept by `keep_known`, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, text_slices

WINDOW, WIDTHS, FILTERS, WINDOWS_EACH = 256, (2, 3, 4), 12, 4
ROWS = 64


def folded() -> np.ndarray:
    """Bytes as the network sees them: A-Z lower-cased, digits alike, white space alike."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[48:58] = 48
    t[[9, 10, 11, 12, 13]] = 32
    return t


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict:
    """Adam on cross-entropy. Only the byte under each maximum has a gradient, so a step touches few table rows."""
    rng = np.random.default_rng(seed)
    weights = {f"w{w}": rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    weights |= {"bias": np.zeros(FILTERS * len(WIDTHS), np.float32), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)).astype(np.float32), "out_bias": np.zeros(classes, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0
    table = folded()
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = table[windows[pick]]
            cut = rng.random(len(pick)) < 0.3  # short texts are seen too
            keep = np.where(cut, rng.integers(4, 96, len(pick)), WINDOW)
            x = np.where(np.arange(WINDOW)[None] < keep[:, None], x, 0)
            pooled, places = [], []
            for w in WIDTHS:
                y = sum(weights[f"w{w}"][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                places.append(y.argmax(axis=1))
                pooled.append(y.max(axis=1))
            z = np.concatenate(pooled, axis=1) + weights["bias"]
            h = np.maximum(z, 0)
            logits = h @ weights["out"] + weights["out_bias"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            back = (p @ weights["out"].T) * (z > 0)
            grads = {"out": h.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0)}
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(weights[f"w{w}"])
                d = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (x[np.arange(len(pick))[:, None], places[k] + j], np.arange(FILTERS)[None]), d)
                grads[f"w{w}"] = g
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return weights


def _tables(weights: dict):
    """Filters over byte pairs: one lookup serves the first two bytes of every width."""
    table = folded()
    pair = lambda a, b: (a[table][:, None] + b[table][None]).reshape(65536, -1)
    heads = np.concatenate([pair(weights[f"w{w}"][0], weights[f"w{w}"][1]) for w in WIDTHS], axis=1)
    return heads.astype(np.float32), weights["w3"][2][table].astype(np.float32), pair(weights["w4"][2], weights["w4"][3]).astype(np.float32)


def window_scores(x: np.ndarray, weights: dict, tables) -> np.ndarray:
    """Softmax scores of (n, WINDOW) bytes, in blocks that stay in the processor's cache."""
    heads, third, tail = tables
    f, out = FILTERS, np.empty((len(x), len(weights["out_bias"])), np.float32)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        pairs = part[:, :-1].astype(np.uint16) << np.uint16(8) | part[:, 1:]
        y = heads.take(pairs, axis=0)
        y[:, :-1, f : 2 * f] += third.take(part[:, 2:], axis=0)
        y[:, :-2, 2 * f :] += tail.take(pairs[:, 2:], axis=0)
        z = np.concatenate((y[:, :, :f].max(axis=1), y[:, :-1, f : 2 * f].max(axis=1), y[:, :-2, 2 * f :].max(axis=1)), axis=1) + weights["bias"]
        logits = np.maximum(z, 0) @ weights["out"] + weights["out_bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[at : at + ROWS] = p / p.sum(axis=1, keepdims=True)
    return out


def cut_windows(data: np.ndarray, starts: np.ndarray):
    """(windows, WINDOW) bytes padded with 0, the row of each and how many of its bytes are text."""
    size = np.diff(starts)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[:-1][row] + nth * WINDOW
    held = np.minimum(starts[1:][row] - begin, WINDOW)
    padded = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
    x = padded[begin[:, None] + np.arange(WINDOW)]
    x[np.arange(WINDOW)[None] >= held[:, None]] = 0
    return x, row, held


def _spread_windows(batches):
    schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("nth", pa.int32()), ("data", pa.binary())])
    for batch in batches:
        langs, orders = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, end, data, starts in text_slices(batch):
            out, raw = [], data.tobytes()
            for i in range(end - at):
                a, b = int(starts[i]), int(starts[i + 1])
                places = np.unique(np.linspace(0, max(0, b - a - WINDOW), WINDOWS_EACH).astype(int))
                out += [(langs[at + i], orders[at + i], k, raw[a + p : min(b, a + p + WINDOW)]) for k, p in enumerate(places.tolist())]
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, per_lang: int = 800) -> tuple[list[str], dict | None]:
    known = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], None
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_lang / n))])
    picked = known.withColumn("order", F.xxhash64("doc_id", F.lit(11))).where(F.pmod("order", F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000)
    rows = picked.select("lang", "order", "text").mapInArrow(_spread_windows, "lang string, order long, nth int, data binary").toPandas()
    rows = rows.sort_values(["lang", "order", "nth", "data"])
    rows = rows[rows.groupby("lang")["order"].rank(method="dense") <= per_lang]
    langs = sorted(counts)
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, data in enumerate(rows["data"]):
        windows[i, : len(data)] = np.frombuffer(data, np.uint8)
    return langs, train(windows, rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), len(langs))


def _predict(langs, weights):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tkey", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        tables = _tables(weights) if weights else None
        for batch in batches:
            doc, held, key, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "tkey", "text"))
            # ASCII letters settle nearly all texts; the rest is looked at letter by letter
            letter = pc.fill_null(pc.match_substring_regex(text.cast(pa.string()), "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
            for at, end, data, starts in text_slices(batch):
                n = end - at
                names, scores = ["und"] * n, np.zeros(n)
                if weights and len(data):
                    x, row, size = cut_windows(data, starts)
                    total = np.zeros((n, len(langs)))
                    np.add.at(total, row, window_scores(x, weights, tables) * size[:, None])
                    total /= np.maximum(np.diff(starts), 1)[:, None]
                    best = total.argmax(axis=1)
                    for i in range(n):
                        if starts[i + 1] > starts[i] and (letter[at + i] or any(map(str.isalpha, text[at + i].as_py()))):
                            names[i], scores[i] = langs[best[i]], min(1.0, float(total[i, best[i]]))
                yield record_batch(schema, doc.slice(at, n), held.slice(at, n), key.slice(at, n), names, scores)

    return run


def predict(docs: DataFrame, model: tuple[list[str], dict | None]) -> DataFrame:
    """One row per document: doc_id, held_out, tkey, lang_pred, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(*model), "doc_id long, held_out boolean, tkey long, lang_pred string, score double")


def _keep(langs, weights, schema, least):
    names = schema.names

    def run(batches):
        tables = _tables(weights) if weights else None
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            keep = np.zeros(batch.num_rows, bool)
            for at, end, data, starts in text_slices(batch):
                if not weights or not len(data):
                    continue
                x, row, size = cut_windows(data, starts)
                total = np.zeros((end - at, len(langs)))
                np.add.at(total, row, window_scores(x, weights, tables) * size[:, None])
                total /= np.maximum(np.diff(starts), 1)[:, None]
                for i in range(end - at):
                    keep[at + i] = starts[i + 1] > starts[i] and total[i].max() >= least and any(map(str.isalpha, text[at + i].as_py()))
            yield batch.filter(pa.array(keep)).select(names)

    return run


def keep_known(docs: DataFrame, model: tuple[list[str], dict | None], above: float = 1.2) -> DataFrame:
    """The documents whose language the model tells with a score of at least `above` times an even share, with all their columns.

    Scores are shares over the learned languages, so a text that none of them fits has a best score near 1 / their number. With
    one language learned, every text with a letter stays.
    """
    return docs.mapInArrow(_keep(*model, docs.schema, min(1.0, above / max(len(model[0]), 1))), docs.schema)
