"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelake.llm import bwt, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, tkey string, did string"


def corpus(seed: int, unit: str = " "):
    """Texts with shared passages, copies, nulls, empty texts, periodic texts and scripts of several bytes a letter."""
    rng = random.Random(seed)
    words = ["ab", "cde", "f", "ghij", "é", "漢字", "kl-m", "no.", "p", "qrs"]
    say = lambda n: unit.join(rng.choice(words) for _ in range(n))
    passages = [say(n) for n in (30, 55, 80, 140)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else say(rng.randint(0, 60)))
        rows.append(rng.choice(["\n", " ", "\t  "]).join(parts))
    rows += [None, "", " ", "ab " * 300, "ab " * 170 + say(30), "x" * 900, "x" * 300, rows[3], rows[3], passages[3]]
    return [(i + 1 if i % 13 else 10**9 + i, t, "clash", "clash") for i, t in enumerate(rows)]


def brute_words(rows, window):
    words = {d: WORD.findall(t or "") for d, t, *_ in rows}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(rows, length):
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen: dict[bytes, int] = {}
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows_agree_with_brute_force(spark, seed, hot):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=hot).collect()}
    assert got == brute_words(rows, 50)
    assert any(0 < n < total for total, n, _ in got.values())


def test_factors_are_greedy_and_go_on_across_their_ends():
    block = substring_dedup.Block(4)
    say = lambda s: " ".join(s).encode()
    assert block.parse(1, say("abcdefgh")) == [] and block.parse(1, say("cdefxyz")) == []  # one document is no reference for itself
    assert block.parse(2, say("bcdefxyzq")) == [(0, 5), (2, 8)]  # bcdef of one stretch, then defxyz of the other
    assert block.parse(3, say("abcdefgh")) == [(0, 8)] and block.parse(3, b"") == []
    assert block.parse(4, b"a\tb\n c  d") == [(0, 4)]


def test_windows_of_one_hash_are_told_apart():
    class Same(bytes):
        def __hash__(self):
            return 7

    block = substring_dedup.Block(2)
    words = lambda s: [Same(c.encode()) for c in s]
    for p, w in ((0, words("ab")), (0, words("cd"))):
        slot, found = block._place(w, p)
        assert found is None
        block.index[slot] = (w, p)
    assert block._place(words("cd"), 0)[1] is not None and block._place(words("ad"), 0)[1] is None


@pytest.mark.parametrize("hot", [3, 60_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_byte_strings_agree_with_brute_force(spark, seed, hot):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in suffix_dedup.cut_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), length=60, gram=12, hot=hot).drop("spans").collect())
    assert got == brute_bytes(rows, 60)


@pytest.mark.parametrize("hot", [3, 4_000])
def test_long_texts_in_segments(spark, hot):
    long = " ".join(t for _, t, *_ in corpus(7) if t)
    rows = [*corpus(7), (500, long * 25, "clash", "clash")]
    assert len(rows[-1][1]) > 1 << 18
    got = sorted(tuple(r) for r in suffix_dedup.cut_repeated_bytes(spark.createDataFrame(rows, SCHEMA), length=60, gram=12, hot=hot, segment=997).drop("spans").collect())
    assert got == brute_bytes(rows, 60)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh\0"])
def test_transform_tells_repeats_of_a_block(letters):
    rng = random.Random(letters)
    for _ in range(40):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))).encode() for _ in range(rng.randint(1, 6))]
        length = rng.choice([1, 2, 3, 8, 9, 17, 50])
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [flag for t in texts for flag in [seen[t[i : i + length]] > 1 if i + length <= len(t) else False for i in range(len(t))] + [False]]
        assert bwt.repeated(np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8), length).tolist() == want


def test_transform_tells_common_prefixes_by_value():
    data = np.frombuffer(b"banana\xffananas\xff", np.uint8)
    raw = data.tobytes()
    for length in range(1, 7):
        order, agree = bwt.untold(data, length)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] : order[k - 1] + length], raw[order[k] : order[k] + length]
            if b"\xff" not in a + b:
                assert agree[k] == (a == b)


def test_default_length(spark):
    rows = corpus(5)
    got = sorted(tuple(r) for r in suffix_dedup.cut_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).drop("spans").collect())
    assert got == brute_bytes(rows, 400)


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "a", "b"), (1, text, "a", "b"), (1, text, "a", "b"), (2, text + " tail", "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    words = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.cut_repeats(df).collect()]
    assert sorted(words, key=str) == sorted([(None, 0), (1, 0), (1, 0), (2, 60)], key=str)
    bytes_ = suffix_dedup.cut_repeated_bytes(df, length=50, gram=10).collect()
    assert all(r["n_removed"] == len(text) for r in bytes_)


@pytest.mark.parametrize("f", [substring_dedup.cut_repeats, suffix_dedup.cut_repeated_bytes])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
