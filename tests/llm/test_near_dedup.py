"""Near duplicates against all pairs, and the lemma behind the residual search."""

import itertools
import random
import re

import pytest

from tracelake.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, tkey string, n_shingles string"


def shingles(text, words):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, words, percent):
    sets = {}
    for d, t, *_ in rows:
        sets[d] = shingles(t, words)
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def corpus(seed, groups=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "漢", "A.b", "X"]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 60, 150]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "\n", " \t"]).join(x.upper() if rng.random() < 0.05 and x.isascii() else x for x in w))
    rows += [None, "", "  \n", "one", "One", "one two", rows[0], rows[0]]
    rng.shuffle(rows)
    return [(i + 5, t, "clash", "clash") for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,percent,crowd", [(3, 85, 2000), (5, 80, 2000), (3, 85, 5)])
@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_all_pairs(spark, seed, words, percent, crowd):
    rows = corpus(seed)
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), words, percent, crowd).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, words, percent)


@pytest.mark.parametrize("crowd", [2000, 20])
def test_large_region_of_near_copies(spark, crowd):
    """Many copies of one text, changed more or less: most regions are large, and some copies are linked with nothing."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(3000)}"
        rows.append((i, " ".join(w), "c", "c"))
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA), crowd=crowd).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = brute(rows, 3, 85)
    assert sorted(map(tuple, got)) == want and 1 < len({r[2] for r in want}) < 140


def test_crowded_regions_go_deeper(spark):
    rng = random.Random(3)
    rows = [(n, 0, 0, t, 7 if n < 300 else n, (rng.randrange(3) << 32) + rng.choice([1, 1, 1, 2])) for n in range(330) for t in (0, 1)]
    each = spark.createDataFrame(rows, "node long, low long, high long, tree int, region long, rest long")
    got = near_dedup.cut_regions(each, 25).collect()
    assert len(got) == len(rows) and all(r["sub"] == r["region"] and not r["cut"] for r in got if r["node"] >= 300)
    parts: dict = {}
    for r in got:
        if r["cut"]:
            parts.setdefault((r["tree"], r["sub"]), []).append(r["rest"])
    # of one part all agree in all values, or in the fifth where that was enough; none is much above the bound
    assert max(map(len, parts.values())) <= 45 and all(len({x >> 32 for x in p}) == 1 for p in parts.values())
    assert near_dedup.cut_regions(each, 1000).where("cut or sub <> region").isEmpty()


def test_common_prefix(spark):
    df = spark.createDataFrame([(5 << 32 | 3, 5 << 32 | 3), (5 << 32 | 3, 5 << 32 | 4), (5 << 32 | 3, 6 << 32 | 3), (-(1 << 40), -(1 << 40))], "a long, b long")
    assert [r[0] for r in df.select(near_dedup.common_prefix(df.a, df.b)).collect()] == [6, 5, 4, 6]


def test_very_long_and_very_frequent(spark):
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [(1, long, "c", "c"), (2, long + " tail", "c", "c"), (3, "a " * 50_000, "c", "c"), (4, "a " * 40_000, "c", "c"), (5, "b " * 100, "c", "c")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_prefixes_meet_for_every_link(spark):
    """Two sets at the threshold share a shingle of their prefixes, at places that leave room for what they share."""
    rng = random.Random(9)
    sets = []
    for _ in range(80):
        base = [rng.randrange(300) for _ in range(rng.randint(1, 40))] if not sets or rng.random() < 0.3 else list(rng.choice(sets))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.randrange(10**6)
        sets.append(sorted(set(base)))
    rows = [(i, len(s), t) for i, s in enumerate(sets) for t in s]
    got = near_dedup.prefixes(spark.createDataFrame(rows, "node long, n int, token long"), 80).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["token"], []).append(r)
    met = {frozenset((a["node"], b["node"])) for x in by.values() for a, b in itertools.combinations(x, 2) if (1 + min(a["n"] - a["place"], b["n"] - b["place"])) * 180 >= 80 * (a["n"] + b["n"])}
    links = {frozenset((a, b)) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert links and links <= met


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "c", "c"), (7, text, "c", "c"), (7, text, "c", "c"), (3, text, "c", "c"), (9, None, "c", "c")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, True), (7, 3, False), (7, 3, False), (3, 3, True), (9, 9, True)], key=str)


def test_empty_table(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
