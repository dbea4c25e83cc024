"""Benchmark decontamination against edit distances, and its bounds."""

import random
import re

import numpy as np
import pytest

from tracelake.llm import decontaminate

SCHEMA = "doc_id long, text string, tkey string, item_id string"


def plain(text):
    return " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())) + " "


def least_edits(item: bytes, text: bytes) -> int:
    """Sellers' algorithm: the least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], ["z"], [t[k], "q"]])
    return "".join(t)


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_edit_distance(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "Delta", "é", "omega", "漢字", "x1", "to"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 12, 25, 40]))) for i in range(12)] + [(20, None), (21, ""), (22, "!!")]
    docs = [(100, None), (101, ""), (102, say(300))]
    for d in range(40):
        k = rng.randrange(12)
        body = items[k][1]
        cut = edited(rng, body, rng.choice([0, 0, 1, 2, len(body) // 15]))
        docs.append((d, rng.choice([say(5) + "! ", ""]) + rng.choice([cut, cut.upper(), cut.replace(" ", " -- ")]) + rng.choice([" " + say(9), ""])))
    found = decontaminate.find(spark.createDataFrame([(d, t, "c", "c") for d, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found.collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            own = plain(x).encode()
            if len(own) > 2:
                k = 0 if len(own) < 24 else max(1, int(0.05 * len(own)))
                e = least_edits(own, plain(t).encode())
                if e <= k:
                    want[d, i] = e
    assert got == want and len({e for e in got.values()}) > 1


def test_places_are_bytes_of_the_text(spark):
    item = "Ein Satz über die Größe der Häuser, der lang genug ist."
    text = "漢字 vorher: EIN SATZ ÜBER DIE GRÖSSE".replace("SS", "ß") + " der Häuser; der lang genug ist! Danach."
    (row,) = decontaminate.find(spark.createDataFrame([(1, text, "c", "c")], SCHEMA), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert row["edits"] == 0 and text.encode()[row["begin"] : row["end"]].decode() == text[text.index("EIN") : text.index("!")]


def test_lemma_bound_never_drops_a_match():
    rng = random.Random(3)
    for _ in range(60):
        item = ("".join(rng.choice("abcd ") for _ in range(rng.randint(30, 120)))).strip() or "abc"
        own = decontaminate.normalised(np.frombuffer(item.encode(), np.uint8), np.array([0, len(item)]))[0].tobytes()
        own = b" " + own.strip() + b" "
        index = decontaminate.Index([(1, own)], 4, 0.05)
        text = (" ".join(["xx", edited(rng, item, rng.randint(0, 4)), "yy"])).encode()
        got = decontaminate.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]), index, decontaminate.Powers())
        e = least_edits(own, plain(text.decode()).encode())
        assert (len(got) == 1) == (e <= index.edits[0])


def test_contaminated_documents_go(spark):
    docs = spark.createDataFrame([(1, "so: the quick brown fox jumps over the lazy dog, twice", "c", "c"), (2, "clean text", "c", "c"), (3, None, "c", "c"), (1, "other text of the same id", "c", "c")], SCHEMA)
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, None)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(1, "other text of the same id"), (2, "clean text")] and kept.count() == 3
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == 4
    assert decontaminate.find(docs.where("false"), bench).count() == 0
