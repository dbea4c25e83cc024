"""Licences that no single line holds: wrapped texts, notices among other words, whole licence texts; brute force over windows."""

import random
import re
import textwrap

import pytest

from tracelake.llm import licenses

SCHEMA = "doc_id long, text string"
GPL = licenses.TEMPLATES["GPL-3.0"][1]


def found(spark, texts, **kw):
    out = {i: {} for i in range(len(texts))}
    for r in licenses.scan_texts(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **kw).collect():
        out[r["doc_id"]][r["license"]] = r
    return out


def test_wrapped_and_embedded_notices(spark):
    comment = "\n".join(" * " + x for x in textwrap.wrap(GPL, 60))
    texts = [
        f"/*\n * prog.c\n{comment}\n */\nint main() {{}}",
        "\n".join("// " + x for x in textwrap.wrap(licenses.TEMPLATES["BSD-3-Clause"][1], 40)),
        "Released under the MIT License. Copyright 2020 Jane Doe.",
        "one two three four five six seven eight Released under the MIT License.",
        "Here the work stands: Licensed under CC BY-NC 4.0. as told before by all of us",
        "the license under which this was published is not known to us",
    ]
    got = found(spark, texts)
    assert [next(iter(got[i])) for i in range(5)] == ["GPL-3.0", "BSD-3-Clause", "MIT", "MIT", "CC-BY-NC-4.0"]
    assert all(len(got[i]) == 1 and all(r["dice"] == 1 and r["n_lines"] == 0 for r in got[i].values()) for i in range(5)) and not got[5]
    assert got[3]["MIT"]["line"] == "released under the mit license"


def test_whole_licence_texts(spark):
    full = licenses.full_texts()
    names = sorted(full)
    got = found(spark, ["Copyright 2020 Jane Doe\n\n" + "\n".join(textwrap.wrap(full[n][0], 50)) + "\nthe end of it" for n in names])
    for i, n in enumerate(names):
        assert n in got[i] and got[i][n]["dice"] >= 0.99, (n, got[i])


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    templates = {"A": ["one two three four five"], "B": ["one two six three four seven two six eight"], "C": ["nine ten one two"]}
    vocabulary = "one two three four five six seven eight nine ten".split()
    forms = [t.split() for x in templates.values() for t in x]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = list(rng.choice(forms))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words += part + rng.choices(vocabulary, k=rng.randint(0, 3))
        texts.append(re.sub(" ", lambda _: rng.choice([" ", " ", "\n"]), " ".join(words)))  # noqa: B023
    want = set()
    for d, text in enumerate(texts):
        w = text.split()
        hits = []
        for name, (form,) in templates.items():
            f = form.split()
            grams = set(zip(f, f[1:]))
            for a in range(len(w) - 1):
                for b in range(a + 1, min(len(w), a + 1 + int((len(f) - 1) * 1.15 / 0.85))):
                    own = set(zip(w[a:b], w[a + 1 : b + 1]))
                    k = len(own & grams)
                    if 2 * k / (len(own) + len(grams)) >= 0.85 - 1e-12:
                        hits.append((name, a, b, k, round(2 * k / (len(own) + len(grams)), 6)))
        # whatever is a match of a licence with no better match around it must be found
        for name in templates:
            mine = [h for h in hits if h[0] == name]
            if mine:
                top = max(h[4] for h in mine)
                if any(h[4] == top and not any(o[0] != name and o[1] <= h[1] and o[2] >= h[2] and o[3] > h[3] for o in hits) for h in mine):
                    want.add((d, name, top))
    rows = licenses.windows(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates).collect()
    best = {}
    for r in rows:
        best[r["doc_id"], r["license"]] = max(best.get((r["doc_id"], r["license"]), 0), round(r["dice"], 6))
    assert len(want) > 40 and all(best.get((d, n)) == x for d, n, x in want)


def test_no_documents_and_no_templates(spark):
    assert licenses.scan_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert licenses.scan_texts(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).count() == 0
    assert licenses.scan_texts(spark.createDataFrame([(1, "a b c")], SCHEMA), templates={}).count() == 0
