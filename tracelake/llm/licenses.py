"""License scans: lines and word windows of a text against licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. Text and templates are normalised alike: lower case, runs of anything but letters, digits and dots
become one space, dots at a word's end go. A coefficient of at least `least` bounds the sizes: with t template bigrams, a line
has between t * least / (2 - least) and t * (2 - least) / least of them, so each line meets only the templates of its size and
lines of no template's size are dropped before any bigram is made. The same bound says how many of a template's bigrams a line
may lack, and so words of which it must have one: texts and lines without any of them go first. Templates are a fixed list, held
in the plan.

`scan` compares single lines. `scan_texts`, the query, adds the licences that are wrapped over lines or stand among other words:
windows of the whole normalised text, of any start and end that the size bound allows, against the same templates and the full
texts in `license_texts`. A window that lies within another licence's with more shared bigrams is the other's.

Defined results: null or empty text has no lines; a document has one row for each licence it matches, with its best line;
texts of one word have no bigrams and match nothing; rows that share a doc_id, repeated ones included, are one document; of
lines with equal coefficients the last by code point is shown; very long lines and texts are read whole by one task; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0-header": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Licensed under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under the Creative Commons CC0 1.0 Universal public domain dedication."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
LEAST = 0.85


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+", " "), r"\.(?= |$)", ""))


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def needed_words(forms: list[list[str]], least: float) -> list[str]:
    """Words of which every line at least `least` alike to one of the forms (word lists) holds one.

    At least t * least / (2 - least) of a form's t bigrams are in such a line; words that would take more than the rest of
    them away cannot all be missing.
    """
    chosen: list[str] = []
    for words in forms:
        grams = set(zip(words, words[1:], strict=False))
        spare, gone = len(grams) - len(grams) * least / (2 - least) + 1e-9, set()
        for w in sorted(set(words), key=lambda w: (w not in chosen, -len(w), w)):
            if len(gone) > spare:
                break
            gone |= {g for g in grams if w in g}
            if w not in chosen:
                chosen.append(w)
    return chosen


def holds_any(text: Column, words: list[str]) -> Column:
    # as a lambda's variable the text is lowered once, not once for each word
    return F.exists(F.array(text), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in words], F.lit(False)))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, n_lines, line: one row for each document and licence with a line at least `least` alike."""
    spark = docs.sparkSession
    forms = [(name, t) for name, texts in (TEMPLATES if templates is None else templates).items() for t in texts]
    known = spark.createDataFrame(forms, "license string, form string").select("license", F.split(normal(F.col("form")), " ").alias("words"))
    known = known.select("license", "words", bigrams(F.col("words")).alias("grams")).withColumn("t", F.size("grams")).where("t > 0")
    held = known.select("words", "t").collect()  # the fixed list of templates
    if not held:
        return docs.select(F.col("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_lines"), F.lit("").alias("line")).where("false")
    known, low, high = known.drop("words"), F.col("t") * least / (2 - least), F.col("t") * (2 - least) / least
    bounds = {"lo": min(r["t"] for r in held) * least / (2 - least), "hi": max(r["t"] for r in held) * (2 - least) / least}
    keys = needed_words([r["words"] for r in held], least)
    texts = docs.select("doc_id", "text").where(holds_any(F.lower("text"), keys))
    lines = texts.select("doc_id", F.explode(F.split("text", r"[\r\n]+")).alias("line")).where(holds_any(F.lower("line"), keys))
    # a line with fewer words than the smallest bound, or one too long in characters to hold few words, makes no bigrams;
    # repeated bigrams only lower the count, so no upper bound is laid on words here
    lines = lines.where(F.length("line") > 2 * bounds["lo"])
    lines = lines.withColumn("n", F.regexp_count("line", F.lit(r"[\p{L}\p{N}]+"))).where(F.col("n") > bounds["lo"])
    lines = lines.select("doc_id", "line", bigrams(F.split(normal(F.col("line")), " ")).alias("own")).withColumn("n", F.size("own")).where(F.col("n").between(bounds["lo"], bounds["hi"]))
    # by size: a template meets lines of each of the few sizes that its bounds allow
    sized = known.withColumn("n", F.explode(F.sequence(F.ceil(low).cast("int"), F.floor(high).cast("int"))))
    pairs = lines.join(F.broadcast(sized), "n")
    pairs = pairs.withColumn("dice", 2.0 * F.size(F.array_intersect("own", "grams")) / (F.col("n") + F.col("t"))).where(F.col("dice") >= least)
    best = pairs.groupBy("doc_id", "license").agg(F.max(F.struct("dice", "line")).alias("x"), F.count_distinct("line").alias("n_lines"))
    return best.select("doc_id", "license", F.round("x.dice", 6).alias("dice"), "n_lines", "x.line")


def full_texts() -> dict[str, list[str]]:
    """The licences whose whole text is a template of `scan_texts`, read on the driver."""
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def needed_frequent(forms: list[list[str]], least: float, without: tuple[str, ...] = ()) -> list[str]:
    """As needed_words, by the words that take most bigrams away, other than `without`: long texts have too many long words."""
    chosen: list[str] = []
    for words in forms:
        grams = set(zip(words, words[1:], strict=False))
        spare = len(grams) - len(grams) * least / (2 - least) + 1e-9
        held: dict[str, set] = {}
        for g in grams:
            for w in g:
                held.setdefault(w, set()).add(g)
        gone: set = set().union(*(held.get(w, ()) for w in chosen))
        left = Counter(w for g in grams - gone for w in set(g) if w not in without)
        while len(gone) <= spare:
            w = max(left, key=lambda w: (left[w] if len(w) > 5 else 0, left[w], w))  # noqa: B023
            chosen.append(w)
            left.subtract(x for g in held[w] - gone for x in set(g))
            gone |= held[w]
    return chosen


def windows(docs: DataFrame, templates: dict[str, list[str]], least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, line: the best window of words of each document for each licence, over the whole text."""
    spark = docs.sparkSession
    given = [(name, t) for name, texts in templates.items() for t in texts]
    rows = spark.createDataFrame(given, "license string, form string").select("license", F.split(normal(F.col("form")), " ").alias("words")).collect()
    forms = [(r["license"], r["words"], sorted(set(zip(r["words"], r["words"][1:], strict=False)))) for r in rows if len(r["words"]) > 1]
    long = {i: needed_frequent([w], least) for i, (_, w, g) in enumerate(forms) if len(g) >= 60}
    keys = list(dict.fromkeys(needed_words([w for i, (_, w, _) in enumerate(forms) if i not in long], least) + [w for i in long for w in long[i]]))
    listed = lambda grams: F.split(F.lit("\n".join(" ".join(g) for g in grams)), "\n")  # noqa: E731  one literal, folded once
    # a window has at most `most` bigrams, repeats included: the bound on sizes, for a template counted with its own repeats
    sizes = [(i, name, len(g), math.ceil(len(g) * least / (2 - least) - 1e-9), math.floor((len(w) - 1) * (2 - least) / least + 1e-9)) for i, (name, w, g) in enumerate(forms)]
    known = spark.createDataFrame(sizes, "form int, license string, t int, fewest int, most int")
    texts = docs.select("doc_id", "text").where(holds_any(F.lower("text"), keys))
    texts = texts.select("doc_id", F.xxhash64("text").alias("tkey"), F.split(normal(F.col("text")), " ").alias("words"))
    texts = texts.withColumn("grams", F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    texts = texts.withColumn("shared", F.array_intersect("grams", listed(sorted({g for i, (*_, gs) in enumerate(forms) if i not in long for g in gs}))))

    # the forms of which the text has enough bigrams, wherever they stand; a long one is only looked for where a word of each
    # of two disjoint sets stands, of which every match must have one
    def held(i):
        _, words, grams = forms[i]
        if i not in long:
            return F.array_intersect("shared", listed(grams))
        sets = long[i], needed_frequent([words], least, tuple(long[i]))
        return F.when(reduce(Column.__and__, [F.arrays_overlap("words", F.split(F.lit(" ".join(x)), " ")) for x in sets]), F.array_intersect("grams", listed(grams)))

    texts = texts.withColumn("own", F.array(*map(held, range(len(forms)))))
    least_of = F.split(F.lit(" ".join(str(x[3]) for x in sizes)), " ").cast("array<int>")
    fit = F.filter(F.transform("own", lambda x, i: F.struct(i.alias("form"), x.alias("held"))), lambda f: F.size(f["held"]) >= F.get(least_of, f["form"]))
    # explode_outer: from explode the planner derives a filter that would work everything out twice
    pairs = texts.select("doc_id", "tkey", "words", "grams", F.explode_outer(fit).alias("f")).where("f is not null").select("doc_id", "tkey", "words", "grams", "f.*")
    pairs = pairs.join(F.broadcast(known), "form")
    # where each bigram stood before, by sorting: a bigram counts once in a window, at its first place there
    pairs = pairs.withColumn("by_gram", F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    before = lambda s, j: F.when((j > 0) & (F.col("by_gram")[j - 1]["g"] == s["g"]), F.col("by_gram")[j - 1]["i"]).otherwise(F.lit(-1))
    places = F.sort_array(F.transform("by_gram", lambda s, j: F.struct(s["i"].alias("i"), before(s, j).alias("prev"), F.array_contains("held", s["g"]).alias("hit"))))
    pairs = pairs.withColumn("places", places)
    pairs = pairs.withColumn("hits", F.transform(F.filter("places", lambda p: p["hit"]), lambda p: p["i"]))
    starts = F.filter("hits", lambda a, j: (j + F.col("fewest") <= F.size("hits")) & (F.get(F.col("hits"), j + F.col("fewest") - 1) - a < F.col("most")))
    pairs = pairs.withColumn("starts", starts)

    def best_from(a):
        def step(s, p):
            first = p["prev"] < a
            n, k = s["n"] + first.cast("int"), s["k"] + (first & p["hit"]).cast("int")
            dice = 2.0 * k / (n + F.col("t"))
            better = p["hit"] & (dice > s["dice"])
            return F.struct(n.alias("n"), k.alias("k"), F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, p["i"]).otherwise(s["b"]).alias("b"), F.when(better, k).otherwise(s["m"]).alias("m"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0.0).alias("dice"), F.lit(-1).alias("b"), F.lit(0).alias("m"))
        return F.aggregate(F.slice("places", a + 1, F.col("most")), zero, step, lambda s: F.struct(a.alias("a"), s["b"].alias("b"), s["dice"].alias("dice"), s["m"].alias("m")))

    found = pairs.withColumn("all", F.filter(F.transform("starts", best_from), lambda x: x["dice"] >= least))
    # of the windows of one place the best
    at = lambda j, f: F.get(F.col("all"), j)[f]
    worse = lambda x, j: F.coalesce((at(j - 1, "b") >= x["a"]) & (at(j - 1, "dice") >= x["dice"]), F.lit(False)) | F.coalesce((at(j + 1, "a") <= x["b"]) & (at(j + 1, "dice") > x["dice"]), F.lit(False))
    found = found.withColumn("w", F.explode_outer(F.filter("all", lambda x, j: ~worse(x, j)))).where("w is not null")
    line = F.array_join(F.slice("words", F.col("w.a") + 1, F.col("w.b") - F.col("w.a") + 2), " ")
    found = found.select("doc_id", "tkey", "license", "w.*", line.alias("line"))
    # what stands within a window that shares more bigrams with another licence is that licence's
    whole = found.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("license", "a", "b", "dice", "m", "line")).alias("all"))
    inside = lambda x: F.exists("all", lambda y: (y["license"] != x["license"]) & (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & (y["m"] > x["m"]))
    return whole.select("doc_id", F.explode(F.filter("all", lambda x: ~inside(x))).alias("x")).select("doc_id", "x.license", "x.dice", "x.line")


def scan_texts(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of `scan`, and those of licences that only windows over the whole text find: n_lines 0, the window's words as line."""
    given = TEMPLATES if templates is None else templates
    lines = scan(docs, given, least).withColumn("by_line", F.lit(True))
    full = full_texts() if templates is None else {}
    every = {name: [*given.get(name, []), *full.get(name, [])] for name in [*given, *(n for n in full if n not in given)]}
    if not any(every.values()):
        return lines.drop("by_line")
    wide = windows(docs, every, least).select("doc_id", "license", F.round("dice", 6).alias("dice"), F.lit(0).cast("long").alias("n_lines"), "line", F.lit(False).alias("by_line"))
    both = lines.unionByName(wide).groupBy("doc_id", "license").agg(F.max(F.struct("by_line", "dice", "line", "n_lines")).alias("x"))
    return both.select("doc_id", "license", "x.dice", "x.n_lines", "x.line")


def oracle() -> str:
    """The same in SQL: normalised lines and templates, distinct bigrams, Dice, best line."""
    values = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, texts in TEMPLATES.items() for t in texts)
    return f"""
with forms(license, form) as (values {values}),
t0 as (select license, string_split(trim(regexp_replace(regexp_replace(lower(form), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.( |$)', '\\1', 'g')), ' ') as w from forms),
t as (select license, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as grams from t0),
lines as (select distinct doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) as line from documents),
l0 as (select doc_id, line, string_split(trim(regexp_replace(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.( |$)', '\\1', 'g')), ' ') as w from lines),
l as (select doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as own from l0),
d as (select doc_id, license, line, 2.0::double * len(list_intersect(own, grams)) / (len(own) + len(grams)) as dice from l, t
  where len(own) between len(grams) * {LEAST} / (2 - {LEAST}) and len(grams) * (2 - {LEAST}) / {LEAST})
select doc_id, license, round(max(dice), 6) as dice, count(distinct line)::bigint as n_lines, arg_max(line, (dice, line)) as line from d where dice >= {LEAST} group by doc_id, license
"""
