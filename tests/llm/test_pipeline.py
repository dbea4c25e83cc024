"""The corpus pipeline stage by stage on a small table with planted cases, and on an empty one."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from tracelake.llm import decontaminate, lang_id, secrets
from tracelake.llm.queries import ORACLES, QUERIES

BENCH = [(1, "which of these planets has the largest moon and why does it matter to the tides"), (2, None)]


def documents():
    rng = random.Random(6)
    lexicon = {"en": "the and of shall with from this that have been which would there".split(), "de": "über und für nicht der die das ein mit sich auf auch nach".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(lexicon[lang]) + rng.choice(["", "", "x", "ly", "en"]) for _ in range(rng.randint(20, 60))), lang, rng.choice(["web", "books", None]), 0))
    base = rows[3][1]
    rows += [(200, base, "en", "web", 0), (201, base.replace(" ", "  "), "en", "web", 0), (202, base + " tail", None, "web", 0)]
    rows += [(210, rows[5][1] + ". " + BENCH[0][1].upper() + "! " + rows[7][1], "en", "books", 0)]
    rows += [(220, " ".join(sorted(rows[9][1].split())) + " password = hunter22secret end", "en", "web", 0)]
    rows += [(230, None, "en", "web", None), (231, "", None, "web", 0), (232, "12 34 !!", None, None, 8), (233, rows[11][1] * 40, "en", "web", 0)]
    return [(d, t, x, s, None if t is None else len(t)) for d, t, x, s, _ in rows]


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("corpus"), documents())


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = corpus_pipeline.language_id(spark, docs, folder)
    assert known.columns == docs.columns
    kept = {r["doc_id"] for r in known.collect()}
    model = lang_id.learn(docs)
    told = {r["doc_id"] for r in lang_id.predict(docs, model).where("lang_pred <> 'und' and score >= 0.3").collect()}
    assert kept == told and not kept & {230, 231, 232} and len(kept) > 120

    unique = corpus_pipeline.near_duplicates(spark, known, folder)
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert unique.columns == docs.columns
    assert {r["doc_id"] for r in unique.collect()} == {d for d, _, _, first in brute(rows, 5, 80) if first}
    assert not {200, 201, 202} & {r["doc_id"] for r in unique.collect()}

    clean = corpus_pipeline.benchmark_decontamination(spark, unique, folder)
    assert {r["doc_id"] for r in unique.collect()} - {r["doc_id"] for r in clean.collect()} == {210}
    hits = decontaminate.find(unique, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    assert {r["doc_id"] for r in hits} == {210}

    masked = corpus_pipeline.secret_scans(spark, clean, folder)
    tools, field = secrets._compiled(), secrets.Field(secrets.train())
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (clean, masked))
    assert before.keys() == after.keys() and "hunter22secret" not in after[220] and "[SECRET] end" in after[220]
    for d, text in before.items():
        assert (after[d] != text) == bool(secrets.spans_of(text, field, *tools))

    mixed = corpus_pipeline.mixing_sources(spark, masked, folder).collect()
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] and r["text"] == after[r["doc_id"]] for r in mixed)


def test_other_columns_stay_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "concat('d', doc_id) did", "'t' tkey", "'s' size", "doc_id did_", "1 node", "'c' component_id", "true kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.where("did <> concat('d', doc_id) or tkey <> 't' or did_ <> doc_id").isEmpty(), name
    assert corpus_pipeline.mixing_sources(spark, docs, folder).count() > 0


def test_run_gives_what_its_stages_give(spark, folder):
    first = sorted((r["doc_id"], r["text"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect())
    again = sorted((r["doc_id"], r["text"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert first == again and first
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "mixing"]


def test_empty_tables(spark, tmp_path):
    path = write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
