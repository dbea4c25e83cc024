"""The subpackage's queries and their SQL twins, by name."""

from __future__ import annotations

from . import decontaminate, html_text, lang_id, licenses, media, mixing, near_dedup, secrets, substring_dedup, suffix_dedup
from .common import table


def op1_secret_scans(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.learn(docs)).drop("tkey")


def op3_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.cut_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.cut_repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_html_extraction(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


def op9_media_columns(spark, sf_dir):
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_license_scans(spark, sf_dir):
    return licenses.scan_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_language_id, op3_mixing, op4_substring_dedup, op5_suffix_dedup, op6_near_dedup, op7_html_extraction, op8_decontamination, op9_media_columns, op10_license_scans)}
ORACLES = {"op3_mixing": mixing.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op10_license_scans": licenses.oracle()}
