"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept; all but the last return the columns of
documents, whatever else these hold. Rows that repeat share their fate; a null doc_id is never a duplicate; null and empty texts
go with language ID; empty tables give empty tables. `run` applies them to the table documents. SQL cannot express the learned stages, so ORACLE_SQL is None and the
tests hold the stages against brute force.
"""

from pyspark.sql import functions as F

from tracelake.llm import decontaminate, lang_id, mixing, near_dedup, secrets
from tracelake.llm.common import materialize, table


def language_id(spark, docs, sf_dir):
    """Drops documents without a letter and those that no learned language fits clearly better than an even share."""
    return lang_id.keep_known(docs, lang_id.learn(docs))


def near_duplicates(spark, docs, sf_dir):
    """Keeps the smallest doc_id of each group of documents linked at five-word shingles and similarity 0.8 or more."""
    kept = near_dedup.near_groups(docs, words=5, percent=80).where("kept").select(*near_dedup.KEY).distinct()
    kept = materialize(kept.toDF("did_", "tkey_"), "kept").hint("shuffle_hash")
    # columns by their frame, as documents may have any names of their own
    same = (F.xxhash64(docs["doc_id"]) == kept["did_"]) & (F.xxhash64(docs["text"]) == kept["tkey_"])
    return docs.join(kept, same, "left_semi")


def benchmark_decontamination(spark, docs, sf_dir):
    """Drops documents that hold an item of benchmark within five edits in a hundred characters."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """Masks every span in the text."""
    return secrets.mask(docs)


def mixing_sources(spark, docs, sf_dir):
    """The documents the mix takes, with their texts: size, target of the source, words taken and how often."""
    named = docs.select("doc_id", "source", "lang", "text", F.xxhash64("doc_id").alias("did"), F.xxhash64("text").alias("tkey"))
    mixed = mixing.mix(named, mixing.label_weights(table(spark, sf_dir, "labels")), extra=("did", "tkey"))
    plan = mixed.where("taken > 0").groupBy("did", "tkey").agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")))
    plan = plan.withColumn("copies", (F.col("taken") / F.col("size")).cast("int"))
    return named.join(materialize(plan, "plan").hint("shuffle_hash"), ["did", "tkey"]).select("doc_id", "source", "lang", "text", "size", "source_size", "target", "taken", "copies")


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("mixing", mixing_sources)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
