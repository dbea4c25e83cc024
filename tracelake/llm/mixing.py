"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target holds whole epochs of it and a fraction of one. Every document is taken once for each epoch; for the
fraction, documents stand in the order of exponential keys -ln(u) / weight, which draws them without replacement in
proportion to their weights, and are taken while the sum of sizes before them plus half their own stays within the budget.
u comes from a digest of the doc_id, so reruns agree.

The prefix sums of a hot source never meet in one task: keys fall into buckets of about `per_bucket` documents, buckets are
summed first, and only those sums are ordered within a source.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, the last; a null doc_id draws like
the text "null"; a missing weight counts as 1; rows that repeat take separately; ties of keys are ordered by doc_id and size;
sizes count words of whole texts, however long; an empty table gives an empty table; other columns are ignored, whatever
their names. The table of sources is assumed small (one row per source meets in one task), as are the sums of a source's
buckets (one row for about `per_bucket` documents). Rows of one doc_id draw the same key and meet in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORDS = r"[^\x20\x09-\x0D]+"
PATTERN = (3.0, 1.0, 2.0)


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, documents and target: weights by position, none above `most` times its source's size.

    Reshare by weight until none is above: the level L solves sum(min(cap, L * weight)) = share * total, and the sources that
    reach their cap first are those with the smallest cap / weight. Past the first source that is not full, L only falls.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    weight = F.element_at(F.array(*map(F.lit, PATTERN)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(PATTERN) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).over(every))
    return ranked.select("source", "source_size", "documents", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def draw_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return -F.log(u) / weight


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = 7, per_bucket: int = 4096, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken and the `extra` columns; weights: doc_id, weight."""
    sized = docs.select("doc_id", "source", *extra, F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    if weights is not None:
        sized = sized.join(weights.select("doc_id", "weight"), "doc_id", "left")
    value = F.coalesce("weight", F.lit(1.0)) if weights is not None else F.lit(1.0)
    sized = sized.select("doc_id", "source", *extra, "size", draw_key(F.col("doc_id"), value, seed).alias("key"))
    sized = materialize(sized, "sized")
    plan = targets(sized, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # equal nulls, so a null source meets its own plan; one row per source, so AQE splits a hot source without copying much
    joined = sized.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.ceil(F.col("documents") / per_bucket)))
    sums = joined.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    joined = joined.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).drop("of", "at")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    part = (F.col("ahead") + inside - F.col("size") / 2.0) <= F.col("rest")
    taken = F.col("size") * (F.col("epochs") + F.when(part, 1).otherwise(0))
    return joined.select("doc_id", "source", *extra, "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight: 2 for quality 1, 0.5 for quality 0; the best label of a document counts, none leaves weight 1."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


ORACLE = r"""
with sized as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    case l.quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as weight
  from documents d left join (select doc_id, max(quality) as quality from labels where doc_id is not null group by 1) l on d.doc_id = l.doc_id),
keyed as (select *, -ln((('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 1) / 281474976710656.0::double) / weight as k from sized),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from keyed group by source),
weighed as (select *, case (r - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2.0::double * source_size as cap from sources),
levels as (select *, cap / w as full_at, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as lvl from weighed),
level as (select max(lvl) as lvl from levels where full_at >= lvl),
plan as (select s.source, s.source_size, least(s.cap, coalesce(level.lvl * s.w, s.cap)) as target from levels s, level),
cut as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from plan),
summed as (select k.doc_id, k.size, c.source_size, c.target, c.epochs, c.target - c.epochs * c.source_size as rest,
    sum(k.size) over (partition by k.source order by k.k, k.doc_id, k.size rows between unbounded preceding and current row) as upto
  from keyed k join cut c on k.source is not distinct from c.source)
select doc_id, size, source_size, target, (size * (epochs + case when upto - size / 2.0::double <= rest then 1 else 0 end))::bigint as taken from summed
"""
