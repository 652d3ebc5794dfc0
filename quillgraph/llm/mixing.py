"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words: shares follow the weights, a target stops at
`max_epochs` times the source's size, and the excess goes to the others by weight. A target
of e.g. 2.3 sizes takes every document twice (complete epochs), and for the rest takes
documents in order of an exponential key -ln(u) / quality until the budget is used up, so a
document of twice the quality comes up twice as fast. u is a hash of doc_id and text, so rows that share an id, or
have none, are spread too. Quality is lower the more of a text is markup, digits and symbols. The last document reached counts with
the words that still fit.

The order within a source is never sorted as a whole: keys fall into `BINS` ranges, words are
summed by (source, range) with partial aggregation, and only documents of the one range in
which a source's budget ends (one of 65,536) are sorted. A source with a third of all rows is spread over all
tasks.

Null texts have size 0 and are never taken; null sources form one source, ranked last; an
empty table gives an empty result; repeated rows are separate documents (equal ones are
interchangeable); ties of keys are ordered by doc_id, text and size; extra columns are kept, but for those of our results' names.
Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import REST, WORD, packed, stored, table, uniform

#: Ranges of keys in each source; a budget ends in one of them, and only that one is sorted.
BINS = 1 << 16
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Characters that lower a document's quality weight.
NOISE = "#*$%&|<>{}[]~^=_\\@0123456789"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), a row for each source: also its target.

    With caps c = max_epochs * size, the targets are min(c, x * weight) for the x at which they
    add up to the total. That sum is concave in x, the lower bound of its linear pieces, so x is
    the largest solution of any piece: those with the sources of the lowest c / weight capped.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.get(w, F.col("_k") % len(weights))).withColumn("_c", max_epochs * F.col("source_size"))
    low = W.orderBy(F.col("_c") / F.col("_w"), "_k").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(F.col("_c") / F.col("_w"), "_k").rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    pieces = ranked.withColumn("_x", (F.sum("source_size").over(every) - F.coalesce(F.sum("_c").over(low), F.lit(0))) / F.sum("_w").over(rest))
    out = pieces.withColumn("_x", F.max("_x").over(every))
    return out.select("source", "source_size", F.round(F.least(F.col("_c").cast("double"), F.col("_x") * F.col("_w")), 6).alias("target"))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """docs with _size (words), _key (exponential, by quality) and _bin (its range)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    quality = 0.25 + 0.75 * F.length(F.translate(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    key = -F.ln(uniform("doc_id", F.md5(text), seed=seed)) / quality
    out = docs.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_key", key)
    return out.withColumn("_bin", F.floor((1 - F.exp(-F.col("_key"))) * BINS).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and taken."""
    ours = ("size", "source_size", "target", "taken")
    names = [c for c in docs.columns if c.lower() not in ours]
    rows = measured(packed(docs.select(*names), "doc_id", "text", "source"), seed)
    bins = stored(rows.groupBy("source", "_bin").agg(F.sum("_size").alias("_words")))
    aims = targets(bins.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    whole = F.round("target").cast("long")
    aims = aims.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    aims = aims.withColumn("_budget", whole - F.col("_epochs") * F.col("source_size"))
    ends = bins.withColumn("_upto", F.sum("_words").over(W.partitionBy("source").orderBy("_bin")))
    ends = ends.withColumnRenamed("source", "_s").join(aims, F.col("_s").eqNullSafe(F.col("source"))).where(F.col("_upto") <= F.col("_budget"))
    ends = ends.groupBy("source").agg(F.max("_bin").alias("_last"), F.sum("_words").alias("_before"))
    plan = aims.withColumnRenamed("source", "_s").join(ends, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
    # The first range with words that doesn't fit wholly; ranges before it are taken, those after it not.
    edge = bins.withColumnRenamed("source", "_e").join(plan, F.col("_s").eqNullSafe(F.col("_e"))).where(F.col("_bin") > F.coalesce("_last", F.lit(-1)))
    edge = edge.groupBy("_e").agg(F.min("_bin").alias("_edge"))
    plan = stored(plan.join(edge, F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e", "_last"))
    # A row for each source: Catalyst broadcasts it below its size threshold and else shuffles, AQE splitting large sources.
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    budget, before = F.col("_budget"), F.coalesce("_before", F.lit(0))
    at_edge = F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))
    part = F.when(F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(True)), F.col("_size")).otherwise(F.lit(0).cast("long"))
    order = W.partitionBy("source").orderBy("_key", "doc_id", F.xxhash64("text"), "_size").rowsBetween(W.unboundedPreceding, -1)
    ran = before + F.coalesce(F.sum("_size").over(order), F.lit(0))
    sorted_ = rows.where(at_edge).withColumn("_part", F.least("_size", F.greatest(budget - ran, F.lit(0))))
    out = rows.where(~at_edge).withColumn("_part", part).unionByName(sorted_)
    taken = F.col("_epochs") * F.col("_size") + F.col("_part")
    out = out.withColumn("taken", taken)
    return out.select(*[F.col(c) if c in ("doc_id", "text", "source") else F.col(REST).getField(c).alias(c) for c in names], F.col("_size").alias("size"), "source_size", "target", "taken")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text").select("doc_id", "size", "source_size", "target", "taken")


#: md5 gives the same keys in both engines; the whole order is one window here.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(t)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / (0.25 + 0.75 * length(translate(t, '#*$%&|<>{}[]~^=_\@0123456789', '')) / greatest(length(t), 1)) AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM m GROUP BY source),
x AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM s),
a AS (SELECT source, source_size, round(least(3.0 * source_size, max(x) OVER () * w), 6) AS target FROM x),
p AS (
  SELECT m.*, a.source_size, a.target, CAST(round(a.target) AS BIGINT) AS aim,
    coalesce(sum(size) OVER (PARTITION BY m.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ran
  FROM m JOIN a ON m.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE aim // source_size * size + least(size, greatest(0, aim % source_size - ran)) END AS BIGINT) AS taken
FROM p
"""
