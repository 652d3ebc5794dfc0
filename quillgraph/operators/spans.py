"""Span datasets: annotation, relation census, seeded splits, precision and recall, decoding of BIO tags."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_relation, clean_type, find_spans
from ..functions.vocabulary import RELATION_LABELS, UNSUPPORTED


def annotated(records: DataFrame) -> DataFrame:
    """(doc, name, type, start, end) from (doc, text, name, type): every span, nulls where a name isn't found."""
    hits = records.withColumn("hits", find_spans(F.col("text"), F.col("name")))
    return hits.select("doc", "name", clean_type(F.col("type")).alias("type"), F.explode_outer("hits").alias("s")).select("doc", "name", "type", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def relation_census(facts: DataFrame) -> DataFrame:
    """(relation, n, status): canonical relations, most frequent first."""
    rel = canonical_relation(F.col("relation"))
    status = F.when(F.col("relation").isin(RELATION_LABELS), "trainable").when(F.col("relation").isin(UNSUPPORTED), "unsupported").otherwise("other")
    return facts.groupBy(rel.alias("relation")).agg(F.count("*").alias("n")).select("relation", "n", status.alias("status")).orderBy(F.col("n").desc(), "relation")


def seeded_split(docs: list[str], seed: int = 42, dev: float = 0.1, test: float = 0.1) -> dict[str, str]:
    """Split of each document: a seeded shuffle of the sorted names; at least one each if there are three."""
    names = sorted(docs)
    random.Random(seed).shuffle(names)
    some = lambda share: max(1, round(share * len(names)))
    n_test = some(test)
    return {d: "test" if i < n_test else "dev" if i < n_test + some(dev) else "train" for i, d in enumerate(names)}


def hashed_split(docs: DataFrame) -> DataFrame:
    """docs (doc) with split, by hash: the form for corpora whose names don't fit the driver."""
    h = F.pmod(F.conv(F.substring(F.md5(F.col("doc").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(10))
    return docs.withColumn("split", F.when(h == 0, "test").when(h == 1, "dev").otherwise("train"))


def span_scores(gold: DataFrame, found: DataFrame, by: str = "type") -> DataFrame:
    """Precision, recall and F1 of multisets of rows, for each type and (`micro`) for all."""
    cols = gold.columns
    both = gold.groupBy(*cols).agg(F.count("*").alias("g")).join(found.groupBy(*cols).agg(F.count("*").alias("p")), cols, "full").na.fill(0, ["g", "p"])
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.least("g", "p"), "tp"), (F.col("g"), "gold"), (F.col("p"), "pred"))]
    sums = both.groupBy(by).agg(*counts).unionByName(both.agg(*counts).withColumn(by, F.lit("micro")))
    ratio = lambda d: F.when((F.col("gold") == 0) & (F.col("pred") == 0), 1.0).when(F.col(d) == 0, 0.0).otherwise(F.col("tp") / F.greatest(F.col(d), F.lit(1)))
    out = sums.withColumns({"p": ratio("pred"), "r": ratio("gold")})
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / F.when(F.col("p") + F.col("r") == 0, 1.0).otherwise(F.col("p") + F.col("r")))
    return out.select(by, F.round("p", 4).alias("p"), F.round("r", 4).alias("r"), F.round(f1, 4).alias("f1"), "gold", "pred")


def decode_bio(tags: DataFrame) -> DataFrame:
    """(doc, start, end, type) from (doc, pos, tag): B- or a change of type starts a span, O ends it."""
    w = W.partitionBy("doc").orderBy("pos")
    kind = F.when(F.col("tag") == "O", None).otherwise(F.regexp_replace("tag", "^[BI]-", ""))
    rows = tags.withColumn("type", kind).withColumn("before", F.lag("type").over(w))
    start = F.col("type").isNotNull() & (F.col("tag").startswith("B-") | ~F.col("before").eqNullSafe(F.col("type")))
    rows = rows.withColumn("island", F.sum(start.cast("int")).over(w)).where("type is not null")
    return rows.groupBy("doc", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.min("type").alias("type")).drop("island")
