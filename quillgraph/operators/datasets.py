"""Span datasets from records and from tagged tokens: offsets, claims, scores and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_relation, clean_type, find_spans, is_trainable, tag_type
from .spans import decode_bio


def word_offsets(text: Column) -> Column:
    """[(start, end)] of a text's words, runs of anything but white space."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\s+|\S+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("words"))

    def step(state, p):
        end = state["at"] + F.length(p)
        word = F.struct(state["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p.rlike(r"(?U)^\S"), F.concat(state["words"], F.array(word))).otherwise(state["words"]).alias("words"))

    return F.aggregate(pieces, start, step, lambda s: s["words"])


def sentence_spans(sentences: DataFrame) -> DataFrame:
    """(id, text, start, end, type) from (id, tokens, tags): the tokens joined by blanks, and the spans that B- and I- tags make, in characters. No row for a sentence without spans."""
    joined = sentences.select("id", F.array_join("tokens", " ").alias("text"), F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "own"))
    before = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = joined.select("id", "text", "pos", F.col("own.tokens").alias("token"), F.col("own.tags").alias("tag")).withColumn("at", F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)))
    kind = F.when(F.col("tag").rlike("^[BI]-"), F.concat(F.substring("tag", 1, 2), tag_type(F.col("tag")))).otherwise("O")
    found = decode_bio(rows.select(F.col("id").alias("doc"), "pos", kind.alias("tag")))
    first = rows.select(F.col("id").alias("doc"), F.col("pos").alias("start"), "text", F.col("at").alias("a"))
    last = rows.select(F.col("id").alias("doc"), F.col("pos").alias("end"), (F.col("at") + F.length("token")).alias("b"))
    return found.join(first, ["doc", "start"]).join(last, ["doc", "end"]).select(F.col("doc").alias("id"), "text", F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), "type")


def scored_spans(tags: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc, start, end, type, score) from a tagger's (doc, pos, tag, score): decoded spans with the mean score of their words, those under `least` left out."""
    spans = decode_bio(tags.select("doc", "pos", "tag"))
    inside = spans.join(tags.select("doc", "pos", F.col("score").alias("own")), "doc").where((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end")))
    return inside.groupBy("doc", "start", "end", "type").agg(F.round(F.avg("own"), 3).alias("score")).where(F.col("score") >= least)


def claimed(words: Column, spans: Column) -> Column:
    """A tag for each word (start, end): longer spans (start, end, type) claim first, and one whose first word is taken is dropped whole; O elsewhere."""
    order = F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct((s["start"] - s["end"]).alias("less"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    none = F.transform(words, lambda w: F.lit("O"))

    def claim(tags, s):
        own = F.transform(words, lambda w: (w["start"] < s["end"]) & (w["end"] > s["start"]))
        first = F.array_position(own, True)
        free = (first > 0) & (F.get(tags, first.cast("int") - 1) == "O")
        new = F.transform(tags, lambda t, i: F.when(F.get(own, i) & (t == "O"), F.concat(F.when(i + 1 == first, F.lit("B-")).otherwise("I-"), s["type"])).otherwise(t))
        return F.when(free, new).otherwise(tags)

    return F.aggregate(order, none, claim)


def annotated_entities(rows: DataFrame) -> DataFrame:
    """rows (chunk_id, text, entities) exploded: (chunk_id, text, name, type, spans), an empty array of spans for an entity that the text doesn't hold."""
    each = rows.select("chunk_id", "text", F.explode("entities").alias("e")).select("chunk_id", "text", F.coalesce("e.name", F.lit("")).alias("name"), clean_type(F.coalesce("e.type", F.lit(""))).alias("type"))
    return each.withColumn("spans", find_spans(F.col("text"), F.col("name")))


def builder_stats(rows: DataFrame, missing: int = 0) -> DataFrame:
    """(rows, missing_chunk, mentions, found, dropped, drop_rate) of rows (chunk_id, text, entities): an entity is dropped if its text doesn't hold it."""
    each = rows.select("text", F.posexplode_outer("entities").alias("i", "e")).select("text", "i", F.coalesce("e.name", F.lit("")).alias("name"))
    exact = F.coalesce(F.contains("text", "name"), F.lit(False))
    # Rows are counted in the same pass, and no text goes to Python for a name that it holds as it is.
    left = (F.col("name") != "") & ~exact
    held = (F.col("name") != "") & (exact | (F.size(find_spans(F.when(left, F.col("text")), F.when(left, F.col("name")))) > 0))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    hits = each.agg(count(F.coalesce(F.col("i"), F.lit(0)) == 0).alias("rows"), F.count("i").alias("mentions"), count(F.col("i").isNotNull() & ~held).alias("dropped"))
    rate = F.when(F.col("mentions") > 0, F.round(F.col("dropped") / F.col("mentions"), 4)).otherwise(0.0)
    return hits.select("rows", F.lit(missing).cast("long").alias("missing_chunk"), "mentions", (F.col("mentions") - F.col("dropped")).alias("found"), "dropped", rate.alias("drop_rate"))


def types_of(rows: DataFrame) -> DataFrame:
    """(type, n) of the named entities of rows (entities), most frequent first."""
    each = rows.select(F.explode("entities").alias("e")).where("e.name <> ''").select(clean_type(F.coalesce("e.type", F.lit(""))).alias("type"))
    return each.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type")


def unsupported(triples: DataFrame) -> DataFrame:
    """(relation, n) of triples (relation) whose canonical relation can't be trained."""
    each = triples.where(F.coalesce("relation", F.lit("")) != "")
    return each.where(~is_trainable(F.col("relation"))).groupBy(canonical_relation(F.col("relation")).alias("relation")).agg(F.count("*").alias("n"))


def split_counts(spans: DataFrame) -> DataFrame:
    """(split, type, n_rows, n_spans) of spans (split, id, type)."""
    return spans.groupBy("split", "type").agg(F.countDistinct("id").alias("n_rows"), F.count("*").alias("n_spans"))
