"""Extraction records and chunks: from checkpoint rows to facts, from chunk ids to texts, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_text, strip

#: Triples of a chunk at most, a rule of the data model.
MOST = 20


def valid_triples(triples: Column, most: int = MOST) -> Column:
    """The first `most` triples whose head, relation and tail are not blank."""
    filled = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return F.slice(F.filter(triples, lambda t: filled(t["head"]) & filled(t["relation"]) & filled(t["tail"])), 1, most)


def type_of(entities: Column, name: Column) -> Column:
    """The type that a record's last entity of that name has, MISC without one."""
    own = F.filter(entities, lambda e: e["name"] == name)
    return F.when((name != "") & (F.size(own) > 0), F.coalesce(F.element_at(own, -1)["type"], F.lit("MISC"))).otherwise("MISC")


def facts_of(records: DataFrame) -> DataFrame:
    """(seq, chunk_id, head, relation, tail, head_type, tail_type) of records (ord, chunk_id, triples, entities); ord orders the records."""
    empty = F.array().cast("array<struct<name:string,type:string>>")
    rows = records.select("ord", "chunk_id", F.coalesce("entities", empty).alias("entities"), F.posexplode(valid_triples(F.col("triples"))).alias("i", "t"))
    rows = rows.select((F.col("ord") * MOST + F.col("i")).cast("long").alias("seq"), "chunk_id", "entities", "t.head", "t.relation", "t.tail")
    return rows.select("seq", "chunk_id", "head", "relation", "tail", type_of(F.col("entities"), F.col("head")).alias("head_type"), type_of(F.col("entities"), F.col("tail")).alias("tail_type"))


def chunks(index: DataFrame, articles: DataFrame, target: int = 1000, overlap: int = 150) -> DataFrame:
    """(chunk_id, doc, chunk_ord, text) of index (file, title) and articles (file, text): files that aren't there are left out, as is the entry `_meta`."""
    own = index.where("file <> '_meta'").join(articles.select("file", "text"), "file")
    rows = own.select("file", F.col("title").alias("doc"), F.posexplode(chunk_text(F.col("text"), target, overlap)).alias("chunk_ord", "text"))
    return rows.select(F.concat(F.regexp_replace("file", "[.]txt$", ""), F.lit("::"), F.col("chunk_ord").cast("string")).alias("chunk_id"), "doc", "chunk_ord", "text")


def first_chunks(rows: DataFrame, limit: int = 0, articles: int = 0, each: int = 15) -> DataFrame:
    """The first chunks by (doc, chunk_ord): `articles` times `each`, then `limit`; 0 is no limit."""
    n = min([x for x in (articles * each, limit) if x] or [0])
    return rows.orderBy("doc", "chunk_ord").limit(n) if n else rows


def todo(rows: DataFrame, done: DataFrame, failed: DataFrame, on: str = "chunk_id") -> DataFrame:
    """Chunks that are neither done nor failed for good."""
    return rows.join(done.select(on).distinct(), on, "left_anti").join(failed.select(on).distinct(), on, "left_anti")


def texts_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """ids (chunk_id) with the chunk's text, null for an id that no chunk has."""
    return ids.select("chunk_id").distinct().join(rows.select("chunk_id", "text"), "chunk_id", "left")


def totals(index: DataFrame, failed: DataFrame) -> DataFrame:
    """(articles_ok, articles_failed, n_chunks, chars) of an index (doc, chars, num_chunks) and the titles that failed."""
    sums = index.agg(F.count("*").alias("articles_ok"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    return sums.select("articles_ok", F.lit(failed.count()).cast("long").alias("articles_failed"), "n_chunks", "chars")
