"""Readers and writers of the pipeline's files: checkpoints as JSON lines, graphs and communities as Parquet."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION = "chunk_id string, doc string, triples array<struct<head:string,relation:string,tail:string>>, entities array<struct<name:string,type:string>>"


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint records; lines that don't parse are left out."""
    raw = spark.read.schema(f"{EXTRACTION}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record is null and chunk_id is not null").drop("_corrupt_record")


def append_extractions(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, text): whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("doc_key"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("text"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_failed(old: DataFrame, new: DataFrame, path: str) -> None:
    """Chunk ids that failed for good, old and new."""
    old.select("chunk_id").union(new.select("chunk_id")).distinct().orderBy("chunk_id").write.mode("overwrite").parquet(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Span rows as JSON lines, a folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id) of a list of failed chunks: a JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("chunk_id"))


def index(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, chars, num_chunks, chunks_preview) of docs (doc, text) and their chunks (doc, chunk_ord, text): the first 120 characters of the first chunk, "" without one."""
    own = chunks.groupBy("doc").agg(F.count("*").alias("num_chunks"), F.min_by("text", "chunk_ord").alias("first"))
    preview = F.coalesce(F.concat(F.substring("first", 1, 120), F.lit("...")), F.lit(""))
    return docs.select("doc", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).join(own, "doc", "left").select("doc", "chars", F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), preview.alias("chunks_preview"))


def write_index(docs: DataFrame, chunks: DataFrame, path: str) -> None:
    index(docs, chunks).write.mode("overwrite").json(path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines, aliases sorted, in order of first mention."""
    nodes.withColumn("aliases", F.array_sort("aliases")).orderBy("node_seq").drop("node_seq").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("edge_seq").drop("edge_seq").write.mode("overwrite").json(f"{path}/edges")


def write_merge_log(nominations: DataFrame, groups: DataFrame, key_map: DataFrame, threshold: float, path: str) -> None:
    """Nominations (scores to 3 places), and each judged group with what its canonical key absorbed."""
    nominations.select(F.lit(threshold).alias("threshold"), "a", "b", F.round("score", 3).alias("score")).write.mode("overwrite").json(f"{path}/nominations")
    own = groups.join(key_map, "key", "left").groupBy("group").agg(F.max("canon").alias("canonical"), F.array_sort(F.collect_list(F.when(F.col("canon").isNotNull(), F.col("key")))).alias("absorbed"))
    own.write.mode("overwrite").json(f"{path}/audit")


def write_communities(members: DataFrame, summaries: DataFrame, path: str) -> None:
    """(id, size, entities, summary): members (id, key, display, type, mentions) by mentions; a missing summary is empty."""
    entity = F.struct(-F.col("mentions"), "key", "display", "type")
    own = members.groupBy("id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(entity.cast("struct<less:bigint,key:string,display:string,type:string>"))).alias("e"))
    entities = F.transform("e", lambda x: F.struct(x["key"].alias("key"), x["display"].alias("display"), x["type"].alias("type"), (-x["less"]).alias("mentions")))
    out = own.join(summaries.select("id", "summary"), "id", "left").select("id", "size", entities.alias("entities"), F.coalesce("summary", F.lit("")).alias("summary"))
    out.write.mode("overwrite").json(path)


COMMUNITIES = "id long, size long, entities array<struct<key:string,display:string,type:string,mentions:bigint>>, summary string"


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMUNITIES).json(path)


def community_of(communities: DataFrame) -> DataFrame:
    """(key, id) of every member."""
    return communities.select("id", F.explode("entities").alias("e")).select(F.col("e.key").alias("key"), "id")


def page(nodes: DataFrame, edges: DataFrame, title: str = "graph") -> str:
    """A page that carries a bounded graph (of vis_subgraph) as JSON; only frames limited beforehand belong here."""
    held = [json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=True).replace("<", "\\u003c") for df in (nodes, edges)]
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><script>const nodes = {held[0]}, edges = {held[1]};</script>\n'
