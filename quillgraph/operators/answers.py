"""Questions to texts: evidence and prompts of local answers, community prompts, the rated points of global ones, and a small store of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ports import answered, rating
from .search import best_communities

#: Characters of a chunk in a prompt; entities, relations and points of a community at most.
SHOWN, LISTED, POINTS = 500, 40, 5


def fact_line(head: Column | str = "head", relation: Column | str = "relation", tail: Column | str = "tail") -> Column:
    return F.format_string("%s --[%s]--> %s", head, relation, tail)


def chunk_lines(texts: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(chunk_id, line) of (chunk_id, text): the id in brackets and the text's first characters; chunks without text are left out."""
    return texts.where("text is not null").select("chunk_id", F.format_string("[%s] %s", "chunk_id", F.substring("text", 1, shown)).alias("line"))


def joined(rows: DataFrame, order: str, line: str) -> str:
    """Lines of a bounded table (a question's evidence) as text, `(none)` without any."""
    return "\n".join(f"  {r[0]}" for r in rows.orderBy(order).select(line).collect()) or "  (none)"


def local_prompt(spark, question: str, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(system, user): the prompt of a local answer from ranked facts (r, head, relation, tail; bounded by their rank) and their chunks' texts."""
    lines = joined(facts.withColumn("line", fact_line()), "r", "line"), joined(chunk_lines(texts), "chunk_id", "line")
    user = f"Question: {question}\n\nFacts:\n{lines[0]}\n\nChunks:\n{lines[1]}\n\nUse the evidence only, cite chunk ids, say so if it holds no answer. Reply as JSON: answer, chunks_used."
    return spark.createDataFrame([("You answer from the evidence of a graph, as JSON.", user)], "system string, user string")


def answer_of(answers: DataFrame) -> DataFrame:
    return answers.withColumn("said", F.coalesce(F.get_json_object("answer", "$.answer"), F.lit("(no answer returned)")))


def community_lines(members: DataFrame, edges: DataFrame, least: int = 3, listed: int = LISTED) -> DataFrame:
    """(id, entities, relations) for communities of `least` members: the names of the `listed` most mentioned and the first `listed` edges at a member, one that leaves marked.

    members: (id, key, display, mentions, node_seq). Only ranked rows are gathered: `listed` for each community.
    """
    large = members.groupBy("id").agg(F.count("*").alias("size")).where(F.col("size") >= least).select("id")
    gather = lambda df, order: df.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(*order))).where(F.col("r") <= listed).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]).alias("lines"))
    names = gather(members.join(large, "id", "left_semi").withColumn("line", F.col("display")), (F.col("mentions").desc(), "node_seq"))
    own = lambda s: members.select(F.col("key").alias(s), F.col("id").alias(f"{s}_id"), F.col("display").alias(f"{s}_name"))
    both = edges.join(own("head"), "head").join(own("tail"), "tail")
    line = F.format_string("%s --[%s x%d]--> %s%s", "head_name", "relation", "mentions", "tail_name", F.when(F.col("head_id") != F.col("tail_id"), "  (border)").otherwise(""))
    ends = both.select("edge_seq", line.alias("line"), F.explode(F.array_distinct(F.array("head_id", "tail_id"))).alias("id"))
    relations = gather(ends, ("edge_seq", "line")).withColumnRenamed("lines", "relations")
    return names.withColumnRenamed("lines", "entities").join(relations, "id", "left")


def community_prompts(lines: DataFrame) -> DataFrame:
    """(id, system, user) for a summariser."""
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit(""))
    user = F.concat(F.lit("Entities:\n"), listed(F.col("entities")), F.lit("\n\nRelations:\n"), listed(F.col("relations")), F.lit("\n\nSay in three to five sentences what this community is about, by these relations only. Reply as JSON: summary."))
    return lines.select("id", F.lit("You summarise communities of a graph, as JSON.").alias("system"), user.alias("user"))


def summaries(prompts: DataFrame, client: Callable) -> DataFrame:
    """(id, summary), `(summary failed)` where the model gave none."""
    said = F.trim(F.get_json_object("answer", "$.summary"))
    return answered(prompts, client).select("id", F.when(F.coalesce(said, F.lit("")) != "", said).otherwise("(summary failed)").alias("summary"))


def rated(communities: DataFrame, question: str, client: Callable, k: int = 5, least: int = 20) -> DataFrame:
    """(id, score, points) of the k communities (id, names, summary) that a model rates highest; failed ratings are left out, points are the first five strings."""
    user = F.concat(F.lit(f"Question: {question}\n\nCommunity ("), "names", F.lit("):\n"), "summary", F.lit("\n\nReply as JSON: score from 0 to 100, points."))
    got = answered(communities.where("coalesce(summary, '') <> ''").select("id", F.lit("You rate relevance, as JSON.").alias("system"), user.alias("user")), client, retries=2)
    points = F.slice(F.coalesce(F.from_json(F.get_json_object("answer", "$.points"), "array<string>"), F.array().cast("array<string>")), 1, POINTS)
    return best_communities(got.where("answer is not null").select("id", rating(F.col("answer")).alias("score"), points.alias("points")), k, least)


# ---- a store of single edges, none merged


def added(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges (chunk, head, relation, tail) and more of them; parallel ones stay."""
    return edges.unionByName(more)


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("head") == node).select("tail", "relation", "chunk")


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("tail") == node).select("head", "relation", "chunk")


def all_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("head", "tail")).alias("node")).distinct()


def evidence_lines(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(part, line): facts (head, relation, tail, chunk) as lines, then each of their chunks (chunk, text) once."""
    first = facts.select(F.lit(0).alias("part"), fact_line().alias("line"))
    return first.unionByName(chunks.join(facts.select("chunk").distinct(), "chunk").select(F.lit(1).alias("part"), F.format_string("[%s] %s", "chunk", "text").alias("line")))
