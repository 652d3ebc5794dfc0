"""Questions: linking mentions to nodes, evidence within hops, ranking, chunks; map-reduce over communities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import checkpointed

#: Mentions that are matched with all nodes at once.
BLOCK = 1000


def link(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention, key): the node of the same key, else the most mentioned one that contains the mention's key or lies in it."""
    nodes = checkpointed(nodes.select("key", "mentions", "node_seq"))
    exact = mentions.join(nodes, mentions.mention_key == nodes.key)
    rest = mentions.join(exact.select("mention").distinct(), "mention", "left_anti")
    rest = rest.where("mention_key <> ''")
    # Mentions come from a question and are few; more of them are taken block by block, so that no broadcast is larger than BLOCK rows or so.
    blocks = -(-rest.count() // BLOCK)
    both = exact.select("mention", "key", "mentions", "node_seq")
    for i in range(blocks):
        some = F.broadcast(rest.where(F.pmod(F.xxhash64("mention"), F.lit(blocks)) == i))
        near = nodes.where("key <> ''").join(some, F.col("key").contains(F.col("mention_key")) | F.col("mention_key").contains(F.col("key")))
        both = both.unionByName(near.select("mention", "key", "mentions", "node_seq"))
    return both.groupBy("mention").agg(F.max_by("key", F.struct("mentions", -F.col("node_seq"))).alias("key"))


def incident(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges with an end in frontier (key), once each: an equi-join on both ends, no OR."""
    ends = edges.select("*", F.explode(F.array_distinct(F.array("head", "tail"))).alias("key")).join(frontier, "key", "left_semi")
    return ends.drop("key").dropDuplicates(["head", "relation", "tail"])


def evidence(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Edges within 1 or 2 hops of seeds (key), with the hop."""
    first = incident(edges, seeds).withColumn("hop", F.lit(1))
    if hops < 2:
        return first
    out = first.select(F.explode(F.array("head", "tail")).alias("key")).distinct().join(seeds, "key", "left_anti")
    second = incident(edges, out).join(first.select("head", "relation", "tail"), ["head", "relation", "tail"], "left_anti").withColumn("hop", F.lit(2))
    return first.unionByName(second)


def ranked(found: DataFrame, seeds: DataFrame, k: int = 40) -> DataFrame:
    """The k facts that touch most seeds, then have most chunks, then come first."""
    hit = lambda s: seeds.select(F.col("key").alias(s), F.lit(1).alias(f"{s}_hit"))
    out = found.join(hit("head"), "head", "left").join(hit("tail"), "tail", "left")
    out = out.withColumn("touches", F.coalesce("head_hit", F.lit(0)) + F.coalesce("tail_hit", F.lit(0)))
    return out.orderBy(F.col("touches").desc(), F.col("n_chunks").desc(), "edge_seq", "head", "relation", "tail").limit(k)


def best_facts(edges: DataFrame, seeds: DataFrame, sizes, k: int = 40) -> DataFrame:
    """ranked() of the edges within two hops; sizes gives the number of chunks, n_chunks, of some edges.

    All edges that touch a seed are within one hop, and rank first: where they are k or more the others can't be among the k, and their chunks aren't counted.
    """
    found = checkpointed(evidence(edges, seeds, 1))
    if found.count() < k:
        found = checkpointed(evidence(edges, seeds, 2))
    return ranked(found.join(sizes(found), ["head", "relation", "tail"]), seeds, k)


def outgoing_two_hops(edges: DataFrame, seed: str) -> DataFrame:
    """Edges at the seed, and those that leave its neighbours for other nodes."""
    near = edges.where((F.col("head") == seed) | (F.col("tail") == seed))
    others = near.select(F.when(F.col("head") == seed, F.col("tail")).otherwise(F.col("head")).alias("head")).distinct()
    return near.select("head", "relation", "tail").union(edges.join(others, "head", "left_semi").where(F.col("tail") != seed).select("head", "relation", "tail")).distinct()


def best_communities(ratings: DataFrame, k: int = 5, least: int = 20) -> DataFrame:
    """The k highest scores (clamped to 0-100, none is 0), those under `least` dropped."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("score").cast("int"), F.lit(0))))
    return ratings.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(k).where(F.col("score") >= least)


#: Queries that are compared with all vectors at once.
QUERIES = 256


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, vec_id, cosine): the k vectors (vec_id, embedding) nearest to each query, itself left out; ties by vec_id.

    Queries are stated rows, taken in blocks of QUERIES that are broadcast, and every task keeps k rows of each; null, zero and other vectors of another length have no cosine.
    """
    import numpy as np

    usable = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries, out = usable(queries), None
    blocks = max(1, -(-queries.count() // QUERIES))
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        held = [(r.vec_id, np.array(r.embedding)) for r in rows if r.embedding and None not in r.embedding]

        def run(batches, held=held):
            best: dict = {}
            for batch in batches:
                own = [(v, np.array(x)) for v, x in zip(batch["vec_id"], batch["embedding"], strict=True) if len(x) and not any(y is None for y in x)]
                for size in {len(x) for _, x in own}:
                    ids = np.array([v for v, x in own if len(x) == size])
                    x = np.stack([x for _, x in own if len(x) == size])
                    for q, p in ((q, p) for q, p in held if len(p) == size):
                        with np.errstate(all="ignore"):
                            c = np.round((x * p).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((p * p).sum())), 6)
                        some = np.flatnonzero(np.isfinite(c) & (ids != q))
                        some = some[np.lexsort((ids[some], -c[some]))[:k]]
                        best[q] = sorted(best.get(q, []) + [(-c[j], ids[j]) for j in some])[:k]
            yield pd.DataFrame([(q, v, -c) for q, own in best.items() for c, v in own], columns=["query_id", "vec_id", "cosine"])

        part = usable(vectors).mapInPandas(run, "query_id long, vec_id long, cosine double")
        out = part if out is None else out.unionByName(part)
    ranked_ = out.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")))
    return ranked_.where(F.col("r") <= k).drop("r")
