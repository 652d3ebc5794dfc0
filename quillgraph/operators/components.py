"""Connected components and label propagation on string keys; checkpoints cut lineage in shared storage."""

from __future__ import annotations

import random
import tempfile
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to shared storage and read back, and where it lies.

    What is read has the size of its files. DataFrame.checkpoint() keeps the optimizer's estimate instead, for joins the product of both sides: in a loop its digits multiply each round, until the driver has no memory for the number.
    """
    spark = df.sparkSession
    path = f"{(spark.sparkContext.getCheckpointDir() or shared_base(spark)).rstrip('/')}/quillgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df)[0]


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and they are one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or tempfile.mkdtemp(prefix="quillgraph-")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its rows' numbers, from 0, by order: a distributed sort, and one offset for each of its partitions."""
    rows = checkpointed(checkpointed(df).orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part, at = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    starts, before = [], 0
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):
        starts += [F.lit(r.p), F.lit(before)]
        before += r["count"]
    return rows.withColumn(name, (F.element_at(F.create_map(*starts), part) + at).cast("long")) if starts else rows


def components(pairs: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable over pairs (a, b)."""
    links = checkpointed(pairs.select("a", "b").unionAll(pairs.select("b", "a")).distinct())
    labels = checkpointed(links.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = links.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        step = labels.join(near, "key").select("key", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("key").alias("to"), F.col("component").alias("top"))
        labels = checkpointed(step.join(jump, "to", "left").select("key", F.least("to", F.coalesce("top", "to")).alias("component"), "was"))
        if labels.where("component <> was").isEmpty():
            return labels.drop("was")
        labels = labels.drop("was")


def vote(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, label): one synchronous round; a node moves only to a strictly heavier label, the smallest on ties."""
    votes = adj.join(labels.select(F.col("key").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("key"), "label").agg(F.round(F.sum("w"), 9).alias("w"))
    own = votes.join(labels.select("key", F.col("label").alias("own")), "key")
    best = own.groupBy("key").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("best"), F.max("w").alias("top"), F.max(F.when(F.col("label") == F.col("own"), F.col("w"))).alias("mine"))
    out = labels.join(best, "key", "left")
    return out.select("key", F.when(F.col("top") > F.coalesce("mine", F.lit(0.0)), F.col("best")).otherwise(F.col("label")).alias("label"))


def propagate(adj: DataFrame, labels: DataFrame, sweeps: int = 20) -> DataFrame:
    """Synchronous label propagation, half of the nodes (by hash) in each round, so that pairs don't swap for ever.

    Two rounds are a sweep over all nodes; it ends when two rounds in a row, one of each half, change nothing. Rounds work on numbers of nodes, and on the links of the half that moves.
    """
    spark, half = adj.sparkSession, F.pmod(F.xxhash64("key"), F.lit(2))
    nodes = checkpointed(numbered(labels.select("key", "label"), "id", "key").withColumn("half", half))
    own = lambda s: nodes.select(F.col("key").alias(s), F.col("id").alias(f"{s}_id"), F.col("half").alias(f"{s}_half"))
    links = adj.join(own("src"), "src").join(own("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "w", "src_half")
    links = checkpointed(links)
    halves = [checkpointed(links.where(F.col("src_half") == i).drop("src_half")) for i in range(2)]
    now, calm, path = nodes.select(F.col("id").alias("key"), "label"), 0, None
    for i in range(2 * sweeps):
        new = vote(halves[i % 2], now).withColumnRenamed("label", "new")
        step, at = written(now.join(new, "key").select("key", F.col("new").alias("label"), F.col("label").alias("was")))
        if path:
            deleted(spark, path)
        now, path = step.drop("was"), at
        calm = calm + 1 if step.where("label <> was").isEmpty() else 0
        if calm == 2:
            break
    return nodes.select("key", "id").join(now.withColumnRenamed("key", "id"), "id").select("key", "label")


def propagate_in_order(adj: DataFrame, order: DataFrame, seed: int = 42, rounds: int = 20) -> DataFrame:
    """Asynchronous label propagation over nodes shuffled anew each round: inherently one task, which holds 12 bytes for each row of adj and some 30 for each node.

    Nodes are numbered and rows joined and sorted outside of it; it takes rows in order, batch by batch, as numbers.
    """
    nodes = numbered(order.select("key", "node_seq").join(adj.select(F.col("src").alias("key")).distinct(), "key", "left_semi"), "id", "node_seq", "key")
    nodes = checkpointed(numbered(nodes, "rank", "key"))
    src, dst = nodes.select(F.col("key").alias("src"), F.col("id").cast("int").alias("s")), nodes.select(F.col("key").alias("dst"), F.col("id").cast("int").alias("d"), F.col("rank").cast("int").alias("rank"))
    rows = checkpointed(adj.join(src, "src").join(dst, "dst").select("s", "d", "rank", F.col("w").cast("double").alias("w")))
    n, m = nodes.count(), rows.count()

    def run(batches):
        start, near, weight, at = np.zeros(n + 1, np.int64), np.empty(m, np.int32), np.empty(m, np.float64), 0
        for batch in batches:
            some, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            start[some + 1] += counts
            near[at : at + batch.num_rows], weight[at : at + batch.num_rows] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at += batch.num_rows
        np.cumsum(start, out=start)
        label, rng = np.arange(n), random.Random(seed)
        for _ in range(rounds):
            keys = array("q", range(n))
            rng.shuffle(keys)
            moved = False
            for k in keys:
                a, b = start[k], start[k + 1]
                votes: dict[int, float] = {}
                for other, w in zip(label[near[a:b]].tolist(), weight[a:b].tolist(), strict=True):
                    votes[other] = votes.get(other, 0.0) + w
                if not votes:
                    continue
                top = max(votes.values())
                if top > votes.get(int(label[k]), 0.0):
                    label[k], moved = min(x for x, w in votes.items() if w == top), True
            if not moved:
                break
        for i in range(0, n, 10_000):
            own = label[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(own))), pa.array(own)], names=["id", "label"])

    found = rows.repartition(1).sortWithinPartitions("s", "rank").select("s", "d", "w").mapInArrow(run, "id long, label long")
    return found.join(nodes.select("id", "key"), "id").select("key", "label")
