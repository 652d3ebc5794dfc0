"""Entity resolution: blocking on shared words, guards, fuzzy nomination, batches for a judge, canonical keys, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..functions.vocabulary import PRODUCT_RELATIONS


def blocking_pairs(nodes: DataFrame, most: int = 60) -> DataFrame:
    """(a, b) once for nodes that share a word found in 2 to `most` keys; a is the earlier node."""
    words = nodes.select("key", "node_seq", F.explode(F.array_distinct(F.split("key", " "))).alias("word")).where("word <> ''")
    kept = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("word")
    words = words.join(kept, "word")
    left, right = (words.select("word", F.col("key").alias(x), F.col("node_seq").alias(f"{x}_seq")) for x in "ab")
    return left.join(right, "word").where("a_seq < b_seq").select("a", "b").distinct()


def guarded(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs without compound keys and without a maker's edge between the two."""
    made = edges.where(F.col("relation").isin(PRODUCT_RELATIONS)).select(F.least("head", "tail").alias("lo"), F.greatest("head", "tail").alias("hi")).distinct()
    open_ = pairs.where(~F.col("a").contains(" and ") & ~F.col("b").contains(" and ")).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return open_.join(made, ["lo", "hi"], "left_anti").select("a", "b")


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", similarity(F.col("a"), F.col("b")))


def nominations(nodes: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(guarded(blocking_pairs(nodes), edges)).where(F.col("score") >= threshold)


def batches(parts: DataFrame, nodes: DataFrame, size: int = 15) -> DataFrame:
    """(component, batch, key): a component's members by mentions, in slices of `size` for the judge."""
    ranked = parts.join(nodes.select("key", "mentions", "node_seq"), "key").withColumn("r", F.row_number().over(W.partitionBy("component").orderBy(F.col("mentions").desc(), "node_seq")))
    return ranked.select("component", F.floor((F.col("r") - 1) / size).cast("int").alias("batch"), "key", "mentions", "node_seq")


def canonical(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, canon) from (group, key): the member of most mentions, the longest name, the first."""
    own = groups.join(nodes.select("key", "mentions", "display", "node_seq"), "key")
    best = own.groupBy("group").agg(F.max_by("key", F.struct("mentions", F.length("display"), -F.col("node_seq"))).alias("canon"))
    return own.select("group", "key").join(best, "group").where("key <> canon").select("key", "canon")


def renamed(log: DataFrame, key_map: DataFrame) -> DataFrame:
    """The mention log with merged keys; rebuilding applies no gate again, and merged pairs become loops."""
    own = lambda s: key_map.select(F.col("key").alias(s), F.col("canon").alias(f"{s}_canon"))
    out = log.join(own("head"), "head", "left").join(own("tail"), "tail", "left")
    return out.withColumns({s: F.coalesce(f"{s}_canon", s) for s in ("head", "tail")}).drop("head_canon", "tail_canon").withColumns({"head_type": F.lit("MISC"), "tail_type": F.lit("MISC")})


def context(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(key, context): a node's name, type, mentions and first k edges, each with its direction and the other node's name, as text for the judge."""
    names = nodes.select(F.col("key").alias("other"), "display")
    out, back = F.struct(F.col("head").alias("key"), F.lit(True).alias("leaves"), F.col("tail").alias("other")), F.struct(F.col("tail").alias("key"), F.lit(False).alias("leaves"), F.col("head").alias("other"))
    # A loop counts once, as an edge that leaves.
    ends = edges.select("edge_seq", "relation", F.inline(F.when(F.col("head") == F.col("tail"), F.array(out)).otherwise(F.array(out, back))))
    first = ends.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("edge_seq", "relation", "other"))).where(F.col("r") <= k).join(names, "other", "left")
    other = F.coalesce("display", "other")
    line = F.when(F.col("leaves"), F.format_string("%s -> %s", "relation", other)).otherwise(F.format_string("<- %s from %s", "relation", other))
    joined = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "; ").alias("edges"))
    text = F.format_string('"%s" (type=%s, mentions=%d) | edges: %s', "display", "type", "mentions", F.coalesce("edges", F.lit("(no edges)")))
    return nodes.join(joined, "key", "left").select("key", text.alias("context"))


def with_displays(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nominations (a, b, score) with both names."""
    own = lambda s: nodes.select(F.col("key").alias(s), F.col("display").alias(f"{s}_name"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "a_name", "b_name", "score")


def judged_groups(batches_: DataFrame, judge) -> DataFrame:
    """(group, key) from a judge, a function of a batch's keys that returns groups of keys.

    Of each group count members of the batch that no earlier surviving group has; groups under two are void.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["mentions", "node_seq"], ascending=[False, True])
        batch, claimed, out = list(frame["key"]), set(), []
        for g in judge(batch):
            own = [k for k in dict.fromkeys(g) if isinstance(k, str) and k in batch and k not in claimed]
            if len(own) >= 2:
                claimed |= set(own)
                out += [(f"{frame['component'].iloc[0]}/{frame['batch'].iloc[0]}/{own[0]}", k) for k in own]
        return pd.DataFrame(out, columns=["group", "key"])

    return batches_.groupBy("component", "batch").applyInPandas(run, "group string, key string")
