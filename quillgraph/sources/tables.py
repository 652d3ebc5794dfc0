"""A deterministic extractor: (head, relation, tail) facts of the star schema's tables, with order and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, chunk_id, head, relation, tail, head_type, tail_type); seq orders facts as a reader of the tables meets them."""
    get = lambda name: table(spark, sf_dir, name)
    nation, part, supplier, line = get("nation"), get("part"), get("supplier"), get("lineitem")

    def shaped(df: DataFrame, seq, chunk, head, relation, tail, kinds) -> DataFrame:
        return df.select(seq.cast("long").alias("seq"), chunk.alias("chunk_id"), F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.lit(kinds[0]).alias("head_type"), F.lit(kinds[1]).alias("tail_type"))

    own = part.withColumn("word", F.split("p_name", " ")[1])
    made = F.concat(F.lit("part::"), F.col("p_partkey"))
    order, at = F.concat(F.lit("order::"), F.col("l_orderkey")), 10**10 + F.col("l_orderkey") * 100 + F.col("l_linenumber") * 2
    # A line gives two facts, of the same supplier: lineitem is read once.
    sold = line.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(supplier.select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    fact = lambda i, relation, tail, key, kind: F.struct(F.lit(i).alias("i"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.col(key).isNotNull().alias("has"), F.lit(kind).alias("tail_type"))
    sold = sold.select(at.alias("at"), order.alias("chunk_id"), F.col("s_name").alias("head"), F.inline(F.array(fact(0, "LOCATED_IN", "n_name", "n_nationkey", "MISC"), fact(1, "SUPPLIES", "p_name", "p_partkey", "PRODUCT")))).where("has")
    return reduce(
        DataFrame.unionByName,
        [
            shaped(nation.join(get("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey"), F.concat(F.lit("nation::"), F.col("n_nationkey")), "n_name", "LOCATED_IN", "r_name", ("MISC", "LOCATION")),
            shaped(own, 10**6 + F.col("p_partkey") * 2, made, "p_brand", "MANUFACTURES", "p_name", ("MISC", "PRODUCT")),
            shaped(own.where("word is not null"), 10**6 + F.col("p_partkey") * 2 + 1, made, "word", "PRODUCES", "p_name", ("MISC", "PRODUCT")),
            sold.select((F.col("at") + F.col("i")).cast("long").alias("seq"), "chunk_id", "head", "relation", "tail", F.lit("MISC").alias("head_type"), "tail_type"),
        ],
    )
