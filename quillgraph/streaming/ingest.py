"""Resumable extraction as a stream: chunks in, extraction records appended, failures set aside, nothing done twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import EXTRACTION


def ingest(spark: SparkSession, chunks: str, out: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs over all chunk files (chunk_id, doc, text; JSON lines) that came since the last run; returns all records.

    extract maps chunks to (chunk_id, doc, triples, entities), triples null where it failed. The file source's log skips files
    done, the state of dropDuplicates skips chunks done, and a batch is written to a folder of its own, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = extract(batch).persist()
        done.where("triples is not null").withColumn("triples", F.slice("triples", 1, 20)).write.mode("overwrite").parquet(f"{out}/records/batch={batch_id}")
        done.where("triples is null").select("chunk_id").write.mode("overwrite").parquet(f"{out}/failed/batch={batch_id}")
        done.unpersist()

    stream = spark.readStream.schema("chunk_id string, doc string, text string").json(chunks).dropDuplicates(["chunk_id"])
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(EXTRACTION + ", batch long").parquet(f"{out}/records").drop("batch")
