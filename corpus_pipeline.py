"""From raw documents to token ids: five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import byte_bpe, minhash_dedup, mixing, quality_classifier, secrets
from quillgraph.llm.common import cleared, packed, stored, table, unpacked, written


#: Words and characters that the last stage keeps at once: the stages before it leave executors less memory than a fresh one has.
CACHE, SPAN = 50_000, 1 << 19


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler draws.

    Null and empty texts weigh as much as the corpus on average; equal rows stay or go together; without labels all stay; an empty table
    stays empty. Columns of docs pass through unchanged, whatever their names.
    """
    found = quality_classifier.classify(packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels")).where("kept")
    return unpacked(found, docs.columns, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each component of near-duplicates.

    Texts without words and rows without an id all stay; of equal rows one stays; an empty table stays empty. Columns pass through unchanged.
    """
    return minhash_dedup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced.

    Null texts stay null; repeated rows are redacted each; an empty table stays empty. Columns pass through unchanged, but for text and n_chars.
    """
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; one that it takes in part is taken whole (one for each source).

    Texts without words are never taken; null sources are one source; repeated rows are documents of their own; an empty table stays empty.
    Columns pass through unchanged, whatever their names.
    """
    out = mixing.mix(packed(docs, "doc_id", "text", "source"))
    copies = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return unpacked(out.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies))), docs.columns, "doc_id", "text", "source")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of what they decode to; the text goes.

    Null texts have no ids; every row is encoded; an empty table gives an empty result. Columns of docs stay, but for those of the results' names.
    """
    return byte_bpe.encode(docs, cache=CACHE, span=SPAN)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("byte-level BPE", tokens),
]

#: Hashed models, Gumbel draws and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself is deleted once its result is written, and that once the next one's is."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        cleared(spark, mark, written() - 1)
        mark = written() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
