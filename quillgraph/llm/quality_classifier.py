"""Quality classifier by importance resampling.

Two generative models, multinomials over hashed trigrams of a text's bytes: the target's is counted on a bounded
sample of documents labelled good, the raw one on every document. A document's log importance weight is the sum of
log(target / raw) over its trigrams, shrunk towards 0 for short ones and scaled to `TEMPER` trigrams: temper * sum / (n + SHRINK).
Documents are then drawn without replacement by Gumbel top-k: the k largest of log weight + Gumbel noise
(a hash of the key, so reruns agree) stay. k is the number of documents whose weight reaches the limit that keeps
`KEEP` of the good sample and parts it best from the bad one.

Counting sends a row for each bucket and task. The k-th largest key is found by counting keys in ranges, twice as
fine each time, never by a global sort. Documents are scored twice, and no text is shuffled.

Null and empty texts weigh 1 (log 0). Without labels every document stays. Equal rows get equal keys and stay or go
together, so ties may keep a few more than k. Extra columns stay, but for those of our results' names; an empty table gives an empty result.
Texts may be of any length.

`TEMPER` sets what the draw decides: at 400 trigrams a document's weight differs from the limit by more than the noise for most
documents, so junk goes and clean documents stay, and the draw settles the ones near the limit. A lower one
would trade clean documents for variety.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import blocks
from .common import mapped, stored, table, uniform

BITS = 16
#: Labelled documents of each class that fit target and limit, at most, by default (those of the smallest hashes).
LABELLED = 3000
#: Weights are whole multiples of 1 / SCALE, so that their sums don't depend on the order.
SCALE = 1 << 20
KEEP, SHRINK, TEMPER = 0.998, 300.0, 400.0


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' trigrams, one text after the other, and where each text's begin (and the end)."""
    n = np.maximum(np.array([len(t) for t in texts], dtype=np.int64) - 2, 0)
    x = np.frombuffer(b"".join(t for t in texts if len(t) > 2), dtype=np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(n)])
    h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    sizes = n[n > 0] + 2
    ends = np.cumsum(sizes)
    keep = np.ones(len(x), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return h[keep[: len(h)]], np.concatenate([[0], np.cumsum(n)])


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def counted(docs: DataFrame) -> np.ndarray:
    """Occurrences by bucket in all texts of docs: 2 ** BITS rows a task, then as many in all."""

    def run(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in blocks(texts):
                total += np.bincount(hashed(texts[a:b])[0], minlength=1 << BITS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    out = np.zeros(1 << BITS)
    for r in mapped(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def scored(docs: DataFrame, weights: np.ndarray, column: str) -> DataFrame:
    """docs with the log weight as `column`."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    small = np.rint(weights * SCALE).astype(np.int64)

    def run(batches):
        for batch in batches:
            texts, out = texts_of(batch), []
            for a, b in blocks(texts):
                h, at = hashed(texts[a:b])
                total = np.concatenate([[0], np.cumsum(small[h])])
                out.append(TEMPER / SCALE * (total[at[1:]] - total[at[:-1]]) / (np.diff(at) + SHRINK))
            got = np.round(np.concatenate(out), 6) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=schema.names)

    return mapped(docs, run, schema)


def labelled(docs: DataFrame, labels: DataFrame, quality: int, most: int = LABELLED) -> DataFrame:
    """(doc_id, text) of the documents of `most` ids at most of one quality: a broadcast of a proven size."""
    ids = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")


def known_weights(docs: DataFrame, weights: np.ndarray, most: int) -> np.ndarray:
    """Log weights of docs, of `most` rows at most: an id may have come up many times."""
    rows = scored(docs, weights, "log_weight").select(F.xxhash64("doc_id", "text").alias("h"), "log_weight")
    return np.array([r.log_weight for r in rows.orderBy("h").limit(most).collect()])


def limit_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that a document must reach: below all but 1 - KEEP of the good, as far up towards them from the bad as their gap's middle."""
    if not len(good):
        return -np.inf
    top = float(np.quantile(good, 1 - KEEP))
    under = bad[bad < top]
    return (top + float(np.quantile(under, 0.98))) / 2 if len(under) else top - 1.0


def cutoff(keys: DataFrame, k: int, levels: int = 40) -> float | None:
    """The k-th largest of column `key`, exactly: the range that holds it is split in 256 until its keys are all the same."""
    if k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high and levels:
        levels -= 1
        width = (high - low) / 256
        own = keys.where(F.col("key").between(low, high))
        at = F.least(F.floor((F.col("key") - low) / F.lit(width)), F.lit(255)) if width > 0 else F.lit(0)
        bins = sorted(((r.b, r.n, r.lo, r.hi) for r in own.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in bins:
            if k <= n:
                low, high = lo, hi
                break
            k -= n
    return low


def classify(docs: DataFrame, labels: DataFrame, seed: int = 13, most: int = LABELLED) -> DataFrame:
    """docs with log_weight, key and kept; target and limit are fitted on `most` labelled documents of each class at most."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("log_weight", "key", "kept")])
    raw, target = counted(docs), counted(labelled(docs, labels, 1, most))
    size = 1 << BITS
    weights = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size)) if target.sum() else np.zeros(size)
    scores = scored(docs, weights, "log_weight")
    gumbel = -F.ln(-F.ln(uniform("doc_id", seed=seed)))
    scores = scores.withColumn("key", F.round(F.col("log_weight") + gumbel, 9))
    least = limit_of(*(known_weights(labelled(docs, labels, q, most), weights, most) for q in (1, 0)))
    keys = stored(scores.select("log_weight", "key"))
    edge = cutoff(keys.select("key"), keys.where(F.col("log_weight") >= float(least)).count())
    return scores.withColumn("kept", F.lit(False) if edge is None else F.col("key") >= edge)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")
