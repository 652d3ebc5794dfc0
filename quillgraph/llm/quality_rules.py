"""Quality rules on DataFrame functions alone: base counts, and a log-likelihood ratio of hashed n-grams.

Whole words, pairs of neighbouring words and words' endings (three characters, for words that nobody wrote before) fall into
`BUCKETS` hashed buckets each. Multinomials over them come from trusted documents (target: all of them, up to a bound of `TRUSTED`, a parameter) and from every document (raw), smoothed by
`PRIOR` occurrences of each n-gram (raw) and by the target's share of that: n-grams seldom seen weigh next to nothing. A text's score
is the sum of log(target / raw) over its n-grams by their number, and texts under `THRESHOLD` go.

The threshold says by how much a text's n-grams may be rarer among trusted documents than in the corpus, on (geometric)
average: exp(-0.2) is 0.82 times. Prose like the trusted documents' lies around 0 whatever its subject, since rare words
are rare in both; text of another make is mostly n-grams that trusted documents lack, and lies far below.

The corpus is counted with partial aggregation: `FAMILIES` * `BUCKETS` rows a task at most are shuffled. Scores come from
an array of as many weights, a literal, inside each row: no text is shuffled. The trusted ids are broadcast, under that bound.

Windows of three words that recur in a text are found in the row too: 64-bit hashes, their upper 33 bits packed
with positions, are sorted and neighbours compared; windows alike in those bits are sorted again by whole hashes.

Null texts count as no words, so they fail the base; without trusted documents all scores are 0; repeated
rows count as often as they occur; an empty table gives an empty result; extra columns stay, but for those of our results' names.
A score at the threshold is kept. Texts may be of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, table

#: Hashed buckets of each family of n-grams: words, pairs, endings.
BUCKETS, FAMILIES = 1 << 16, 3
THRESHOLD = -0.2
#: Trusted documents that the target is counted on, at most, by default (of more, those of the smallest hashes).
TRUSTED = 1 << 20
#: Occurrences that every n-gram is given beforehand.
PRIOR = 8
SYMBOLS = r"[#*$%&|<>]"
#: Lowest bits of a packed hash, that hold a window's position: any index that an array can have.
SHIFT = 31


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def tail(xs: Column, k: int) -> Column:
    return F.slice(xs, k + 1, F.greatest(F.size(xs), F.lit(1)))


def bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - (BUCKETS - 1).bit_length()).cast("int")


def ending(x: Column) -> Column:
    return F.xxhash64(F.substring(x, -3, 3))


def joined(xs: Column, h: Column, k: int) -> Column:
    """Hashes of xs, each with the word k places on, for as long as h, the words' hashes, goes."""
    return F.slice(F.zip_with(xs, tail(h, k), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - k, F.lit(0)))


def grams(w: Column, h: Column) -> Column:
    """Buckets of words w (hashes h), of pairs of neighbouring words, and of words' endings, a range of numbers for each family."""
    pairs = F.slice(F.zip_with(h, tail(h, 1), lambda a, b: bucket(F.xxhash64(a, b)) + BUCKETS), 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return F.flatten(F.array(F.transform(h, bucket), pairs, F.transform(w, lambda x: bucket(ending(x)) + 2 * BUCKETS)))


def trusted_ids(trusted: DataFrame, most: int) -> DataFrame:
    """(_trusted): all ids of trusted, or of more than `most` those of the smallest hashes, a little under `most`: a proven bound for a broadcast."""
    ids = trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct()
    n = ids.count()
    return ids if n <= most else ids.where(F.pmod(F.xxhash64("_trusted"), F.lit(1 << 30)) < int(0.98 * most / n * (1 << 30)))


def weights(docs: DataFrame, trusted: DataFrame, most: int = TRUSTED) -> list[float] | None:
    """log(target / raw) of every bucket; None without trusted documents. FAMILIES * BUCKETS rows come to the driver, whatever the corpus."""
    ids = trusted_ids(trusted, most)
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).join(F.broadcast(ids), F.col("doc_id") == F.col("_trusted"), "left")
    rows = rows.select("w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.col("_trusted").isNotNull().cast("int").alias("own"))
    # explode_outer: below explode Spark would put a filter on the array's size, that makes all n-grams a second time.
    each = rows.select("own", grams(F.col("w"), F.col("h")).alias("g")).select("own", F.explode_outer("g").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("own").alias("target"))
    found = [r for r in counts.collect() if r.bucket is not None]  # null: of texts without words
    raw, target = {r.bucket: r.raw for r in found}, {r.bucket: r.target for r in found}
    out = []
    for part in (range(i * BUCKETS, (i + 1) * BUCKETS) for i in range(FAMILIES)):
        r, t = (sum(x.get(k, 0) for k in part) for x in (raw, target))
        share = t / max(r, 1) or 1.0  # as much smoothing, by size, as in the raw model
        out += [round(math.log((target.get(k, 0) + PRIOR * share) / (t + PRIOR * share * BUCKETS)) - math.log((raw.get(k, 0) + PRIOR) / (r + PRIOR * BUCKETS)), 6) for k in part]
    return out if sum(target.values()) else None


def placed(g: Column) -> Column:
    """Hashes in order, each with its position in its lowest bits. A column of its own, so that the sort is one of primitives, in generated code."""
    return F.sort_array(F.transform(g, lambda x, i: F.shiftleft(F.shiftright(x, SHIFT), SHIFT).bitwiseOR(i.cast("long"))))


def repeated(g: Column, packed: Column) -> Column:
    """Words in windows whose hash, in g (and placed in packed), occurs more than once."""
    at = lambda x: x.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")
    neighbours = lambda s, hit: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), hit)

    def alike(s: Column) -> Column:
        """Positions whose upper bits also another has."""
        both = neighbours(s, lambda a, b: F.when(F.shiftright(a, SHIFT) == F.shiftright(b, SHIFT), F.array(at(a), at(b))))
        return F.array_distinct(F.flatten(F.filter(both, lambda p: p.isNotNull())))

    def positions(few: Column) -> Column:
        """Of those, the ones whose whole hash another has."""
        whole = F.transform(F.array(F.array_sort(F.transform(few, lambda i: F.struct(F.get(g, i).alias("h"), i.alias("i"))))), lambda s: neighbours(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        return F.when(F.size(few) < 2, F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(F.flatten(F.filter(F.flatten(whole), lambda p: p.isNotNull())))))

    found = F.transform(F.transform(F.array(packed), alike), positions)
    covered = F.aggregate(
        F.get(found, F.lit(0)),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    # Most texts repeat nothing, and one pass says so.
    return F.when((F.size(g) < 2) | (F.size(F.array_distinct(g)) == F.size(g)), F.lit(0).cast("long")).otherwise(covered)


def rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, most: int = TRUSTED) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept."""
    ours = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ours])
    table_ = weights(docs, trusted, most)
    w, h, two, three, at = fresh(docs, "_w", "_h", "_two", "_three", "_at")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(w, words(F.col("text"))).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumn(two, joined(F.col(h), F.col(h), 1)).withColumn(three, joined(F.col(two), F.col(h), 2))
    out = out.withColumn(at, placed(F.col(three)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated(F.col(three), F.col(at)).alias("n_repeat_words"),
        (_score(table_, F.col(w), F.col(h), F.col(two)) if table_ else F.lit(0.0)).alias("llr"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def _score(table_: list[float], w: Column, h: Column, two: Column) -> Column:
    """Mean weight of a row's n-grams, those of grams(w, h), each looked up where it is hashed."""
    word, pair, end = (F.split(F.lit(",".join(map(str, table_[i * BUCKETS : (i + 1) * BUCKETS]))), ",").cast("array<double>") for i in range(FAMILIES))
    total = F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.get(word, bucket(x)))
    total = F.aggregate(w, total, lambda acc, x: acc + F.get(end, bucket(ending(x))))
    total = F.aggregate(two, total, lambda acc, x: acc + F.get(pair, bucket(x)))
    return F.round(total / F.greatest(3 * F.size(w) - 1, F.lit(1)), 9)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).drop("text")
