"""Near-duplicate documents by an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. Every text's set of 5-word shingles (64-bit hashes) gives a digest and a signature of `COORDS` minima. Documents of one
   digest are one class, represented by its smallest doc_id: copies never meet each other again.
2. Pairs of Jaccard similarity s agree in COORDS * s coordinates on average; pairs that agree in fewer than `matches(percent)`
   are out, a number that a pair at the threshold misses with a chance of `MISSED` at most. Two signatures
   that agree in m places share one of any COORDS - m + 1 of their coordinates, if both choose by one order:
   so each document is posted under that prefix only, rarest coordinate-value pairs first, and the lists of that prefix are merged. The others, those
   of common passages, are skipped, and the count of collisions is completed by probing the two signatures.
3. Collisions are counted on four bits of each coordinate (never too low). Round one compares every document of a posting list with
   the list's smallest only; components of the pairs that agree are candidate groups. Round two takes lists that still hold
   several groups and joins documents of different groups and of sizes that allow the similarity (by bands of sizes, so that no
   others meet), and merges groups that agree. So any two documents that agree are in one group, and a group costs its size in rows.
4. Each group's full sets meet in one task and are compared there, whole, by their incidence matrix. A group of more than `BLOCK`
   documents is first compared with one of its members, the one whose postings the others share most: that is its size in rows.
   Only members that this one isn't linked with are then compared with all others, in blocks. Only links to a local root leave a task.
5. Components of these by hooking and pointer jumping; smallest doc_id reachable.

Everything is joined and aggregated; hot posting lists are a skewed join that adaptive execution splits. Only the table of
coordinate frequencies, 2 ** `FREQUENCY_BITS` numbers, comes to the driver. Intermediate tables lie in the shared folder.

Null, empty and blank texts have no shingles and link with nothing. Repeated rows are copies of one class; of one doc_id with several texts each text is
a class, and all have the smallest component of any. A null doc_id takes no part and is kept. Extra columns aren't used; an empty table gives an empty
result. Texts may be of any length.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, maybe_in, stored, table
from .graph_components import components, local_roots

SHINGLE, COORDS = 5, 128
PERCENT = 85
#: The chance, at most, that a pair at the threshold is no candidate.
MISSED = 2e-6
FREQUENCY_BITS = 17
#: Documents of a group compared at once with as many others.
BLOCK = 256
CACHE = 60_000
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int) -> int:
    """The most coordinates that may be asked for: fewer agree with a chance of MISSED at most."""
    p, below = percent / 100, 0.0
    for m in range(COORDS):
        below += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if below > MISSED:
            return m
    return COORDS


class Hasher:
    """Shingle sets of texts; hashes of words met are kept, in two generations."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        found = text.lower().split()  # bytes: only A-Z change, and only ASCII white space divides
        get = self.cache.get
        out = list(map(get, found))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = found[i]
                    x = self.cache.get(w)
                    if x is None:
                        x = self.older.get(w)
                        self.cache[w] = x = xxhash.xxh3_64_intdigest(w) if x is None else x
                    out[i] = x
            if len(self.cache) > CACHE:
                self.cache, self.older = {}, self.cache
        return np.array(out, dtype=np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes."""
        w = self.words(text or b"")
        if not len(w):
            return w
        k = min(SHINGLE, len(w))
        with np.errstate(over="ignore"):
            h = np.full(len(w) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                h += w[i : len(w) - k + 1 + i] * _PLACES[i]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """COORDS minima, their upper 32 bits."""
    low = np.full(COORDS, 2**64 - 1, dtype=np.uint64)
    for a in range(0, len(h), 2048):
        low = np.minimum(low, (h[a : a + 2048, None] * _MULTIPLIERS).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig)."""

    def run(batches):
        own = Hasher()
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                h = own.shingles(text.as_py())
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, digest binary, sig binary")


def tokens(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, COORDS) 64-bit names of (coordinate, value)."""
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u4").reshape(-1, COORDS).astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (sig << np.uint64(8) | np.arange(COORDS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(29))


def frequencies(reps: DataFrame) -> np.ndarray:
    """How often coordinate values occur, by 2 ** FREQUENCY_BITS hashed buckets."""

    def run(batches):
        total = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((tokens(batch) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64).ravel(), minlength=1 << FREQUENCY_BITS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["b", "n"])

    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for r in mapped(reps.select("sig"), run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def posted(reps: DataFrame, often: np.ndarray, percent: int) -> DataFrame:
    """(token, rep): each representative under the rarest COORDS - matches + 1 of its coordinate values."""
    most = COORDS - matches(percent) + 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = tokens(batch)
            f = often[(t >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
            order = np.lexsort((t, f), axis=1)[:, :most]
            rep = np.repeat(batch.column("rep").to_numpy(), most)
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(t, order, 1).ravel().view(np.int64)), pa.array(rep)], names=["token", "rep"])

    return mapped(reps.select("rep", "sig"), run, "token long, rep long")


SKETCH = [f"s{i}" for i in range(COORDS * 4 // 64)]


def sketched(reps: DataFrame) -> DataFrame:
    """(rep, n, s0, s1, ...): four bits of every coordinate, bit planes of 64 coordinates in a long each."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u4").reshape(-1, COORDS)
                planes = [np.packbits((sig >> np.uint32(k)) & np.uint32(1), axis=1).view("<i8") for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), *(pa.array(np.ascontiguousarray(x[:, i])) for x in planes for i in range(COORDS // 64))], names=["rep", "n", *SKETCH])

    return mapped(reps.select("rep", "n", "sig"), run, "rep long, n long, " + ", ".join(f"{c} long" for c in SKETCH))


def side(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in SKETCH])


def agree(percent: int) -> Column:
    """Whether a and b agree in enough coordinates, and their sizes allow the similarity."""
    words = COORDS // 64
    differ = [F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in SKETCH]
    off = sum(F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), differ[i::words])) for i in range(words))
    return (off <= COORDS - matches(percent)) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def grouped(post: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(rep, component): candidate groups of two or more representatives."""
    lead = post.groupBy("token").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("token", "a")
    first = stored(post.join(lead, "token").where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    like = stored(first.join(side(sketches, "b"), "b").join(side(sketches, "a"), "a").where(agree(percent)).select("a", "b"))
    label = components(like).select(F.col("id").alias("rep"), "component")
    marked = post.join(label, "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("component"))
    split = marked.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    some = stored(marked.join(split, "token").join(sketches, "rep"))
    # Sizes of similar sets lie in one band or in neighbouring ones: a is the smaller set, b meets its own band's and the one's below.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    left, right = (some.select("token", band.alias("band"), F.col("component").alias(f"c_{x}"), F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in SKETCH]) for x in ("a", "b"))
    right = right.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") - 2)))
    pairs = left.join(right, ["token", "band"]).where(F.expr("c_a <> c_b and (n_a < n_b or (n_a = n_b and a < b))") & agree(percent))
    more = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return components(like.unionByName(more)).select(F.col("id").alias("rep"), "component")


def linked(sets: list[np.ndarray], percent: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """For each set the position of its local root, by links between all pairs of a left and a right set."""
    n = np.array([len(x) for x in sets])
    near = np.zeros((len(sets), len(sets)), bool)
    if min(left.sum(), right.sum()) < 3:
        turned = left.sum() > right.sum()
        one, other = (np.flatnonzero(x) for x in ((right, left) if turned else (left, right)))
        for i in one.tolist():
            for j in other.tolist():
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                near[i, j] = 100 * common >= percent * (n[i] + n[j] - common)
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = times[at] > 1  # a shingle of one set alone is in no intersection
        _, at = np.unique(at[keep], return_inverse=True)
        owner = owner[keep]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(at.max(initial=-1)) + 1, 8192):
            part = (at >= a) & (at < a + 8192)
            x = np.zeros((len(sets), 8192), np.float32)
            x[owner[part], at[part] - a] = 1
            common += x @ x.T
        near = (100 * common >= percent * (n[:, None] + n[None] - common)) & left[:, None] & right[None]
    np.fill_diagonal(near, False)
    return local_roots(len(sets), *np.nonzero(near)).tolist()


def compared(docs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that have the components of all links between a left and a right text of a unit, from (g, rep, left, right); a rep has one text."""
    texts = docs.where(maybe_in(units, "rep", "doc_id")).select(F.col("doc_id").alias("rep"), "text").join(units, "rep").select("g", "rep", "text", "left", "right")

    def run(batches):
        own, g, reps, sets, sides = Hasher(), None, [], [], []

        def links():
            root = linked(sets, percent, *np.array(sides, bool).T) if len(sets) > 1 else [0]
            found = [(reps[r], reps[i]) for i, r in enumerate(root) if r != i and reps[r] != reps[i]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, rep, text, a, b in zip(*(batch.column(c).cast(pa.binary()) if c == "text" else batch.column(c).to_pylist() for c in ("g", "rep", "text", "left", "right")), strict=True):
                if k != g:
                    yield links()
                    g, reps, sets, sides = k, [], [], []
                reps.append(rep)
                sides.append((a, b))
                sets.append(own.shingles(text.as_py()))
        yield links()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(texts.repartition(n, "g").sortWithinPartitions("g", "rep"), run, "a long, b long")


def blocks_of(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def dealt(column: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")


def confirmed(docs: DataFrame, groups: DataFrame, post: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), on full sets, that have the components of all pairs of a group with 100 * intersection >= percent * union."""
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("size")), "component")
    true = F.lit(True)
    small = sized.where(F.col("size") <= BLOCK).select(F.xxhash64("component").alias("g"), "rep", true.alias("left"), true.alias("right"))
    found = stored(compared(docs, stored(small), percent))
    large = stored(sized.where(F.col("size") > BLOCK))
    if large.isEmpty():
        return found
    # Of each large group the member whose postings the others share most.
    own = stored(post.where(maybe_in(large, "rep", "rep")).join(large.select("rep", "component"), "rep"))
    shared = own.groupBy("component", "token").agg(F.count("*").alias("n"))
    score = own.join(shared, ["component", "token"]).groupBy("component", "rep").agg(F.sum("n").alias("n"))
    pivots = stored(score.groupBy("component").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("pivot")))
    rows = large.join(pivots, "component").withColumn("parts", blocks_of(F.col("size")))
    others = rows.where("rep <> pivot").withColumn("part", dealt("rep", "parts"))
    stars = others.select("component", "part", "rep", F.lit(False).alias("left"), true.alias("right"))
    heads = rows.where("rep = pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stars = stars.unionByName(heads.select("component", "part", "rep", true.alias("left"), F.lit(False).alias("right")))
    star = stored(compared(docs, stored(stars.select(F.xxhash64("component", "part").alias("g"), "rep", "left", "right")), percent))
    # Members that aren't linked with it are compared with all others.
    near = star.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    open_ = stored(others.select("component", "rep", "parts").join(near, "rep", "left_anti"))
    many = open_.groupBy("component").agg(blocks_of(F.count("*")).alias("open_parts"))
    left = open_.join(many, "component").withColumn("l", dealt("rep", "open_parts")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = rows.join(many, "component").withColumn("r", dealt("rep", "parts")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("open_parts") - 1)))
    sides = left.select("component", "l", "r", "rep", true.alias("left"), F.lit(False).alias("right")).unionByName(right.select("component", "l", "r", "rep", F.lit(False).alias("left"), true.alias("right")))
    units = sides.groupBy(F.xxhash64("component", "l", "r").alias("g"), "rep").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    return found.unionByName(star).unionByName(stored(compared(docs, stored(units), percent)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text)."""
    rows = stored(signed(docs))
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    reps = stored(classes)
    post = stored(posted(reps, frequencies(reps), percent))
    groups = stored(grouped(post, stored(sketched(reps)), percent))
    label = components(confirmed(docs, groups, post, percent)).select(F.col("id").alias("rep"), "component")
    whole = reps.select("digest", "rep").join(label, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without documents whose component has a smaller one."""
    found = stored(near_duplicates(docs))
    gone = stored(found.where("not kept").select("doc_id"))
    maybe = maybe_in(gone, "doc_id", "doc_id")
    out = docs.where(~maybe).unionByName(docs.where(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns))
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
