"""Near-duplicates among embeddings: p-stable hashing for Euclidean distance, then exact cosines.

Normalised vectors are projected on random Gaussian directions; each of `TABLES` tables joins `WIDE` quantised
projections, floor((a.v + b) / width), to a bucket. Vectors of one label and bucket are compared, in blocks,
by their cosine in double precision; a pair met in several tables counts in the first only.

Vectors that are bit for bit the same (with one label) are one class: they are compared once and linked among
themselves by their number, so copies don't multiply. Links are never listed: a block returns, for each vector, how
many it is linked with and the smallest vector of its local component. A bucket of more than `BLOCK` vectors is dealt
into blocks, and every pair of blocks is a group of its own, so that no group holds more than two blocks.

At a cosine of 0.93 (distance 0.374, width 1.5) a projection agrees with probability 0.80, so a pair is missed
by all tables with probability 0.02; closer pairs far less often.

Vectors of different lengths are never compared, those of each length have planes of their own. Vectors that are null, zero, hold a
null or non-finite number, or have a null label, link with nothing. A null vec_id is dropped from links but returned. Repeated vec_ids count
as vectors of their own. Empty tables give empty results. Extra columns aren't used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, table
from .graph_components import components, local_roots

COSINE = 0.93
TABLES, WIDE, WIDTH = 10, 5, 1.5
BLOCK = 2048


def coded(vectors: DataFrame, tables: int, wide: int, width: float, seed: int = 17) -> DataFrame:
    """(vec_id, label with the length, unit binary of doubles, codes array<long>) of the usable vectors."""
    mixer = np.random.default_rng(seed).integers(1, 1 << 62, wide) | 1
    schema = "vec_id long, label string, unit binary, codes array<long>"

    def run(batches):
        drawn: dict = {}
        for batch in batches:
            rows: dict = {}
            for i, k, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                if k is not None and v and None not in v and np.isfinite(x := np.array(v, dtype=np.float64)).all() and x.any():
                    rows.setdefault(len(v), []).append((i, k, x))
            for dim, own in rows.items():
                if dim not in drawn:
                    r = np.random.default_rng([seed, dim])
                    drawn[dim] = r.normal(size=(dim, tables * wide)), r.uniform(0, width, tables * wide)
                plane, shift = drawn[dim]
                x = np.stack([v for _, _, v in own])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                with np.errstate(over="ignore"):
                    q = np.floor((x @ plane + shift) / width).astype(np.int64).reshape(len(x), tables, wide)
                    codes = ((q + 7) * mixer).sum(axis=2)
                    codes ^= codes >> 31
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in own], pa.int64()), pa.array([f"{dim}|{k}" for _, k, _ in own]), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["vec_id", "label", "unit", "codes"],
                )

    return mapped(vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding"), run, schema)


#: Rows of whole groups that are compared in one go, and cells of a similarity matrix.
ROWS, CELLS = 20_000, 1 << 19


class Part:
    """Rows of whole groups, in order of group and rep."""

    def __init__(self, batch: pa.RecordBatch, starts: np.ndarray, least: float):
        num = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "rep", "n", "side", "split")}
        self.t, self.rep, self.n, self.side, self.split, self.least = *num.values(), least
        sizes = np.diff(np.append(starts, len(self.rep)))
        self.links, self.edges = np.zeros(len(self.rep), np.int64), [np.zeros((2, 0), np.int64)]
        codes = batch.column("codes")
        self.codes = codes.flatten().to_numpy().reshape(len(codes), -1) if len(codes) else np.zeros((0, 1), np.int64)
        units = batch.column("unit").to_pylist()
        length = np.array([len(u) for u in units]) // 8
        for size in np.unique(sizes[sizes > 1]).tolist():
            for dim in np.unique(length[starts[sizes == size]]).tolist():
                own = starts[(sizes == size) & (length[starts] == dim)]
                step = max(1, CELLS // (size * size))
                for a in range(0, len(own), step):
                    at = own[a : a + step, None] + np.arange(size)
                    x = np.frombuffer(b"".join([units[i] for i in at.ravel()]), dtype=np.float64).reshape(len(at), size, dim)
                    rows = max(1, CELLS // (len(at) * size))
                    for b in range(0, size, rows):
                        self.take(at, b, x[:, b : b + rows] @ x.transpose(0, 2, 1))

    def take(self, at: np.ndarray, first: int, cosines: np.ndarray) -> None:
        """Links of rows `first` and on of each group with later rows, if no earlier table has them."""
        k, i, j = np.nonzero(cosines >= self.least)
        i += first
        k, i, j = k[i < j], i[i < j], j[i < j]
        i, j = at[k, i], at[k, j]
        own = ~self.split[i] | (self.side[i] != self.side[j])  # two blocks: pairs within a block belong to that block's own group
        i, j = i[own], j[own]
        met = ((self.codes[i] == self.codes[j]) & (np.arange(self.codes.shape[1]) < self.t[i][:, None])).any(axis=1)
        i, j = i[~met], j[~met]
        np.add.at(self.links, i, self.n[j])
        np.add.at(self.links, j, self.n[i])
        self.edges.append(np.stack([i, j]))
        if sum(e.shape[1] for e in self.edges) > CELLS:
            self.edges = [np.stack([np.arange(len(self.rep)), self.roots()])]

    def roots(self) -> np.ndarray:
        return local_roots(len(self.rep), *np.concatenate(self.edges, axis=1))

    def result(self) -> pa.RecordBatch:
        keep = self.links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (self.rep, self.links, self.rep[self.roots()])], names=["rep", "links", "root"])


def compared(rows: DataFrame, least: float) -> DataFrame:
    """From (g, t, side, split, rep, n, unit, codes), a group's rows together: (rep, links, root)."""

    def run(batches):
        held: list = []

        def done(last: bool):
            """Whole groups; the last one may go on in the next batch."""
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = whole.column("g").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            end = len(g) if last else int(starts[-1])
            held[:] = [] if last else [whole.slice(end)]
            if end:
                yield Part(whole.slice(0, end), starts[starts < end], least).result()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from done(False)
        if held:
            yield from done(True)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(rows.repartition(n, "g").sortWithinPartitions("g", "rep"), run, "rep long, links long, root long")


def link(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, wide: int = WIDE, width: float = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding, label)."""
    own = stored(coded(vectors.where("vec_id is not null"), tables, wide, width))
    reps = stored(own.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("codes").alias("codes")))
    posted = reps.select("*", F.posexplode("codes").alias("t", "code"))
    sizes = posted.groupBy("label", "t", "code").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    posted = posted.join(sizes, ["label", "t", "code"])
    side = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    posted = posted.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.xxhash64("label", "t", "code", F.least("side", "other"), F.greatest("side", "other"))
    rows = posted.withColumn("split", F.col("side") != F.col("other")).withColumn("g", group)
    # A row meets its own block's group once, and each other block's in one group of two.
    other = rows.select("g", "t", "side", "split", "rep", "n", "unit", "codes")
    found = stored(compared(other, least))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = reps.select("label", "unit", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    whole = reps.select("label", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    mine = own.select("vec_id", "label", "unit").join(whole, ["label", "unit"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(mine, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
