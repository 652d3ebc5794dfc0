"""Token ids in binary files, with a minimal perfect hash index from document keys to offsets.

Layout of a shard (little endian): payload of ids (uint16 if the vocabulary allows it, else
uint32), then a footer: keys int64[n], of which the first ones may be null, offsets uint64[n + 1] (in ids), displacements int32[b],
fingerprints uint32[d], slots uint32[d], and a header of 8 fields at the very end. d is the number of
distinct keys. A key hashes to one of b buckets; the bucket's displacement sends it to a slot of
its own; the slot holds a fingerprint, which refuses most foreign keys, and the key's record.
A look-up is one hash, one displacement, one slot and one offset, whatever the shard's size; shards
are ordered by key, so a reader finds the shard among their first keys.

Writing: documents are range-partitioned by key, each partition streams its ids into one
shard of a unique name, and only names that tasks return count (a lost task leaves an orphan, not
a double). They return to the driver, a row for each shard, which writes the manifest as one file: Hadoop's local
file system starts a process for each file and folder that a task makes, and a JVM that does so stands in memory twice for a moment. A shard's ids are never held whole; its keys and counts (16 bytes a document) and its index
(some 100 bytes a document while it is built) are. There are as many shards as the range partitioning makes, so
`spark.sql.shuffle.partitions` bounds a shard's size.

A null text is an empty one: the end id alone. A document with a null key is written, first in
order, but has no index entry. Repeated keys are neighbours, ordered by text; the index has the first. Texts may be of any length, their
ids are written as they come. Extra columns aren't read. Files of an empty table: none.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import blocks
from .common import mapped, shared_dir, table

END_ID = 2
#: Words whose ids a Python worker keeps in each of two generations: words met again outlive a change.
CACHE = 500_000
_HEADER = "<8sIQQQQQQ"
_MAGIC = b"QGTOKEN1"
#: The tokenizer's pieces of a lower-case ASCII word.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each key (SplitMix64's finaliser)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def place(keys: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys under displacements d: a negative one names the slot, others reseed the hash."""
    with np.errstate(over="ignore"):
        z = mixed(keys, 1) ^ (d.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = z ^ (z >> np.uint64(29))
    return np.where(d < 0, -d.astype(np.int64) - 1, (z % np.uint64(max(n, 1))).astype(np.int64))


class PerfectHash:
    """Hash and displace: large buckets first, those of one key take what is left."""

    def __init__(self, n: int, displacements: np.ndarray, fingerprints: np.ndarray, records: np.ndarray):
        self.n, self.d, self.prints, self.records = n, displacements, fingerprints, records

    @classmethod
    def build(cls, keys: np.ndarray, records: np.ndarray) -> PerfectHash:
        """All buckets of one size try the same displacement at once; those that find free slots, first come first served, are done."""
        n, b = len(keys), max(1, len(keys) // 3)
        bucket = (mixed(keys, 0) % np.uint64(b)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(b + 1))
        sizes = np.diff(starts)
        d, used, slot = np.zeros(b, np.int32), np.zeros(n, bool), np.zeros(n, np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            left, t = np.flatnonzero(sizes == size), 0
            while len(left):
                own = order[starts[left][:, None] + np.arange(size)]
                at = place(keys[own], np.full(own.shape, t), n)
                free = ~used[at].any(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                few = np.flatnonzero(free)
                flat = at[few].ravel()
                _, first = np.unique(flat, return_index=True)
                mine = np.zeros(len(flat), bool)
                mine[first] = True
                won = few[mine.reshape(-1, size).all(axis=1)]
                d[left[won]], slot[own[won]], used[at[won]] = t, at[won], True
                left, t = np.delete(left, won), t + 1
        single = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(~used)[: len(single)]
        d[single], slot[order[starts[single]]] = -rest - 1, rest
        prints, to = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        prints[slot], to[slot] = (mixed(keys, 2) >> np.uint64(32)).astype(np.uint32), records
        return cls(n, d, prints, to)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Records of keys, -1 where the fingerprint differs."""
        if not self.n:
            return np.full(len(keys), -1)
        slot = place(keys, self.d[(mixed(keys, 0) % np.uint64(len(self.d))).astype(np.int64)], self.n)
        same = self.prints[slot] == (mixed(keys, 2) >> np.uint64(32)).astype(np.uint32)
        return np.where(same, self.records[slot].astype(np.int64), -1)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


class Shard:
    """Reads one shard: the footer at once, ids where they are asked for."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - struct.calcsize(_HEADER))
        magic, width, nulls, n, d, b, tokens, crc = struct.unpack(_HEADER, self.file.read(struct.calcsize(_HEADER)))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.type = np.dtype(f"<u{width}")
        size = 8 * n + 8 * (n + 1) + 4 * b + 8 * d
        self.file.seek(end - struct.calcsize(_HEADER) - size)
        raw = self.file.read(size)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{uri}: damaged footer")
        take, at = {}, 0
        for name, kind, k in (("keys", "<i8", n), ("offsets", "<u8", n + 1), ("d", "<i4", b), ("prints", "<u4", d), ("records", "<u4", d)):
            take[name] = np.frombuffer(raw, dtype=kind, count=k, offset=at)
            at += take[name].nbytes
        self.keys, self.offsets, self.tokens, self.nulls = take["keys"], take["offsets"].astype(np.int64), tokens, nulls
        self.index = PerfectHash(d, take["d"], take["prints"], take["records"])

    def ids(self, record: int) -> np.ndarray:
        a, b = self.offsets[record], self.offsets[record + 1]
        self.file.seek(int(a) * self.type.itemsize)
        return np.frombuffer(self.file.read(int(b - a) * self.type.itemsize), dtype=self.type)

    def get(self, key: int) -> np.ndarray | None:
        k = int(self.index.get(np.array([key]))[0])
        return None if k < self.nulls or self.keys[k] != key else self.ids(k)


_words: dict = {}


class WordIds:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    The tokenizer drops white space and no token crosses it, so a text's ids are its words' ids.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec.decode())
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tok.get_vocab()
        self.end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # Bytes split at ASCII white space. The tokenizer lowers case itself; special tokens are matched before it does.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        new = list(set().union(*split).difference(self.cache))
        if self.older:
            old = list(map(self.older.get, new))
            self.cache.update((w, x) for w, x in zip(new, old, strict=True) if x is not None)
            new = [w for w, x in zip(new, old, strict=True) if x is None]
        for i in range(0, len(new), 16_384):
            self.cache.update(self.encoded(new[i : i + 16_384]))
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Plain ASCII words go to the library many at a time: each ends with the last of its pieces, and every piece's last id is an end."""
        code, out = "H" if self.type.itemsize == 2 else "I", {}
        plain = [w for w in words if w.isascii() and b"<|" not in w]
        for i in range(0, len(plain), 64 * 256):
            part = plain[i : i + 64 * 256]
            lines = [part[k : k + 64] for k in range(0, len(part), 64)]
            pieces = [len(_PIECE.findall(w.lower())) for w in part]
            found = [e.ids for e in self.batch([b" ".join(x).decode() for x in lines], add_special_tokens=False)]
            ids = np.concatenate([np.array(x, dtype=np.int64) for x in found])
            ends = np.flatnonzero(self.end[ids]) + 1
            line = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            own = np.add.reduceat(pieces, np.arange(0, len(part), 64))
            if (np.diff(np.searchsorted(ends, line, side="right")) != own).any():  # a word of unforeseen pieces: each word by itself
                continue
            at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])] * self.type.itemsize
            raw, at = ids.astype(self.type).tobytes(), at.tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(part, at, at[1:], strict=False))
        rest = [w for w in words if w not in out]
        for w, e in zip(rest, self.batch([w.decode() for w in rest], add_special_tokens=False), strict=True):
            out[w] = array(code, e.ids).tobytes()
        return out


def word_ids(spec: bytes) -> WordIds:
    import os

    if (k := hash(spec)) not in _words:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _words.clear()
        _words[k] = WordIds(spec)
    return _words[k]


MANIFEST = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("first_key", T.LongType()), T.StructField("last_key", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Writes docs' ids as shards in folder; returns the manifest (a row for each shard), which is written there too."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        spec = f.read()
    store, top = opened(f"{folder}/manifest")
    if store.get_file_info(top).type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} has shards already")
    names = pa.schema([("name", pa.string())] + [(k, pa.int64()) for k in MANIFEST.names[1:]])

    def run(batches):
        own, fs, out = None, None, None
        keys, nulls, counts = array("q"), 0, array("q")
        name = f"shard-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                own = word_ids(spec)
                fs, at = opened(folder)
                fs.create_dir(at, recursive=True)
                out, tail = fs.open_output_stream(f"{at}/{name}"), np.array([end_id], own.type).tobytes()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            nulls += batch.column(0).null_count  # they come first
            keys.extend(batch.column(0).fill_null(0).to_pylist())
            for a, b in blocks(texts, 1 << 22):
                for raw in own.encode([t or b"" for t in texts[a:b]]):
                    out.write(raw + tail)
                    counts.append((len(raw) + len(tail)) // own.type.itemsize)
        if out is None:
            return
        keys, offsets = np.frombuffer(keys, "<i8"), np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int64))]).astype("<u8")
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        new[:nulls], new[nulls : nulls + 1] = False, True
        new = np.flatnonzero(new)
        index = PerfectHash.build(keys[new], new)
        foot = b"".join([keys.tobytes(), offsets.tobytes(), index.d.astype("<i4").tobytes(), index.prints.astype("<u4").tobytes(), index.records.astype("<u4").tobytes()])
        out.write(foot + struct.pack(_HEADER, _MAGIC, own.type.itemsize, nulls, len(keys), len(new), len(index.d), int(offsets[-1]), zlib.crc32(foot)))
        out.close()
        yield pa.RecordBatch.from_pylist([{"name": name, "first_key": int(keys[nulls]) if nulls < len(keys) else None, "last_key": int(keys[-1]) if nulls < len(keys) else None, "n_docs": len(keys), "n_tokens": int(offsets[-1])}], schema=names)

    # Keys first, so that sampling for the ranges reads no texts' ids; ties by text, so that reruns agree.
    ranged = docs.select(F.col(key).cast("long").alias("_key"), "text").repartitionByRange("_key").sortWithinPartitions("_key", "text")
    rows = [r.asDict() for r in mapped(ranged, run, MANIFEST).collect()]
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/part-0.parquet") as f:
        pq.write_table(pa.Table.from_pylist(rows, schema=names), f)
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: each record is found through its shard's index."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # Shards are few: one for each partition written.
    starts = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(W.orderBy(F.col("first_key").asc_nulls_first(), "name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(f"{folder}/{row['name']}")
                record = np.arange(len(shard.keys))
                own = np.arange(shard.nulls, len(shard.keys))
                at = shard.index.get(shard.keys[own])
                if (at < 0).any() or (shard.keys[at] != shard.keys[own]).any():
                    raise ValueError(f"{row['name']}: its index misses a key")
                first = np.concatenate([[True], np.diff(shard.keys[own]) != 0])[: len(own)]
                record[own[first]] = at[first]
                for a in range(0, len(record), 4096):
                    part = record[a : a + 4096].tolist()
                    crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in part]
                    keys = [None if i < shard.nulls else k for i, k in zip(part, shard.keys[part].tolist(), strict=True)]
                    cols = [keys, (shard.offsets[part] + row["start"]).tolist(), (shard.offsets[np.array(part) + 1] - shard.offsets[part]).tolist(), crc]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=schema.names)

    # A number of partitions of its own, else AQE joins these few rows, of little size, in one task.
    spread = starts.select("name", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return mapped(spread, run, schema)


class TokenStore:
    """Keyed access to a folder of shards: the shard by its first key, the record by the perfect hash."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where("first_key is not null").orderBy("first_key").collect()
        self.folder, self.first, self.names, self.open = folder, [r.first_key for r in rows], [r.name for r in rows], {}

    def get(self, key: int) -> np.ndarray | None:
        k = bisect.bisect_right(self.first, key) - 1
        if k < 0:
            return None
        if k not in self.open:
            self.open[k] = Shard(f"{self.folder}/{self.names[k]}")
        return self.open[k].get(key)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder)
