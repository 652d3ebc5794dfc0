"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

Each task splits whole texts into the pattern's matches, takes the distinct ones it hasn't met
and folds the ranked merges over all of them at once: a matrix of byte tokens, a row for each
word, loses the lowest-ranked adjacent pair of every row in each step until no pair has a rank.
The rank map is a literal (the vocabulary file's bytes travel with the plan). Decoding joins
the binary pieces of the ids. No shuffle; memory is bounded by two caches of `cache` words.

`encode_native` is the same with Spark's higher-order functions alone: the ranks of pairs are a literal of two
arrays (a pair lies in one of two places, so a look-up is constant), the corpus's frequent words are folded
once as a table of distinct words and travel as a literal too, and a word outside it is folded in its row. It
gives the same ids and shuffles next to nothing, but costs more than the check's limit (README has figures).

A null text is an empty one: no ids. Extra columns are kept, but for clashing ones, in any case of letters, which give way
to ours; repeated rows are encoded each; ties don't arise. An empty table gives an empty result. Texts and pieces may be of any length: a long
piece merges over a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, table

#: Words whose ids a Python worker keeps in each of two generations, by default: words met again outlive a change.
CACHE = 300_000
#: Characters of texts that a task encodes at once, by default.
SPAN = 1 << 21
#: Cells of the matrix that is folded at once.
CELLS = 1 << 17
#: Pieces of more bytes merge one by one with a heap.
LONG = 48
_NONE = np.int64(1 << 40)
#: White space as the tokenizer's regular expressions have it (Unicode's White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ranks_of(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


def splitter(pattern: str = public_tokenizers.PATTERN):
    """pattern with white space spelled out."""
    inside = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


class Coder:
    """Ranks, and ids of pieces by folding ranked merges."""

    def __init__(self, blob: bytes):
        self.most = CACHE
        self.rank = ranks_of(blob)
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.to = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.find = splitter().findall

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, or _NONE."""
        k = np.where(right < 0, -1, left << 20 | right)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.to[at], _NONE)

    def ranked(self, left: int, right: int) -> int | None:
        k = left << 20 | right
        at = int(np.searchsorted(self.keys, k))
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == k else None

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of about one length (at most LONG bytes)."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        cols = np.arange(width)
        ids = np.where(cols < size[:, None], self.byte[flat], -1)
        out = ids.copy()
        live, rank = np.arange(n), self.joined(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 1), _NONE)
        while True:
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), j]
            go = best < _NONE
            if not go.all():
                out[live[~go]] = ids[~go]
                live, ids, rank, j, best = live[go], ids[go], rank[go], j[go], best[go]
            if not len(live):
                return [row[:k] for row, k in zip(out.tolist(), (out >= 0).sum(axis=1).tolist(), strict=True)]
            row = np.arange(len(live))
            move = np.minimum(cols + (cols > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, move, 1)
            ids[:, -1] = -1
            ids[row, j] = best
            rank = np.take_along_axis(rank, np.minimum(move[:, :-1], width - 2), 1)
            rank[:, -1] = _NONE
            right = np.where(j + 1 < width, ids[row, np.minimum(j + 1, width - 1)], -1)
            rank[row, np.minimum(j, width - 2)] = np.where(j < width - 1, self.joined(best, right), _NONE)
            has = j > 0
            rank[row[has], j[has] - 1] = self.joined(ids[row[has], j[has] - 1], best[has])

    def fold_long(self, word: bytes) -> list[int]:
        """Ids of a piece of any length: a heap of ranked pairs over a linked list."""
        ids = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.joined(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()
        heap = [(r, i, a, b) for i, (r, a, b) in enumerate(zip(ranks, ids, ids[1:], strict=False)) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= len(ids) or ids[k] != b:
                continue
            ids[i], ids[k], after[i] = r, -1, after[k]
            if after[i] < len(ids):
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (s := self.ranked(ids[p], ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if (r := self.rank.get(w)) is not None:
                out[i] = [r]
            elif len(w) > LONG:
                out[i] = self.fold_long(w)
            elif w:
                groups.setdefault(-(-len(w) // 4), []).append(i)
        for width, at in groups.items():
            step = CELLS // (4 * width)
            for s in range(0, len(at), step):
                part = at[s : s + step]
                for i, ids in zip(part, self.fold([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def known(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """For each text its pieces' (ids as b" 1 2", bytes decoded from the ids)."""
        pieces = [self.find(t) for t in texts]
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        new = list(set().union(*pieces).difference(self.cache))
        old = [self.older.get(w) for w in new]
        self.cache.update((w, x) for w, x in zip(new, old, strict=True) if x)
        new = [w for w, x in zip(new, old, strict=True) if not x]
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.cache[w] = ("".join(f" {i}" for i in ids).encode(), self.decode(ids))
        get = self.cache.__getitem__
        return [[get(p) for p in x] for x in pieces]


_coders: dict[int, Coder] = {}


def coder(blob: bytes) -> Coder:
    """One coder for each worker process and vocabulary."""
    if (k := hash(blob)) not in _coders:
        _coders.clear()
        _coders[k] = Coder(blob)
    return _coders[k]


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def blocks(texts: list[str | None], most: int = 1 << 19):
    """(start, end) of runs of texts of about most characters."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, cache: int = CACHE, span: int = SPAN) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    blob = rank_file(path)
    kept = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    fields = [docs.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches):
        own = coder(blob)
        own.most = cache
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts, span):
                n, sha, back, every = [], [], [], []
                for parts in own.known([t or "" for t in texts[a:b]]):
                    ids = b"".join([p[0] for p in parts])
                    n.append(ids.count(b" "))
                    sha.append(hashlib.sha256(ids[1:]).hexdigest())
                    back.append(hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest())
                    if with_ids:
                        every.append(np.array(ids.split(), dtype=np.int32))
                part = batch.slice(a, b - a)
                cols = [part.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(every) if every else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        own.cache, own.older = {}, {}  # workers outlive the stage; what it kept is not for the next one's budget

    return mapped(docs.select(*kept, "text"), run, schema)


NO_RANK = 1 << 30
#: Bits of a token's id in a packed pair.
ID_BITS = 17


def pair_tables(pairs: dict[int, int]) -> tuple[list[list[int]], tuple[int, int]]:
    """Two tables of packed (pair, rank), -1 where empty, and the multiplier of each: every pair lies at one of its two places."""
    size = max(8, 2 * len(pairs)) | 1
    for way in ((40503, 48271), (69621, 16807), (39373, 62089)):
        found = [[-1] * size, [-1] * size]
        for k, r in pairs.items():
            entry, t = k << ID_BITS | r, 0
            for _ in range(500):
                a, b = entry >> 2 * ID_BITS, entry >> ID_BITS & (1 << ID_BITS) - 1
                at = (a * way[0] + b if t == 0 else a + b * way[1]) % size
                entry, found[t][at] = found[t][at], entry
                t = 1 - t
                if entry < 0:
                    break
            else:
                break
        else:
            return found, way
    raise ValueError("the pairs fit no table")


def numbers(xs: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


class NativeCoder:
    """Columns: ids of words by folding ranked merges, and token bytes of ids; the vocabulary is a literal."""

    def __init__(self, ranks: dict[bytes, int] | None = None):
        self.ranks = ranks or ranks_of(rank_file())
        if max(self.ranks.values()) >= 1 << ID_BITS:
            raise ValueError(f"ranks over {1 << ID_BITS}")
        get = self.ranks.get
        pairs = {get(t[:i]) << ID_BITS | get(t[i:]): r for t, r in self.ranks.items() for i in range(1, len(t)) if get(t[:i]) is not None and get(t[i:]) is not None}
        (first, second), self.way = pair_tables(pairs)
        self.size, self.first, self.second = len(first), numbers(first), numbers(second)
        self.byte = numbers([get(bytes([b]), 0) for b in range(256)])
        token = {r: t for t, r in self.ranks.items()}
        self.token = F.split(F.lit(",".join(token.get(r, b"").hex() for r in range(max(token) + 1))), ",")

    def rank(self, a: Column, b: Column) -> Column:
        key = F.shiftleft(a, ID_BITS).bitwiseOR(b)
        places = F.array(F.get(self.first, ((a * self.way[0] + b) % self.size).cast("int")), F.get(self.second, ((a + b * self.way[1]) % self.size).cast("int")))
        own = F.filter(places, lambda e: F.shiftright(e, ID_BITS) == key)
        return F.coalesce(F.get(own, F.lit(0)).bitwiseAND(F.lit((1 << ID_BITS) - 1)), F.lit(NO_RANK).cast("long"))

    def ids(self, word: Column) -> Column:
        """A fold of as many steps as the word has bytes: each merges the first of the best-ranked adjacent pairs."""
        raw = F.hex(F.encode(word, "UTF-8"))
        byte = lambda i: F.get(self.byte, F.conv(raw.substr(i, F.lit(2)), 16, 10).cast("int"))
        start = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2)), byte)).otherwise(F.array().cast("array<bigint>"))

        def step(ids, _):
            n = F.size(ids)
            pairs = F.zip_with(F.slice(ids, 1, F.greatest(n - 1, F.lit(0))), F.slice(ids, 2, F.greatest(n - 1, F.lit(0))), self.rank)
            merged = lambda p: F.when(F.coalesce(F.array_min(p), F.lit(NO_RANK)) == NO_RANK, ids).otherwise(
                F.concat(F.slice(ids, 1, F.array_position(p, F.array_min(p)).cast("int") - 1), F.array(F.array_min(p)), F.slice(ids, F.array_position(p, F.array_min(p)).cast("int") + 2, n))
            )
            return F.get(F.transform(F.array(pairs), merged), F.lit(0))

        whole = F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(raw) / 2, F.lit(2)).cast("int")), start, step)
        return F.when(F.size(start) < 2, start).otherwise(whole)

    def decoded(self, ids: Column) -> Column:
        """The tokens' binary pieces, joined."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.token, i.cast("int"))), ""))


def encode_words_native(words: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(word, ids) by Spark's higher-order functions alone, for a table of distinct words."""
    return words.select("word", NativeCoder(ranks).ids(F.col("word")).alias("ids"))


def java_pattern() -> str:
    return public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def encode_native(docs: DataFrame, bits: int = 17, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by DataFrame functions alone.

    Of the words that the corpus holds most often, those that share no place among 2 ** bits are folded as a table and
    travel as a literal; which they are decides speed only. Letters are those of the JVM's Unicode version.
    """
    own, slots = NativeCoder(ranks), 1 << bits
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(java_pattern()), F.lit(0))
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(slots))
    counts = docs.select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # One word for each place: slots rows at most come to the driver.
    best = counts.groupBy(place(F.col("word")).alias("at")).agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    known = {r["at"]: r for r in best.select("at", "word", own.ids(F.col("word")).alias("ids")).collect()}
    hexed = [known[i]["word"].encode().hex() if i in known else "-" for i in range(slots)]
    given = [" ".join(map(str, known[i]["ids"])) if i in known else "-" for i in range(slots)]
    names, values = (F.split(F.lit(",".join(x)), ",") for x in (hexed, given))
    key = lambda w: F.lower(F.hex(F.encode(w, "UTF-8")))
    shown = lambda w: F.when(F.get(names, place(w).cast("int")) == key(w), F.get(values, place(w).cast("int"))).otherwise(F.array_join(own.ids(w).cast("array<string>"), " "))
    out = docs.select("doc_id", F.array_join(F.transform(pieces, shown), " ").alias("shown"))
    ids = F.when(F.col("shown") == "", F.array().cast("array<bigint>")).otherwise(F.split("shown", " ").cast("array<bigint>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2("shown", 256).alias("ids_sha256"), F.sha2(own.decoded(ids), 256).alias("decoded_sha256"))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
