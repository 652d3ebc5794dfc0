"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts become byte streams: UTF-8, ASCII letters in lower case, nothing left out. The network reads a stream in
segments of `STEPS` bytes, many at a time, labels every position from both directions, and a document's
probabilities are the means over all its positions. It is trained by back-propagation through time on a bounded
sample: `SLOTS` texts of each language, the ones of the smallest hashes, and `SEGMENTS` segments of each, drawn from
the whole text; the `LANGS` most frequent languages are learned. Prediction reads whole texts, in blocks of bounded size.

A text that is null or has no letter is `und` with score 0, as is everything if no text has a language. A language of few
texts is learned from what there is; of equal probabilities the language first by code point wins. Rows are independent: repeated rows and extra
columns are kept, but for those of our results' names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import blocks
from .common import mapped, table

STEPS, HIDDEN = 64, 8
#: Of the training sample: languages, texts of each, and segments of each text, at most.
LANGS, SLOTS, SEGMENTS = 64, 256, 24
_LETTER = re.compile(r"[^\W\d_]")
#: A to Z in lower case; 0 marks what is beyond a stream's end, so a byte 0 reads as a blank.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b or 32 for b in range(256))


def stream(text: bytes) -> np.ndarray:
    return np.frombuffer(text.translate(_LOWER), dtype=np.uint8)


def segments(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All streams cut into rows of STEPS bytes (0 beyond the end), and each row's stream."""
    n = np.array([-(-len(s) // STEPS) for s in streams])
    out = np.zeros((int(n.sum()), STEPS), np.uint8)
    at = 0
    for s, k in zip(streams, n.tolist(), strict=True):
        out[at : at + k].reshape(-1)[: len(s)] = s
        at += k
    return out, np.repeat(np.arange(len(streams)), n)


@dataclass
class Network:
    """For each direction: x (3H, 256) inputs by byte (update, reset, candidate), u (3H, H) and bias of the candidate's recurrent part; v (K, 2H) and c (K) label positions."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.4, s).astype(np.float32)
        return cls(langs, [f(3 * HIDDEN, 256) for _ in range(2)], [f(3 * HIDDEN, HIDDEN) for _ in range(2)], f(len(langs), 2 * HIDDEN), np.zeros((len(langs), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.v, self.c]

    def states(self, codes: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """(T, H, N) states; codes (T, N). keep gets what back-propagation needs."""
        t, n = codes.shape
        h, out = np.zeros((HIDDEN, n), np.float32), np.empty((t, HIDDEN, n), np.float32)
        gate = np.array([0.5] * 2 * HIDDEN + [1.0] * HIDDEN, np.float32)[:, None]
        x, u = self.x[way] * gate, self.u[way] * gate  # a sigmoid is a half tanh of the half
        for i in range(t) if way == 0 else reversed(range(t)):
            a, b = x.take(codes[i], axis=1), u @ h
            a[: 2 * HIDDEN] += b[: 2 * HIDDEN]
            g = np.tanh(a[: 2 * HIDDEN])
            g *= 0.5
            g += 0.5
            z, r = g[:HIDDEN], g[HIDDEN:]
            m = np.tanh(a[2 * HIDDEN :] + r * b[2 * HIDDEN :])
            if keep is not None:
                keep.append((i, h, z, r, m, b[2 * HIDDEN :]))
            h = m + z * (h - m)
            out[i] = h
        return out

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """(T, K, N) probabilities of every position."""
        h = np.concatenate([self.states(codes, 0), self.states(codes, 1)], axis=1)
        p = self.v @ h + self.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions that hold a byte, and gradients, by back-propagation through time."""
        kept: list[list] = [[], []]
        h = np.concatenate([self.states(codes, w, kept[w]) for w in (0, 1)], axis=1)
        p = self.v @ h + self.c
        p -= p.max(axis=1, keepdims=True)
        p = np.exp(p)
        p /= p.sum(axis=1, keepdims=True)
        real = (codes > 0)[:, None, :]
        one = np.eye(len(self.langs), dtype=np.float32)[y].T[None]
        loss = -float((np.log((p * one).sum(axis=1, keepdims=True) + 1e-9) * real).sum()) / real.sum()
        d = ((p - one) * real / real.sum()).astype(np.float32)
        gv, gc = np.tensordot(d, h, ((0, 2), (0, 2))), d.sum(axis=(0, 2))[:, None]
        gx, gu = [], []
        for w in (0, 1):
            dh_out = np.einsum("kh,tkn->thn", self.v[:, w * HIDDEN : (w + 1) * HIDDEN], d)
            u, dx, du, carry = self.u[w], np.zeros_like(self.x[w]), np.zeros_like(self.u[w]), 0.0
            for i, before, z, r, m, b in reversed(kept[w]):
                dh = dh_out[i] + carry
                dm = dh * (1 - z) * (1 - m * m)
                da = np.concatenate([dh * (before - m) * z * (1 - z), dm * b * r * (1 - r), dm])
                db = np.concatenate([da[: 2 * HIDDEN], dm * r])
                np.add.at(dx.T, codes[i], da.T)
                du += db @ before.T
                carry = dh * z + u.T @ db
            gx.append(dx)
            gu.append(du)
        return loss, [*gx, *gu, gv, gc]

    def train(self, rows: np.ndarray, y: np.ndarray, iterations: int = 260, batch: int = 160, rate: float = 0.03, seed: int = 2) -> None:
        """Adam, languages drawn equally often."""
        r = np.random.default_rng(seed)
        own = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = [0 * p for p in self.parameters()]
        s = [0 * p for p in self.parameters()]
        for t in range(1, iterations + 1):
            k = np.concatenate([o[r.integers(0, len(o), -(-batch // len(own)))] for o in own])
            _, grads = self.gradients(rows[k].T.astype(np.int64), y[k])
            step = rate * min(1.0, 2 * (1 - t / (iterations + 1)))
            for i, (p, g) in enumerate(zip(self.parameters(), grads, strict=True)):
                m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
                p -= (step * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(documents, K): the means over all positions of each."""
        streams = [stream(t) for t in texts]
        rows, doc = segments(streams)
        out = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(rows), 4096):
            part = np.ascontiguousarray(rows[a : a + 4096].T)
            p = self.positions(part)
            p *= (part > 0)[:, None, :]
            np.add.at(out, doc[a : a + 4096], p.sum(axis=0).T)
        return out / np.maximum([len(s) for s in streams], 1)[:, None]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, slots: int = SLOTS, pieces: int = SEGMENTS, langs: int = LANGS) -> list[tuple[str, bytes]]:
    """(lang, segment) of a bounded sample of documents (doc_id, text, lang): at most langs * slots * pieces rows of STEPS bytes."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(langs).select("lang")
    # langs * slots hashes at most, partially aggregated: a proven bound for the broadcast.
    best = known.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h")).join(F.broadcast(top), "lang", "left_semi").select("lang", "h")

    def run(batches):
        for batch in batches:
            names, cut, hashes = [], [], []
            for lang, text, h in zip(batch.column("lang").to_pylist(), texts_of(batch), batch.column("h").to_pylist(), strict=True):
                rows, _ = segments([stream(text)])
                some = np.random.default_rng(h & (2**63 - 1)).permutation(len(rows))[:pieces]
                names += [lang] * len(some)
                hashes += [h] * len(some)
                cut += [rows[i].tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cut, pa.binary()), pa.array(hashes, pa.int64())], names=["lang", "row", "h"])

    rows = mapped(known.join(F.broadcast(best), ["lang", "h"], "left_semi"), run, "lang string, row binary, h long")
    return sorted((r.lang, bytes(r.row)) for r in rows.dropDuplicates(["lang", "h", "row"]).select("lang", "row").collect())


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame) -> Network | None:
    """A network trained on the documents (doc_id, text, lang) that are not held out; None if no text has a language."""
    rows = sampled(docs.where(~held_out(F.col("doc_id"))))
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    net = Network.new(langs)
    if len(langs) > 1:
        net.train(np.frombuffer(b"".join(r for _, r in rows), np.uint8).reshape(-1, STEPS), np.array([langs.index(lang) for lang, _ in rows]))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts):
                has = [bool(t and net and _LETTER.search(t)) for t in texts[a:b]]
                p = net.probabilities([t.encode() for t, h in zip(texts[a:b], has, strict=True) if h]) if any(has) else None
                best = iter([] if p is None else zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True))
                found = [next(best) if h else (-1, 0.0) for h in has]
                cols = [pa.array([net.langs[k] if k >= 0 else "und" for k, _ in found], pa.string()), pa.array([min(1.0, q) for _, q in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + cols, names=schema.names)

    return mapped(docs.select(*kept), run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
