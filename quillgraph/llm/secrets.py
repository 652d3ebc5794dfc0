"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of 16 or more characters of the alphabet of keys. The network reads it whole,
in windows of 64 characters with 16 characters of context on both sides, and a candidate's score is
its best window's. It is trained in numpy, by back-propagation, on labelled findings: all values that the fixed patterns
found in the texts and all candidates that they left, but for those that something is set to (`found_in`), and findings made
by rule, for kinds of keys that the texts don't hold. Findings alike, with the text around them, count once. Every window of a finding trains; those of a
long one weigh `DRAWN` together. Its scores are calibrated by Platt's method on findings held out, and each
group (an assignment before the candidate, or none) gets the highest threshold, in steps of 1 / `STEPS` of a raw score, that keeps `RECALL` of the secrets of that
group among further findings held out.

Training is dealt out (`fit_on`): findings fall by hash into shares of about `SHARE`; in each of `EPOCHS` rounds every share trains a
copy of the network, and the copies' mean, weighted by windows, starts the next round. The driver holds a network for each share;
calibration and thresholds need counts of rounded scores alone. Shares follow from the findings, so reruns agree whatever the partitioning.

Fixed patterns' spans always stay; the network adds spans of kind `model` that overlap none of those. Of a run
that such a span covers in part, the rest is a candidate wherever it still has 16 characters.

A null text is an empty one: no spans. Spans of one start are ordered by kind, then end. Rows are independent; repeated rows and extra columns
are kept, but for those of our results' names. An empty table gives an empty result. Work grows with a text's length, whatever it holds.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import blocks
from .common import mapped, packed, stored, table, unpacked

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SETS = re.compile(r"""[:=]\s*["'`]?$""")
WINDOW, CONTEXT, WIDTH, EMBED, FILTERS = 64, 16, 5, 6, 16
RECALL = 0.97
#: Windows that a finding weighs in training, at most.
DRAWN = 16
#: Findings of a share of training, about; rounds; steps of a raw score, and the largest that is told apart.
SHARE, EPOCHS, STEPS, LARGEST = 8192, 8, 100, 100
#: Characters of a candidate at least, as in CANDIDATE.
SHORTEST = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches, ordered."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate's windows: 1-127 ASCII, 0 for others and beyond the text."""
    at = range(start, end, WINDOW) if end - start > WINDOW else (start,)
    size = WINDOW + 2 * CONTEXT
    out = np.zeros((len(at), size), dtype=np.int64)
    for i, a in enumerate(at):
        left, stop = max(0, a - CONTEXT), min(end, a + WINDOW)
        raw = text[left : stop + CONTEXT].encode("ascii", "replace").replace(b"?", b"\0")
        out[i, CONTEXT - (a - left) : CONTEXT - (a - left) + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out


def labelled_findings(n: int = 8000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret) of n findings made by rule: keys of common kinds, and what resembles them."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    parts = ["tion", "ment", "er", "an", "heit", "ung", "que", "ado", "eau", "th", "ing", "en", "data", "user", "test", "file", "index", "node", "page", "con", "ver", "sch"]
    word = lambda lo, hi: "".join(r.choice(parts, r.integers(lo, hi)))
    secret = [
        lambda: pick(low[:6] + dig, r.integers(20, 65)), lambda: pick(up[:6] + dig, r.integers(20, 65)),
        lambda: pick(low + up + dig, r.integers(20, 60)), lambda: base64.b64encode(r.bytes(int(r.integers(16, 60)))).decode(),
        lambda: "ghp_" + pick(low + up + dig, 36), lambda: pick(low + up + dig + "/+", 40), lambda: "sk-" + pick(low + up + dig, 40), lambda: "xoxb-" + pick(dig, 12) + "-" + pick(low + up + dig, 24),
        lambda: "eyJ" + pick(low + up + dig + "_-", 30) + ".eyJ" + pick(low + up + dig + "_-", 30),
    ]
    plain = [
        lambda: word(5, 12), lambda: word(5, 12).capitalize(), lambda: "_".join(word(1, 3) for _ in range(r.integers(3, 7))), lambda: "-".join(word(1, 3) for _ in range(r.integers(3, 7))),
        lambda: "www." + word(2, 4) + ".com/" + "/".join(word(1, 3) for _ in range(3)), lambda: "/".join(word(1, 3) for _ in range(5)), lambda: pick("=-_.", 1) * int(r.integers(16, 60)),
        lambda: pick(dig, r.integers(16, 24)), lambda: f"2024-{r.integers(10, 13)}-{r.integers(10, 29)}-{word(2, 5)}", lambda: word(5, 9).upper(), lambda: ".".join(word(1, 3) for _ in range(5)), lambda: pick(low + up, 1) * int(r.integers(16, 40)),
        lambda: f"mail{r.integers(10)}.example.com", lambda: f"{word(1, 3)}.{word(1, 3)}.{['com', 'org', 'de'][r.integers(3)]}", lambda: pick(dig, 16), lambda: word(5, 9).upper() + ".", lambda: "".join(r.choice(["chl", "ich", "pf", "keit", "rr", "zz", "ñll", "ç"], 9)).replace("ñ", "n").replace("ç", "c"),
    ]
    before = ["key = \"", "auth: ", "credential='", "pwd=", "Authorization: Bearer ", "export KEY=", "private_key: \""]
    calm = ["see ", "the ", " in ", "und die ", "\n", "de la ", "href=\"", "url: ", "path = ", "http://", "| ", "an@", "er.en@", "1: ", "n "]
    out = []
    for i in range(n):
        bad = i % 2
        body = (secret if bad else plain)[r.integers(len(secret if bad else plain))]()
        while len(body) < 16:
            body += body
        near = before if r.random() < (0.6 if bad else 0.25) else calm
        left, right = word(2, 5) + " " + near[r.integers(len(near))], ["\" ", " ", ". ", ",\n", "' "][r.integers(5)] + word(2, 5)
        out.append((left + body + right, len(left), len(left) + len(body), bad))
    return out


class Network:
    """Embedding, one convolution, maximum and mean over positions, a dense layer; all in numpy."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (128, EMBED)), "w": r.normal(0, 0.25, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.3, 2 * FILTERS), "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.least = 1.0, 0.0, (0.5, 0.5)

    def forward(self, x: np.ndarray):
        p, n = self.p, x.shape[1] - WIDTH + 1
        z = p["e"][x]
        cols = np.concatenate([z[:, i : i + n] for i in range(WIDTH)], axis=2)
        h = np.maximum(cols @ p["w"] + p["b"], 0)
        top = h.argmax(axis=1)
        f = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return f @ p["v"] + p["c"], (cols, h, top, f)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed=3, weight: np.ndarray | None = None, state=None):
        """Adam; returns its state (both moments, steps), with which training can go on."""
        r, weight = np.random.default_rng(seed), np.ones(len(x), np.float32) if weight is None else weight
        m, s, t = state or ({k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}, 0)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                k = order[a : a + batch]
                out, (cols, h, top, f) = self.forward(x[k])
                d = ((1 / (1 + np.exp(-out)) - y[k]) * weight[k] / len(k)).astype(np.float32)
                g = {"v": f.T @ d, "c": d.sum(keepdims=True)}
                df = d[:, None] * self.p["v"]
                dh = np.repeat(df[:, None, FILTERS:] / h.shape[1], h.shape[1], axis=1)
                at = top[:, None]
                np.put_along_axis(dh, at, np.take_along_axis(dh, at, 1) + df[:, None, :FILTERS], 1)
                dh = dh * (h > 0)
                g |= {"w": np.tensordot(cols, dh, ((0, 1), (0, 1))), "b": dh.sum(axis=(0, 1))}
                dc = dh @ self.p["w"].T
                de = np.zeros_like(self.p["e"])
                n = h.shape[1]
                for i in range(WIDTH):
                    np.add.at(de, x[k][:, i : i + n], dc[:, :, i * EMBED : (i + 1) * EMBED])
                g["e"] = de
                t += 1
                for q in self.p:
                    m[q], s[q] = 0.9 * m[q] + 0.1 * g[q], 0.999 * s[q] + 0.001 * g[q] ** 2
                    self.p[q] = (self.p[q] - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return m, s, t

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale * self.forward(x)[0] + self.shift)))

    def calibrate(self, out: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
        """Platt: a logistic regression of labels on raw scores, each found n times."""
        for _ in range(300):
            q = 1 / (1 + np.exp(-(self.scale * out + self.shift)))
            self.scale -= 0.5 * float(np.average((q - y) * out, weights=n)) / max(1.0, float(np.average(out * out, weights=n)))
            self.shift -= 0.5 * float(np.average(q - y, weights=n))
        self.scale = max(self.scale, 1e-3)  # higher raw scores stay higher

    def constrain(self, q: np.ndarray, y: np.ndarray, group: np.ndarray, n: np.ndarray | None = None) -> None:
        """For each group the highest threshold that keeps RECALL of its secrets; each score was found n times."""
        n, least = np.ones(len(q), np.int64) if n is None else n, []
        for g in (0, 1):
            own = np.flatnonzero((y == 1) & (group == g))
            own = own[np.argsort(q[own])]
            upto = np.cumsum(n[own])
            least.append(float(q[own[np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right")]]) if len(own) else 0.5)
        self.least = (least[0], least[1])


def best_windows(net: Network, found: list[tuple[str, int, int]], score) -> np.ndarray:
    """Of each (text, start, end) the best window's score."""
    x = [windows(t, a, b) for t, a, b in found]
    n = np.cumsum([0] + [len(w) for w in x])
    return np.maximum.reduceat(np.concatenate([score(y) for y in np.array_split(np.concatenate(x), -(-n[-1] // 512))]), n[:-1])


def training_windows(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of (text, start, end, is a secret), their labels and their weights."""
    x = [windows(t, a, b).astype(np.uint8) for t, a, b, _ in found]
    n = np.array([len(w) for w in x])
    return np.concatenate(x), np.repeat(np.array([f[3] for f in found], np.float32), n), np.repeat(np.minimum(1, DRAWN / n).astype(np.float32), n)


def is_set(text: str, start: int) -> int:
    """Whether an assignment stands before a candidate: its group."""
    return int(bool(SETS.search(text[max(0, start - 8) : start])))


def fit(findings: list[tuple[str, int, int, int]] | None = None) -> Network:
    """A trained, calibrated network: of every eight findings six train, one calibrates and one sets the thresholds."""
    findings = findings or labelled_findings()
    y = np.array([f[3] for f in findings], dtype=np.float32)
    group = np.array([is_set(t, a) for t, a, _, _ in findings])
    part = np.arange(len(findings)) % 8
    net = Network()
    x, label, weight = training_windows([f for f, p in zip(findings, part.tolist(), strict=True) if p < 6])
    net.train(x, label, weight=weight)
    for p in (6, 7):
        own = [f[:3] for f, k in zip(findings, part.tolist(), strict=True) if k == p]
        if own and p == 6:
            net.calibrate(best_windows(net, own, lambda w: net.forward(w)[0]).astype(float), y[part == p])
        elif own:
            net.constrain(best_windows(net, own, net.score), y[part == p], group[part == p])
    return net


def found_in(docs: DataFrame) -> DataFrame:
    """(bad, near, a, b): every value found by fixed patterns in docs (text) and every other candidate, with the text around; those alike once."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                values = [(a if k else ASSIGN.match(text, a).start(2), b, 1) for a, k, b in spans]
                for a, b, bad in [(a, b, 1) for a, b, _ in values if b - a >= SHORTEST] + [(a, b, 0) for a, b in rests(text, spans) if not is_set(text, a)]:
                    left = max(0, a - 2 * CONTEXT)
                    out.append((bad, text[left : b + 2 * CONTEXT], a - left, b - left))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["bad", "near", "a", "b"])

    return mapped(docs.select("text"), run, "bad int, near string, a int, b int").distinct()


def findings_of(docs: DataFrame, most: int | None = None) -> list[tuple[str, int, int, int]]:
    """(text around, start, end, is a secret) of all that `found_in` gives, to look at; given `most`, of so many of each kind. Fits take all (`fit_on`)."""
    rows = found_in(docs).withColumn("h", F.xxhash64("near", "a", "b"))
    if most:
        rows = rows.groupBy("bad", F.pmod("h", F.lit(most)).alias("slot")).agg(F.min(F.struct("h", "near", "a", "b")).alias("own")).select("own.*", "bad")
    return [(r.near, r.a, r.b, r.bad) for r in sorted(rows.collect(), key=lambda r: (r.h, r.near))]


def by_share(batches):
    """(share, its findings), of batches ordered by share."""
    share, own = None, []
    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in ("share", "near", "a", "b", "bad")], strict=True):
            if r[0] != share and own:
                yield share, own
                own = []
            share = r[0]
            own.append(r[1:])
    if own:
        yield share, own


def fit_on(docs: DataFrame, made: list[tuple[str, int, int, int]] | None = None, share: int = SHARE) -> Network:
    """As `fit`, on all findings of docs and those made by rule, wherever they lie."""
    spark, made = docs.sparkSession, labelled_findings() if made is None else made
    rule = spark.createDataFrame([(bad, near, a, b) for near, a, b, bad in made], "bad int, near string, a int, b int")
    h = F.xxhash64("near", "a", "b", "bad")
    found = stored(found_in(docs).unionByName(rule).distinct().withColumns({"h": h, "part": F.pmod(h, F.lit(8))}))
    net, state = Network(), None
    shares = -(-found.where("part < 6").count() // share)
    names = list(net.p)
    lengths = np.cumsum([net.p[k].size for k in names])[:-1]
    flat = lambda p: np.concatenate([p[k].ravel() for k in names])
    whole = lambda v: {k: x.reshape(net.p[k].shape).astype(np.float32) for k, x in zip(names, np.split(v, lengths), strict=True)}
    if shares:
        dealt = found.where("part < 6").withColumn("share", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shares)))
        dealt = dealt.repartition(shares, "share").sortWithinPartitions("share", "h", "near", "a", "b", "bad").select("share", "near", "a", "b", "bad")

    def trained(epoch):
        def run(batches):
            for k, own in by_share(batches):
                x, y, weight = training_windows(own)
                copy = Network()
                copy.p = dict(net.p)
                m, s, t = copy.train(x, y, epochs=1, seed=(3, epoch, k), weight=weight, state=state and (dict(state[0]), dict(state[1]), state[2]))
                values = np.concatenate([flat(copy.p), flat(m), flat(s)]).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([float(weight.sum())], pa.float64()), pa.array([t], pa.int64()), pa.array([values], pa.binary())], names=["share", "n", "t", "net"])

        return run

    for epoch in range(EPOCHS if shares else 0):
        rows = sorted(mapped(dealt, trained(epoch), "share long, n double, t long, net binary").collect(), key=lambda r: r.share)
        mean = np.average([np.frombuffer(r.net, "<f4").astype(float) for r in rows], axis=0, weights=[r.n for r in rows])
        p, m, s = np.split(mean, 3)
        net.p, state = whole(p), (whole(m), whole(s), max(r.t for r in rows))

    def scored(batches):
        for batch in batches:
            near, a, b = (batch.column(c).to_pylist() for c in ("near", "a", "b"))
            if near:
                raw = best_windows(net, list(zip(near, a, b, strict=True)), lambda w: net.forward(w)[0]).astype(float)
                step = np.floor(np.clip(raw, -LARGEST, LARGEST) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("bad"), pa.array([is_set(t, i) for t, i in zip(near, a, strict=True)], pa.int32()), pa.array(step)], names=["part", "bad", "grp", "step"])

    counts = mapped(found.where("part >= 6").select("part", "bad", "near", "a", "b"), scored, "part long, bad int, grp int, step int").groupBy("part", "bad", "grp", "step").count().collect()
    for part in (6, 7):
        own = sorted((r.step, r.bad, r.grp, r["count"]) for r in counts if r.part == part)
        if own:
            step, y, group, n = np.array(own).T
            if part == 6:
                net.calibrate((step + 0.5) / STEPS, y, n)
            else:
                net.constrain(1 / (1 + np.exp(-(net.scale * step / STEPS + net.shift))), y, group, n)
    return net


def rests(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """All candidates of a text, less what ordered spans cover, where still as long as one. Both lists are read once."""
    out, k = [], 0
    joined: list[list[int]] = []
    for a, _, b in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(joined) and joined[k][1] <= start:
            k += 1
        i = k
        while i < len(joined) and joined[i][0] < end:
            if joined[i][0] - start >= SHORTEST:
                out.append((start, joined[i][0]))
            start = max(start, joined[i][1])
            i += 1
        if end - start >= SHORTEST:
            out.append((start, end))
    return out


def scan(net: Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Every text's (start, kind's number, end), ordered."""
    out, cand = [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        out.append(spans)
        cand += [(i, a, b) for a, b in rests(text, spans)]
    for s in range(0, len(cand), 512):
        part = cand[s : s + 512]
        p = best_windows(net, [(texts[i], a, b) for i, a, b in part], net.score)
        for (i, a, b), q in zip(part, p.tolist(), strict=True):
            if q >= net.least[is_set(texts[i], a)]:
                out[i].append((a, 3, b))
    return [sorted(x) for x in out]


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    net = net or fit_on(docs)
    ours = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in ours}]
    schema = T.StructType([docs.schema[c] for c in kept] + ours)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts):
                found = scan(net, [t or "" for t in texts[a:b]])
                base = [[x for x in s if x[1] < 3] for s in found]
                cols = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)]
                cols += [pa.array([hashlib.sha256(shown(s).encode()).hexdigest() for s in base], pa.string()), pa.array([shown(s) for s in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + cols, names=schema.names)

    return mapped(docs.select(*kept), run, schema)


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """text with every span (overlapping ones as one) replaced by mark."""
    done, out = 0, []
    for _, a, b in (x.split(":") for x in spans.split(",") if x):
        a, b = int(a), int(b)
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with secrets in text replaced; n_chars, if there, is renewed where the text changed."""
    names = docs.columns
    size = "n_chars" in names
    found = find_secrets(packed(docs, "text", "n_chars"), net)
    schema = found.schema

    def run(batches):
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            new = [redacted(t, s) if t and s else t for t, s in zip(texts, spans, strict=True)]
            cols = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string())}
            if size:
                cols["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, batch.column("n_chars").to_pylist(), strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return unpacked(mapped(found, run, schema), names, "text", "n_chars")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
