import random
import zlib

import numpy as np

from quillgraph.llm import lang_id, quality_classifier

PARTS = {"aa": ["the", "ing", "wh", "er", "on"], "bb": ["ßen", "ung", "heit", "ü", "sch"], "cc": ["éau", "que", "oi", "eux", "è"]}


def prose(r, lang, n):
    return " ".join("".join(r.choices(PARTS[lang], k=r.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, prose(r, lang, r.choice([8, 30, 300])), lang, "x") for i in range(360) for lang in [list(PARTS)[i % 3]]]
    odd = [(1000, None, "aa", None), (1001, "", None, None), (1002, "12 -- 34", "bb", None), (None, "the ing whon", None, None), (0, rows[0][1], "aa", "twice")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    net = lang_id.fit(docs)
    out = lang_id.predict(docs.drop("lang"), net).collect()
    assert len(out) == len(rows) + len(odd)
    held = [x for x in out if x.doc_id is not None and x.doc_id < 360 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert np.mean([x.lang_pred == list(PARTS)[x.doc_id % 3] for x in held]) > 0.97 and len(held) > 50
    for x in out:
        assert 0 <= x.score <= 1
        assert (x.lang_pred == "und") == (x.doc_id in (1000, 1001, 1002))
    assert lang_id.fit(docs.where("lang is null")) is None
    assert {x.lang_pred for x in lang_id.predict(docs, None).collect()} == {"und"}
    assert lang_id.predict(docs.limit(0), net).count() == 0


def test_gradients_are_those_of_differences():
    net = lang_id.Network.new(["a", "b", "c"])
    for i, p in enumerate(net.parameters()):
        p *= 0.5
    r = np.random.default_rng(0)
    codes, y = r.integers(1, 256, (7, 5)), np.array([0, 1, 2, 1, 0])
    codes[5:, 2] = 0
    _, grads = net.gradients(codes, y)
    for p, g in zip(net.parameters(), grads):
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(0 for _ in g.shape)]:
            was, eps = p[at], 1e-2
            p[at] = was + eps
            up = net.gradients(codes, y)[0]
            p[at] = was - eps
            down = net.gradients(codes, y)[0]
            p[at] = was
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_quality_draw(spark):
    r = random.Random(5)
    good = [(i, prose(r, "aa", r.choice([5, 80, 400])), None) for i in range(150)]
    bad = [(500 + i, " ".join(f"{r.choice(['X', 'ZQ'])}{r.randint(0, 99)}###" for _ in range(80)), None) for i in range(60)]
    odd = [(900, None, None), (901, "", None), (902, "ab", None), (None, prose(r, "aa", 50), None), (3, good[3][1], "twice")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(500 + i, 0) for i in range(0, 60, 2)] + [(None, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels)
    kept = {(x.doc_id, x.text): x.kept for x in out.collect()}
    assert out.count() == len(good) + len(bad) + len(odd)
    assert np.mean([kept[g[:2]] for g in good]) > 0.98 and np.mean([kept[b[:2]] for b in bad]) < 0.1
    again = {(x.doc_id, x.text): x.kept for x in quality_classifier.classify(docs.repartition(5), labels).collect()}
    assert kept == again
    assert all(x.kept for x in quality_classifier.classify(docs, labels.limit(0)).collect())
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_cutoff_is_the_kth_largest(spark):
    values = [random.Random(1).choice([1.5, -2.0, 7.25, 1e6, 1.5000001]) for _ in range(50)] + list(np.random.default_rng(1).normal(size=300).tolist())
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 40, 349, 350):
        assert quality_classifier.cutoff(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality_classifier.cutoff(keys, 0) is None


def test_trigrams_of_texts():
    texts = [b"abcd", b"", b"ab", b"xyz", b"abc"]
    h, at = quality_classifier.hashed(texts)
    assert at.tolist() == [0, 2, 2, 2, 3, 4] and h[0] == h[3]


def test_language_equals_a_plain_network(spark):
    """Probabilities of whole documents, position by position and state by state."""
    net = lang_id.Network.new(["a", "b", "c"], seed=4)
    texts = ["Straße 12, é!", "x", "The the THE\n" * 30, "日本 text"]
    sig = lambda v: 1 / (1 + np.exp(-v))
    H, want = lang_id.HIDDEN, []
    for text in texts:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = np.zeros(3)
        for at in range(0, len(raw), lang_id.STEPS):
            codes = list(raw[at : at + lang_id.STEPS].ljust(lang_id.STEPS, b"\0"))
            states = []
            for way in (0, 1):
                h, own = np.zeros(H), {}
                for i in range(len(codes)) if way == 0 else reversed(range(len(codes))):
                    x, u = net.x[way][:, codes[i]], net.u[way] @ h
                    z, r = sig(x[:H] + u[:H]), sig(x[H : 2 * H] + u[H : 2 * H])
                    h = (1 - z) * np.tanh(x[2 * H :] + r * u[2 * H :]) + z * h
                    own[i] = h
                states.append(own)
            for i in range(min(lang_id.STEPS, len(raw) - at)):
                p = np.exp(net.v @ np.concatenate([states[0][i], states[1][i]]) + net.c[:, 0])
                total += p / p.sum()
        want.append(total / len(raw))
    out = {r.doc_id: r for r in lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), net).collect()}
    for i, p in enumerate(want):
        assert out[i].lang_pred == "abc"[int(p.argmax())] and abs(out[i].score - p.max()) < 1e-4


def test_training_segments_come_from_whole_texts(spark):
    rows = [(i, "a" * 5000 + "zyx" * 2000, "aa") for i in range(40)] + [(100 + i, "é" * 300, None) for i in range(5)]
    found = lang_id.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), slots=8, pieces=6)
    assert 0 < len(found) <= 48 and {lang for lang, _ in found} == {"aa"}
    assert any(b"zyx" in r for _, r in found) and any(r == b"a" * lang_id.STEPS for _, r in found)


def test_quality_equals_brute_force(spark):
    """Weights from plain counts, and the draw from all keys sorted."""
    import hashlib
    import math

    r = random.Random(9)
    docs = [(i, prose(r, "aa", 60)) for i in range(60)] + [(100 + i, "Q#7 " * r.randint(5, 60) + prose(r, "bb", 3)) for i in range(30)] + [(200, None), (201, "ab")]
    labels = [(i, 1) for i in range(0, 60, 3)] + [(100 + i, 0) for i in range(0, 30, 3)]
    size = 1 << quality_classifier.BITS

    def buckets(text):
        t = (text or "").encode()
        return [((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761 % 2**32) >> (32 - quality_classifier.BITS) for i in range(len(t) - 2)]

    raw, target, quality = {}, {}, dict(labels)
    for i, t in docs:
        for b in buckets(t):
            raw[b] = raw.get(b, 0) + 1
            if quality.get(i) == 1:
                target[b] = target.get(b, 0) + 1
    n_raw, n_target = sum(raw.values()) + size, sum(target.values()) + size
    weight = lambda b: math.log((target.get(b, 0) + 1) / n_target) - math.log((raw.get(b, 0) + 1) / n_raw)
    want = {i: quality_classifier.TEMPER * sum(map(weight, buckets(t))) / (len(buckets(t)) + quality_classifier.SHRINK) for i, t in docs}
    out = {x.doc_id: x for x in quality_classifier.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, w in want.items():
        u = (int(hashlib.md5(f"13|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert abs(out[i].log_weight - w) < 2e-3 and abs(out[i].key - (out[i].log_weight - math.log(-math.log(u)))) < 1e-6
    known = lambda q: np.array([out[i].log_weight for i, x in labels if x == q])
    k = sum(x.log_weight >= quality_classifier.limit_of(known(1), known(0)) for x in out.values())
    assert 0 < k < len(docs)
    assert {i for i, x in out.items() if x.kept} == set(sorted(out, key=lambda i: -out[i].key)[:k])
