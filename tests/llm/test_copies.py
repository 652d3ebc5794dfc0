import random

import numpy as np

from quillgraph.llm import embedding_dedup, graph_components, minhash_dedup


def closed(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(80)] + [(7, 7), (5, 400), (400, 5)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {x.id: x.component for x in graph_components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert graph_components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def documents():
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=60)
    rows, n = [], 0
    for size in (3, 5, 12, 40, 150, 400):
        base = r.choices(words, k=size)
        for k in range(14):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4]) * max(1, size // 100)):
                own[r.randrange(size)] = r.choice(words)
            rows.append((n, " ".join(own)))
            n += 3
    for k in range(25):
        rows.append((1000 + k, " ".join(passage + r.choices(words, k=r.choice([2, 5, 20, 100])))))
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "The CAT sat on ÉTÉ"), (2004, "the cat\nSAT on ÉTÉ"), (2005, "the cat sat on été"), (2006, "one"), (2007, "ONE"), (2003, "The CAT sat on ÉTÉ"), (None, "one"), (2008, "big " * 30_000)]
    return rows


def test_minhash_equals_all_pairs(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]]
    want = closed(ids, links)
    assert len(links) > 150 and 10 < len(set(want.values())) < len(ids)
    out = minhash_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    for x in out:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id), x
    left = minhash_dedup.deduplicated(docs).collect()
    assert sorted(x.doc_id for x in left if x.doc_id is not None) == sorted(set(want.values()))
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows, bases = [], [r.choices(words, k=90) for _ in range(3)]
    for n in range(150):
        own = list(bases[n % 3])
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            own[r.randrange(90)] = r.choice(words)
        rows.append((n, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    assert 3 < len(set(want.values())) < 120 and len(links) > 300
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in out} == want


def test_coordinates_asked_for_follow_from_the_threshold():
    asked = [minhash_dedup.matches(p) for p in (50, 70, 85, 95, 100)]
    assert asked == sorted(asked) and asked[2] == 88 and asked[-1] == minhash_dedup.COORDS


def test_recall_at_the_threshold_in_64_dimensions(spark):
    r = np.random.default_rng(6)
    rows, pairs = [], 0
    for i in range(500):
        a, b = r.normal(size=64), r.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = r.uniform(0.9301, 0.95)
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), i % 3)]
        pairs += 1
    out = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(x.n_links for x in out) >= 2 * 0.95 * pairs


def test_a_vector_of_another_length_changes_nothing(spark):
    base = np.random.default_rng(2).normal(size=64)
    rows = [(i, (base + 1e-3 * i).tolist(), 1) for i in range(6)] + [(50, [1.0] * 65, 1), (51, [1.0] * 65, 1), (52, [1.0] * 64 + [1.01], 1)]
    out = {x.vec_id: x.n_links for x in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [out[i] for i in range(6)] == [5] * 6 and out[50] == out[51] == out[52] == 2


def test_embeddings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 24))
    rows = [(i * 2, (base[i % 30] * r.uniform(0.1, 9) + r.normal(0, r.choice([0.05, 0.2, 0.35]), 24)).tolist(), int(i % 3 == 0)) for i in range(260)]
    rows += [(5001 + i, (base[0] + r.normal(0, 0.02, 24)).tolist(), 7) for i in range(90)] + [(6001 + i, base[1].tolist(), 7) for i in range(40)]
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [None] + [1.0] * 23, 1), (9004, [float("nan")] * 24, 1), (9005, base[2].tolist(), None), (9006, [float("inf")] + [1.0] * 23, 1), (9007, [1.0], 1), (None, base[3].tolist(), 1)]
    ids, labels = np.array([x[0] for x in rows]), np.array([x[2] for x in rows])
    x = np.array([v[1] for v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    want = closed(ids.tolist(), [(ids[i], ids[j]) for i, j in np.argwhere(near) if i < j])
    frame = spark.createDataFrame([(*v, "clash") for v in rows + odd], "vec_id long, embedding array<double>, label int, n_links string")
    out = {v.vec_id: v for v in embedding_dedup.link(frame).collect()}
    assert len(out) == len(rows) + len(odd)
    found = sum(out[i].n_links for i in ids.tolist())
    assert 0.95 * near.sum() <= found <= near.sum()
    assert all(out[i].n_links <= n for i, n in zip(ids.tolist(), near.sum(axis=1)))
    assert np.mean([out[i].component_id == want[i] for i in ids.tolist()]) > 0.97
    assert all(out[6001 + i].n_links >= 39 for i in range(40))
    for v in odd:
        assert out[v[0]].n_links == 0 and out[v[0]].component_id == v[0] and out[v[0]].kept
    assert embedding_dedup.link(frame.limit(0)).count() == 0
