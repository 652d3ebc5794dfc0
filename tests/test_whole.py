import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.plans import queries
from quillgraph.streaming import ingest as stream

LONG = "\n".join(f"== Part {i} ==\n" + f"Sentence {i} of a long text. " * 9 for i in range(400))


@pytest.fixture
def long_texts(spark, tmp_path):
    rows = [(1, LONG, "a"), (2, "short", "b"), (3, None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_whole_texts_are_chunked(spark, long_texts):
    got = queries.chunk_documents(spark, long_texts).orderBy("chunk_ord").where("doc_id = 1").collect()
    chunks = spark.createDataFrame([(LONG,)], "text string").select(T.clean_text(F.col("text")).alias("c")).select("c", T.chunk_text(F.col("c"), overlap=0).alias("own")).first()
    assert len(chunks.c) > 80_000 and "\n".join(chunks.own) == "\n".join(x.strip() for x in chunks.c.split("\n") if x.strip())
    assert [(r.chunk_ord, r.n_chars) for r in got] == [(i, len(c) + (151 if i else 0)) for i, c in enumerate(chunks.own)]


def test_whole_texts_are_streamed(spark, long_texts, monkeypatch):
    seen = []
    run = stream.ingest
    monkeypatch.setattr(stream, "ingest", lambda *a: seen.append(run(*a)) or seen[-1])
    assert {r.chunk_id: r.n_triples for r in queries.stream_resume(spark, long_texts).collect()} == {"c1": 1, "c2": 1, "c3": 1}
    assert {r.chunk_id: r.triples[0].tail for r in seen[-1].collect()} == {"c1": LONG, "c2": "short", "c3": None}


def spread(adj, labels, halves, sweeps=20):
    """propagate() in plain Python: labels, and how many rounds changed something."""
    labels, moved, calm = dict(labels), 0, 0
    near = {}
    for s, d, w in adj:
        near.setdefault(s, []).append((d, w))
    for i in range(2 * sweeps):
        new = dict(labels)
        for k in (k for k in near if halves[k] == i % 2):
            votes = {}
            for d, w in near[k]:
                votes[labels[d]] = votes.get(labels[d], 0.0) + w
            votes = {x: round(w, 9) for x, w in votes.items()}
            best = min(votes, key=lambda x: (-votes[x], x))
            if votes[best] > votes.get(labels[k], 0.0):
                new[k] = best
        calm = calm + 1 if new == labels else 0
        moved, labels = moved + (new != labels), new
        if calm == 2:
            break
    return labels, moved


def test_propagation_query_runs_to_its_end(spark, monkeypatch):
    """A chain along which the first label travels, edge weights falling: many more rounds than four."""
    n = 10
    keys = [f"k{i}" for i in range(n)]
    adj = [(keys[i + a], keys[i + b], float(n - i)) for i in range(n - 1) for a, b in ((0, 1), (1, 0))]
    edges = spark.createDataFrame(adj, "src string, dst string, w double")
    nodes = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, node_seq long")
    halves = {r.key: r.h for r in nodes.select("key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("h")).collect()}
    monkeypatch.setattr(queries, "graph", lambda *a: (nodes, edges))
    monkeypatch.setattr(queries.G, "adjacency", lambda e: e)
    want, moved = spread(adj, {k: i for i, k in enumerate(keys)}, halves)
    assert moved > 4
    assert {r.key: r.label for r in queries.lpa_scalable(spark, "").collect()} == want
