import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import components, graph, ports, resolve, search, spans
from quillgraph.plans import queries
from quillgraph.sources import files
from quillgraph.streaming.ingest import ingest

SCHEMA = "seq long, chunk_id string, head string, relation string, tail string, head_type string, tail_type string"


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, c, h, r, t, "MISC", "MISC") for i, (c, h, r, t) in enumerate(queries.TOY)]
    return spark.createDataFrame(rows, SCHEMA)


def test_toy_graph_and_hops(spark, toy):
    log = graph.mention_log(toy)
    nodes, edges = graph.nodes(log), graph.edges(log)
    assert (nodes.count(), edges.count()) == (8, 9)
    assert nodes.agg(F.sum("mentions")).first()[0] == 2 * edges.agg(F.sum("mentions")).first()[0]
    seed = spark.createDataFrame([("lumen harbour",)], "key string")
    assert search.evidence(edges, seed, 1).count() == 4 and search.evidence(edges, seed, 2).count() == 9
    assert search.ranked(search.evidence(graph.edge_sizes(log), seed), seed, 3).first().touches == 1


def test_gate(spark):
    got = {r.id: r.verdict for r in graph.judged(queries.fixture(spark)).collect()}
    want = {1: "accept", 2: "vague", 3: "accept", 4: "same_raw", 5: "same_key", 6: "length", 7: "length", 8: "junk_relation", 14: "accept", 15: "vague", 16: "empty", 17: "empty_key", 18: "accept"}
    assert {k: got[k] for k in want} == want
    pairs = [r.id for r in graph.accepted_pairs(queries.fixture(spark)).collect()]
    assert [pairs.count(i) for i in (9, 10, 11, 12, 13, 14)] == [2, 4, 1, 1, 2, 0]


def test_parts_of_a_compound_keep_their_order(spark):
    rows = [(1, "c", " and ".join(f"N{i:02}" for i in range(12)), "KNOWS", "Rome", "MISC", "MISC")]
    log = graph.mention_log(spark.createDataFrame(rows, SCHEMA))
    assert [r.head for r in log.orderBy("seq").collect()] == [f"n{i:02}" for i in range(12)] and log.select("seq").distinct().count() == 12


def test_names_of_any_script_have_keys(spark):
    rows = [(1, "c", "Café Müller", "LOCATED_IN", "北京", "MISC", "MISC"), (2, "c", "Cafe Muller GmbH", "OWNS", "Nestlé", None, None), (3, None, "Nestlé", None, None, None, None)]
    facts = spark.createDataFrame(rows, SCHEMA)
    log = graph.mention_log(facts)
    assert sorted((r.head, r.tail) for r in log.collect()) == [("cafe muller", "nestle"), ("cafe muller", "北京")]
    assert sorted((r.key, r.mentions, r.node_seq // 512) for r in graph.nodes(graph.mentions(facts)).collect()) == sorted((r.key, r.mentions, r.node_seq // 512) for r in graph.nodes(log).collect())


def test_node_rules_and_votes(spark):
    rows = [
        (1, "c1", "Acme", "CEO_OF", "Bolt", "", "MISC"), (2, "c2", "ACME", "CEO_OF", "Bolt Inc", "EVENT", "MISC"), (3, "c1", "Acme", "LOCATED_IN", "Rome", "odd", "MISC"), (4, "c3", "Acme", "LOCATED_IN", "Rome", None, "MISC"), (4, "c3", "Acme", "LOCATED_IN", "Rome", None, "MISC"),
    ]
    log = graph.mention_log(spark.createDataFrame(rows, SCHEMA))
    nodes, edges = graph.nodes(log), graph.edges(log)
    got = {r.key: r for r in graph.backfilled(nodes, edges).collect()}
    assert (got["acme"].type, got["bolt"].type, got["rome"].type) == ("EVENT", "ORGANIZATION", "LOCATION")
    assert got["bolt"].display == "Bolt Inc" and got["acme"].aliases == ["ACME", "Acme"] and got["acme"].mentions == 5
    e = {r.relation: r for r in edges.collect()}
    assert e["LOCATED_IN"].mentions == 3 and e["LOCATED_IN"].source_chunks == ["c1", "c3"]
    assert graph.adjacency(edges).where("src = 'acme' and dst = 'rome'").first().w == pytest.approx(2.098612)


def test_components_and_propagation(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    got = {r.key: r.component for r in components.components(pairs).collect()}
    assert {k: got[k] for k in "abcxy"} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    adj = [(s, d, 1.0) for g in ("abc", "xyz") for s in g for d in g if s != d]
    frame = spark.createDataFrame(adj, "src string, dst string, w double")
    order = spark.createDataFrame([(k, i) for i, k in enumerate("abcxyz")], "key string, node_seq long")
    for out in (components.propagate_in_order(frame, order), components.propagate(frame, order.select("key", F.col("node_seq").alias("label")))):
        label = {r.key: r.label for r in out.collect()}
        assert len({label[k] for k in "abc"}) == 1 and len({label[k] for k in "xyz"}) == 1 and label["a"] != label["x"]


def test_resolution(spark):
    rows = [(i, f"c{i}", h, r, t, "MISC", "MISC") for i, (h, r, t) in enumerate([("Tesla", "MAKES", "Tesla Model"), ("Tesla Motors", "HAS", "Palo Alto"), ("Tesla", "HAS", "Elon"), ("Tesla", "HAS", "Elon"), ("Tesla", "IS_LIKE", "Tesla Motors")])]
    log = graph.mention_log(spark.createDataFrame(rows, SCHEMA))
    nodes, edges = graph.nodes(log), graph.edge_counts(log)
    assert {(r.a, r.b) for r in resolve.blocking_pairs(nodes).collect()} == {("tesla", "tesla model"), ("tesla", "tesla motors"), ("tesla model", "tesla motors")}
    named = resolve.nominations(nodes, edges, 0.7)
    assert ("tesla", "tesla model") not in {(r.a, r.b) for r in named.collect()}
    batches = resolve.batches(components.components(named), nodes)
    groups = resolve.judged_groups(batches, lambda keys: [["tesla", "tesla motors", "tesla"], ["tesla", "tesla model"], ["nobody"]])
    key_map = resolve.canonical(groups, nodes)
    assert [tuple(r) for r in key_map.collect()] == [("tesla motors", "tesla")]
    merged = {(r.head, r.relation, r.tail) for r in graph.edge_counts(resolve.renamed(log, key_map)).collect()}
    assert ("tesla", "IS_LIKE", "tesla") in merged and ("tesla", "HAS", "palo alto") in merged


def test_span_scores(spark):
    cols = "start int, end int, type string"
    gold = spark.createDataFrame([(3, 8, "EVENT"), (10, 14, "LOCATION"), (20, 22, "LOCATION"), (30, 31, "PRODUCT"), (30, 31, "PRODUCT")], cols)
    found = spark.createDataFrame([(3, 8, "EVENT"), (10, 14, "LOCATION"), (20, 23, "LOCATION"), (30, 31, "PRODUCT")], cols)
    got = {r.type: r for r in spans.span_scores(gold, found).collect()}
    assert (got["micro"].p, got["micro"].r, got["LOCATION"].p, got["PRODUCT"].r, got["EVENT"].f1) == (0.75, 0.6, 0.5, 0.5, 1.0)
    assert spans.span_scores(gold.limit(0), gold.limit(0)).where("type = 'micro'").first().f1 == 1.0
    tags = spark.createDataFrame([("d", i, t) for i, t in enumerate(["B-MISC", "I-MISC", "B-MISC", "O", "I-LOC", "I-PER"])], "doc string, pos int, tag string")
    assert sorted((r.start, r.end, r.type) for r in spans.decode_bio(tags).collect()) == [(0, 1, "MISC"), (2, 2, "MISC"), (4, 4, "LOC"), (5, 5, "PER")]
    assert set(spans.seeded_split([f"d{i}" for i in range(20)]).values()) == {"train", "dev", "test"}


def test_files_and_stream(spark, tmp_path):
    good = {"chunk_id": "c1", "doc": "d", "triples": [{"head": "a", "relation": "b", "tail": "c"}], "entities": []}
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\nnot json\n")
    assert files.read_extractions(spark, str(tmp_path / "x.jsonl")).count() == 1
    for part in ([("c1", "d", "t"), ("c2", "d", "fail")], [("c2", "d", "t"), ("c3", "d", "t")]):
        spark.createDataFrame(part, "chunk_id string, doc string, text string").write.mode("append").json(f"{tmp_path}/in")
        fact = F.array(F.struct(F.col("doc").alias("head"), F.lit("R").alias("relation"), F.col("text").alias("tail")))
        out = ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda c, fact=fact: c.select("chunk_id", "doc", F.when(F.col("text") != "fail", fact).alias("triples"), F.array().cast("array<struct<name:string,type:string>>").alias("entities")))
    assert sorted(r.chunk_id for r in out.collect()) == ["c1", "c3"]
    assert [r.chunk_id for r in spark.read.parquet(f"{tmp_path}/out/failed").collect()] == ["c2"]


def test_ports_retry_and_report(spark):
    def client():
        seen = {}

        def ask(system, user):
            seen[user] = seen.get(user, 0) + 1
            if user == "never" or (user == "later" and seen[user] < 2):
                raise TimeoutError("slow")
            return "no json" if user == "odd" else '{"score": 7}'

        return ask

    prompts = spark.createDataFrame([("s", u) for u in ("at once", "later", "never", "odd")], "system string, user string").coalesce(1)
    got = {r.user: r for r in ports.answered(prompts, client, 2, 0.0).collect()}
    assert got["at once"].answer == got["later"].answer == '{"score": 7}' and got["later"].error is None
    assert got["never"].answer is None and got["never"].error == "TimeoutError: slow" and got["odd"].error.startswith("JSONDecodeError")


def test_graph_files(spark, toy, tmp_path):
    log = graph.mention_log(toy)
    nodes, edges = graph.nodes(log), graph.edges(log)
    files.write_graph_json(nodes, edges, f"{tmp_path}/g")
    assert spark.read.json(f"{tmp_path}/g/nodes").count() == 8 and spark.read.json(f"{tmp_path}/g/edges").first().source_chunks
    (tmp_path / "failed.json").write_text('["c2", "c1"]')
    assert sorted(r.chunk_id for r in files.read_failed(spark, f"{tmp_path}/failed.json").collect()) == ["c1", "c2"]
    chunks = spark.createDataFrame([("d", 1, "bb"), ("d", 0, "a" * 130)], "doc string, chunk_ord int, text string")
    files.write_index(spark.createDataFrame([("d", "a" * 130 + "\nb"), ("none", "")], "doc string, text string"), chunks, f"{tmp_path}/index")
    rows = {r.doc: (r.chars, r.num_chunks, r.chunks_preview) for r in spark.read.json(f"{tmp_path}/index").collect()}
    assert rows == {"d": (132, 2, "a" * 120 + "..."), "none": (0, 0, "")}
    members = nodes.withColumn("id", F.when(F.col("key").contains("il"), 1).otherwise(0).cast("long"))
    files.write_communities(members, spark.createDataFrame([(0, "both")], "id long, summary string"), f"{tmp_path}/com")
    back = files.read_communities(spark, f"{tmp_path}/com")
    assert {r.id: (r.size, r.summary) for r in back.collect()} == {0: (6, "both"), 1: (2, "")}
    assert files.community_of(back).count() == 8 and back.where("id = 0").first().entities[0].key == "lumen harbour"
    key_map = spark.createDataFrame([("b", "a")], "key string, canon string")
    files.write_merge_log(spark.createDataFrame([("a", "b", 0.73456)], "a string, b string, score double"), spark.createDataFrame([("g", "a"), ("g", "b")], "group string, key string"), key_map, 0.5, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log/nominations").first().score == 0.735
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/log/audit").select("canonical", "absorbed").collect()] == [("a", ["b"])]
    odd = spark.createDataFrame([("</script>",)], "key string")
    assert "</script>" not in files.page(odd, odd, "t<").replace(";</script>", "")


def test_modularity_of_two_pairs(spark):
    adj = spark.createDataFrame([(a, b, 1.0) for x, y in ("ab", "cd") for a, b in ((x, y), (y, x))], "src string, dst string, w double")
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "key string, label int")
    assert graph.modularity(adj, labels).first()[0] == pytest.approx(0.5)
    assert graph.modularity(adj.limit(0), labels).first()[0] == 0.0


def test_a_missing_rating_is_none(spark):
    rows = spark.createDataFrame([(1, 150), (2, None), (3, 19), (4, 40)], "id int, score int")
    assert [(r.id, r.score) for r in search.best_communities(rows).collect()] == [(1, 100), (4, 40)]
    said = spark.createDataFrame([(1, "{}"), (2, '{"score": "high"}'), (3, None), (4, '{"score": 55}')], "id int, answer string")
    assert [r.s for r in said.orderBy("id").select(ports.rating(F.col("answer")).alias("s")).collect()] == [0, 0, 0, 55]


def test_propagation_in_order_is_the_sequential_algorithm(spark):
    """Against a plain loop that shuffles the first order anew in each round, on graphs that need several rounds."""
    import random

    def plain(near, seed=42):
        rng, label = random.Random(seed), {k: i for i, k in enumerate(near)}
        for _ in range(20):
            order, calm = list(near), True
            rng.shuffle(order)
            for k in order:
                votes = {}
                for o, w in near[k].items():
                    votes[label[o]] = votes.get(label[o], 0.0) + w
                top = max(votes.values())
                if top > votes.get(label[k], 0.0):
                    label[k], calm = min(x for x, w in votes.items() if w == top), False
            if calm:
                break
        return label

    for seed in range(4):
        r = random.Random(seed)
        near = {f"k{i:02}": {} for i in range(30)}
        for _ in range(55):
            a, b = r.sample(sorted(near), 2)
            near[a][b] = near[b][a] = float(r.randint(1, 3))
        near = {k: dict(sorted(v.items())) for k, v in near.items() if v}
        adj = spark.createDataFrame([(a, b, w) for a, v in near.items() for b, w in v.items()], "src string, dst string, w double")
        order = spark.createDataFrame([(k, i) for i, k in enumerate(near)], "key string, node_seq long")
        assert {x.key: x.label for x in components.propagate_in_order(adj, order).collect()} == plain(near)
