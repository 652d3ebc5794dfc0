"""What must not grow faster than the input."""

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import components, datasets, graph, search
from quillgraph.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_a_tables_estimated_size_does_not_grow_with_rounds(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("key"), F.col("id").alias("label"))
    for _ in range(6):
        rows = components.checkpointed(rows.join(rows.withColumnRenamed("label", "new"), "key").select("key", F.least("label", "new").alias("label")))
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**6


def test_propagation_in_order_takes_batches_of_numbers(spark):
    """No group of all rows is handed over at once; a node without known neighbours keeps its label."""
    adj = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "?", 1.0)], "src string, dst string, w double")
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "key string, node_seq long")
    out = components.propagate_in_order(adj, order)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    got = {r.key: r.label for r in out.collect()}
    assert got["a"] == got["b"] and got["c"] == 2


def joins(df):
    """The conditions of a plan's joins."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {line}"]


def test_no_join_deals_facts_by_relation_alone(spark):
    """Two relations make up most facts: a join on them left half of all facts to one task."""
    for run in (queries.kg_edges, queries.kg_edge_chunks, queries.evidence_chunks, queries.ranked_facts):
        assert not [j for j in joins(run(spark, SMALL)) if "raw_relation" in j and "raw_head" not in j], run.__name__


def test_a_mention_log_has_a_row_for_each_accepted_fact(spark):
    rows = [(1, "c1", "Acme", None, "Bolt", None, "x"), (2, "c1", "Acme", "", "Bolt", "y", None), (3, None, "ACME", " ", "Bolt", None, None), (4, "c2", None, "HAS", "Bolt", None, None), (5, "c2", "Ann Lee and Bob Ray", "KNOWS", "Bolt", None, None)]
    facts = spark.createDataFrame(rows, "seq long, chunk_id string, head string, relation string, tail string, head_type string, tail_type string")
    got = sorted((r.seq, r.head, r.relation, r.head_name) for r in graph.mention_log(facts).collect())
    assert got == [(256, "acme", "RELATED_TO", "Acme"), (512, "acme", "RELATED_TO", "Acme"), (768, "acme", "RELATED_TO", "ACME"), (1280, "ann lee", "KNOWS", "Ann Lee"), (1296, "bob ray", "KNOWS", "Bob Ray")]
    own = graph.mentions(facts)
    some = graph.edge_counts(own).where("relation = 'RELATED_TO'")
    assert sorted(str(r.chunk_id) for r in graph.edge_chunks(facts, own, some).collect()) == ["None", "c1"]


def test_chunks_are_counted_of_edges_that_can_rank(spark):
    rows = [("s", "R", "a", 1, 0), ("b", "R", "s", 1, 1), ("a", "R", "c", 9, 2), ("c", "R", "d", 9, 3)]
    edges = spark.createDataFrame(rows, "head string, relation string, tail string, n_chunks long, edge_seq long")
    seeds, asked = spark.createDataFrame([("s",)], "key string"), []
    sizes = lambda some: asked.append(some.count()) or edges.select("head", "relation", "tail", "n_chunks")
    for k, want, counted in ((2, ["sRa", "bRs"], 2), (3, ["sRa", "bRs", "aRc"], 3)):
        got = search.best_facts(edges.drop("n_chunks"), seeds, sizes, k).collect()
        assert [r.head + r.relation + r.tail for r in got] == want and asked.pop() == counted


def test_facts_are_aggregated_once(spark, monkeypatch):
    """What follows blocking or linking reads written tables: facts are extracted once for a query, and the plan left holds no table of theirs."""
    every, seen = queries.every_fact, []
    monkeypatch.setattr(queries, "every_fact", lambda *a: seen.append(a) or every(*a))
    for run in (queries.link_entities, queries.canonical_pick, queries.merged_edges, queries.llm_batches):
        seen.clear()
        plan = run(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(seen) == 1 and "l_suppkey" not in plan, run.__name__


def test_builder_stats_judge_a_window_only_where_its_words_are(spark, monkeypatch):
    rows = [(1, "Ann met The Café Müller of Rome", ["Ann", "cafe muller", "Zzyzx", "", None]), (2, None, ["Ann"]), (3, "Rome", []), (4, "Rome", None), (5, "a - b", ["the", "-!"])]
    df = spark.createDataFrame([(i, t, None if e is None else [(n, "x") for n in e]) for i, t, e in rows], "chunk_id int, text string, entities array<struct<name:string,type:string>>")
    got = datasets.builder_stats(df, 2).first()
    assert tuple(got) == (5, 2, 8, 4, 4, 0.5)
    assert datasets.builder_stats(df.limit(0)).first().mentions == 0
    made, whole = [], text.plain_key
    monkeypatch.setattr(text, "plain_key", lambda x: made.append(x) or whole(x))
    assert text.spans_of("one two three " * 100, "Zzyzx") == [] and made == ["Zzyzx"]
    assert text.spans_of("met Cafe  Muller", "CAFÉ MÜLLER") == [(4, 16)]
