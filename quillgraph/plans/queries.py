"""Every registered query: a function of (spark, sf_dir), and its SQL where an independent engine can run it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import components as C
from ..operators import graph as G
from ..operators import resolve as R
from ..operators import search as S
from ..operators import spans as N
from ..sources.tables import facts, table
from . import sql as Q
from .fixtures import ACCENTED, ACCENTED_KEYS, MENTIONS, TOY, TOY_SEED

QUERIES: dict = {}
ORACLES: dict = {}
SEED = "supplier 000000001"

_ROWS = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in MENTIONS)
_TOY = ", ".join("(" + ", ".join(f"'{x}'" for x in r[1:]) + ")" for r in TOY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def every_fact(spark, sf_dir):
    """The tables' facts, and some with names beyond ASCII."""
    own = spark.createDataFrame(ACCENTED, "seq long, head string, relation string, tail string, head_type string, tail_type string")
    return facts(spark, sf_dir).unionByName(own.withColumn("chunk_id", F.concat(F.lit("extra::"), "seq")))


def log(spark, sf_dir):
    return G.mention_log(every_fact(spark, sf_dir))


def graph(spark, sf_dir):
    """Nodes and edges, both from the distinct facts with their numbers, which are written once; all that follows is small."""
    own = G.mentions(every_fact(spark, sf_dir))
    return G.nodes(own), G.edge_counts(own)


def fixture_and_facts(spark, sf_dir) -> DataFrame:
    """(id, head, relation, tail, ...): the fixture, and the tables' distinct facts (id: 1000 and their first seq)."""
    own = G.compact(facts(spark, sf_dir)).select((F.col("first") + 1000).alias("id"), "head", "relation", "tail")
    return fixture(spark).select(F.col("id").cast("long").alias("id"), "head", "relation", "tail").unionByName(own)


def fixture(spark) -> DataFrame:
    return spark.createDataFrame(MENTIONS, "id int, head string, relation string, tail string").withColumns({"seq": F.col("id").cast("long"), "chunk_id": F.lit("c"), "head_type": F.lit("MISC"), "tail_type": F.lit("MISC")})


def kinds(nodes: DataFrame) -> DataFrame:
    k = F.col("key")
    return nodes.select("*", F.when(k.startswith("supplier"), 0).when(k.startswith("nation"), 1).when(k.startswith("brand"), 2).otherwise(3).alias("label"))


# ---- text


@query(r"""SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('== Head ==' || chr(10) || text, '(?m)^==+\s*(.+?)\s*==+\s*$', '\1:', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.concat(F.lit("== Head ==\n"), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


@query()
def chunk_documents(spark, sf_dir):
    cleaned = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("c"))
    chunks = cleaned.select("doc_id", F.posexplode(T.chunk_text(F.col("c"))).alias("chunk_ord", "text"))
    return chunks.select("doc_id", "chunk_ord", F.concat_ws("::", "doc_id", "chunk_ord").alias("chunk_id"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN before IS NULL THEN text ELSE right(before, 150) || ' ' || text END AS text FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def chunk_overlap(spark, sf_dir):
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before)
    return rows.select("conv_id", "turn", F.when(F.col("before").isNull(), F.col("text")).otherwise(F.concat(F.right("before", F.lit(150)), F.lit(" "), F.col("text"))).alias("text"))


@query(f"WITH {Q.FACTS}, v(id, h, r, t) AS (VALUES {_ROWS}), n AS (SELECT head AS name FROM facts UNION SELECT tail FROM facts UNION SELECT h FROM v UNION SELECT t FROM v) SELECT name, {Q.key('name')} AS key FROM n UNION ALL SELECT * FROM (VALUES {Q.values(ACCENTED_KEYS.items())}) x")
def normalize_entities(spark, sf_dir):
    own = every_fact(spark, sf_dir).select("head", "tail").unionByName(fixture(spark).select("head", "tail"))
    names = own.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    return T.with_keys(names, {"name": "key"})


@query(f"SELECT relation, {Q.relation('relation')} AS name, {Q.canonical(Q.relation('relation'))} AS canonical FROM (SELECT DISTINCT event_type || ' of-the  thing' AS relation FROM events UNION SELECT r FROM (VALUES {_ROWS}) v(id, h, r, t) UNION SELECT * FROM (VALUES ('co-founded'), ('__x__'), ('works for'), ('\" in \"')) x)")
def normalize_relations(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" of-the  thing")).alias("relation")).union(fixture(spark).select("relation")).union(spark.createDataFrame([("co-founded",), ("__x__",), ("works for",), ('" in "',)], "relation string")).distinct()
    return own.select("relation", T.relation_name(F.col("relation")).alias("name"), T.canonical_relation(F.col("relation")).alias("canonical"))


@query(f"WITH {Q.FACTS}, {Q.gate(_ROWS)} SELECT id, rel, hk AS head_key, tk AS tail_key, verdict FROM judged")
def triple_gate_rejects(spark, sf_dir):
    return G.judged(fixture_and_facts(spark, sf_dir)).select("id", "rel", "head_key", "tail_key", "verdict")


@query(f"WITH {Q.FACTS}, {Q.gate(_ROWS)} SELECT id, head, relation, tail FROM split WHERE head <> tail AND len(string_split(head, ' ')) <= 7 AND len(string_split(tail, ' ')) <= 7")
def compound_split(spark, sf_dir):
    return G.accepted_pairs(fixture_and_facts(spark, sf_dir)).select("id", F.col("hk").alias("head"), F.col("rel").alias("relation"), F.col("tk").alias("tail"))


# ---- graph


@query(f"WITH {Q.GRAPH} SELECT * FROM nodes")
def kg_nodes(spark, sf_dir):
    return graph(spark, sf_dir)[0].withColumn("aliases", F.array_join("aliases", "|"))


@query(f"WITH {Q.GRAPH} SELECT * FROM edges")
def kg_edges(spark, sf_dir):
    return G.edge_sizes(log(spark, sf_dir))


@query(f"WITH {Q.LOG}, c AS (SELECT head, relation, tail, chunk_id, min(seq) AS s FROM log GROUP BY ALL) SELECT head, relation, tail, md5(string_agg(chunk_id, '|' ORDER BY s, chunk_id)) AS chunks FROM c GROUP BY ALL")
def kg_edge_chunks(spark, sf_dir):
    return G.edges(log(spark, sf_dir)).select("head", "relation", "tail", F.md5(F.array_join("source_chunks", "|")).alias("chunks"))


@query(f"WITH {Q.BACKFILL} SELECT key, type FROM typed")
def kg_types_backfilled(spark, sf_dir):
    return G.backfilled(*graph(spark, sf_dir)).select("key", "type")


@query(f"WITH {Q.GRAPH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_edges, CAST(sum(mentions) AS BIGINT) AS edge_mentions, round(2 * count(*) / (SELECT count(*) FROM nodes), 2) AS avg_degree FROM edges")
def kg_stats(spark, sf_dir):
    return G.stats(*graph(spark, sf_dir))


@query(f"WITH {Q.GRAPH} SELECT key, count(*) AS degree FROM (SELECT head AS key, edge_seq * 2 AS s FROM edges UNION ALL SELECT tail, edge_seq * 2 + 1 FROM edges) GROUP BY key ORDER BY degree DESC, min(s) LIMIT 8")
def kg_top_hubs(spark, sf_dir):
    return G.top_hubs(graph(spark, sf_dir)[1])


@query(f"WITH {Q.GRAPH} SELECT relation, count(*) AS n_edges FROM edges GROUP BY relation ORDER BY n_edges DESC, min(edge_seq) LIMIT 10")
def kg_relation_hist(spark, sf_dir):
    return G.relation_histogram(graph(spark, sf_dir)[1])


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def resume_todo(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'MISC') AS type FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def type_lookup(spark, sf_dir):
    types = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(types, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("MISC")).alias("type"))


# ---- resolution


@query(f"WITH {Q.BLOCKED} SELECT a, b FROM pairs")
def blocking_pairs(spark, sf_dir):
    return R.blocking_pairs(graph(spark, sf_dir)[0])


@query(f"WITH {Q.BLOCKED} SELECT a, b FROM guarded")
def product_guard(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return R.guarded(R.blocking_pairs(nodes), edges)


@query(f"WITH {Q.BLOCKED} SELECT a, b, round(score, 6) AS score FROM scored")
def similarity_scores(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return R.scored(R.guarded(R.blocking_pairs(nodes), edges)).withColumn("score", F.round("score", 6))


@query(f"WITH {Q.BLOCKED} SELECT a, b, round(score, 3) AS score FROM scored WHERE score >= 0.5")
def nominations(spark, sf_dir):
    return R.nominations(*graph(spark, sf_dir)).withColumn("score", F.round("score", 3))


def parts_of(spark, sf_dir):
    """Mentions, nodes and components; nodes are written once, for blocking and for what follows the components."""
    own = G.mentions(every_fact(spark, sf_dir))
    nodes = C.checkpointed(G.nodes(own))
    return own, nodes, C.components(R.nominations(nodes, G.edge_counts(own), 0.65))


@query(f"WITH {Q.COMPONENTS} SELECT key, component FROM parts")
def merge_components(spark, sf_dir):
    return parts_of(spark, sf_dir)[2]


@query(f"WITH {Q.COMPONENTS} SELECT component, CAST((row_number() OVER (PARTITION BY component ORDER BY mentions DESC, node_seq) - 1) // 15 AS INTEGER) AS batch, key FROM parts JOIN nodes USING (key)")
def llm_batches(spark, sf_dir):
    _, nodes, parts = parts_of(spark, sf_dir)
    return R.batches(parts, nodes).select("component", "batch", "key")


@query(f"WITH {Q.COMPONENTS} SELECT component AS \"group\", first(key ORDER BY mentions DESC, length(display) DESC, node_seq) AS canon FROM parts JOIN nodes USING (key) GROUP BY component")
def canonical_pick(spark, sf_dir):
    _, nodes, parts = parts_of(spark, sf_dir)
    own = parts.join(nodes.select("key", "mentions", "display", "node_seq"), "key")
    return own.groupBy(F.col("component").alias("group")).agg(F.max_by("key", F.struct("mentions", F.length("display"), -F.col("node_seq"))).alias("canon"))


@query(f"""WITH {Q.COMPONENTS}, canon AS (SELECT component, first(key ORDER BY mentions DESC, length(display) DESC, node_seq) AS canon FROM parts JOIN nodes USING (key) GROUP BY component),
m AS (SELECT key, canon FROM parts JOIN canon USING (component)) SELECT coalesce(h.canon, head) AS head, relation, coalesce(t.canon, tail) AS tail, count(*) AS mentions FROM log LEFT JOIN m h ON head = h.key LEFT JOIN m t ON tail = t.key GROUP BY ALL""")
def merged_edges(spark, sf_dir):
    log_, nodes, parts = parts_of(spark, sf_dir)
    key_map = R.canonical(parts.select(F.col("component").alias("group"), "key"), nodes)
    return G.edge_counts(R.renamed(log_, key_map)).drop("edge_seq")


@query(f"""WITH {Q.GRAPH}, e AS (SELECT head AS key, edge_seq, relation, tail AS other, relation || ' -> ' || n.display AS line FROM edges JOIN nodes n ON tail = n.key
  UNION ALL SELECT tail, edge_seq, relation, head, '<- ' || relation || ' from ' || n.display FROM edges JOIN nodes n ON head = n.key WHERE head <> tail),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY edge_seq, relation, other) AS r FROM e), c AS (SELECT key, string_agg(line, '; ' ORDER BY r) AS edges FROM r WHERE r <= 5 GROUP BY key)
SELECT key, '"' || display || '" (type=' || type || ', mentions=' || mentions || ') | edges: ' || coalesce(c.edges, '(no edges)') AS context FROM nodes LEFT JOIN c USING (key)""")
def entity_context(spark, sf_dir):
    return R.context(*graph(spark, sf_dir))


@query(f"WITH {Q.BLOCKED} SELECT a, b, x.display AS a_name, y.display AS b_name, round(score, 3) AS score FROM scored JOIN nodes x ON a = x.key JOIN nodes y ON b = y.key WHERE score >= 0.5")
def nominations_named(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return R.with_displays(R.nominations(nodes, edges), nodes).withColumn("score", F.round("score", 3))


# ---- communities


@query(f"WITH {Q.ADJACENT} SELECT src, dst, round(w, 6) AS w FROM adj")
def adjacency_weights(spark, sf_dir):
    return G.adjacency(graph(spark, sf_dir)[1]).withColumn("w", F.round("w", 6))


@query(f"WITH {Q.ADJACENT}, v AS (SELECT src AS key, label, round(sum(w), 9) AS w FROM adj JOIN labels ON dst = key GROUP BY ALL), b AS (SELECT key, first(label ORDER BY w DESC, label) AS best, max(w) AS top FROM v GROUP BY key) SELECT l.key, CASE WHEN top > coalesce(v.w, 0) THEN best ELSE l.label END AS label FROM labels l LEFT JOIN b USING (key) LEFT JOIN v ON v.key = l.key AND v.label = l.label")
def lpa_sync_round(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    # Ranks of all nodes need one order over them; ids alone would do where the graph is large.
    labels = nodes.select("key", (F.row_number().over(W.orderBy("node_seq", "key")) - 1).cast("long").alias("label"))
    return C.vote(G.adjacency(edges), labels)


@query()
def lpa_scalable(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return C.propagate(G.adjacency(edges), nodes.select("key", F.col("node_seq").alias("label")))


@query()
def lpa_in_order(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return C.propagate_in_order(G.adjacency(edges), nodes.select("key", "node_seq"))


@query(f"WITH {Q.GRAPH}, c AS (SELECT {Q.KINDS} AS label, mentions, node_seq FROM nodes) SELECT row_number() OVER (ORDER BY sum(mentions) DESC, min(node_seq)) - 1 AS id, count(*) AS size, CAST(sum(mentions) AS BIGINT) AS mentions FROM c GROUP BY label")
def community_rank(spark, sf_dir):
    own = kinds(graph(spark, sf_dir)[0]).groupBy("label").agg(F.count("*").alias("size"), F.sum("mentions").alias("mentions"), F.min("node_seq").alias("s"))
    return own.select((F.row_number().over(W.orderBy(F.col("mentions").desc(), "s")) - 1).cast("long").alias("id"), "size", "mentions")


@query(f"""WITH {Q.GRAPH}, l AS (SELECT key, {Q.KINDS} AS label FROM nodes), x AS (SELECT e.*, h.label AS hl, t.label AS tl FROM edges e JOIN l h ON head = h.key JOIN l t ON tail = t.key)
SELECT label, head || ' --[' || relation || ' x' || mentions || ']--> ' || tail || CASE WHEN hl <> tl THEN ' (border)' ELSE '' END AS line FROM (SELECT *, hl AS label FROM x UNION SELECT *, tl FROM x)""")
def community_relations(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    own = kinds(nodes).select("key", "label")
    x = edges.join(own.select(F.col("key").alias("head"), F.col("label").alias("hl")), "head").join(own.select(F.col("key").alias("tail"), F.col("label").alias("tl")), "tail")
    line = F.format_string("%s --[%s x%d]--> %s%s", "head", "relation", "mentions", "tail", F.when(F.col("hl") != F.col("tl"), " (border)").otherwise(""))
    return x.select(F.explode(F.array_distinct(F.array("hl", "tl"))).alias("label"), line.alias("line"))


@query(f"""WITH {Q.ADJACENT}, l AS (SELECT key, {Q.KINDS} AS label FROM nodes), x AS (SELECT s.label AS a, d.label AS b, w FROM adj JOIN l s ON src = s.key JOIN l d ON dst = d.key),
c AS (SELECT a, sum(w) AS deg, coalesce(sum(w) FILTER (a = b), 0) AS ins FROM x GROUP BY a) SELECT round(sum(ins) / sum(deg) - sum(deg * deg) / (sum(deg) * sum(deg)), 6) AS modularity FROM c""")
def modularity(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return G.modularity(G.adjacency(edges), kinds(nodes).select("key", "label")).select(F.round("modularity", 6).alias("modularity"))


# ---- search


@query(f"""WITH {Q.GRAPH}, m(mention) AS (VALUES ('Supplier#000000001'), ('The NATION_3 Inc'), ('000000002'), ('no such thing')), k AS (SELECT mention, {Q.key('mention')} AS mk FROM m),
x AS (SELECT mention, key, mentions, node_seq FROM k JOIN nodes ON key = mk), y AS (SELECT * FROM x UNION ALL SELECT mention, key, mentions, node_seq FROM k JOIN nodes ON contains(key, mk) OR contains(mk, key) WHERE mention NOT IN (SELECT mention FROM x))
SELECT mention, first(key ORDER BY mentions DESC, node_seq) AS key FROM y GROUP BY mention""")
def link_entities(spark, sf_dir):
    asked = spark.createDataFrame([("Supplier#000000001",), ("The NATION_3 Inc",), ("000000002",), ("no such thing",)], "mention string")
    asked = T.with_keys(asked, {"mention": "mention_key"})
    return S.link(asked, graph(spark, sf_dir)[0])


_HOPS = f"""{Q.GRAPH}, one AS (SELECT *, 1 AS hop FROM edges WHERE head = '{SEED}' OR tail = '{SEED}'),
out AS (SELECT head AS key FROM one UNION SELECT tail FROM one), two AS (SELECT *, 2 AS hop FROM edges WHERE (head IN (SELECT key FROM out WHERE key <> '{SEED}') OR tail IN (SELECT key FROM out WHERE key <> '{SEED}')) AND head <> '{SEED}' AND tail <> '{SEED}'),
found AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


def seeds(spark):
    return spark.createDataFrame([(SEED,)], "key string")


@query(f"WITH {_HOPS} SELECT head, relation, tail, mentions FROM one")
def local_hop1(spark, sf_dir):
    return S.evidence(graph(spark, sf_dir)[1], seeds(spark), 1).select("head", "relation", "tail", "mentions")


@query(f"WITH {_HOPS} SELECT head, relation, tail, hop FROM found")
def local_hop2(spark, sf_dir):
    return S.evidence(graph(spark, sf_dir)[1], seeds(spark), 2).select("head", "relation", "tail", "hop")


@query(f"WITH {_HOPS} SELECT head, relation, tail, n_chunks, CAST((head = '{SEED}') AS INTEGER) + CAST((tail = '{SEED}') AS INTEGER) AS touches FROM found ORDER BY touches DESC, n_chunks DESC, edge_seq, head, relation, tail LIMIT 40")
def ranked_facts(spark, sf_dir):
    rows = every_fact(spark, sf_dir)
    own = G.mentions(rows)
    sizes = lambda some: G.edge_chunks(rows, own, some).groupBy("head", "relation", "tail").agg(F.count("chunk_id").alias("n_chunks"))
    return S.best_facts(G.edge_counts(own), seeds(spark), sizes).select("head", "relation", "tail", "n_chunks", "touches")


@query(f"WITH {_HOPS} SELECT DISTINCT chunk_id FROM log JOIN one USING (head, relation, tail)")
def evidence_chunks(spark, sf_dir):
    rows = every_fact(spark, sf_dir)
    own = G.mentions(rows)
    return G.edge_chunks(rows, own, S.evidence(G.edge_counts(own), seeds(spark), 1)).select("chunk_id").distinct()


@query(f"""WITH e(head, relation, tail) AS (VALUES {_TOY}), n AS (SELECT * FROM e WHERE head = '{TOY_SEED}' OR tail = '{TOY_SEED}'), o AS (SELECT CASE WHEN head = '{TOY_SEED}' THEN tail ELSE head END AS head FROM n)
SELECT * FROM n UNION SELECT * FROM e WHERE head IN (SELECT head FROM o) AND tail <> '{TOY_SEED}'""")
def toy_two_hop(spark, sf_dir):
    return S.outgoing_two_hops(spark.createDataFrame(TOY, "chunk string, head string, relation string, tail string").drop("chunk"), TOY_SEED)


@query("SELECT id, score FROM (SELECT p_partkey AS id, CAST(greatest(0, least(100, p_size * 3 - 20)) AS INTEGER) AS score FROM part ORDER BY score DESC, id LIMIT 5) WHERE score >= 20")
def global_topk(spark, sf_dir):
    return S.best_communities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3 - 20).alias("score")))


@query(f"""WITH {Q.GRAPH}, l AS (SELECT key, {Q.KINDS} AS label FROM nodes), part_ AS (SELECT * FROM edges WHERE mentions >= 2),
keep AS (SELECT key FROM (SELECT head AS key, edge_seq * 2 AS s FROM part_ UNION ALL SELECT tail, edge_seq * 2 + 1 FROM part_) GROUP BY key ORDER BY count(*) DESC, min(s) LIMIT 100)
SELECT head, relation, tail, mentions, h.label <> t.label AS dashed, CAST(round(1 + least(mentions, 8) * 0.6, 6) AS DOUBLE) AS width FROM part_ JOIN l h ON head = h.key JOIN l t ON tail = t.key WHERE head IN (FROM keep) AND tail IN (FROM keep)""")
def vis_subgraph(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return G.vis_subgraph(edges, kinds(nodes).select("key", "label"), 2, 100)


# ---- spans


@query("""WITH d AS (SELECT doc_id, text, string_split(text, ' ')[1] AS name FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, name, text, generate_series(1, length(text) - length(name) + 1) AS places FROM d WHERE name <> ''), u AS (SELECT doc_id, name, text, unnest(places) AS place FROM n)
SELECT doc_id AS doc, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(place - 1) AS BIGINT) AS starts FROM u WHERE substr(text, place, length(name)) = name GROUP BY doc_id""")
def span_annotate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text", F.split("text", " ")[0].alias("name"), F.lit("person ").alias("type")).where("name <> ''")
    return N.annotated(docs).where("start is not null").groupBy("doc").agg(F.count("*").alias("n_spans"), F.sum(F.col("start").cast("long")).alias("starts"))


@query(f"WITH {Q.FACTS}, c AS (SELECT {Q.canonical('relation')} AS relation, count(*) AS n FROM facts GROUP BY ALL) SELECT relation, n, {Q.CENSUS} AS status FROM c")
def relation_census(spark, sf_dir):
    return N.relation_census(facts(spark, sf_dir))


@query("SELECT doc, CASE WHEN h = 0 THEN 'test' WHEN h = 1 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id AS doc, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS h FROM documents)")
def doc_split(spark, sf_dir):
    return N.hashed_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc")))


@query("""WITH g AS (SELECT doc_id, coalesce(lang, '') AS type, count(*) AS g FROM documents GROUP BY ALL), f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE coalesce(lang, '') END AS type, count(*) AS p FROM documents WHERE doc_id % 5 > 0 GROUP BY ALL),
b AS (SELECT type, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN f USING (doc_id, type)), s AS (SELECT coalesce(type, 'micro') AS type, sum(least(g, p)) AS tp, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS pred FROM b GROUP BY ROLLUP (type)),
q AS (SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS pp, CASE WHEN gold = 0 THEN 0 ELSE tp / gold END AS rr FROM s)
SELECT type, round(pp, 4) AS p, round(rr, 4) AS r, round(CASE WHEN pp + rr = 0 THEN 0 ELSE 2 * pp * rr / (pp + rr) END, 4) AS f1, gold, pred FROM q""")
def span_prf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("type"))
    return N.span_scores(docs, docs.where("doc_id % 5 > 0").withColumn("type", F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("type"))))


_TAGS = "CASE WHEN event_id % 5 = 0 THEN 'O' WHEN event_id % 3 = 0 THEN 'B-' || event_type ELSE 'I-' || event_type END"


@query(f"""WITH t AS (SELECT user_id AS doc, event_id AS pos, {_TAGS} AS tag FROM events), k AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE substr(tag, 3) END AS type FROM t),
s AS (SELECT *, type IS NOT NULL AND (tag LIKE 'B-%' OR lag(type) OVER w IS DISTINCT FROM type) AS start FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)), i AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc ORDER BY pos) AS island FROM s)
SELECT doc, min(pos) AS start, max(pos) AS "end", min(type) AS type FROM i WHERE type IS NOT NULL GROUP BY doc, island""")
def bio_decode(spark, sf_dir):
    tag = F.when(F.col("event_id") % 5 == 0, "O").when(F.col("event_id") % 3 == 0, F.concat(F.lit("B-"), "event_type")).otherwise(F.concat(F.lit("I-"), "event_type"))
    return N.decode_bio(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), tag.alias("tag")))


# ---- ports


_ANSWERS = [(1, '{"score": 130, "route": "Global", "entities": ["a", " ", "b", "c", "d", "e", "f"]}'), (2, '{"score": "41.9", "route": "local", "entities": []}'), (3, '{"entities": "x"}'), (4, '{"score": -3, "route": "other", "entities": ["only"]}')]


@query("""SELECT * FROM (VALUES (1, 100, 'global', 'a|b|c|d|e'), (2, 41, 'local', ''), (3, 0, 'local', ''), (4, 0, 'local', 'only')) v(id, score, route, names)""")
def model_answers(spark, sf_dir):
    """What is read from a model's answers, by values fixed in advance."""
    from ..operators import ports as P

    a = F.col("answer")
    return spark.createDataFrame(_ANSWERS, "id int, answer string").select("id", P.rating(a).alias("score"), P.route(a).alias("route"), F.array_join(P.names_asked(a), "|").alias("names"))


# ---- vectors and streams


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), r AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS cosine FROM e JOIN e q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM r) WHERE r <= 20""")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return S.vector_topk(rows, rows.where("vec_id % 50 = 0"))


@query("SELECT 'c' || doc_id AS chunk_id, 1 AS n_triples FROM documents")
def stream_resume(spark, sf_dir):
    """Two runs of the stream over files that overlap: every chunk is extracted once."""
    from ..streaming.ingest import ingest

    path = f"{C.shared_base(spark)}/stream-{uuid.uuid4().hex}"
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text")
    fact = F.struct(F.col("doc").alias("head"), F.lit("NAMES").alias("relation"), F.col("text").alias("tail"))
    extract = lambda c: c.select("chunk_id", "doc", F.array(fact).alias("triples"), F.array().cast("array<struct<name:string,type:string>>").alias("entities"))
    for half in (F.crc32("chunk_id") % 2 == 0, F.lit(True)):
        chunks.where(half).write.mode("append").option("compression", "gzip").json(f"{path}/in")
        out = ingest(spark, f"{path}/in", f"{path}/out", extract)
    return out.select("chunk_id", F.size("triples").alias("n_triples"))
