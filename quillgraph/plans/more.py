"""Registered queries on records, chunks, span datasets and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import datasets as D
from ..operators import graph as G
from ..operators import records as R

from ..sources import files
from ..sources.tables import table
from . import sql as Q
from .fixtures import TOY, TOY_SEED
from .queries import _TAGS, _TOY, graph, kinds, query

_TOY_ROWS = Q.values(TOY)


def part_records(spark, sf_dir):
    """A record for each part: three triples, of which one is blank, and entities with types in any case, one of them twice."""
    t = lambda *c: F.struct(*[F.col(x).alias(n) if x in ("p_brand", "p_name", "p_type") else F.lit(x).alias(n) for x, n in zip(c, ("head", "relation", "tail"), strict=True)])
    e = lambda name, kind: F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"))
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("part::"), "p_partkey").alias("chunk_id"), F.array(t("p_brand", "makes", "p_name"), t("p_name", " ", "p_type"), t("p_name", "IS_OF", "p_type")).alias("triples"), F.array(e("p_brand", "EVENT"), e("p_brand", "ORGANIZATION"), e("p_name", "PRODUCT")).alias("entities"))


_RECORD_FACTS = """rf AS (SELECT p_partkey * 20 AS seq, 'part::' || p_partkey AS chunk_id, p_brand AS head, 'makes' AS relation, p_name AS tail, 'ORGANIZATION' AS head_type, 'PRODUCT' AS tail_type FROM part
  UNION ALL SELECT p_partkey * 20 + 1, 'part::' || p_partkey, p_name, 'IS_OF', p_type, 'PRODUCT', 'MISC' FROM part)"""


@query(f"WITH {_RECORD_FACTS} SELECT * FROM rf")
def record_facts(spark, sf_dir):
    return R.facts_of(part_records(spark, sf_dir))


@query(f"WITH {_RECORD_FACTS}, n AS (SELECT {Q.key('head')} AS head, upper(relation) AS relation, {Q.key('tail')} AS tail, chunk_id FROM rf) SELECT head, relation, tail, count(*) AS mentions, count(DISTINCT chunk_id) AS n_chunks FROM n GROUP BY ALL")
def stream_to_graph(spark, sf_dir):
    """Records are written by the stream, in two runs over files that overlap, read back and built into a graph."""
    import uuid

    from ..operators.components import shared_base
    from ..streaming.ingest import ingest

    path = f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"
    records = part_records(spark, sf_dir)
    chunks = records.select("chunk_id", F.lit("part").alias("doc"), F.to_json(F.struct("triples", "entities")).alias("text"))
    kind = "triples array<struct<head:string,relation:string,tail:string>>, entities array<struct<name:string,type:string>>"
    extract = lambda c: c.withColumn("own", F.from_json("text", kind)).select("chunk_id", "doc", "own.triples", "own.entities")
    for half in (F.crc32("chunk_id") % 2 == 0, F.lit(True)):
        chunks.where(half).write.mode("append").option("compression", "gzip").json(f"{path}/in")
        out = ingest(spark, f"{path}/in", f"{path}/out", extract)
    ordered = out.withColumn("ord", F.regexp_extract("chunk_id", "([0-9]+)$", 1).cast("long"))
    return G.edge_sizes(G.mention_log(R.facts_of(ordered))).drop("edge_seq")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)")
def todo_chunks(spark, sf_dir):
    get = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("doc_id"))
    return R.todo(get("documents", "doc_id"), get("labels", "doc_id"), get("benchmark", "item_id"), "doc_id")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("::", "conv_id", "turn").alias("chunk_id"), "conv_id", "text")


@query("SELECT DISTINCT conv_id || '::' || turn AS chunk_id, '[' || conv_id || '::' || turn || '] ' || substr(text, 1, 500) AS line FROM conversations WHERE conv_id % 7 = 0 AND text IS NOT NULL")
def evidence_texts(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return A.chunk_lines(R.texts_of(rows.where("conv_id % 7 = 0").select("chunk_id").unionByName(spark.createDataFrame([("none::1",)], "chunk_id string")), rows.dropDuplicates(["chunk_id", "text"])))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(coalesce(length(text), 0) AS BIGINT) AS chars FROM documents")
def article_index(spark, sf_dir):
    """Sizes of all documents; those without chunks have a row too. (Numbers of chunks and previews are tested, SQL has no fold of this kind.)"""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    chunks = docs.select("doc", F.posexplode(T.chunk_text(F.col("text"))).alias("chunk_ord", "text"))
    return files.index(docs, chunks).select("doc", "chars")


@query("SELECT count(*) AS articles_ok, (SELECT count(*) FROM benchmark) AS articles_failed, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(c) AS BIGINT) AS chars FROM (SELECT conv_id, count(*) AS n, coalesce(sum(length(text)), 0) AS c FROM conversations GROUP BY conv_id)")
def corpus_totals(spark, sf_dir):
    own = turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("num_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return R.totals(own, table(spark, sf_dir, "benchmark"))


# ---- communities


@query(f"""WITH {Q.GRAPH}, m AS (SELECT {Q.KINDS} AS id, key, display, mentions, node_seq FROM nodes), big AS (SELECT id FROM m GROUP BY id HAVING count(*) >= 3),
n AS (SELECT id, string_agg(display, '; ' ORDER BY r) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mentions DESC, node_seq) AS r FROM m WHERE id IN (FROM big)) WHERE r <= 40 GROUP BY id),
x AS (SELECT h.id AS hi, t.id AS ti, edge_seq, h.display || ' --[' || relation || ' x' || e.mentions || ']--> ' || t.display || CASE WHEN h.id <> t.id THEN '  (border)' ELSE '' END AS line FROM edges e JOIN m h ON head = h.key JOIN m t ON tail = t.key),
l AS (SELECT hi AS id, edge_seq, line FROM x UNION ALL SELECT ti, edge_seq, line FROM x WHERE hi <> ti), r AS (SELECT id, string_agg(line, '; ' ORDER BY r) AS relations FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edge_seq, line) AS r FROM l) WHERE r <= 40 GROUP BY id)
SELECT id, entities, relations FROM n LEFT JOIN r USING (id)""")
def community_prompts(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    lines = A.community_lines(kinds(nodes).withColumnRenamed("label", "id"), edges)
    return lines.select("id", F.array_join("entities", "; ").alias("entities"), F.array_join("relations", "; ").alias("relations"))


_INSIDE = """s AS (SELECT * FROM edges WHERE mentions >= 2), keep AS (SELECT key FROM (SELECT head AS key, edge_seq * 2 AS s FROM s UNION ALL SELECT tail, edge_seq * 2 + 1 FROM s) GROUP BY key ORDER BY count(*) DESC, min(s) LIMIT 100),
inside AS (SELECT * FROM s WHERE head IN (FROM keep) AND tail IN (FROM keep)), shown AS (SELECT head AS key FROM inside UNION SELECT tail FROM inside)"""


@query(f"""WITH {Q.GRAPH}, {_INSIDE} SELECT key, display AS label, display || ' | type: ' || type || ' | mentions: ' || mentions || ' | aliases: ' || array_to_string(string_split(aliases, '|')[1:5], ', ') AS title, 'C' || ({Q.KINDS}) AS "group", CAST(round(6 + least(mentions, 40) * 0.7, 6) AS DOUBLE) AS size FROM nodes JOIN shown USING (key)""")
def vis_nodes(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return G.vis_nodes(nodes, G.vis_edges(edges, 2, 100), kinds(nodes).select("key", "label"))


@query(f"""WITH {Q.GRAPH}, {_INSIDE}, m AS (SELECT {Q.KINDS} AS id, key, display, row_number() OVER (PARTITION BY {Q.KINDS} ORDER BY mentions DESC, node_seq) AS r FROM nodes)
SELECT 'C' || id AS "group", string_agg(display, ', ' ORDER BY r) AS names, CASE WHEN id = 0 THEN rpad('suppliers ', 90, 'x') ELSE '' END AS summary FROM m WHERE r <= 4 AND id IN (SELECT id FROM m JOIN shown USING (key)) GROUP BY id""")
def vis_legend(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    own = kinds(nodes)
    vis = G.vis_nodes(nodes, G.vis_edges(edges, 2, 100), own.select("key", "label"))
    return G.legend(vis, own.withColumnRenamed("label", "id"), spark.createDataFrame([(0, "suppliers " + "x" * 200)], "id int, summary string"))


# ---- a store of single edges


@query(f"WITH e(chunk, head, relation, tail) AS (VALUES {_TOY_ROWS}) SELECT 'in' AS way, head AS other, relation, chunk FROM e WHERE tail = '{TOY_SEED}' UNION ALL SELECT 'out', tail, relation, chunk FROM e WHERE head = '{TOY_SEED}' UNION ALL SELECT DISTINCT 'node', n, '', '' FROM (SELECT head AS n FROM e UNION SELECT tail FROM e)")
def toy_store(spark, sf_dir):
    edges = spark.createDataFrame(TOY, "chunk string, head string, relation string, tail string")
    edges = A.added(edges.limit(4), edges.exceptAll(edges.limit(4)))
    way = lambda name, df, other: df.select(F.lit(name).alias("way"), F.col(other).alias("other"), "relation", "chunk")
    nodes = A.all_nodes(edges).select(F.lit("node").alias("way"), F.col("node").alias("other"), F.lit("").alias("relation"), F.lit("").alias("chunk"))
    return way("in", A.incoming(edges, TOY_SEED), "head").unionByName(way("out", A.outgoing(edges, TOY_SEED), "tail")).unionByName(nodes)


@query(f"WITH e(chunk, head, relation, tail) AS (VALUES {_TOY_ROWS}), f AS (SELECT * FROM e WHERE head = '{TOY_SEED}' OR tail = '{TOY_SEED}') SELECT 0 AS part, head || ' --[' || relation || ']--> ' || tail AS line FROM f UNION ALL SELECT DISTINCT 1, '[' || chunk || '] text of ' || chunk FROM f")
def toy_answer(spark, sf_dir):
    edges = spark.createDataFrame(TOY, "chunk string, head string, relation string, tail string")
    chunks = edges.select("chunk").distinct().withColumn("text", F.concat(F.lit("text of "), "chunk"))
    return A.evidence_lines(edges.where((F.col("head") == TOY_SEED) | (F.col("tail") == TOY_SEED)), chunks)


# ---- span datasets


_SCORED = f"""t AS (SELECT user_id AS doc, event_id AS pos, {_TAGS} AS tag, CAST(floor(abs(value)) AS BIGINT) % 2 AS score FROM events), k AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE substr(tag, 3) END AS type FROM t),
s AS (SELECT *, type IS NOT NULL AND (tag LIKE 'B-%' OR lag(type) OVER w IS DISTINCT FROM type) AS start FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)), i AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc ORDER BY pos) AS island FROM s)"""


@query(f"""WITH {_SCORED} SELECT * FROM (SELECT doc, min(pos) AS start, max(pos) AS "end", min(type) AS type, round(avg(score), 3) AS score FROM i WHERE type IS NOT NULL GROUP BY doc, island) WHERE score >= 0.2""")
def scored_spans(spark, sf_dir):
    tag = F.expr(_TAGS)
    score = F.floor(F.abs("value")) % 2
    return D.scored_spans(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), tag.alias("tag"), score.alias("score")), 0.2)


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\f\\r ]+')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), l AS (SELECT conv_id || '::' || turn AS id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM w),
t AS (SELECT *, CASE WHEN pos % 7 = 1 THEN 'PERSON' WHEN pos % 7 = 2 THEN 'PERSON' WHEN pos % 7 = 4 THEN 'LOCATION' END AS type, coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM l)
SELECT a.id, CAST(a.at AS INTEGER) AS start, CAST(coalesce(b.at + length(b.token), a.at + length(a.token)) AS INTEGER) AS "end", a.type FROM t a LEFT JOIN t b ON a.id = b.id AND b.pos = a.pos + 1 AND a.pos % 7 = 1 WHERE a.pos % 7 IN (1, 4)""")
def sentence_spans(spark, sf_dir):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\t\n\f\r ]+"), F.lit(0))
    tag = lambda w, i: F.when(i % 7 == 0, "B-PER").when(i % 7 == 1, "I-PER").when(i % 7 == 3, "B-LOC").otherwise("O")
    rows = turns(spark, sf_dir).select(F.col("chunk_id").alias("id"), words.alias("tokens")).withColumn("tags", F.transform("tokens", tag))
    return D.sentence_spans(rows).drop("text")


@query("""WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, text, w[1] AS name FROM d UNION ALL SELECT doc_id, text, 'Zzyzx' || doc_id FROM d UNION ALL SELECT doc_id, text, '' FROM d)
SELECT (SELECT count(*) FROM d) AS rows, 2::BIGINT AS missing_chunk, count(*) AS mentions, count(*) - CAST(sum((name = '' OR NOT contains(text, name))::INT) AS BIGINT) AS found, CAST(sum((name = '' OR NOT contains(text, name))::INT) AS BIGINT) AS dropped, round(sum((name = '' OR NOT contains(text, name))::INT) / count(*), 4) AS drop_rate FROM e""")
def builder_stats(spark, sf_dir):
    e = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("::0")).alias("chunk_id"), "text", F.array(e(F.split("text", " ")[0], "person"), e(F.concat(F.lit("Zzyzx"), "doc_id"), "x"), e(F.lit(""), "person")).alias("entities"))
    return D.builder_stats(rows, 2)


@query(f"SELECT {Q.canonical(Q.relation('event_type'))} AS relation, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1 HAVING relation NOT IN ({Q.listed(__import__('quillgraph.functions.vocabulary', fromlist=['x']).RELATION_LABELS)})")
def unsupported_relations(spark, sf_dir):
    return D.unsupported(table(spark, sf_dir, "events").select(F.col("event_type").alias("relation")))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split, coalesce(lang, 'none') AS type, count(DISTINCT source) AS n_rows, count(*) AS n_spans FROM documents GROUP BY ALL")
def split_counts(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    return D.split_counts(table(spark, sf_dir, "documents").select(split.alias("split"), F.col("source").alias("id"), F.coalesce("lang", F.lit("none")).alias("type")))


@query("""SELECT * FROM (VALUES (1, 'B-ORG I-ORG O B-PER'), (2, 'O O B-LOC O'), (3, 'O B-X I-X I-X')) v(id, tags)""")
def claimed_spans(spark, sf_dir):
    """Tags of words that spans claim, by values fixed in advance: the longest first, one whose first word is taken is dropped."""
    text = "Acme Corp hired Ann"
    rows = [(1, text, [(0, 9, "ORG"), (5, 9, "MISC"), (16, 19, "PER")]), (2, text, [(10, 15, "LOC")]), (3, text, [(16, 19, "Y"), (5, 19, "X")])]
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int,type:string>>").withColumn("words", D.word_offsets(F.col("text")))
    return df.select("id", F.array_join(D.claimed(F.col("words"), F.col("spans")), " ").alias("tags"))



