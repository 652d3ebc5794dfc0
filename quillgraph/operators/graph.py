"""Building a graph: gate, keys, nodes and edges by aggregation, type votes, statistics.

A node or edge is an aggregate over the log of its mentions, ordered by seq, so rebuilding is a plan, not an upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_vague, parts, relation_name, strip, with_keys
from ..functions.vocabulary import COMPANY_HEAD, JUNK_RELATIONS, OFFICE, PLACE_TAIL, TYPES
from .components import checkpointed


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, each computed once for a row.

    A generator holds them: filters above a projection would repeat its expressions, patterns and all, and those of the projections below it.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(made)))


#: Characters of a name and of a relation at most; a name of these has fewer than PARTS parts.
NAME, RELATION, PARTS = 100, 60, 16


def verdict() -> Column:
    """accept, or why not, from head, relation, tail (stripped), rel, head_key, tail_key, head_vague and tail_vague."""
    return (
        F.when((F.col("head") == "") | (F.col("tail") == ""), "empty").when(F.col("head") == F.col("tail"), "same_raw").when((F.length("head") > NAME) | (F.length("tail") > NAME) | (F.length("relation") > RELATION), "length")
        .when(F.col("head_vague") | F.col("tail_vague"), "vague").when((F.col("head_key") == "") | (F.col("tail_key") == ""), "empty_key").when(F.col("head_key") == F.col("tail_key"), "same_key")
        .when(F.col("rel").isin(JUNK_RELATIONS), "junk_relation").otherwise("accept")
    )


def named(facts: DataFrame) -> DataFrame:
    """(raw, name, key, vague, at, part, part_key): a row for each part of each distinct name of facts; whatever depends on a name alone is computed here."""
    names = facts.select(F.explode(F.array_distinct(F.array(*[F.coalesce(c, F.lit("")) for c in ("head", "tail")]))).alias("raw")).distinct()
    rows = once(names, {"name": strip(F.col("raw"))})
    # Parts of names over the limit are never used, so they aren't split.
    rows = rows.select("raw", "name", is_vague(F.col("name")).alias("vague"), F.posexplode(F.when(F.length("name") <= NAME, parts(F.col("name"))).otherwise(F.array("name"))).alias("at", "part"))
    return with_keys(rows, {"name": "key", "part": "part_key"})


#: Columns of a fact as they are, nulls as empty strings.
RAW = ["raw_head", "raw_relation", "raw_tail"]


def raw(facts: DataFrame) -> DataFrame:
    """facts with RAW in place of head, relation and tail."""
    return facts.select(*[c for c in facts.columns if c not in ("head", "relation", "tail")], *[F.coalesce(c[4:], F.lit("")).alias(c) for c in RAW])


def judged_parts(facts: DataFrame) -> DataFrame:
    """facts with RAW and the gate's verdict, a row for every pair of a part of head and a part of tail: h, hk, hp and t, tk, tp.

    Names come from a table of the distinct ones, joined back. Relations are few, so a join on them would leave all facts to a few tasks: their names are made in each row.
    """
    names = named(facts)
    side = lambda s, x: names.select(F.col("raw").alias(f"raw_{s}"), F.col("name").alias(s), F.col("key").alias(f"{s}_key"), F.col("vague").alias(f"{s}_vague"), F.col("at").alias(f"{x}p"), F.col("part").alias(x), F.col("part_key").alias(f"{x}k"))
    rows = once(once(raw(facts), {"relation": strip(F.col("raw_relation"))}), {"rel": relation_name(F.col("relation"))})
    return rows.join(side("head", "h"), "raw_head").join(side("tail", "t"), "raw_tail").withColumn("verdict", verdict())


def judged(facts: DataFrame) -> DataFrame:
    """facts with stripped head, relation and tail, rel (its name) and verdict: accept, or why not."""
    return judged_parts(facts).where("hp = 0 and tp = 0").drop("h", "t", "hk", "tk", "hp", "tp", *RAW)


def accepted_pairs(facts: DataFrame) -> DataFrame:
    """Of accepted facts a row for every pair of parts whose keys differ, aren't empty and have 7 words at most."""
    out = judged_parts(facts).where("verdict = 'accept' and hk <> tk")
    return out.where((F.size(F.split("hk", " ")) <= 7) & (F.size(F.split("tk", " ")) <= 7))


def mention_log(facts: DataFrame) -> DataFrame:
    """(seq, chunk_id, head, relation, tail keys, head_name, tail_name, head_type, tail_type) of accepted facts.

    Distinct facts are judged, and joined with their mentions on all of head, relation and tail: no few names or relations hold most of the rows.
    """
    pairs = accepted_pairs(checkpointed(facts.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("head", "relation", "tail")]).distinct()))
    pairs = pairs.select(*RAW, (F.col("hp") * PARTS + F.col("tp")).alias("at"), F.col("hk").alias("head"), F.col("rel").alias("relation"), F.col("tk").alias("tail"), F.col("h").alias("head_name"), F.col("t").alias("tail_name"))
    rows = raw(facts.select("seq", "chunk_id", "head", "relation", "tail", "head_type", "tail_type")).join(pairs, RAW)
    return rows.select((F.col("seq") * PARTS * PARTS + F.col("at")).alias("seq"), "chunk_id", "head", "relation", "tail", "head_name", "tail_name", "head_type", "tail_type")


def compact(facts: DataFrame) -> DataFrame:
    """facts without their chunks, each distinct one once, with its number and first and last seq: what gates, keys and counts work on."""
    keys = ("head", "relation", "tail", "head_type", "tail_type")
    return facts.groupBy(*keys).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def mentions(facts: DataFrame) -> DataFrame:
    """mention_log of compact(facts): (RAW, head, relation, tail, head_name, tail_name, head_type, tail_type, n, first, last).

    Distinct facts and their mentions are written: names, nodes and edges read them, each with other columns, which would aggregate all facts anew.
    """
    pairs = accepted_pairs(checkpointed(compact(facts)))
    seq = lambda c: (F.col(c) * PARTS * PARTS + F.col("hp") * PARTS + F.col("tp")).alias(c)
    return checkpointed(pairs.select(*RAW, F.col("hk").alias("head"), F.col("rel").alias("relation"), F.col("tk").alias("tail"), F.col("h").alias("head_name"), F.col("t").alias("tail_name"), "head_type", "tail_type", "n", seq("first"), seq("last")))


def edge_chunks(facts: DataFrame, own: DataFrame, some: DataFrame) -> DataFrame:
    """(head, relation, tail, chunk_id): the distinct chunks of some edges (head, relation, tail), of facts whose mentions() are own."""
    edge = ["head", "relation", "tail"]
    raws = checkpointed(own.select(*RAW, *edge).join(some.select(*edge), edge, "left_semi").distinct())
    return raw(facts.select("chunk_id", *edge)).join(raws, RAW).select(*edge, "chunk_id").distinct()


def _counted(log: DataFrame) -> DataFrame:
    return log if "n" in log.columns else log.withColumns({"n": F.lit(1).cast("long"), "first": F.col("seq"), "last": F.col("seq")})


def nodes(log: DataFrame) -> DataFrame:
    """(key, display, type, mentions, aliases, node_seq) of a mention log or of mentions(): the longest name, first on ties; the last valid type, else the first."""
    at = lambda c, i: (F.col(c) * 2 + i).alias(c)
    ends = _counted(log).select(F.inline(F.array(*[F.struct(F.col(s).alias("key"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_type").alias("type"), F.col("n"), at("first", i), at("last", i)) for i, s in enumerate(("head", "tail"))])))
    valid = F.col("type").isin([t for t in TYPES if t != "MISC"])
    return ends.groupBy("key").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("first"))).alias("display"),
        F.coalesce(F.max_by(F.when(valid, F.col("type")), F.when(valid, F.col("last"))), F.min_by("type", "first")).alias("type"),
        F.sum("n").alias("mentions"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
        F.min("first").alias("node_seq"),
    )


def edges(log: DataFrame) -> DataFrame:
    """(head, relation, tail, mentions, source_chunks, edge_seq); chunks distinct, in order of first mention; mentions are dealt by edge, once for both aggregates."""
    by_chunk = log.repartition("head", "relation", "tail").groupBy("head", "relation", "tail", "chunk_id").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return by_chunk.groupBy("head", "relation", "tail").agg(
        F.sum("n").alias("mentions"), F.transform(F.array_sort(F.collect_list(F.struct("s", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunks"), F.min("s").alias("edge_seq")
    )


def edge_counts(log: DataFrame) -> DataFrame:
    """Edges of a mention log or of mentions(), without their chunks: nothing but partial aggregates is shuffled."""
    return _counted(log).groupBy("head", "relation", "tail").agg(F.sum("n").alias("mentions"), F.min("first").alias("edge_seq"))


def edge_sizes(log: DataFrame) -> DataFrame:
    """Edges with the number of their chunks: chunks are counted, never gathered."""
    by_chunk = log.groupBy("head", "relation", "tail", "chunk_id").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return by_chunk.groupBy("head", "relation", "tail").agg(F.sum("n").alias("mentions"), F.count("chunk_id").alias("n_chunks"), F.min("s").alias("edge_seq"))


def backfilled(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """nodes whose type is MISC or empty get the first vote of edges with two mentions or more."""
    rel = F.col("relation")
    vote = lambda when, end, kind, i: F.when(when, F.struct(F.col(end).alias("key"), F.lit(kind).alias("vote"), F.lit(i).alias("i")))
    votes = F.array(
        vote(rel.isin(PLACE_TAIL), "tail", "LOCATION", 0), vote(rel.isin(OFFICE), "head", "PERSON", 1), vote(rel.isin(OFFICE), "tail", "ORGANIZATION", 2), vote(rel.isin(COMPANY_HEAD), "head", "ORGANIZATION", 3)
    )
    cast = edges_.where("mentions >= 2").select("edge_seq", F.explode(F.array_compact(votes)).alias("v"))
    won = cast.groupBy(F.col("v.key").alias("key")).agg(F.min_by("v.vote", F.struct("edge_seq", "v.i")).alias("vote"))
    out = nodes_.join(won, "key", "left")
    return out.withColumn("type", F.when(F.col("type").isin("", "MISC") | F.col("type").isNull(), F.coalesce("vote", "type")).otherwise(F.col("type"))).drop("vote")


def degrees(edges_: DataFrame) -> DataFrame:
    """(key, degree, first_seen): first_seen orders nodes as a reader of the edges meets them."""
    return edges_.select(F.posexplode(F.array("head", "tail")).alias("i", "key"), "edge_seq").groupBy("key").agg(F.count("*").alias("degree"), F.min(F.struct("edge_seq", "i")).alias("first_seen"))


def stats(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    counts = nodes_.select(F.lit(1).alias("n"), zero.alias("e"), zero.alias("m")).unionAll(edges_.select(F.lit(0), F.lit(1).cast("long"), F.col("mentions")))
    out = counts.agg(*[F.coalesce(F.sum(c), zero).alias(name) for c, name in (("n", "n_nodes"), ("e", "n_edges"), ("m", "edge_mentions"))])
    return out.withColumn("avg_degree", F.round(2 * F.col("n_edges") / F.greatest("n_nodes", F.lit(1)), 2))


def relation_histogram(edges_: DataFrame, k: int = 10) -> DataFrame:
    counts = edges_.groupBy("relation").agg(F.count("*").alias("n_edges"), F.min("edge_seq").alias("s"))
    return counts.orderBy(F.col("n_edges").desc(), "s").limit(k).select("relation", "n_edges")


def top_hubs(edges_: DataFrame, k: int = 8) -> DataFrame:
    return degrees(edges_).orderBy(F.col("degree").desc(), "first_seen", "key").limit(k).select("key", "degree")


def adjacency(edges_: DataFrame) -> DataFrame:
    """(src, dst, w): undirected weights, the sum of 1 + ln(mentions) over edges between two nodes; a loop counts twice."""
    w = (1 + F.ln("mentions")).alias("w")
    both = edges_.select(F.col("head").alias("src"), F.col("tail").alias("dst"), w).unionAll(edges_.select(F.col("tail").alias("src"), F.col("head").alias("dst"), w))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def vis_edges(edges_: DataFrame, min_mentions: int = 2, max_nodes: int = 400) -> DataFrame:
    """Edges of at least min_mentions among the max_nodes nodes of the highest degree, the first seen on ties."""
    some = edges_.where(F.col("mentions") >= min_mentions)
    keep = degrees(some).orderBy(F.col("degree").desc(), "first_seen", "key").limit(max_nodes).select("key")
    return some.join(keep.withColumnRenamed("key", "head"), "head", "left_semi").join(keep.withColumnRenamed("key", "tail"), "tail", "left_semi")


def vis_subgraph(edges_: DataFrame, labels: DataFrame, min_mentions: int = 2, max_nodes: int = 400) -> DataFrame:
    """vis_edges, dashed across communities, with the width of a line."""
    own = lambda s: labels.select(F.col("key").alias(s), F.col("label").alias(f"{s}_label"))
    out = vis_edges(edges_, min_mentions, max_nodes).join(own("head"), "head", "left").join(own("tail"), "tail", "left")
    dashed = F.coalesce(F.col("head_label") != F.col("tail_label"), F.lit(False))
    return out.select("head", "relation", "tail", "mentions", dashed.alias("dashed"), F.round(1 + F.least(F.col("mentions"), F.lit(8)) * 0.6, 6).alias("width"))


def vis_nodes(nodes_: DataFrame, inside: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, label, title, group, size) of the nodes of vis_edges: group is C and the community's number, Cnone without one."""
    keep = inside.select(F.explode(F.array("head", "tail")).alias("key")).distinct()
    out = nodes_.join(keep, "key").join(labels.select("key", F.col("label").alias("community")), "key", "left")
    group = F.concat(F.lit("C"), F.coalesce(F.col("community").cast("string"), F.lit("none")))
    title = F.format_string("%s | type: %s | mentions: %d | aliases: %s", "display", "type", "mentions", F.array_join(F.slice("aliases", 1, 5), ", "))
    return out.select("key", F.col("display").alias("label"), title.alias("title"), group.alias("group"), F.round(6 + F.least(F.col("mentions"), F.lit(40)) * F.lit(0.7).cast("double"), 6).alias("size"))


def legend(vis: DataFrame, members: DataFrame, summaries: DataFrame) -> DataFrame:
    """(group, names, summary) of the groups of vis_nodes in numeric order, Cnone last: four main members and 90 characters of the summary (id, summary)."""
    top = members.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.col("mentions").desc(), "node_seq"))).where("r <= 4")
    top = top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "display"))), lambda x: x["display"]), ", ").alias("names"))
    about = top.join(summaries, "id", "left").select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("group"), "names", F.substring(F.coalesce("summary", F.lit("")), 1, 90).alias("summary"))
    out = vis.select("group").distinct().join(about, "group", "left").na.fill("", ["names", "summary"])
    return out.orderBy(F.coalesce(F.regexp_extract("group", "^C([0-9]+)$", 1).try_cast("int"), F.lit(999)), "group")


def modularity(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): of communities (key, label) over undirected weights (src, dst, w); 0 for no edges."""
    own = lambda s: labels.select(F.col("key").alias(s), F.col("label").alias(f"{s}_label"))
    rows = adj.join(own("src"), "src").join(own("dst"), "dst")
    by_label = rows.groupBy(F.col("src_label").alias("label")).agg(F.sum("w").alias("all"), F.sum(F.when(F.col("src_label") == F.col("dst_label"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = by_label.agg(F.sum("all").alias("t"), F.sum("inside").alias("i"), F.sum(F.col("all") * F.col("all")).alias("sq"))
    return total.select(F.coalesce(F.col("i") / F.col("t") - F.col("sq") / (F.col("t") * F.col("t")), F.lit(0.0)).alias("modularity"))
