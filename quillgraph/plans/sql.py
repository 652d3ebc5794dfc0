"""SQL, for an independent engine, of what the registered queries compute."""

from __future__ import annotations

from .fixtures import ACCENTED, ACCENTED_KEYS
from ..functions.vocabulary import ALIASES, ARTICLES, COMPANY_HEAD, JUNK_RELATIONS, OFFICE, PLACE_TAIL, PRODUCT_RELATIONS, RELATION_LABELS, SUFFIXES, TYPES, UNSUPPORTED, VAGUE


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def key(x: str) -> str:
    words = f"regexp_split_to_array(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g'), '\\s+')"
    kept = f"array_to_string(list_filter({words}, lambda w: w NOT IN ('', {listed(ARTICLES)})), ' ')"
    return f"regexp_replace({kept}, '^(\\S+(?: \\S+)*?)(?: (?:{'|'.join(SUFFIXES)}))+$', '\\1')"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def relation(x: str) -> str:
    words = strip(f"regexp_replace({x}, '[^\\w\\s]', ' ', 'g')")
    bare = f"regexp_replace(regexp_replace(upper(regexp_replace({words}, '\\s+', '_', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce(nullif({bare}, ''), 'RELATED_TO')"


def canonical(x: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + f" ELSE {x} END)"


def parts(x: str) -> str:
    found = f"list_filter(list_transform(string_split({x}, ' and '), lambda p: {strip('p')}), lambda p: length(p) > 2)"
    return f"CASE WHEN len({found}) >= 2 THEN {found} ELSE [{x}] END"


FACTS = """facts AS (
  SELECT CAST(n_nationkey AS BIGINT) AS seq, 'nation::' || n_nationkey AS chunk_id, n_name AS head, 'LOCATED_IN' AS relation, r_name AS tail, 'MISC' AS head_type, 'LOCATION' AS tail_type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000 + p_partkey * 2, 'part::' || p_partkey, p_brand, 'MANUFACTURES', p_name, 'MISC', 'PRODUCT' FROM part
  UNION ALL SELECT 1000000 + p_partkey * 2 + 1, 'part::' || p_partkey, string_split(p_name, ' ')[2], 'PRODUCES', p_name, 'MISC', 'PRODUCT' FROM part WHERE string_split(p_name, ' ')[2] IS NOT NULL
  UNION ALL SELECT 10000000000 + l_orderkey * 100 + l_linenumber * 2, 'order::' || l_orderkey, s_name, 'LOCATED_IN', n_name, 'MISC', 'MISC' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 10000000000 + l_orderkey * 100 + l_linenumber * 2 + 1, 'order::' || l_orderkey, s_name, 'SUPPLIES', p_name, 'MISC', 'PRODUCT' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
EVERY = FACTS[:-1] + f"\n  UNION ALL SELECT seq, 'extra::' || seq, head, relation, tail, ht, tt FROM (VALUES {values(ACCENTED)}) x(seq, head, relation, tail, ht, tt))"
#: Keys of names beyond ASCII are given, not computed.
LOG = f"""{EVERY}, given(name, key) AS (VALUES {values(ACCENTED_KEYS.items())}), names AS (SELECT name, coalesce(given.key, {key('name')}) AS key FROM (SELECT head AS name FROM facts UNION SELECT tail FROM facts) LEFT JOIN given USING (name)),
log AS (SELECT seq * 256 AS seq, chunk_id, h.key AS head, relation, t.key AS tail, head AS head_name, f.tail AS tail_name, head_type, tail_type
  FROM facts f JOIN names h ON f.head = h.name JOIN names t ON f.tail = t.name WHERE h.key <> t.key)"""
GRAPH = f"""{LOG},
ends AS (SELECT head AS key, head_name AS name, head_type AS type, seq * 2 AS mseq FROM log UNION ALL SELECT tail, tail_name, tail_type, seq * 2 + 1 FROM log),
nodes AS (SELECT key, first(name ORDER BY length(name) DESC, mseq) AS display,
  coalesce(first(type ORDER BY mseq DESC) FILTER (type IN ({listed(t for t in TYPES if t != 'MISC')})), first(type ORDER BY mseq)) AS type,
  count(*) AS mentions, array_to_string(list_sort(list(DISTINCT name)), '|') AS aliases, min(mseq) AS node_seq FROM ends GROUP BY key),
edges AS (SELECT head, relation, tail, count(*) AS mentions, count(DISTINCT chunk_id) AS n_chunks, min(seq) AS edge_seq FROM log GROUP BY ALL)"""
BACKFILL = f"""{GRAPH},
votes AS (
  SELECT tail AS key, 'LOCATION' AS vote, edge_seq, 0 AS i FROM edges WHERE mentions >= 2 AND relation IN ({listed(PLACE_TAIL)})
  UNION ALL SELECT head, 'PERSON', edge_seq, 1 FROM edges WHERE mentions >= 2 AND relation IN ({listed(OFFICE)})
  UNION ALL SELECT tail, 'ORGANIZATION', edge_seq, 2 FROM edges WHERE mentions >= 2 AND relation IN ({listed(OFFICE)})
  UNION ALL SELECT head, 'ORGANIZATION', edge_seq, 3 FROM edges WHERE mentions >= 2 AND relation IN ({listed(COMPANY_HEAD)})),
won AS (SELECT key, first(vote ORDER BY edge_seq, i) AS vote FROM votes GROUP BY key),
typed AS (SELECT n.key, CASE WHEN type IN ('', 'MISC') THEN coalesce(vote, type) ELSE type END AS type FROM nodes n LEFT JOIN won USING (key))"""
BLOCKED = f"""{GRAPH},
words AS (SELECT DISTINCT key, node_seq, unnest(string_split(key, ' ')) AS word FROM nodes),
kept AS (SELECT word FROM words GROUP BY word HAVING count(*) BETWEEN 2 AND 60),
pairs AS (SELECT DISTINCT x.key AS a, y.key AS b FROM words x JOIN words y USING (word) JOIN kept USING (word) WHERE x.node_seq < y.node_seq),
guarded AS (SELECT a, b FROM pairs WHERE NOT contains(a, ' and ') AND NOT contains(b, ' and ') AND NOT EXISTS (
  SELECT 1 FROM edges WHERE relation IN ({listed(PRODUCT_RELATIONS)}) AND least(head, tail) = least(a, b) AND greatest(head, tail) = greatest(a, b))),
prefixed AS (SELECT *, jaro_similarity(a, b) AS j, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[:2] <> b[:2] OR least(length(a), length(b)) < 2 THEN 1 WHEN a[:3] <> b[:3] OR least(length(a), length(b)) < 3 THEN 2 WHEN a[:4] <> b[:4] OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS p,
  len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS o FROM guarded),
scored AS (SELECT a, b, 0.6 * (j + 0.1 * p * (1 - j)) + 0.4 * o AS score FROM prefixed)"""
COMPONENTS = f"""RECURSIVE {BLOCKED},
near AS (SELECT a, b FROM scored WHERE score >= 0.65 UNION SELECT b, a FROM scored WHERE score >= 0.65),
reach AS (SELECT a AS key, b AS other FROM near UNION SELECT r.key, n.b FROM reach r JOIN near n ON r.other = n.a),
parts AS (SELECT key, least(key, min(other)) AS component FROM reach GROUP BY key)"""
ADJACENT = f"""{GRAPH},
adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT head AS src, tail AS dst, 1 + ln(mentions) AS w FROM edges UNION ALL SELECT tail, head, 1 + ln(mentions) FROM edges) GROUP BY ALL),
labels AS (SELECT key, row_number() OVER (ORDER BY node_seq, key) - 1 AS label FROM nodes)"""
#: Communities of the SQL-checked queries: nodes by the kind of their name.
KINDS = "CASE WHEN key LIKE 'supplier%' THEN 0 WHEN key LIKE 'nation%' THEN 1 WHEN key LIKE 'brand%' THEN 2 ELSE 3 END"


def gate(rows: str) -> str:
    """CTEs judged and split over VALUES rows (id, head, relation, tail)."""
    vague = "|".join(VAGUE)
    return f"""v(id, h0, r0, t0) AS (SELECT * FROM (VALUES {rows}) x UNION ALL SELECT min(seq) + 1000, head, relation, tail FROM facts GROUP BY head, relation, tail, head_type, tail_type),
s AS (SELECT id, {strip('h0')} AS head, {strip('r0')} AS rel0, {strip('t0')} AS tail FROM v),
k AS (SELECT *, {relation('rel0')} AS rel, {key('head')} AS hk, {key('tail')} AS tk FROM s),
judged AS (SELECT *, CASE WHEN head = '' OR tail = '' THEN 'empty' WHEN head = tail THEN 'same_raw' WHEN length(head) > 100 OR length(tail) > 100 OR length(rel0) > 60 THEN 'length'
  WHEN regexp_matches(lower(head), '^({vague})\\b') OR regexp_matches(lower(tail), '^({vague})\\b') THEN 'vague' WHEN hk = '' OR tk = '' THEN 'empty_key' WHEN hk = tk THEN 'same_key' WHEN rel IN ({listed(JUNK_RELATIONS)}) THEN 'junk_relation' ELSE 'accept' END AS verdict FROM k),
hs AS (SELECT id, rel, tail, unnest({parts('head')}) AS h FROM judged WHERE verdict = 'accept'),
ts AS (SELECT id, rel, h, unnest({parts('tail')}) AS t FROM hs),
split AS (SELECT id, {key('h')} AS head, rel AS relation, {key('t')} AS tail FROM ts)"""


CENSUS = f"""CASE WHEN relation IN ({listed(RELATION_LABELS)}) THEN 'trainable' WHEN relation IN ({listed(UNSUPPORTED)}) THEN 'unsupported' ELSE 'other' END"""
