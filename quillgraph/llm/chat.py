"""Chat formatting: reply trees become conversations, one for each chosen root-to-leaf path.

Messages are nodes with a parent. Paths are enumerated by self-joins that double their reach: level k links a message
with its 2^k-th ancestor and the scores between, so a thread of n replies needs log2(n) joins. Leaves are ranked
in their tree by the sum of their path's scores, the best `branches` are chosen, and only chosen paths are unrolled,
by the same levels. Levels are written to the shared folder.

A turn is `<s>[role]text</s>`. Inside roles and texts, backslash, `<` and `[` (in roles also `]`) become two-character escapes
that hold none of them, so no control string can occur there, and unescaping gives back every text. Loss spans
(code points, in the formatted string) cover the texts of the assistant's turns.

Null roles and texts are empty ones; a message whose parent isn't in its tree is a root; a cycle raises an
error; a null tree id is a tree of its own; repeated message ids of a tree are an error of the caller (the query numbers
them). Trees without messages don't exist; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, stored, table

TURN = re.compile(r"<s>\[([^\]]*)\]([^<]*)</s>")
_OUT = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\e": "]"}
LEVELS = 40


def escaped(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")
    return text.replace("]", "\\e") if role else text


def unescaped(text: str) -> str:
    return re.sub(r"\\[\\lbe]", lambda m: _OUT[m.group()], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """The conversation's string, and [start, end] of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[{escaped(role, True)}]", escaped(text)
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m.group(1)), unescaped(m.group(2))))
        at = m.end()
    return out


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """From messages (tree, node, parent, role, text, score): (tree, leaf, score, turns) of the best branches."""
    rows = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("k"), "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("s"))
    nodes = stored(rows)
    inner = nodes.select("k", F.col("parent").alias("node")).where("node is not null").distinct()
    real = inner.join(nodes.select("k", "node"), ["k", "node"], "left_semi")
    level = stored(nodes.where("parent is not null").join(real.withColumnRenamed("node", "parent"), ["k", "parent"]).select("k", "node", F.col("parent").alias("up"), "s"))
    levels = []
    while not level.isEmpty():
        if len(levels) == LEVELS:
            raise ValueError("replies form a cycle")
        levels.append(level)
        far = level.select("k", F.col("node").alias("up"), F.col("up").alias("top"), F.col("s").alias("more"))
        level = stored(level.join(far, ["k", "up"]).select("k", "node", F.col("top").alias("up"), (F.col("s") + F.col("more")).alias("s")))
    leaves = nodes.join(real, ["k", "node"], "left_anti").select("k", "tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("depth"))
    for i, step in reversed(list(enumerate(levels))):
        step = step.select("k", F.col("node").alias("at"), "up", "s")
        leaves = stored(leaves.join(step, ["k", "at"], "left").select("k", "tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("sum") + F.coalesce("s", F.lit(0.0))).alias("sum"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1 << i)).alias("depth")))
    leaves = leaves.join(nodes.select("k", F.col("node").alias("at"), "s"), ["k", "at"]).withColumn("score", F.col("sum") + F.col("s"))
    best = leaves.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(F.col("score").desc(), "leaf"))).where(F.col("rank") <= branches)
    best = stored(best.select("k", "tree", "leaf", "score", "depth"))
    members = best.select("k", "leaf", F.col("leaf").alias("node"), "depth")
    for i, step in reversed(list(enumerate(levels))):
        further = members.join(step.select("k", "node", "up"), ["k", "node"]).select("k", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << i)).alias("depth"))
        members = stored(members.unionByName(further))  # else the plan would double with each level
    said = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("k"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = members.join(said, ["k", "node"]).groupBy("k", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return best.join(turns, ["k", "leaf"]).select("tree", "leaf", "score", "turns")


def format_paths(chosen: DataFrame) -> DataFrame:
    """(tree, leaf, score, formatted, loss) from paths()."""

    def run(batches):
        for batch in batches:
            done = [formatted([(t["role"], t["text"]) for t in x]) for x in batch.column("turns").to_pylist()]
            cols = [batch.column(c) for c in ("tree", "leaf", "score")] + [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, names=["tree", "leaf", "score", "formatted", "loss"])

    return mapped(chosen, run, "tree long, leaf long, score double, formatted string, loss array<array<int>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of formatted conversations and of what their loss spans cover."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        for batch in batches:
            out = []
            for tree, text, spans in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss")), strict=True):
                turns = parsed(text)
                loss = "".join(unescaped(text[a:b]) for a, b in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return mapped(conversations, run, schema)


def threads(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as reply trees: every turn answers the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_paths(paths(threads(every))))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + 2 * length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), ']', ''))
    + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
