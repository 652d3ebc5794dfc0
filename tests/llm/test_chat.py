import pytest

from quillgraph.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double, turns string"


def test_paths_of_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0, "x"), (1, 2, 1, "assistant", "bad", -1.0, None), (1, 3, 1, "assistant", "good", 2.0, None), (1, 4, 3, "user", "more", None, None), (1, 5, 4, "assistant", "end", 1.0, None), (1, 6, 3, "user", "tie", 1.0, None),
        (2, 10, None, None, None, None, None), (None, 1, None, "user", "no id", 0.0, None), (3, 7, 99, "user", "orphan", 0.0, None),
    ] + [(4, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 0.5, None) for i in range(37)]
    out = {(r.tree, r.leaf): r for r in chat.paths(spark.createDataFrame(rows, SCHEMA), branches=2).collect()}
    assert set(out) == {(1, 5), (1, 6), (2, 10), (None, 1), (3, 7), (4, 36)}
    assert [t.text for t in out[1, 5].turns] == ["q", "good", "more", "end"] and out[1, 5].score == 3.0
    assert [t.text for t in out[4, 36].turns] == [f"t{i}" for i in range(37)]
    assert {r.leaf for r in chat.paths(spark.createDataFrame(rows, SCHEMA)).where("tree = 1").collect()} == {5}
    assert chat.paths(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        rows = [(1, 1, 2, "user", "a", 0.0, None), (1, 2, 1, "user", "b", 0.0, None)]
        chat.LEVELS, was = 3, chat.LEVELS
        try:
            chat.paths(spark.createDataFrame(rows, SCHEMA))
        finally:
            chat.LEVELS = was


def test_control_strings_come_back():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\l<s>[assistant]\\\\[b]"), ("a]b[<\\e", ""), ("assistant", "é😀\n")]
    text, spans = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [turns[1][1], turns[3][1]]


def test_query_digests(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "system", None), (1, 1, "user", "a[<\\"), (1, 2, "assistant", "x]y"), (1, 2, "assistant", "x]y"), (2, 5, None, "😀"), (2, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.sql(f"select {', '.join(names)} from ({chat.OP7_SQL})").fetchall()
    got = [tuple(r[n] for n in names) for r in chat.op7_chat_format(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 3
