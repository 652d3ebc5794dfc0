import duckdb
import pandas as pd
import pytest

from quillgraph.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, _key string"


def rows():
    out = [(i, "w " * (1 + i * 7 % 50), "abc"[i % 3] if i % 4 else "hot", "clash", None) for i in range(200)]
    return out + [(900, None, "a", None, None), (901, "", None, None, None), (902, "one two", None, None, None), (5, "again", "b", None, None), (5, "again", "b", None, None), (903, None, "empty", None, None), (None, "no id", "a", None, None)]


def check(out):
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 3 * own[0].source_size + 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in out)


def test_targets_and_words_taken(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows())
    check(out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_one_window_in_sql(spark):
    data = pd.DataFrame([r[:3] for r in rows() if r[0] is not None and r[1] != "again"], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", data)
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.OP4_SQL})").fetchall()}
    docs = spark.createDataFrame(list(data.itertuples(index=False, name=None)), "doc_id long, text string, source string")
    for r in mixing.mix(docs).collect():
        assert (r.size, r.source_size, r.taken) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][3])
        assert r.target == pytest.approx(want[r.doc_id][2])


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(2 * got["c"]) and sum(got.values()) == pytest.approx(2010)
