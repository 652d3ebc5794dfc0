import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillgraph.llm import byte_bpe, token_files

DOCS = "doc_id long, text string, n_tokens string"


def texts():
    r = random.Random(4)
    odd = ["", " ", "a" * 3000, "\n\n  x \x1c\x85  y", "é" * 90 + "😀" * 30, "don't  WE'LL 12345 ---\t\n ok", "x" * 100 + "1234567890" * 20, None, "same", "same", "Straße é ﬁ 中文字"]
    return odd + ["".join(r.choice("abcdé \n\t'!1\x1c\x85 😀ñ中S") for _ in range(150)) for _ in range(60)]


def rows():
    return [(i - 2, t, "clash") for i, t in enumerate(texts())] + [(None, "no key", None), (1, "twice", None)]


def test_byte_bpe_equals_tiktoken_and_decodes(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.rank_file()), special_tokens={})
    out = byte_bpe.encode(spark.createDataFrame(rows(), DOCS)).collect()
    want = sorted((d is None, d or 0, t or "") for d, t, _ in rows())
    got = {(r.doc_id, r.ids_sha256): r for r in out}
    assert len(out) == len(rows())
    for none, d, t in want:
        ids = enc.encode_ordinary(t)
        r = got[None if none else d, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert (r.n_tokens, r.ids, r.decoded_sha256) == (len(ids), ids, hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_native_fold_gives_the_same_ids(spark):
    ranks = {bytes([b]): b for b in range(97, 103)} | {b"ab": 103, b"cd": 104, b"abcd": 105, b"bc": 106, b"aa": 107, b"aab": 108}
    words = ["abcd", "bcd", "aabcd", "aaab", "fed", "abcabc", "a", ""]
    enc = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={bytes([b]): b + 1000 for b in range(256) if not 97 <= b < 103} | ranks, special_tokens={})
    out = byte_bpe.encode_words_native(spark.createDataFrame([(w,) for w in words], "word string"), ranks)
    assert {r.word: r.ids for r in out.collect()} == {w: enc.encode_ordinary(w) for w in words}


def test_native_form_gives_the_library_s_ids_on_the_whole_vocabulary(spark):
    some = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 400]
    out = {r.doc_id: r for r in byte_bpe.encode_native(spark.createDataFrame(some, "doc_id long, text string"), bits=6).collect()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.rank_file()), special_tokens={})
    for i, t in some:
        ids = enc.encode_ordinary(t or "")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_token_files_round_trip(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = f"file://{tmp_path}/shards"
    data = rows()
    token_files.write_shards(spark.createDataFrame(data, DOCS).repartition(3), folder)
    out = token_files.read_shards(spark, folder).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(((d, t) for d, t, _ in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in out] == want
    store = token_files.TokenStore(spark, folder)
    assert store.get(0).tolist() == tok.encode("a" * 3000, add_special_tokens=False).ids + [2]
    assert store.get(10**9) is None and store.get(-50) is None
    token_files.write_shards(spark.createDataFrame([], DOCS), f"{folder}-none")
    assert token_files.read_shards(spark, f"{folder}-none").count() == 0


def test_tasks_write_nothing_but_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i}", None) for i in range(400)], DOCS).repartition(4)
    found = token_files.write_shards(docs, f"file://{tmp_path}/shards")
    assert [p.name for p in (tmp_path / "shards" / "manifest").iterdir()] == ["part-0.parquet"]
    shards = {p.name for p in (tmp_path / "shards").glob("shard-*")}
    assert {r.name for r in found.collect()} == shards and sum(r.n_docs for r in found.collect()) == 400
    with pytest.raises(FileExistsError):
        token_files.write_shards(docs, f"file://{tmp_path}/shards")


def test_perfect_hash_is_minimal_and_refuses():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 20_000))
    index = token_files.PerfectHash.build(keys, np.arange(len(keys)))
    assert (index.get(keys) == np.arange(len(keys))).all() and len(index.prints) == len(keys)
    assert (index.get(keys + 1) >= 0).mean() < 0.001
