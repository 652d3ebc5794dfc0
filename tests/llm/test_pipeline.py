import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quillgraph.llm import byte_bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(6)
    parts = ["the", "ing", "wh", "er", "on", "ed", "re"]
    prose = lambda n: " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))
    clean = [(i, prose(120), "aa", f"s{i % 3}", 0) for i in range(90)]
    copies = [(200 + i, clean[i][1] + " tail", "aa", "s0", 0) for i in range(10)] + [(300, clean[0][1], "aa", None, 0)]
    junk = [(400 + i, " ".join(f"Q{r.randint(0, 999)}###" for _ in range(120)), "aa", "s1", 0) for i in range(40)]
    secret = [(500, prose(60) + ' token = "ab59b03a9d0189cc1ff5513a5b496212436c9831" ' + prose(60), "aa", "s2", 0)]
    rows = clean + copies + junk + secret + [(600, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)] + [(400 + i, 0, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, str(tmp_path))
        assert new.schema.simpleString() == docs.schema.simpleString()
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([x.doc_id for x in docs.collect()])
    assert {x for x in kept[0] if 400 <= x < 500} == set() and len([x for x in kept[0] if x < 90]) >= 89
    assert not {x for x in kept[1] if 200 <= x <= 300} - {200 + i for i in range(10) if i not in kept[0]} and 500 in kept[1]
    assert sorted(kept[1]) == sorted(kept[2])
    texts = {x.doc_id: x.text for x in docs.collect()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.rank_file()), special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == sorted(kept[3])
    for x in out:
        assert x.ids == enc.encode_ordinary(texts[x.doc_id])
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
        assert "ab59b03a9d01" not in texts[x.doc_id]
