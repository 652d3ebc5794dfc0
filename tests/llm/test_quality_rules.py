import random
import re
from collections import Counter

from quillgraph.llm import quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(WORD, text)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def rows():
    r = random.Random(2)
    vocabulary = ["the", "of", "läng", "😀x", "a*b", "und", "<p>", "word", "ing"]
    out = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 49, 50, 120]))).replace("und of", "\n"), None) for i in range(80)]
    clean = [(100 + i, " ".join(f"{r.choice(['alpha', 'beta', 'gamma', 'delta'])}{r.choice(['ing', 'ed', 'er'])}{r.randint(0, 3)}" for _ in range(80)), None) for i in range(30)]
    junk = [(200 + i, " ".join(f"x{r.randint(0, 99999)}###" for _ in range(80)), None) for i in range(30)]
    odd = [(300, None, None), (301, "", None), (302, "\n\n \x85\xa0 \x0b\n", None), (303, "same line\nsame line\n\nsame line", None), (None, "word " * 60, None), (1, "twice", None), (304, "long " * 60_000, "x")]
    return out + clean + junk + odd


def test_base_and_verdict(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(100 + i,) for i in range(20)] + [(None,)], "doc_id long")
    out = quality_rules.rules(docs, trusted).collect()
    assert len(out) == len(rows())
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text), r
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in out}
    assert all(verdict[100 + i] for i in range(30)) and not any(verdict[200 + i] for i in range(30))


def test_empty_table_and_no_trusted_rows(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long")
    assert {r.llr for r in quality_rules.rules(docs, none).collect()} == {0.0}
    assert quality_rules.rules(docs.limit(0), none).count() == 0


def test_trusted_texts_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, "some words of a text"), (3, None)], "doc_id long, text string")
    for trusted in ([(1,), (3,)], [(2,)]):
        found = quality_rules.weights(docs, spark.createDataFrame(trusted, "doc_id long"))
        assert (found is None) == (trusted[0] == (1,))
