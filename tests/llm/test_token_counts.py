import random

import pytest
from hypothesis import given, settings, strategies as st

from granary.llm.queries_tokens import tokenizer_file
from granary.llm.token_counts import counter, prefix_table, token_counts
from granary.llm.tokens import tokenizer

PATH = tokenizer_file("byte_bpe_50k.json")


def library(text):
    return len(tokenizer(PATH).library.encode(text, add_special_tokens=False).ids)


def check(text):
    got = counter(PATH).prefixes(text).tolist()
    assert got == [library(text[:k]) for k in range(len(text) + 1)], text
    assert counter(PATH).total(text) == got[-1]
    for budget in range(0, got[-1] + 2):
        assert counter(PATH).longest_within(text, budget) == max(k for k, n in enumerate(got) if n <= budget), (text, budget)


@pytest.mark.parametrize("text", ["", " ", "  a", "a   b\n\n\nc  ", "don't we've I'll 'lx they're!'re", "x!<|endoftext|>y <|endoftext|><|endo", "日本語 ² ½ Ⅷ é́", "a　　 b", "=" * 300, "nul\x00\x1c\x1d b", "12345 67 _a_b"])
def test_every_prefix(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBstlredv 'é\n\t!<|>1_²本", max_size=40))
def test_every_prefix_of_random_text(text):
    check(text)


def test_long_random_words():
    rnd = random.Random(5)
    for _ in range(200):
        word = "".join(rnd.choice(["the", "ing", "ré", "eaux", "on", "tion", "q", "ß"]) for _ in range(rnd.randint(1, 12)))
        assert counter(PATH).total(word) == library(word)


def test_operator(spark):
    texts = [None, "", "a b", "word " * 600, "a b", " x"]
    df = spark.createDataFrame([(k if k != 2 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = token_counts(df, PATH).collect()
    assert [r.n_tokens for r in rows] == [library(t or "") for t in texts]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [False, False, False, True, False, False]
    long = rows[3]
    assert library(texts[3][: long.fit_chars]) <= 512 < library(texts[3][: long.fit_chars + 2])
    assert [r.prefix_tokens for r in prefix_table(df, PATH).collect()][2] == [0, 1, 2, 2]
    assert token_counts(df.limit(0), PATH).collect() == []


def test_whole_documents_table_against_the_library(spark):
    from granary.llm.queries_tokens import op5_token_counts

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op5_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    ids = [e.ids for e in tokenizer(PATH).library.encode_batch([docs[r.doc_id] or "" for r in rows], add_special_tokens=False)]
    assert [r.n_tokens for r in rows] == [len(x) for x in ids]


def test_long_runs():
    from granary.llm.token_counts import PrefixCounter

    counter = PrefixCounter(PATH)
    for text in (" " * 300_000, "a" * 300_000, "ab" * 100_000, "\n" * 200_000, "x" + " " * 5000 + "é" * 3000):
        assert counter.total(text) == library(text)
    for text in (" " * 700, "abc" * 150, "é" * 200, "-" * 300 + " \n" * 60):
        counts = counter.prefixes(text)
        assert [int(counts[k]) for k in range(0, len(text), 37)] == [library(text[:k]) for k in range(0, len(text), 37)]
