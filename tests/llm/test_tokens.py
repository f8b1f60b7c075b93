import random

import numpy as np
import pytest

from granary.llm.queries_tokens import tokenizer_file
from granary.llm.tokens import FastTokenizer

FIXED = ["", None, " ", "\n\n a", "don't I'll we've 'lx ''s !'s", "a  b   c\n\n\nfoo  ", "x<|endoftext|>y", "ΑΣ İ ² ½ é", "日本語 テスト", "A_B__c 12 345", "tab\t\tx \r\n y", "’s “q” — …", "Éà ÇŠ ŉ ǅ", "é\x1cx"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    t = FastTokenizer(tokenizer_file(name))
    assert t.fast is not None
    rnd = random.Random(1)
    letters = "aB 'st\n\tlre.,!_9é¡ßĿǆ’—×"
    plain = "aB st\n\tlre.,!_97éßĿǆ’—×"
    texts = FIXED + ["".join(rnd.choice(plain) for _ in range(rnd.randint(1, 60))) for _ in range(5000)] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(5000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in t.library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert t.encode(texts) == want
    assert t.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_the_documents_equal_the_library(spark, name):
    t = FastTokenizer(tokenizer_file(name))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert t.encode(texts) == t.whole([x or "" for x in texts])


LONG = ["x" + " " * 1_100_000 + "a", "\n" * 2_000_000 + "b", "a" * 300_000, "é" * 200_000, "!" * 300_000, "7" * 300_000, " \n" * 500_000, "'s" * 100_000, "a b " * 200_000, "\u0301" * 100_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_runs_equal_the_library(name):
    t = FastTokenizer(tokenizer_file(name))
    assert t.encode(LONG) == t.whole(LONG)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_full_caches_change_nothing(name, monkeypatch):
    from granary.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    t = FastTokenizer(tokenizer_file(name))
    for k in range(20):
        texts = [f"word{k} and{j} more, 'll {k * j}" for j in range(9)]
        assert t.encode(texts) == t.whole(texts)
