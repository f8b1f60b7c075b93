import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import encoder as E
from granary.operators import retrieval as R

THEMES = [["chip", "gpu", "foundry", "wafer", "node"], ["loan", "credit", "deposit", "bank", "rate"], ["cloud", "azure", "server", "office", "copilot"]]


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice(THEMES[k % 3]) for _ in range(rnd.randint(1, 30)))) for k in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([*texts(), (100, None), (101, ""), (102, "the of"), (103, "chip"), (104, "chip")], "id int, text string").repartition(5)


def plain_rows(corpus, buckets):
    """Ids and unit TF-IDF rows, written out."""
    bags = {r["id"]: r["b"] for r in corpus.select("id", E.bag(F.col("text"), buckets).alias("b")).collect()}
    counts = {k: {b: bag.count(b) for b in bag} for k, bag in bags.items() if bag}
    df = {b: sum(b in c for c in counts.values()) for c in counts.values() for b in c}
    a = np.zeros((len(counts), buckets))
    for n, k in enumerate(sorted(counts)):
        for b, c in counts[k].items():
            a[n, b] = (1 + np.log(c)) * (np.log((1 + len(counts)) / (1 + df[b])) + 1)
    return sorted(counts), a / np.linalg.norm(a, axis=1, keepdims=True)


@pytest.mark.parametrize(("buckets", "chunk"), [(512, 1 << 16), (512, 7), (4, 50)])
def test_vectors_are_those_of_a_whole_decomposition(spark, corpus, monkeypatch, buckets, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    width = min(6, buckets - 1)
    model = E.fit_encoder(corpus, buckets=buckets, width=width, extra=min(20, buckets - width))
    ids, a = plain_rows(corpus, buckets)
    right = np.linalg.svd(a)[2][:width]
    want = a @ right.T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r["id"]: r["vector"] for r in E.encoded(corpus, model).collect()}
    assert {k for k, v in got.items() if v is None} == {100, 101, 102}
    v = np.array([got[k] for k in ids])
    assert np.allclose(v @ v.T, want @ want.T, atol=1e-6) and np.allclose(np.linalg.norm(v, axis=1), 1)
    assert got[103] == got[104]


def test_words_of_a_theme_meet(spark, corpus):
    """A question finds texts that go with its word without holding it."""
    model = E.fit_encoder(corpus, width=3)
    vectors = E.encoded(corpus, model)
    asked = spark.createDataFrame([(1, "wafer"), (2, "azure"), (3, "never seen"), (4, None)], "query_id int, text string")
    hits = R.Searcher(corpus, vectors, encode=model.column(spark)).search("dense", asked, top=15).collect()
    assert {r["query_id"] for r in hits} == {1, 2}
    theme = lambda k: 0 if k > 100 else k % 3
    assert {theme(r["id"]) for r in hits if r["query_id"] == 1} == {0} and {theme(r["id"]) for r in hits if r["query_id"] == 2} == {2}
    for mode in R.MODES:
        assert R.Searcher(corpus, vectors, encode=model.column(spark)).search(mode, asked, top=5).count() > 0


def test_written_and_loaded(spark, corpus, tmp_path):
    model = E.fit_encoder(corpus, buckets=64, width=4, extra=8)
    model.write(spark, str(tmp_path / "model"))
    again = E.Encoder.load(spark, str(tmp_path / "model"))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.basis, again.basis)


def test_few_and_no_texts(spark, corpus):
    none = E.fit_encoder(corpus.where("id between 100 and 102"), buckets=64, width=4, extra=8)
    assert all(r["vector"] is None for r in E.encoded(corpus, none).collect())
    one = E.fit_encoder(corpus.where("id = 103"), buckets=64, width=4, extra=8)
    v = np.array([r["vector"] for r in E.encoded(corpus.where("id in (103, 104)"), one).collect()])
    assert v.shape == (2, 4) and np.allclose(np.abs(v[:, 0]), 1)
    with pytest.raises(ValueError):
        E.fit_encoder(corpus, buckets=8, width=8, extra=1)
