"""Queries cover whole tables."""

import re

import numpy as np
import pytest

from granary.config import STOPWORDS
from granary.operators import news as N, retrieval as R
from granary.plans import answers, news, retrieval


def brute_pairs(ids, vectors, labels, threshold):
    sims = {(a, b): round(float(np.dot(vectors[i], vectors[j])), 6) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and labels[i] == labels[j]}
    return {k: s for k, s in sims.items() if s >= threshold}


def unit_vectors(n, d=4, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_near_dup_edges_has_no_bound_on_ids(spark, tmp_path):
    ids, v = list(range(99_990, 100_030)), unit_vectors(40)
    labels = [k % 3 for k in ids]
    spark.createDataFrame(list(zip(ids, v.tolist(), labels, strict=True)), "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.sim for r in news.near_dup_edges(spark, str(tmp_path)).collect()}
    want = brute_pairs(ids, v, labels, 0.35)
    assert got.keys() == want.keys() and any(b >= 100_000 for _, b in got) and got == pytest.approx(want, abs=1.1e-6)


@pytest.mark.parametrize("group", [None, "label"])
@pytest.mark.parametrize("block", [1, 7, 1500])
def test_near_pairs_in_blocks(spark, group, block):
    ids, v = list(range(60)), unit_vectors(60)
    labels = [k % 5 == 0 for k in ids] if group else [0] * 60
    df = spark.createDataFrame([*zip(ids, v.tolist(), labels, strict=True), (60, None, labels[0])], f"id long, vector array<double>, label {'boolean' if group else 'int'}")
    rows = N.near_pairs(df, 0.5, group, block).collect()
    got = {(r.a, r.b): r.sim for r in rows}
    want = brute_pairs(ids, v, labels, 0.5)
    assert len(rows) == len(got) and got.keys() == want.keys() and got == pytest.approx(want, abs=1.1e-6)


def test_numbered_context_covers_every_order(spark, tmp_path):
    rows = [(order, line, 100 * order + line) for order in range(1, 25) for line in range(1, order % 4 + 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.context for r in answers.numbered_context(spark, str(tmp_path)).collect()}
    assert got == {order: "\n\n".join(f"[{n}] (line {n})\npart {100 * order + n}" for n in range(1, order % 4 + 2)) for order in range(1, 25)}


def test_pool_and_evaluation_have_all_arms(spark):
    d = "/root/testdata/sf0.001"
    rows = retrieval.retrieval_pool(spark, d).collect()
    assert rows[0].__fields__[2:] == [*R.MODES, "best"]
    texts = {r.id: r.text for r in retrieval.corpus(spark, d).collect()}
    asked = {r.query_id: r.text for r in retrieval.asked(spark, d).collect()}
    words = lambda t: {w for w in re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", t.lower()) if len(w) > 1 and w not in STOPWORDS}
    order = {}
    for r in rows:
        assert r.best == min(x for x in r[2:6] if x is not None)
        if r.hybrid is not None and (texts.get(r.id) or "").strip():
            q = words(asked[r.query_id])
            order.setdefault(r.query_id, []).append((-round(len(q & words(texts[r.id])) / len(q), 6), r.hybrid, r.id))
        else:
            assert r.rerank is None
    ranks = {(r.query_id, r.id): r.rerank for r in rows if r.rerank is not None}
    assert ranks == {(q, h[2]): k for q, hits in order.items() for k, h in enumerate(sorted(hits), 1)} and max(ranks.values()) > R.FINAL_TOP
    scores = retrieval.retrieval_eval_by_mode(spark, d).collect()
    assert {(r.mode, r.category) for r in scores} == {(m, c) for m in R.MODES for c in (None, "even", "odd")}


def parts(labels):
    return {frozenset(k for k, x in enumerate(labels) if x == y) for y in labels}


def test_average_linkage_of_a_large_group():
    rnd = np.random.default_rng(5)
    centres = np.linalg.qr(rnd.normal(size=(32, 32)))[0]
    label = rnd.integers(0, 32, 5200)
    v = centres[label] + 0.02 * rnd.normal(size=(5200, 32))
    assert parts(N.average_linkage(v, 0.7)) == parts(label.tolist())
