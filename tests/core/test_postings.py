import random

import pytest
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.operators import retrieval as R
from granary.operators.postings import BLOCK, Shard, blocks_of, search_blocks
from granary.operators.retrieval import postings


def naive(impacts, asked, top, allowed=None):
    score = {}
    for text, term, impact in impacts:
        for t, w in asked:
            if t == term and (allowed is None or text in allowed):
                score[text] = score.get(text, 0.0) + w * impact
    rows = [(-round(s, 6), text is not None, text) for text, s in score.items() if round(s, 6) > 0]
    return [(text, -s) for s, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] if r[1] else 0))[:top]]


def impacts_of(rnd, texts, terms, kind=int):
    out = []
    for k in range(texts):
        for t in rnd.sample(terms, rnd.randint(0, len(terms))):
            out.append((kind(k), t, rnd.choice([0.5, 1.0, 2.0, rnd.random() * 3])))
    return out


@pytest.mark.parametrize("kind,name", [(int, "long"), (str, "string")])
def test_blocks_give_the_scores_of_all_postings(spark, kind, name):
    rnd = random.Random(8)
    terms = [f"t{k}" for k in range(12)]
    impacts = impacts_of(rnd, 700, terms, kind) + [(kind(5), "t1", 1.25), (None, "t2", 9.0)]  # a repeated id, a null id
    asked = [[(t, rnd.choice([0.1, 1.0, 5.0, -0.5])) for t in rnd.sample(terms, n)] for n in (1, 2, 3, 5, 9, 12)] + [[("none", 1.0)], []]
    df = spark.createDataFrame(impacts, f"id {name}, term string, impact double")
    for shards in (1, 5):
        blocks = blocks_of(df, shards)
        hits = search_blocks(blocks, None, list(range(len(asked))), asked, spark.range(1).schema["id"].dataType, 20)
        rows = R.ranked(hits, 20, "id").orderBy("query_id", "rank").collect()
        for q, terms_ in enumerate(asked):
            got = [(r.id, r.score) for r in rows if r.query_id == q]
            want = naive(impacts, terms_, 20)
            assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1.1e-6)
            exact = {i: s for i, s in naive(impacts, terms_, 10**6)}
            assert all(exact[i] == pytest.approx(s, abs=1.1e-6) for i, s in got)


def test_filter_comes_before_the_cut(spark):
    rnd = random.Random(3)
    impacts = impacts_of(rnd, 300, ["a", "b", "c"])
    allowed = {k for k in range(300) if k % 7 == 0}
    kept = spark.createDataFrame([(0, sorted(allowed))], "shard int, ids array<long>")
    blocks = blocks_of(spark.createDataFrame(impacts, "id long, term string, impact double"), 1)
    got = search_blocks(blocks, kept, [1], [[("a", 1.0), ("b", 2.0)]], spark.range(1).schema["id"].dataType, 10).collect()
    want = naive(impacts, [("a", 1.0), ("b", 2.0)], 10, allowed)
    assert [(r.id, r.score) for r in got] == [(i, pytest.approx(s, abs=1.1e-6)) for i, s in want]


def test_most_blocks_of_a_frequent_term_are_not_read(spark):
    n = 20_000
    rare = set(range(7, n, 499))
    impacts = [(k, "common", 1.0 + k % 5 / 10) for k in range(n)] + [(k, "rare", 1.5 + k % 3 / 10) for k in sorted(rare)]
    table = blocks_of(spark.createDataFrame(impacts, "id long, term string, impact double"), 1).toArrow()
    shard = Shard(table)
    texts, scores = shard.search([("common", 0.2), ("rare", 6.0)], 30)
    want = naive(impacts, [("common", 0.2), ("rare", 6.0)], 30)
    assert [(shard.ids[int(t)].as_py(), s) for t, s in zip(texts, scores)] == [(i, pytest.approx(s, abs=1.1e-6)) for i, s in want]
    assert shard.there > n / BLOCK and shard.read < shard.there / 5


def test_bm25_of_many_blocks_of_queries_and_an_empty_corpus(spark):
    docs = spark.createDataFrame([(k, f"apple pear{k % 9} plum{k % 4}") for k in range(90)], "id long, text string")
    queries = spark.createDataFrame([(q, f"pear{q % 9} plum{q % 4} apple") for q in range(20)] + [(99, "nothing"), (98, None)], "query_id int, text string")
    one, many = (sorted(map(tuple, R.bm25(docs, queries, top=5, block_bytes=b).collect())) for b in (1 << 20, 60))
    assert one == many and len({r[0] for r in one}) == 20
    assert R.bm25(docs.limit(0), queries).count() == 0 and R.bm25(docs, queries.limit(0)).count() == 0
    assert {r.id for r in R.bm25(docs, queries, keep=F.col("id") < 9).collect()} <= set(range(9))


def test_terms_are_counted_as_the_column_of_tokens_has_them(spark):
    texts = ["The 10-K, the 10-k. 1.5 and u.s. - a.b..c -d- x", "Kelvin İstanbul café über-bär 3² a_b", "", None, ".-.", "end.\nEnd\tend-", "aa " * 400_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(r.id, t): (r.t.count(t), len(r.t)) for r in rows.select("id", tokens(F.col("text")).alias("t")).where("id < 6").collect() for t in r.t} | {(6, "aa"): (400_000, 400_000)}
    assert {(r.id, r.term): (r.tf, r.dl) for r in postings(rows).collect()} == want
    assert "MapInArrow" in postings(rows)._jdf.queryExecution().executedPlan().toString()
