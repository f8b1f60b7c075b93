import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from granary.operators import retrieval as R

DOCS = [("risk", "Risk Factors", "10-K", date(2025, 2, 26), "foundry capacity may be limited"), ("mdna", "MD&A", "10-K", date(2025, 2, 26), "Blackwell data-center revenue grew. Blackwell sold."), ("liq", "MD&A", "10-Q", date(2025, 8, 27), "cash and repurchases of shares"), ("gov", "Business", "10-K", None, "competition in many markets"), ("none", "Business", "8-K", date(2025, 1, 1), None)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "id string, section string, doc_type string, filing_date date, text string")


def ids(df):
    return [r.id for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_and_filters_before_the_cut(spark, corpus):
    q = spark.createDataFrame([(1, "Blackwell")], "query_id int, text string")
    assert ids(R.bm25(corpus, q)) == ["mdna"]
    assert ids(R.bm25(corpus, q, keep=R.Filters(sections=("Risk Factors",)).column())) == []
    both = spark.createDataFrame([(1, "cash competition capacity blackwell")], "query_id int, text string")
    assert ids(R.bm25(corpus, both, keep=R.Filters(doc_types=("10-Q",)).column())) == ["liq"]
    assert ids(R.bm25(corpus, both, keep=R.Filters(date_from=date(2025, 2, 26), date_to=date(2025, 2, 26)).column())) in (["mdna", "risk"], ["risk", "mdna"])
    assert "gov" in ids(R.bm25(corpus, both)) and ids(R.bm25(corpus, both, keep=R.Filters(tickers=()).column())) == ids(R.bm25(corpus, both))


def test_bm25_against_a_plain_model(spark):
    rnd = random.Random(2)
    docs = [(k, " ".join(rnd.choice(["apple", "pear", "plum", "fig", "date"] + ["rare"] * (k % 17 == 0)) for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    queries = [(1, "apple rare apple"), (2, "fig"), (3, "unknown the")]
    toks = {k: [w for w in t.split()] for k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = {}
    for q, text in queries:
        score = {k: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split()), 6) for k, t in toks.items()}
        want[q] = [(k, s) for k, s in sorted(score.items(), key=lambda x: (-x[1], x[0])) if s > 0][:30]
    hits = R.bm25(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "query_id int, text string")).orderBy("query_id", "rank").collect()
    for q in want:
        got = [(r.id, r.score) for r in hits if r.query_id == q]
        assert [g[0] for g in got] == [w[0] for w in want[q]] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, want[q], strict=True))


def hits(spark, *names):
    return spark.createDataFrame([(1, k, n) for k, n in enumerate(names, 1)], "query_id int, rank int, id string")


def test_fusion(spark):
    dense, sparse = hits(spark, "a", "b", "c", "d"), hits(spark, "x", "y", "z", "d")
    plain, anchored = ids(R.rrf(dense, sparse, anchor=False)), ids(R.rrf(dense, sparse))
    assert plain[0] == "d" and anchored[:3] == ["a", "x", "d"] and sorted(plain) == sorted(anchored) == sorted("abcdxyz")
    assert ids(R.rrf(hits(spark, "a", "b"), hits(spark, "a", "c"))) == ["a", "b", "c"]
    assert {r.id: (r.dense, r.bm25, r.best) for r in R.pool({"dense": dense, "bm25": sparse}).collect()}["d"] == (4, 4, 4)


def test_modes_and_rerank(spark, corpus):
    vectors = spark.createDataFrame([(d[0], [float(k == j) + 0.1 for j in range(5)]) for k, d in enumerate(DOCS)], "id string, vector array<double>").join(corpus.drop("text"), "id")
    q = spark.createDataFrame([(1, "Blackwell revenue", [0.0, 1.0, 0.0, 0.0, 0.0])], "query_id int, text string, vector array<double>")
    full = corpus.where("text is not null")
    some = vectors.where("id != 'none'")
    for mode in R.MODES:
        assert ids(R.search(mode, full, some, q, top=1)) == ["mdna"]
    with pytest.raises(ValueError):
        R.search("sql", full, some, q)
    with pytest.raises(Exception, match="no text"):
        R.rerank(R.hydrate(hits(spark, "none"), corpus), q).collect()


def test_evaluation(spark):
    ranked = spark.createDataFrame([("m", 1, k, n) for k, n in enumerate("abcdef", 1)] + [("m", 2, 1, "q")], "mode string, query_id int, rank int, id string")
    rel = spark.createDataFrame([(1, "b", True), (1, "e", False), (1, "f", True), (2, "r", True), (3, "s", True)], "query_id int, id string, current boolean")
    rows = {r.query_id: r for r in R.evaluate(ranked, rel, ["mode"]).collect()}
    assert (rows[1].recall, rows[1].precision, rows[1].mrr, rows[1].hit, rows[1].ceiling, rows[1].freshness) == (2 / 3, 0.4, 0.5, 1.0, 1.0, 0.5)
    assert (rows[2].recall, rows[2].mrr, rows[3].precision, rows[3].hit) == (0.0, 0.0, 0.0, 0.0)


def test_relevant_chunks(spark):
    df = spark.createDataFrame([(1, "Azure and azure"), (2, "Azure once"), (3, "a limited number of customers"), (4, "azure azure About NVIDIA"), (5, None)], "id int, text string")
    rows = R.relevant_chunks(df, ["azure", "limited number of customers"], without=["about nvidia"])
    assert sorted(r.id for r in rows.collect()) == [1, 3]
    assert R.normalized(F.array(F.lit(3.0), F.lit(4.0))) is not None
