import numpy as np

from granary.llm import ann
from granary.llm.queries_vectors import op3_nearest_neighbours
from pyspark.sql import functions as F


def brute(rows, asked, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q, v in rows:
        if asked(q):
            s = (x * np.array(v, dtype=np.float64)).sum(axis=1)
            out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_recall_on_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got, want = found(op3_nearest_neighbours(spark, "/root/testdata/sf0.01")), brute(rows, lambda q: q % 20 == 0)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95
    true = {(q, i): s for q, w in brute(rows, lambda q: q % 20 == 0, 10**6).items() for i, s in w}
    assert all(abs(true[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_norms_ties_hot_vectors_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CAP", 50)
    rnd = np.random.default_rng(1)
    rows = [(k, (rnd.normal(size=8) * rnd.choice([0.1, 1, 5])).tolist()) for k in range(600)] + [(k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for k in range(600, 800)]
    odd = [(None, [1.0] * 8), (2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [1.0] * 6), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] + [1.0] * 7), (2100, [1.0] * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, list int").repartition(3)
    got, want = found(ann.nearest(df, F.col("vec_id") % 20 == 0)), brute(rows, lambda q: q % 20 == 0)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())
    assert [i for i, _ in got[620]] == [i for i, _ in want[620]]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest(df, F.col("vec_id") == 0)) == {0: [(1, 0.5), (2, -1.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
