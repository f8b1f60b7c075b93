import math

import numpy as np
from pyspark.sql import functions as F

from granary.llm import ann


def test_a_query_with_too_few_rows_in_its_lists_is_asked_over_all(spark, monkeypatch):
    """Every row has a list of its own, so the lists that a query visits hold too few rows."""
    turn = np.pi * (np.arange(150) / 150) ** 2
    v = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    monkeypatch.setattr(ann, "fit_graph", lambda rows: ann.CentroidGraph.build(ann.augmented(v, math.sqrt((v * v).sum(axis=1).max())), math.sqrt((v * v).sum(axis=1).max())))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [n for n, _ in x] for q, x in got.items()} == {q: list(range(1, 21)) for q in range(0, 150, 10)}
    s = (v * v[140]).sum(axis=1)
    assert [i for _, i in got[140]] == [int(j) for j in np.lexsort((np.arange(len(v)), -s)) if j != 140][:20]
