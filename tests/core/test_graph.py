import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import graph as G, retrieval as R
from granary.plans import retrieval as plans

SF = "/root/testdata/sf0.01"


def recall(found, exact):
    want = {(r.query_id, r.id) for r in exact.collect()}
    return len(want & {(r.query_id, r.id) for r in found.collect()}) / len(want)


@pytest.fixture(scope="module")
def drawn(spark):
    """6,000 vectors around 60 places, a fifth of them copies of one; 40 questions near some of them."""
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(60, 24))[rnd.integers(0, 60, 6000)] + 0.6 * rnd.normal(size=(6000, 24))
    v[rnd.random(6000) < 0.2] = v[0]
    rows = [(k, x.tolist(), int(k % 5)) for k, x in enumerate(v)]
    asked = [(int(k), (v[k] + 0.1 * rnd.normal(size=24)).tolist()) for k in rnd.choice(6000, 40, replace=False)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int"), spark.createDataFrame(asked, "query_id long, vector array<double>")


def test_recall_with_and_without_a_filter(drawn):
    vectors, asked = drawn
    graph = G.build_graph(vectors)
    assert graph.shards == 3 and graph.rows.count() == 3
    found = R.dense_graph(graph, asked).cache()
    assert recall(found, R.dense(vectors, asked)) >= 0.95
    assert found.groupBy("query_id").count().where("count = 30").count() == 40
    for keep in (F.col("label") < 4, F.col("label") == 2, (F.col("label") == 1) & (F.col("id") % 50 == 6)):
        some = R.dense_graph(graph, asked, keep=keep, vectors=vectors).cache()
        assert recall(some, R.dense(vectors, asked, keep=keep)) >= 0.95
        assert some.join(vectors.where(keep), "id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        R.dense_graph(graph, asked, keep=F.col("label") == 1)


def test_copies_come_in_order_of_id_with_exact_scores(drawn):
    vectors, _ = drawn
    hot = vectors.where("id = 0").select(F.lit(7).alias("query_id"), "vector")
    found = R.dense_graph(G.build_graph(vectors), hot).collect()
    assert [(r.rank, r.id, r.score) for r in found] == [(r.rank, r.id, r.score) for r in R.dense(vectors, hot).collect()]


def test_every_node_is_reached_and_layers_are_prefixes():
    rnd = np.random.default_rng(5)
    islands = np.concatenate([rnd.normal(size=8) * 5 + 0.01 * rnd.normal(size=(150, 8)) for _ in range(8)])
    unit = G._unit(rnd.permutation(islands))
    layers = G.layers_of(unit)
    assert [len(x) for x in layers] == [1200, 75]
    for table in layers:
        seen, front = {0}, [0]
        while front:
            front = [y for x in front for y in table[x].tolist() if y >= 0 and y not in seen]
            seen |= set(front)
        assert len(seen) == len(table)
    found = G.walk(unit, layers, unit[::7], 30)
    exact = np.argsort(-(unit[::7] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), exact.tolist())]) >= 0.95


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1e200, 1e200]), ("c", [0.0, 0.0]), ("d", None), ("e", []), ("f", [1.0, None]), ("g", [float("nan"), 1.0]), ("h", [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), ("a", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>")
    graph = G.build_graph(vectors.withColumn("shard", F.lit("mine")).withColumn("v", F.lit(1)))
    asked = spark.createDataFrame([(1, [2.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [float("inf"), 1.0])], "query_id int, vector array<double>")
    found = {(r.query_id, r.rank, r.id) for r in R.dense_graph(graph, asked).collect()}
    assert {x for x in found if x[0] == 2} == {(2, 1, "h")} and {x[2] for x in found if x[0] == 1} == {"a", "b"} and {x[0] for x in found} == {1, 2}
    none = G.build_graph(vectors.limit(0))
    assert R.dense_graph(none, asked).count() == 0 and R.dense_graph(graph, asked.limit(0)).count() == 0


def test_a_missing_graph_is_an_error_and_a_searcher_walks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        G.load_graph(spark, str(tmp_path / "none"))
    assert recall(plans.graph_topk(spark, SF), plans.dense_topk(spark, SF)) >= 0.95
    assert recall(plans.graph_filtered_topk(spark, SF), plans.dense_filtered_topk(spark, SF)) >= 0.95
