"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component so that all have the largest norm; then the nearest in the plane are those of the
largest inner product. Balanced k-means on a bounded sample gives about sqrt(N) centroids, which a graph in memory
links. Every vector goes to the lists of its nearest centroid and of up to COPIES - 1 others not much farther; a query
searches the graph and takes all lists whose centroid is at most 1 + PRUNE times as far as the nearest, LEAST_LISTS at
least. Lists of more than CAP rows are dealt to several tasks, and a query visits them all, so no list is cut. There are
at most MOST_LISTS centroids, so what is broadcast is bounded; beyond MOST_LISTS squared rows, lists grow with the table,
and the work of a query with them.

Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.common import written

SAMPLE, MOST_LISTS = 20_000, 4096
COPIES, COPY_RATIO, PRUNE, LEAST_LISTS, CAP = 4, 0.3, 0.12, 12, 4096
DEGREE, SHORTCUTS, BEAM, POOL, EXPAND = 20, 6, 48, 160, 8


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1, keepdims=True), 0))], axis=1)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, weight: float = 0.5, seed: int = 0) -> np.ndarray:
    """k-means in which a centroid that has more than its share of the sample is made to look farther away."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), k, replace=False)].copy()
    load = np.ones(k)
    for _ in range(rounds):
        d2 = np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T, 0)
        a = (d2 + weight * d2.mean() * 0.1 * np.log(np.maximum(load, 0.05))).argmin(axis=1)
        load = 0.5 * load + 0.5 * np.bincount(a, minlength=k) * k / len(x)
        for j in np.unique(a):
            c[j] = x[a == j].mean(axis=0)
    return c


@dataclass
class CentroidGraph:
    """Centroids, each linked to its nearest and to some random others."""

    centroids: np.ndarray
    links: np.ndarray
    norm: float

    @staticmethod
    def build(centroids: np.ndarray, norm: float, seed: int = 0) -> "CentroidGraph":
        k = len(centroids)
        d2 = (centroids**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * centroids @ centroids.T
        np.fill_diagonal(d2, np.inf)
        near = np.argsort(d2, axis=1)[:, : min(DEGREE, max(k - 1, 1))]
        far = np.random.default_rng(seed).integers(0, k, (k, SHORTCUTS))
        return CentroidGraph(centroids, np.concatenate([near, far], axis=1), norm)

    def search(self, x: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
        """Distances to the centroids that a best-first search sees, infinite for the others.

        Each row keeps a pool of the nearest centroids seen. The search goes on while the pool holds one that isn't
        expanded and is one of the `beam` nearest, or within the ratio of the nearest; a step works on pools and new
        centroids only, not on all of them.
        """
        c, k, n = self.centroids, len(self.centroids), len(x)
        squares, own = (c**2).sum(axis=1), (x**2).sum(axis=1)
        found = np.full((n, k), np.inf)
        start = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        found[:, start] = np.sqrt(np.maximum(own[:, None] + squares[start] - 2 * x @ c[start].T, 0))
        pool, dist = np.full((n, POOL), -1), np.full((n, POOL), np.inf)
        pool[:, : len(start)], dist[:, : len(start)] = start, found[:, start]
        done = pool < 0
        alive, beam = np.arange(n), min(beam, POOL)
        while len(alive):
            near = dist[alive]
            limit = np.maximum(np.partition(near, beam - 1, axis=1)[:, beam - 1], near.min(axis=1) * (1 + ratio))
            waiting = np.where(done[alive], np.inf, near)
            pick = np.argpartition(waiting, EXPAND - 1, axis=1)[:, :EXPAND]
            value = np.take_along_axis(waiting, pick, axis=1)
            row, at = np.nonzero(np.isfinite(value) & (value <= limit[:, None]))
            if not len(row):
                break
            done[alive[row], pick[row, at]] = True
            who = np.repeat(alive[row], self.links.shape[1])
            to = self.links[pool[alive[row], pick[row, at]]].reshape(-1)
            key = np.unique((who * k + to)[np.isinf(found[who, to])])
            who, to = key // k, key % k
            found[who, to] = np.sqrt(np.maximum(own[who] + squares[to] - 2 * np.einsum("ij,ij->i", x[who], c[to]), 0))
            alive = alive[np.unique(row)]
            if not len(key):
                continue
            rows, first, size = np.unique(who, return_index=True, return_counts=True)
            slot = np.arange(len(who)) - np.repeat(first, size)
            line = np.repeat(np.arange(len(rows)), size)
            wide = [np.full((len(rows), int(size.max())), fill) for fill in (-1, np.inf, True)]
            wide[0][line, slot], wide[1][line, slot], wide[2][line, slot] = to, found[who, to], False
            both = [np.concatenate([old[rows], new], axis=1) for old, new in zip((pool, dist, done), wide, strict=True)]
            best = np.argpartition(both[1], POOL - 1, axis=1)[:, :POOL]
            pool[rows], dist[rows], done[rows] = (np.take_along_axis(x_, best, axis=1) for x_ in both)
        return found

    def lists_of_vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list of each vector and its copies."""
        d = self.search(augmented(x, self.norm), 0)
        order = np.argsort(d, axis=1, kind="stable")[:, : min(COPIES, d.shape[1])]
        dist = np.take_along_axis(d, order, axis=1)
        row, at = np.nonzero(dist <= dist[:, :1] * (1 + COPY_RATIO) + 1e-12)
        return row, order[row, at]

    def lists_of_queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True))
        d = self.search(np.concatenate([scaled, np.zeros((len(x), 1))], axis=1), PRUNE)
        least = np.sort(d, axis=1)[:, min(LEAST_LISTS, d.shape[1]) - 1]
        return np.nonzero(np.isfinite(d) & (d <= np.maximum(d.min(axis=1) * (1 + PRUNE), least)[:, None]))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector of the most common length, all finite and not all zero."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit_graph(rows: DataFrame, sample: int = SAMPLE, most_lists: int = MOST_LISTS, seed: int = 0) -> CentroidGraph | None:
    """Fits centroids on at most about `sample` rows, drawn evenly by a hash of the id."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not stats["n"]:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / stats["n"]))
    table = rows.where(draw).limit(2 * sample).toArrow().sort_by("id")
    if not table.num_rows:
        table = rows.limit(sample).toArrow().sort_by("id")
    norm = math.sqrt(stats["m"])
    x = augmented(_matrix(table.column("v").combine_chunks()), norm)
    k = max(1, min(round(math.sqrt(stats["n"])), most_lists, len(x)))
    return CentroidGraph.build(balanced_centroids(x, k, seed=seed), norm)


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row where `queries` holds, its k nearest other rows: query_id, rank (from 1), vec_id, score.

    Nearest first; equal scores go by the smaller vec_id. A query that finds fewer than k in the lists it visits is asked
    again over all lists, so it has fewer rows only where the table has fewer candidates. Null ids, and vectors that are
    null, zero, of another length than most, or hold null or non-finite components, take no part. Rows of one id count as one candidate, with their best score. An empty table, or one
    without usable vectors, gives no rows. Other columns are only read for `queries`.
    """
    spark = df.sparkSession
    rows = written(usable(df, id_col, vector_col), "vectors")
    graph = fit_graph(rows)
    out = "query_id long, rank int, vec_id long, score double"
    if graph is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(graph)
    names = ["list", "kind", "id", "v"]

    def assign(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = _matrix(part.column("v"))
                    row, to = shared.value.lists_of_queries(x) if kind else shared.value.lists_of_vectors(x)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), kind, np.int32)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], names=names)

        return run

    schema = "list int, kind int, id long, v array<double>"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = rows.repartition(parts)  # a small file is one partition
    index = written(vectors.mapInArrow(assign(0), schema), "postings")
    asked = rows.join(df.where(queries).select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    # counts of at most MOST_LISTS lists
    subs = {r["list"]: -(-r["count"] // CAP) for r in index.groupBy("list").count().collect()}
    many = F.create_map(*[F.lit(x) for pair in subs.items() if pair[1] > 1 for x in pair]) if any(n > 1 for n in subs.values()) else None
    pieces = F.coalesce(many[F.col("list")], F.lit(1)) if many is not None else F.lit(1)
    members = index.withColumn("sub", F.pmod(F.xxhash64("id"), pieces).cast("int"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        for batch in batches:
            lists, subs_, kinds = (batch.column(c).to_numpy() for c in ("list", "sub", "kind"))
            edges = np.flatnonzero(np.diff(lists) | np.diff(subs_) | np.diff(kinds)) + 1
            for a, z in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == z:
                    continue
                if key != (lists[a], subs_[a]):
                    key, ids, vectors, block = (lists[a], subs_[a]), [], [], None
                part = batch.slice(a, z - a)
                if kinds[a] == 0:
                    ids.append(part.column("id").to_numpy())
                    vectors.append(_matrix(part.column("v")))
                elif ids:
                    block = block or (np.concatenate(ids), np.concatenate(vectors))
                    yield _best(*block, part.column("id").to_numpy(), _matrix(part.column("v")), k)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, held = None, []

        def flush():
            best: dict[int, float] = {}
            for i, s in held:
                best[i] = max(s, best.get(i, -math.inf))
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            return pa.RecordBatch.from_arrays([pa.array([query] * len(top), pa.int64()), pa.array(range(1, len(top) + 1), pa.int32()), pa.array([i for i, _ in top], pa.int64()), pa.array([s for _, s in top], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "ids", "scores")), strict=True):
                if q != query:
                    yield flush()
                    query, held = q, []
                held += zip(i, s, strict=True)
        yield flush()

    def answered(visits: DataFrame) -> DataFrame:
        visits = visits.withColumn("sub", F.explode(F.sequence(F.lit(0), pieces - 1)))
        dealt = members.unionByName(visits).repartition("list", "sub").sortWithinPartitions("list", "sub", "kind", "id")
        found = dealt.mapInArrow(scan, "query_id long, ids array<long>, scores array<double>")
        return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, out)

    near = written(answered(asked.repartition(parts).mapInArrow(assign(1), schema)), "nearest")
    full = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(asked.join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return near
    every = F.explode(F.array(*map(F.lit, sorted(subs))))  # at most MOST_LISTS lists
    again = answered(short.select(every.alias("list"), F.lit(1).alias("kind"), "id", "v"))
    return near.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(*near.columns).unionByName(again)


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of one list for each query, with scores summed alike for equal vectors so that ties are ties."""
    rough = q @ x.T
    rough[query_ids[:, None] == ids] = -np.inf
    out_ids, out_scores = [], []
    for row, own in zip(rough, q, strict=True):
        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        kept = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0)) & (row > -np.inf))
        scores = (x[kept] * own).sum(axis=1)
        order = np.lexsort((ids[kept], -scores))[:k]
        out_ids.append(ids[kept][order])
        out_scores.append(scores[order])
    return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])
