"""A text encoder trained on the corpus itself: hashed TF-IDF rows, reduced by a randomised singular value decomposition.

It stands in for a neural encoder, which needs a model: texts that share words, or words that go together in the corpus,
are near. Training reads every text a few times; what tasks exchange and what the driver holds is buckets times width
numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.functions.text import tokens
from granary.sources.landing import landed, spread

BUCKETS, WIDTH, EXTRA, ROUNDS, SEED = 1 << 13, 64, 16, 2, 42
CHUNK, ROWS = 1 << 16, 256  # tokens or entries, and rows, that are looked at together
PARTS = 16


def bag(text: Column, buckets: int) -> Column:
    """The hash bucket of every token."""
    return F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _pieces(lengths: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, entries, row of each entry) of lists of some lengths, a bounded number of entries and rows at once, but whole rows."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        start = ends[first] - lengths[first]
        last = max(first + 1, min(first + ROWS, int(np.searchsorted(ends, start + CHUNK, side="right"))))
        yield slice(first, last), slice(start, ends[last - 1]), np.repeat(np.arange(last - first), lengths[first:last])
        first = last


def _counted(row: np.ndarray, flat: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the different buckets of each row, by row and bucket."""
    key, count = np.unique(row * np.int64(buckets) + flat, return_counts=True)
    return *np.divmod(key, buckets), count


def _unit(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each row at unit length."""
    w = (1 + np.log(count)) * weights[bucket]
    length = np.sqrt(np.bincount(row, w * w))
    return np.divide(w, length[row], out=np.zeros_like(w), where=length[row] > 0)


def _counts(buckets: int):
    """Batches of bags -> batches of their different buckets with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bag")
            flat = np.asarray(lists.flatten())
            for rows, part, row in _pieces(np.asarray(lists.value_lengths())):
                row, bucket, count = _counted(row, flat[part], buckets)
                ends = pa.array(np.searchsorted(row, np.arange(rows.stop - rows.start + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (bucket, count)], names=["bucket", "count"])

    return run


def _frequencies(buckets: int):
    """Batches of counted bags -> for a task, in how many of its rows each bucket is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            df += np.bincount(np.asarray(batch.column("bucket").flatten()), minlength=buckets)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], names=["bucket", "df"])

    return run


def _matrix(row: np.ndarray, bucket: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and the rows over these."""
    used, at = np.unique(bucket, return_inverse=True)
    a = np.zeros((row[-1] + 1, len(used)))
    a[row, at] = w
    return used, a


def _gram_product(bags: DataFrame, weights: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'Aq for the matrix A of all rows: each task adds up its rows, tasks' sums are added in two steps, by parts."""
    shared = bags.sparkSession.sparkContext.broadcast((weights, q))
    fold = math.isqrt(max(1, bags.rdd.getNumPartitions() - 1)) + 1

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, q = shared.value
        total = np.zeros_like(q)
        for batch in batches:
            buckets, counts = (np.asarray(batch.column(c).flatten()) for c in ("bucket", "count"))
            for _, part, row in _pieces(np.asarray(batch.column("bucket").value_lengths())):
                bucket = buckets[part]
                used, a = _matrix(row, bucket, _unit(row, bucket, counts[part], weights))
                total[used] += a.T @ (a @ q[used])
        parts = np.array_split(total, PARTS)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "task", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf.sort_values("task")["sums"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "task": [pdf["task"].min()], "sums": [np.asarray(total).tobytes()]})

    kind = "part int, task int, sums binary"
    sums = bags.mapInArrow(of_task, kind)
    some = sums.groupBy("part", F.floor(F.col("task") / fold)).applyInPandas(lambda key, pdf: added(pdf), kind)
    found = {r["part"]: np.frombuffer(r["sums"]) for r in some.groupBy("part").applyInPandas(added, kind).collect()}  # PARTS rows
    shared.destroy()
    return np.concatenate([found[k] for k in range(PARTS)]).reshape(q.shape) if found else np.zeros_like(q)


@dataclass(frozen=True)
class Encoder:
    """weights: a bucket's inverse frequency; basis: a bucket's place in the space of the leading singular vectors."""

    weights: np.ndarray
    basis: np.ndarray

    def column(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A column function from text to a vector of unit length; null where no token was ever seen in training."""
        shared = spark.sparkContext.broadcast((self.weights, self.basis))

        @F.pandas_udf("array<double>")
        def encode(bags: pd.Series) -> pd.Series:
            weights, basis = shared.value
            lengths = bags.map(len).to_numpy(dtype=np.int64, na_value=0)
            some = np.flatnonzero(lengths)
            out = pd.Series([None] * len(bags), dtype=object)
            if len(some):
                flat = np.concatenate([np.asarray(bags.iloc[k]) for k in some])
                for rows, part, row in _pieces(lengths[some]):
                    row, bucket, count = _counted(row, flat[part], len(weights))
                    used, a = _matrix(row, bucket, _unit(row, bucket, count, weights))
                    v = a @ basis[used]
                    size = np.linalg.norm(v, axis=1)
                    for k, x, n in zip(some[rows], v, size, strict=True):
                        if n > 1e-9:
                            out.iat[k] = x / n
            return out

        return lambda text: encode(bag(text, len(self.weights)))

    def write(self, spark: SparkSession, path: str) -> None:
        """The model as a table of a row for each bucket, in place of one that is there."""
        rows = list(zip(range(len(self.weights)), self.weights.tolist(), self.basis.tolist(), strict=True))
        spark.createDataFrame(rows, "bucket int, weight double, vector array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Encoder":
        rows = spark.read.parquet(path).orderBy("bucket").collect()
        return Encoder(np.array([r["weight"] for r in rows]), np.array([r["vector"] for r in rows]))


def fit_encoder(corpus: DataFrame, text_col: str = "text", buckets: int = BUCKETS, width: int = WIDTH, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = SEED) -> Encoder:
    """Trains on all texts. Null texts and texts without tokens teach nothing; repeated ones count each time.

    A random subspace of width + extra is multiplied by A'A and made orthogonal again, `rounds` times; A has a row of unit
    length for each text. In what it then spans, the `width` leading directions are found exactly. Directions without any
    text are left out (zero), so a corpus of few texts gives fewer; one without tokens gives an encoder of nulls.
    """
    if not 0 < width <= width + extra <= buckets:
        raise ValueError("width and extra must fit the buckets")
    bags = spread(corpus.select(F.col(text_col))).select(bag(F.col(text_col), buckets).alias("bag")).where("size(bag) > 0")
    bags = landed(bags.mapInArrow(_counts(buckets), "bucket array<int>, count array<int>"), "bags")
    seen = bags.mapInArrow(_frequencies(buckets), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # at most `buckets` rows
    df = np.zeros(buckets)
    for r in seen:
        df[r["bucket"]] = r["df"]
    weights = np.where(df > 0, np.log((1 + bags.count()) / (1 + df)) + 1, 0.0)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width + extra)) * (df > 0)[:, None])[0]
    for _ in range(rounds):
        q = np.linalg.qr(_gram_product(bags, weights, q))[0]
    small = q.T @ _gram_product(bags, weights, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    leading = np.argsort(values)[::-1][:width]
    kept = values[leading] > 1e-9 * max(values[leading[0]], 1e-300)
    return Encoder(weights, (q @ turn[:, leading]) * kept)


def encoded(corpus: DataFrame, encoder: Encoder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, vector) of every text, landed, so that a search doesn't encode again."""
    rows = spread(corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return landed(rows.select("id", encoder.column(corpus.sparkSession)(F.col("text")).alias("vector")), "vectors")
