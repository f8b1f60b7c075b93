"""Search over a corpus of chunks: filters, BM25, exact cosine, fusion, reranking and evaluation.

Every operator takes all queries at once: (query_id, text) or (query_id, vector) rows against the whole corpus, with
ranks per query. Query terms are only broadcast by Spark itself, after its own check of their size; query vectors go to
the tasks in blocks of bounded bytes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from granary.config import BM25_B, BM25_EPSILON, BM25_K1, DENSE_TOP, FINAL_TOP, RRF_K, SPARSE_TOP
from granary.functions.terms import term_counts
from granary.functions.text import bound, token_counts, tokens
from granary.operators.graph import BEAM, Graph, search_shards
from granary.operators.postings import blocks_of, query_blocks, search_blocks, shard_of, shards_for
from granary.sources.landing import landed, landing_path, spread

QUERY_BYTES, TEXT_BYTES = 8 << 20, 1 << 20


@dataclass(frozen=True)
class Filters:
    """Hard bounds on a chunk's metadata; empty means no bound, and a null date fails any bound on dates."""

    tickers: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    date_from: date | None = None
    date_to: date | None = None
    columns: dict = field(default_factory=lambda: {"tickers": "ticker", "doc_types": "doc_type", "sections": "section", "date": "filing_date"})

    def is_empty(self) -> bool:
        return not (self.tickers or self.doc_types or self.sections or self.date_from or self.date_to)

    def column(self) -> Column:
        out = F.lit(True)
        for name in ("tickers", "doc_types", "sections"):
            if values := getattr(self, name):
                out = out & F.col(self.columns[name]).isin(*values)
        at = F.col(self.columns["date"]) if self.date_from or self.date_to else None
        if self.date_from:
            out = out & (at >= F.lit(self.date_from))
        if self.date_to:
            out = out & (at <= F.lit(self.date_to))
        return out

    def over(self, inferred: "Filters") -> "Filters":
        """Each bound set here replaces the inferred one."""
        pick = lambda name: getattr(self, name) or getattr(inferred, name)
        return Filters(pick("tickers"), pick("doc_types"), pick("sections"), pick("date_from"), pick("date_to"), self.columns)


def ranked(hits: DataFrame, top: int, *ties: str, score: str = "score") -> DataFrame:
    """The top rows of each query by score and the ties in ascending order, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# --- sparse -------------------------------------------------------------------


def postings(corpus: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl) of every term of every text; texts without tokens have no row.

    A text is one row, so its terms are counted there: nothing is exchanged. Batches hold a bounded number of bytes.
    """
    rows = spread(corpus.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    schema = T.StructType([rows.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                held = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, held + TEXT_BYTES, "right")))
                counts = [token_counts(t.as_py()) for t in texts[at:to]]
                of = np.repeat(np.arange(at, to), [len(c) for c in counts])
                dl = np.repeat(np.array([sum(c.values()) for c in counts], dtype=np.int32), [len(c) for c in counts])
                terms, tf = pa.array(list(chain.from_iterable(counts)), pa.string()), pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), terms, tf, pa.array(dl)], names=schema.names)
                at = to

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Index:
    """A corpus ready for BM25: postings (id, term, tf, dl), size (n, avgdl, shards; one row), weights (term, df, idf), and
    blocks, the postings' impacts by shard and term."""

    postings: DataFrame
    size: DataFrame
    weights: DataFrame
    blocks: DataFrame


PARTS = ("postings", "size", "weights", "blocks")


def write_index(corpus: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """Builds the index of a corpus under `path`, in place of one that is there."""
    spark = corpus.sparkSession
    postings(corpus, id_col, text_col).write.mode("overwrite").parquet(f"{path}/postings")
    index = spark.read.parquet(f"{path}/postings")
    shards = shards_for(index.count(), spark.sparkContext.defaultParallelism)
    corpus_size(corpus, index).withColumn("shards", F.lit(shards)).write.mode("overwrite").parquet(f"{path}/size")
    size = spark.read.parquet(f"{path}/size")
    term_weights(index, size).write.mode("overwrite").parquet(f"{path}/weights")
    long = 1 - BM25_B + BM25_B * F.col("dl") / size.select("avgdl").scalar()
    impacts = index.select("id", "term", (F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * long)).alias("impact"))
    blocks_of(impacts, shards).write.mode("overwrite").parquet(f"{path}/blocks")


def load_index(spark: SparkSession, path: str) -> Index:
    """The index that write_index() left under `path`; without one, FileNotFoundError."""
    jvm = spark.sparkContext._jvm
    for part in PARTS:
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            raise FileNotFoundError(f"no complete BM25 index at {path}: build it with write_index()")
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))


def build_index(corpus: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
    """The index of a corpus for this application, in the shared folder."""
    path = landing_path(corpus.sparkSession, "bm25")
    write_index(corpus, path, id_col, text_col)
    return load_index(corpus.sparkSession, path)


def corpus_size(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """One row: n texts and their average length in tokens, empty texts counted."""
    total = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).scalar()
    return corpus.agg(F.count("*").alias("n")).select("n", F.try_divide(total, F.col("n")).alias("avgdl"))


def term_weights(index: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf): negative weights become a share of the mean over all terms before that."""
    n = size.select("n").scalar()
    df = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("n", n)
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * BM25_EPSILON).alias("floor")).scalar()
    return raw.withColumn("floor", floor).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25(corpus: DataFrame, queries: DataFrame, top: int = SPARSE_TOP, keep: Column | None = None, id_col: str = "id", text_col: str = "text", index: Index | None = None, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id, score): Okapi scores over whole-corpus statistics, filtered before the cut, above 0 only.

    queries: (query_id, text). A query's repeated terms count each time. `keep` is a condition on the corpus' columns.
    Without an index one is built. Only lists of the queries' terms are read; of these, blocks that can't change a result
    are skipped (postings.py). Queries go to the tasks in blocks of at most about block_bytes.
    """
    spark = corpus.sparkSession
    index = index or build_index(corpus, id_col, text_col)
    asked = queries.select("query_id", tokens(F.col("text")).alias("terms"))
    kept = None
    if keep is not None:
        ids = corpus.where(keep).select(F.col(id_col).alias("id")).withColumn("shard", shard_of(F.col("id"), index.size.select("shards").scalar()))
        kept = ids.groupBy("shard").agg(F.collect_set("id").alias("ids"))  # at most a shard's texts
    kind = queries.schema["query_id"].dataType
    found = None
    for names, terms in query_blocks(asked, index.weights, block_bytes):
        hits = search_blocks(index.blocks, kept, names, terms, kind, top)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("id", corpus.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    return ranked(found, top, "id").select("query_id", "rank", "id", "score")


# --- dense --------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in element order, as SQL engines sum them."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _blocks(asked: DataFrame, block_bytes: int) -> Iterator[tuple[list, np.ndarray]]:
    """Query ids and vectors of one length, in blocks of bounded bytes that come to the driver one after another."""
    ids, rows, held = [], [], 0
    for r in asked.orderBy(F.size("q"), "query_id").toLocalIterator():
        if rows and (held >= block_bytes or len(r["q"]) != len(rows[0])):
            yield ids, np.array(rows, dtype=float)
            ids, rows, held = [], [], 0
        ids.append(r["query_id"])
        rows.append(r["q"])
        held += 8 * len(r["q"])
    if rows:
        yield ids, np.array(rows, dtype=float)


def dense(vectors: DataFrame, queries: DataFrame, top: int = DENSE_TOP, keep: Column | None = None, id_col: str = "id", vector_col: str = "vector", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id, score): exact cosine, filtered before the cut. queries: (query_id, vector).

    The stated queries go to the tasks in blocks of at most about block_bytes; each batch of vectors meets a block in one
    matrix product and only its best `top` of each query leave the task. Queries and vectors that are null or hold a
    null, and vectors of another length than a query's, take no part; a zero vector has no cosine and ranks last.
    """
    rows = vectors if keep is None else vectors.where(keep)
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())
    rows = spread(rows.where(whole(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    asked = queries.where(whole("vector")).select("query_id", F.col("vector").cast("array<double>").alias("q"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found, kind = vectors.sparkSession.createDataFrame([], schema), to_arrow_type(schema["query_id"].dataType)
    for ids, q in _blocks(asked, block_bytes):
        found = found.unionByName(rows.mapInArrow(_meet(vectors.sparkSession.sparkContext.broadcast((pa.array(ids, kind), q)), top, schema.names), schema))
    return ranked(found, top, "id").select("query_id", "rank", "id", "score")


def _meet(shared, top: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        qn = np.sqrt(_in_order(q, q))
        for batch in batches:
            lists = batch.column("v")
            batch = batch.filter(pc.equal(pc.list_value_length(lists), q.shape[1]))
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column("v").flatten()).reshape(-1, q.shape[1])
            vn = np.sqrt(_in_order(v, v))
            with np.errstate(invalid="ignore", divide="ignore"):
                rough = (q @ v.T) / (qn[:, None] * vn)
            rough = np.where(np.isfinite(rough), rough, -2.0)
            n = min(top, len(v))
            least = np.partition(rough, len(v) - n, axis=1)[:, len(v) - n]
            asked, at = np.nonzero(rough >= least[:, None] - 1e-5)  # ties after rounding stay in
            scale = qn[asked] * vn[at]
            score = np.divide(_in_order(v[at], q[asked]), scale, out=np.full(len(at), np.nan), where=scale > 0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked)), batch.column("id").take(pa.array(at)), pa.array(_rounded(score), pa.float64(), from_pandas=True)], names=names)

    return run


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, as dense() scores them."""
    return _rounded(_in_order(v, q) / (np.sqrt(_in_order(q, q)) * np.sqrt(_in_order(v, v))))


def dense_graph(graph: Graph, queries: DataFrame, top: int = DENSE_TOP, keep: Column | None = None, vectors: DataFrame | None = None, beam: int = BEAM, id_col: str = "id", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id, score): what dense() gives, but by walks over a standing graph, so a hit may be missed.

    `keep` is a condition on the columns of `vectors`, which holds the graph's ids; it acts before the cut. Scores are
    exact. Zero vectors have no cosine and are never hits; queries that are null, zero or hold a null or a non-finite
    number have none. A wider beam misses less and costs in proportion.
    """
    spark = graph.rows.sparkSession
    kept = None
    if keep is not None:
        if vectors is None:
            raise ValueError("a filter needs the table whose columns it reads")
        ids = vectors.where(keep).select(F.col(id_col).alias("id")).where("id is not null")
        kept = ids.groupBy(shard_of(F.col("id"), F.lit(graph.shards)).alias("shard")).agg(F.collect_set("id").alias("kept"))  # at most a shard's ids
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    asked = queries.where((F.size("vector") > 0) & F.forall("vector", finite)).select("query_id", F.col("vector").cast("array<double>").alias("q"))
    kind = asked.schema["query_id"].dataType
    found = None
    for names, q in _blocks(asked, block_bytes):
        hits = search_shards(graph, kept, spark.sparkContext.broadcast((pa.array(names, to_arrow_type(kind)), q)), kind, top, beam, _cosine)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("id", graph.rows.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())]))
    return ranked(found, top, "id").select("query_id", "rank", "id", "score")


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6


def normalized(v: Column) -> Column:
    """v by its length, which is computed once."""
    return bound(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n)))


# --- fusion -------------------------------------------------------------------


def rrf(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = RRF_K, top: int = DENSE_TOP, anchor: bool = True) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, rank, id, score). With anchor, each arm's first hit leads, dense first.

    Equal scores go by arm (dense first), then by the rank there. A hit that leads both arms stands once.
    """
    both = dense_hits.select("query_id", "id", "rank", F.lit(0).alias("arm")).unionByName(sparse_hits.select("query_id", "id", "rank", F.lit(1).alias("arm")))
    fused = both.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"),
        F.min(F.when(F.col("rank") == 1, F.col("arm"))).alias("leads"),
        F.min(F.struct("arm", "rank")).alias("first"),
    )
    order = [F.coalesce("leads", F.lit(2))] if anchor else []
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, F.desc("score"), "first.arm", "first.rank"))
    return fused.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")


def pool(arms: dict[str, DataFrame]) -> DataFrame:
    """All arms' hits by id, the rank in each arm (null: not there), and the best rank."""
    rows = None
    for name, hits in arms.items():
        one = hits.select("query_id", "id", "rank", F.lit(name).alias("mode"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("query_id", "id").pivot("mode", list(arms)).agg(F.min("rank"))
    return wide.withColumn("best", F.least(*arms) if len(arms) > 1 else F.col(next(iter(arms))))


def hydrate(hits: DataFrame, corpus: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Hits with their text, fetched for the few hits only; a missing text is empty."""
    texts = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return hits.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def lexical_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder, which needs a model: the share of the query's tokens that the text holds."""
    q, t = F.array_distinct(tokens(query)), tokens(text)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0)), 6)


def rerank(hits: DataFrame, queries: DataFrame, top: int = FINAL_TOP, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """Hits with text, scored again and cut. Any hit without text is an error, as a score of nothing means nothing.

    The scorer is a column of query and text; a model that scores in batches is one as a pandas UDF.
    """
    asked = queries.select("query_id", F.col("text").alias("query"))
    text = F.when(F.trim("text") == "", F.raise_error(F.lit("a candidate has no text"))).otherwise(F.col("text"))
    scored = hits.select("query_id", "id", F.col("rank").alias("before"), text.alias("text")).join(asked, "query_id")
    return ranked(scored.withColumn("score", scorer(F.col("query"), F.col("text"))), top, "before").select("query_id", "rank", "id", "score")


MODES = ("dense", "bm25", "hybrid", "rerank")


@dataclass(frozen=True)
class Searcher:
    """A corpus (id, text, ...), its vectors (id, vector, ...) and its index, searched in any of the modes.

    keep is a condition on the columns of corpus and vectors alike; prefix is put before a query's text where a model
    encodes it (encode: a column function from text to vector), not before passages. Queries: (query_id, text, vector);
    the vector column isn't read where there is an encoder. With a graph of the vectors, the dense arm walks it (fast, may
    miss hits); without one it is exact.
    """

    corpus: DataFrame
    vectors: DataFrame
    index: Index | None = None
    keep: Column | None = None
    encode: Callable[[Column], Column] | None = None
    prefix: str = ""
    scorer: Callable[[Column, Column], Column] = lexical_score
    graph: Graph | None = None

    def dense(self, queries: DataFrame) -> DataFrame:
        asked = queries if self.encode is None else queries.withColumn("vector", self.encode(F.concat(F.lit(self.prefix), F.col("text"))))
        if self.graph is not None:
            return dense_graph(self.graph, asked, keep=self.keep, vectors=self.vectors)
        return dense(self.vectors, asked, keep=self.keep)

    def bm25(self, queries: DataFrame) -> DataFrame:
        return bm25(self.corpus, queries, keep=self.keep, index=self.index)

    def hybrid(self, queries: DataFrame) -> DataFrame:
        return rrf(landed(self.dense(queries)), landed(self.bm25(queries)))

    def rerank(self, queries: DataFrame, top: int = FINAL_TOP) -> DataFrame:
        """The hybrid hits that have a text, scored anew."""
        return rerank(hydrate(self.hybrid(queries), self.corpus).where("trim(text) != ''"), queries, top, self.scorer)

    def search(self, mode: str, queries: DataFrame, top: int | None = None) -> DataFrame:
        """One mode with candidate widths of the configuration; top only trims what is returned."""
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}; known: {', '.join(MODES)}")
        return getattr(self, mode)(queries).where(F.col("rank") <= (top or (FINAL_TOP if mode == "rerank" else DENSE_TOP)))


def search(mode: str, corpus: DataFrame, vectors: DataFrame, queries: DataFrame, keep: Column | None = None, top: int | None = None) -> DataFrame:
    """One search of a corpus without a standing index."""
    return Searcher(corpus, vectors, keep=keep).search(mode, queries, top)


def compare_modes(searcher: Searcher, queries: DataFrame, top: int | None = None, modes: tuple[str, ...] = MODES) -> tuple[DataFrame | None, list[dict]]:
    """The same queries through every mode: (mode, query_id, rank, id, score) rows, and for each mode its time.

    The list holds mode, latency_ms and error; a mode that fails has its error there, and the others still run.
    """
    rows, said = None, []
    for mode in modes:
        start = time.perf_counter()
        try:
            hits, error = landed(searcher.search(mode, queries, top).withColumn("mode", F.lit(mode))), None
            rows = hits if rows is None else rows.unionByName(hits)
        except Exception as failure:  # one arm's failure is reported beside the others' results
            error = f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"
        said.append({"mode": mode, "latency_ms": int((time.perf_counter() - start) * 1000), "error": error})
    return rows, said


# --- evaluation ---------------------------------------------------------------


def evaluate(hits: DataFrame, judgements: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Scores of each ranked list. hits: keys, query_id, rank, id; judgements: query_id, id, current.

    recall, precision (over what was returned), mrr, hit, ceiling (the best recall possible) and freshness (the share
    of relevant hits that are current); 0 where there is nothing to divide by. Every judged query counts for every
    list of keys, also without a hit.
    """
    relevant = judgements.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    lists = hits.select(*keys).distinct().agg(F.collect_list(F.struct(*keys)).alias("lists")).scalar()  # a few lists
    every = relevant.withColumn("lists", lists).select("query_id", "n_relevant", F.inline("lists"))
    marked = hits.where(F.col("rank") <= k).join(judgements.select("query_id", "id", F.col("current").alias("c"), F.lit(1).alias("r")), ["query_id", "id"], "left")
    found = marked.groupBy(*keys, "query_id").agg(F.count("*").alias("n"), F.count("r").alias("h"), F.count(F.when(F.col("c"), 1)).alias("f"), F.min(F.when(F.col("r") == 1, F.col("rank"))).alias("first"))
    row = every.join(found, [*keys, "query_id"], "left").fillna(0, ["n", "h", "f"])
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    h, n, rel = F.col("h"), F.col("n"), F.col("n_relevant")
    return row.select(*keys, "query_id", share(h, rel).alias("recall"), share(h, n).alias("precision"), share(F.lit(1), F.col("first")).alias("mrr"), (h > 0).cast("double").alias("hit"), share(F.least(F.lit(k), rel), rel).alias("ceiling"), share(F.col("f"), h).alias("freshness"))


METRICS = ("recall", "precision", "mrr", "hit", "ceiling", "freshness")


def aggregate_scores(scores: DataFrame, levels: list[tuple[str, ...]]) -> DataFrame:
    """Means of all metrics, and the median of latency_ms where there is one, at several levels of grouping in one pass."""
    keys = list(dict.fromkeys(c for level in levels for c in level))
    timed = [F.median("latency_ms").alias("latency_ms")] if "latency_ms" in scores.columns else []
    return scores.groupingSets([[F.col(c) for c in level] for level in levels], *map(F.col, keys)).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS), *timed)


def evaluate_modes(searcher: Searcher, queries: DataFrame, judgements: DataFrame, k: int = 5, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Scores of each mode with latency_ms, the measured time of its search over the number of queries.

    A mode runs for all queries at once, so that time is an average, not a single query's. The first failure of a mode is
    an error here, as its scores would be zeros.
    """
    hits, said = compare_modes(searcher, queries, modes=modes)
    if failed := [f"{x['mode']}: {x['error']}" for x in said if x["error"]]:
        raise RuntimeError("; ".join(failed))
    n = max(1, queries.count())
    took = F.coalesce(*(F.when(F.col("mode") == x["mode"], F.lit(x["latency_ms"] / n)) for x in said))
    return aggregate_scores(evaluate(hits, judgements, ["mode"], k).withColumn("latency_ms", took), [("mode",)])


def relevant_chunks(chunks: DataFrame, any_terms: list[str], all_terms: list[str] = (), without: list[str] = (), min_hits: int = 2, specific: int = 18, keep: Column | None = None, text_col: str = "text") -> DataFrame:
    """Chunks that are about something: all of all_terms, one of any_terms, none of `without` (case apart); and
    min_hits occurrences of any_terms in all, or one of a term of `specific` characters. % and _ in terms match freely.

    One pass over a text finds all plain terms, however many they are; only terms that match freely are tried one by one.
    """
    text, cond = F.col(text_col), F.lit(True)
    free = lambda t: any(c in t for c in "%_\\")
    like = lambda t: text.ilike(f"%{t}%")
    rows = chunks if keep is None else chunks.where(keep)
    plain = [[t for t in terms if not free(t)] for terms in (all_terms, without)]
    terms = [*any_terms, *plain[0], *plain[1]]
    some, needed, barred = len(any_terms), len(any_terms) + len(plain[0]), len(terms)
    for t in filter(free, all_terms):
        cond = cond & like(t)
    for t in filter(free, without):
        cond = cond & ~like(t)

    def found(hits: Column) -> Column:
        within = lambda a, b: F.filter(hits, lambda h: (h["at"] >= a) & (h["at"] < b))
        out = (F.size(within(some, needed)) == needed - some) & (F.size(within(needed, barred)) == 0)
        if not any_terms:
            return out
        one = F.size(within(0, some)) > 0
        for t in filter(free, any_terms):
            one = one | like(t)
        total = F.aggregate(within(0, some), F.lit(0), lambda n, h: n + h["n"])
        sure = F.exists(within(0, some), lambda h: F.length(h["term"]) >= specific)
        return out & one & ((total >= min_hits) | sure)

    return rows.where(cond).where(bound(term_counts(chunks.sparkSession, text, terms), found)) if terms else rows.where(cond)
