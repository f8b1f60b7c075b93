"""Retrieval queries over the driver's tables, with their SQL.

The corpus is `documents`, the queries are all `benchmark` items. For the dense arm, the vector of vec_id stands for the
document of that id and for the item of that id; an item without a vector is only asked for its words. A document is
relevant to an item if it holds ten consecutive words of it anywhere (all of it, if it has fewer), whatever the case,
and current if it has a label.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.config import STOPWORDS
from granary.functions.terms import term_hits
from granary.operators import retrieval as R
from granary.operators.encoder import Encoder, encoded, fit_encoder
from granary.operators.graph import Graph, build_graph
from granary.sources.landing import landed, stored
from granary.sources.tables import table

NARROW = R.Filters(tickers=("en",), doc_types=("src1", "src2", "src3"), columns={"tickers": "lang", "doc_types": "source", "sections": "section", "date": "filing_date"})
WINDOW = 10


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).join(vectors(spark, d).select(F.col("id").alias("query_id"), "vector"), "query_id", "left")


def index(spark: SparkSession, d: str) -> R.Index:
    """The corpus' index, built once in an application for each state of the table's files."""
    return stored(spark, "bm25", [f"{d}/documents.parquet"], lambda: R.build_index(corpus(spark, d)))


def searcher(spark: SparkSession, d: str) -> R.Searcher:
    return R.Searcher(corpus(spark, d), vectors(spark, d), index(spark, d))


def bm25_topk(spark, d):
    return R.bm25(corpus(spark, d), items(spark, d), index=index(spark, d))


def bm25_filtered_topk(spark, d):
    return R.bm25(corpus(spark, d), items(spark, d), keep=NARROW.column(), index=index(spark, d))


def bm25_dated_topk(spark, d):
    """Documents of a span of days only; a document without a day is in no span."""
    day = F.when(F.col("id") % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 700).cast("int")))
    span = R.Filters(date_from=date(2024, 3, 1), date_to=date(2025, 2, 28))
    return R.bm25(corpus(spark, d).withColumn("filing_date", day), items(spark, d), keep=span.column(), index=index(spark, d))


def corpus_stats_idf(spark, d):
    return index(spark, d).weights.withColumn("idf", F.round("idf", 6))


def dense_topk(spark, d):
    return R.dense(vectors(spark, d), asked(spark, d))


def dense_filtered_topk(spark, d):
    return R.dense(vectors(spark, d), asked(spark, d), keep=F.col("label").isin(1, 3, 5))


def graph(spark: SparkSession, d: str) -> Graph:
    """The graphs of the vectors, built once in an application for each state of the table's files."""
    return stored(spark, "graph", [f"{d}/embeddings.parquet"], lambda: build_graph(vectors(spark, d)))


def graph_topk(spark, d):
    """dense_topk by walks over the graphs; a hit may be missed, so there is no SQL."""
    return R.Searcher(corpus(spark, d), vectors(spark, d), graph=graph(spark, d)).search("dense", asked(spark, d))


def graph_filtered_topk(spark, d):
    """dense_filtered_topk by walks over the graphs."""
    return R.Searcher(corpus(spark, d), vectors(spark, d), keep=F.col("label").isin(1, 3, 5), graph=graph(spark, d)).search("dense", asked(spark, d))


def hybrid_rrf(spark, d):
    return R.rrf(dense_topk(spark, d), bm25_topk(spark, d), anchor=False)


def hybrid_rrf_anchored(spark, d):
    return R.rrf(dense_topk(spark, d), bm25_topk(spark, d))


def reranked(spark, d):
    return searcher(spark, d).search("rerank", asked(spark, d))


def compared_modes(spark, d):
    """All four modes over the same queries; what a mode's failure says would be in the second result."""
    rows, said = R.compare_modes(searcher(spark, d), asked(spark, d), top=5)
    if failed := [x for x in said if x["error"]]:
        raise RuntimeError(str(failed))
    return rows.select("mode", "query_id", "rank", "id", "score")


def encoder(spark: SparkSession, d: str) -> Encoder:
    """The encoder trained on the corpus, once in an application for each state of the table's files."""
    return stored(spark, "encoder", [f"{d}/documents.parquet"], lambda: fit_encoder(corpus(spark, d)))


def text_searcher(spark: SparkSession, d: str, index: R.Index | None = None) -> R.Searcher:
    """The corpus with vectors of its own texts; questions are encoded as they are asked. Only words need the index."""
    found = stored(spark, "text_vectors", [f"{d}/documents.parquet"], lambda: encoded(corpus(spark, d), encoder(spark, d)))
    return R.Searcher(corpus(spark, d), found, index, encode=encoder(spark, d).column(spark))


def text_dense_topk(spark, d):
    return text_searcher(spark, d).search("dense", items(spark, d))


def text_eval_by_mode(spark, d):
    """What retrieval_eval_by_mode measures, by mode, with vectors of the texts themselves."""
    s, asked = text_searcher(spark, d, index(spark, d)), items(spark, d)
    arms = {"dense": landed(s.dense(asked)), "bm25": landed(s.bm25(asked))}
    arms["hybrid"] = landed(R.rrf(arms["dense"], arms["bm25"]))
    arms["rerank"] = R.rerank(R.hydrate(arms["hybrid"], s.corpus).where("trim(text) != ''"), asked, top=R.DENSE_TOP)
    rows = None
    for name, hits in arms.items():
        one = hits.withColumn("mode", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return R.aggregate_scores(R.evaluate(rows, landed(judgements(spark, d)), ["mode"]), [("mode",)])


def _arms(spark, d):
    """The hits of each of R.MODES, all as deep as the widest: the rerank arm orders every hybrid hit that has a text."""
    found = {"dense": landed(dense_topk(spark, d)), "bm25": landed(bm25_topk(spark, d))}
    found["hybrid"] = landed(R.rrf(found["dense"], found["bm25"]))
    texts = R.hydrate(found["hybrid"], corpus(spark, d)).where("trim(text) != ''")
    return found | {"rerank": R.rerank(texts, asked(spark, d), top=R.DENSE_TOP)}


def retrieval_pool(spark, d):
    return R.pool(_arms(spark, d))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def _runs(words: str, n: Column) -> Column:
    """The different runs of n words; none where there are fewer."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
    return F.array_distinct(F.transform(at, lambda k: F.array_join(F.slice(words, k, n), " ")))


def judgements(spark, d):
    """(query_id, id, current). One pass over a document finds the items' runs; a shorter item is one run."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    spaced = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    runs = landed(items.select("query_id", F.explode(_runs("w", F.least(F.size("w"), F.lit(WINDOW)))).alias("run")).select("query_id", spaced(F.col("run")).alias("term")))
    docs = corpus(spark, d).select("id", spaced(F.array_join(_words(F.col("text")), " ")).alias("text"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("current")).distinct()
    found = term_hits(docs, runs).join(runs, "term").select("query_id", "id").distinct()
    return found.join(labels, "id", "left").select("query_id", "id", F.coalesce("current", F.lit(False)).alias("current"))


def _scores(spark, d):
    rows = None
    for name, hits in _arms(spark, d).items():
        one = hits.withColumn("mode", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return R.evaluate(rows, landed(judgements(spark, d)), ["mode"])


def retrieval_eval_by_mode(spark, d):
    """Scores by mode and by category. latency_ms stands for a measured time: 7 ms a position of the mode's name."""
    took = F.length("mode") * 7 + F.col("query_id") % 3
    scores = _scores(spark, d).withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")).withColumn("latency_ms", took.cast("double"))
    return R.aggregate_scores(scores, [("mode",), ("category", "mode")])


def timed_eval_by_mode(spark, d):
    """Scores of each mode with the time that its searches took here, so there is no SQL."""
    return R.evaluate_modes(searcher(spark, d), asked(spark, d), landed(judgements(spark, d)))


def relevance_rule(spark, d):
    rows = R.relevant_chunks(corpus(spark, d), ["tion", "and the ", "the the the the the"], ["on"], ["zzz", "###"], min_hits=8, keep=F.col("lang") == "en")
    return rows.select("id", "source")


def term_frequencies(spark, d):
    """In how many documents the long words of the items stand, alone or inside other words, and how often."""
    words = items(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("term"))
    return term_hits(corpus(spark, d), words).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def hydrated_hits(spark, d):
    return R.hydrate(bm25_topk(spark, d).where("rank <= 6"), corpus(spark, d)).select("query_id", "rank", "id", F.substring("text", 1, 1800).alias("text"))


def manifest(spark, d):
    return corpus(spark, d).where(F.col("lang").isin("de", "fr")).groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[.\\-][a-z0-9]+)*'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
_BASE = f"""
toks AS (SELECT doc_id AS id, lang, source, {_TOKENS} AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
weights AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, text, embedding AS q FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS}) AS term FROM asked) GROUP BY ALL)"""


def _bm25(keep: str = "true", name: str = "bm25") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM (
      SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM post JOIN qterms USING (term) JOIN weights USING (term), size
      WHERE id IN (SELECT id FROM toks WHERE {keep}) GROUP BY query_id, id) WHERE score > 0) WHERE rank <= 30)"""


def _dense(keep: str = "true", name: str = "dense") -> str:
    v, q = "CAST(embedding AS DOUBLE[])", "CAST(q AS DOUBLE[])"
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM (
      SELECT query_id, vec_id AS id, round(list_dot_product({v}, {q}) / (sqrt(list_dot_product({v}, {v})) * sqrt(list_dot_product({q}, {q}))), 6) AS score
      FROM embeddings, asked WHERE q IS NOT NULL AND {keep})) WHERE rank <= 30)"""


def _rrf(anchor: bool, name: str = "hybrid") -> str:
    lead = "coalesce(min(CASE WHEN rank = 1 THEN arm END), 2)," if anchor else ""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {lead} round(sum(1.0 / (60 + rank)), 9) DESC, min(arm), arg_min(rank, arm)) AS rank,
      id, round(sum(1.0 / (60 + rank)), 9) AS score
    FROM (SELECT query_id, id, rank, 0 AS arm FROM dense UNION ALL SELECT query_id, id, rank, 1 FROM bm25) GROUP BY query_id, id) WHERE rank <= 30)"""


_NARROW = "lang = 'en' AND source IN ('src1', 'src2', 'src3')"
_DATED = "id % 10 <> 0 AND DATE '2024-01-01' + CAST(id % 700 AS INT) BETWEEN DATE '2024-03-01' AND DATE '2025-02-28'"
_CONTENT = "SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM "
_SHARE = "round(coalesce(len(list_intersect(list_distinct(qt), dt)) / nullif(len(list_distinct(qt)), 0), 0), 6)"
_RERANK = f"""
rr AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank, id, score FROM (
    SELECT h.query_id, h.id, h.rank AS before, {_SHARE} AS score
    FROM hybrid h JOIN (SELECT doc_id AS id, {_TOKENS} AS dt FROM documents WHERE trim(coalesce(text, '')) <> '') USING (id) JOIN (SELECT query_id, {_TOKENS} AS qt FROM asked) USING (query_id)))"""
_RUN_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_EVAL = f"""
WITH {_BASE}, {_bm25()}, {_dense()}, {_rrf(True)},
{_RERANK},
iw AS (
  SELECT query_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' ')))) AS run
  FROM (SELECT item_id AS query_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_RUN_WORDS} AS w FROM benchmark)) WHERE n > 0),
dw AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' ')))) AS run
  FROM (SELECT doc_id, {_RUN_WORDS} AS w FROM documents), (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
rel AS (SELECT query_id, doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS cur FROM (SELECT DISTINCT query_id, doc_id FROM dw JOIN iw USING (run))),
judged AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
hits AS (SELECT 'dense' AS mode, * FROM dense UNION ALL SELECT 'bm25', * FROM bm25 UNION ALL SELECT 'hybrid', * FROM hybrid UNION ALL SELECT 'rerank', query_id, rank, id, score FROM rr),
found AS (
  SELECT mode, h.query_id, count(*) AS n, count(r.id) AS h, count(*) FILTER (cur) AS f, min(rank) FILTER (r.id IS NOT NULL) AS first
  FROM hits h LEFT JOIN rel r ON h.query_id = r.query_id AND h.id = r.id WHERE rank <= 5 GROUP BY ALL),
rows AS (
  SELECT m.mode, CASE WHEN j.query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, CAST(length(m.mode) * 7 + j.query_id % 3 AS DOUBLE) AS took,
    coalesce(h, 0) / n_rel AS recall, coalesce(h / nullif(n, 0), 0) AS precision, coalesce(1.0::DOUBLE / first, 0) AS mrr,
    CASE WHEN coalesce(h, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, least(5, n_rel) / n_rel AS ceiling, coalesce(f / nullif(h, 0), 0) AS freshness
  FROM (SELECT DISTINCT mode FROM hits) m CROSS JOIN judged j LEFT JOIN found USING (mode, query_id))
SELECT mode, category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr,
  round(avg(hit), 6) AS hit, round(avg(ceiling), 6) AS ceiling, round(avg(freshness), 6) AS freshness, median(took) AS latency_ms
FROM rows GROUP BY GROUPING SETS ((mode), (category, mode))"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered_topk, bm25_dated_topk, corpus_stats_idf, dense_topk, dense_filtered_topk, graph_topk, graph_filtered_topk, hybrid_rrf, hybrid_rrf_anchored, reranked, compared_modes, text_dense_topk, text_eval_by_mode, retrieval_pool, retrieval_eval_by_mode, timed_eval_by_mode, relevance_rule, term_frequencies, hydrated_hits, manifest)}
ORACLES = {
    "bm25_topk": f"WITH {_BASE}, {_bm25()} {_CONTENT} bm25",
    "bm25_filtered_topk": f"WITH {_BASE}, {_bm25(_NARROW)} {_CONTENT} bm25",
    "bm25_dated_topk": f"WITH {_BASE}, {_bm25(_DATED)} {_CONTENT} bm25",
    "corpus_stats_idf": f"WITH {_BASE} SELECT term, df, round(idf, 6) AS idf FROM weights",
    "dense_topk": f"WITH asked AS (SELECT item_id AS query_id, embedding AS q FROM benchmark LEFT JOIN embeddings ON vec_id = item_id), {_dense()} {_CONTENT} dense",
    "dense_filtered_topk": f"WITH asked AS (SELECT item_id AS query_id, embedding AS q FROM benchmark LEFT JOIN embeddings ON vec_id = item_id), {_dense('label IN (1, 3, 5)')} {_CONTENT} dense",
    "hybrid_rrf": f"WITH {_BASE}, {_bm25()}, {_dense()}, {_rrf(False)} {_CONTENT} hybrid",
    "hybrid_rrf_anchored": f"WITH {_BASE}, {_bm25()}, {_dense()}, {_rrf(True)} {_CONTENT} hybrid",
    "reranked": f"WITH {_BASE}, {_bm25()}, {_dense()}, {_rrf(True)}, {_RERANK} {_CONTENT} rr WHERE rank <= 6",
    "compared_modes": f"""
WITH {_BASE}, {_bm25()}, {_dense()}, {_rrf(True)}, {_RERANK},
hits AS (SELECT 'dense' AS mode, * FROM dense UNION ALL SELECT 'bm25', * FROM bm25 UNION ALL SELECT 'hybrid', * FROM hybrid UNION ALL SELECT 'rerank', query_id, rank, id, score FROM rr)
SELECT mode, query_id, CAST(rank AS INT) AS rank, id, score FROM hits WHERE rank <= 5""",
    "retrieval_pool": f"""
WITH {_BASE}, {_bm25()}, {_dense()}, {_rrf(True)}, {_RERANK},
hits AS (SELECT 'dense' AS mode, query_id, id, rank FROM dense UNION ALL SELECT 'bm25', query_id, id, rank FROM bm25 UNION ALL SELECT 'hybrid', query_id, id, rank FROM hybrid UNION ALL SELECT 'rerank', query_id, id, rank FROM rr)
SELECT query_id, id, CAST(min(rank) FILTER (mode = 'dense') AS INT) AS dense, CAST(min(rank) FILTER (mode = 'bm25') AS INT) AS bm25,
  CAST(min(rank) FILTER (mode = 'hybrid') AS INT) AS hybrid, CAST(min(rank) FILTER (mode = 'rerank') AS INT) AS rerank, CAST(min(rank) AS INT) AS best FROM hits GROUP BY query_id, id""",
    "retrieval_eval_by_mode": _EVAL,
    "relevance_rule": """
WITH c AS (SELECT doc_id AS id, source, lower(text) AS t FROM documents
  WHERE lang = 'en' AND text ILIKE '%on%' AND NOT text ILIKE '%zzz%' AND NOT text ILIKE '%###%'
    AND (text ILIKE '%tion%' OR text ILIKE '%and the %' OR text ILIKE '%the the the the the%'))
SELECT id, source FROM c
WHERE (length(t) - length(replace(t, 'tion', ''))) // 4 + (length(t) - length(replace(t, 'and the ', ''))) // 8
    + (length(t) - length(replace(t, 'the the the the the', ''))) // 19 >= 8
  OR contains(t, 'the the the the the')""",
    "term_frequencies": """
WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS term FROM benchmark),
hits AS (SELECT term, (length(t) - length(replace(t, term, ''))) // length(term) AS n FROM (SELECT lower(text) AS t FROM documents), terms WHERE contains(t, term))
SELECT term, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY term""",
    "hydrated_hits": f"WITH {_BASE}, {_bm25()} SELECT query_id, CAST(rank AS INT) AS rank, id, coalesce(text, '')[1:1800] AS text FROM bm25 LEFT JOIN documents ON id = doc_id WHERE rank <= 6",
    "manifest": "SELECT lang, source, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IN ('de', 'fr') GROUP BY ALL",
}
