"""The queries over documents that decide about whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.llm.common import table
from granary.llm.decontamination import contamination
from granary.llm.language_id import fit_language_model, predict_languages
from granary.llm.ngram_jaccard import ngram_jaccard
from granary.llm.sharding import shard_documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law of bytes. Null texts are of size 1; repeats and ties are placed each."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items. Null texts have no words and no hits; repeated rows have a row each."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out() -> Column:
    """The fold that the language model never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null ids are learned from, as they have no remainder; texts without a letter are und with score 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs, learn=~held_out())
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class and links; texts without words and other characters have none."""
    return ngram_jaccard(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_decontamination": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w, row_number() OVER (ORDER BY item_id, text) AS r FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT item_id, r, unnest(range(0, greatest(1, len(w) - 9))) AS j, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i : i + least(10, len(w)) - 1])) AS win
  FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i : i + n - 1])) AS win
  FROM docs, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id, r, i - j AS line FROM places JOIN windows USING (win)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, line ORDER BY i) AS island FROM found),
runs AS (SELECT doc_id, count(*) + max(n) - 1 AS size, min(i) - 1 AS start FROM islands GROUP BY doc_id, r, line, island),
longest AS (SELECT doc_id, CAST(size AS INT) AS longest_match, CAST(start AS INT) AS longest_at FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start) = 1),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0) AS longest_match, coalesce(longest_at, -1) AS longest_at
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
""",
    "op6_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, trim(coalesce(text, ''), E' \\t\\n\\r') AS t, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 AND t = '' THEN CAST([] AS VARCHAR[])
    WHEN len(w) = 0 THEN ['! ' || t]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS g
  FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id WHERE 5 * c >= 4 * (sx.n + sy.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(y, doc_id)) AS class_id, (SELECT count(*) FROM links WHERE links.x = doc_id) AS n_links
FROM w LEFT JOIN least ON doc_id = x
""",
}
QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard, "op1_sharding": op1_sharding, "op4_language_id": op4_language_id, "op2_decontamination": op2_decontamination}
