"""The query that groups spelling variants. The crc32 of its contract isn't SQL; tests check it by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import table
from granary.llm.spelling import corpus_words, group_spellings


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents. Null texts have none; repeated documents are counted each."""
    return group_spellings(corpus_words(table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES: dict[str, str] = {}
