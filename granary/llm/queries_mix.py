"""The query that mixes sources to target weights. A random sample has no SQL; tests check it by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import table
from granary.llm.mixing import mix_sources


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of each. Null texts have no words; null is a source, the last."""
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_mixing": op12_source_mixing}
ORACLES: dict[str, str] = {}
