"""The query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.llm.ann import nearest
from granary.llm.common import table


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others. Unusable vectors take no part; equal scores go by the smaller id."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLES: dict[str, str] = {}
