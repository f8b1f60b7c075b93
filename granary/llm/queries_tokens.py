"""The queries of the operators that count, pack and store token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import table
from granary.llm.packing import pack_documents
from granary.llm.token_counts import token_counts
from granary.llm.token_files import token_files


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back. Null texts are just the end id; equal ids stand together in any order."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed. Null texts are just the end id; a document longer than a sequence lies in several."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. Null texts count as empty; repeated rows are counted each."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), budget=512)


QUERIES = {"op5_token_counts": op5_token_counts, "op9_token_files": op9_token_files, "op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
