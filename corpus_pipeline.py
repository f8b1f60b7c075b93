"""Documents to training sequences: language ID, near-duplicates, decontamination, packing.

Every stage takes the documents of the stage before, whatever columns they have, and all but the last return the same
columns. Null ids are ids like any others, empty tables stay empty. The tables between the stages stay in the shared
folder until granary.llm.common.purge(spark), as the result reads the last of them when it is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import table, written
from granary.llm.decontamination import decontaminate
from granary.llm.language_id import fit_language_model, keep_known_languages
from granary.llm.ngram_jaccard import keep_one_of_each
from granary.llm.packing import pack_documents
from granary.llm.queries_docs import held_out
from granary.llm.queries_tokens import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those whose language the model rejects, with texts that are null or
    have no letter. Repeated documents are judged each; without a labelled document none is known, so all go."""
    return keep_known_languages(docs, fit_language_model(docs, learn=~held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id (null before others) of each class of near copies, at a similarity of 0.8 on
    five words; of rows that are equal in id and text one. Texts without words or other characters stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one. Null and empty texts
    hold nothing; items without id, text or word match nothing; repeated documents are judged each."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1,024 tokens, a row for each piece. Null and empty texts are just the end id; a
    longer text lies in several sequences; repeated documents are packed each."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: Language ID is a trained model, so SQL can't express the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
