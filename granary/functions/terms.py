"""Many terms in one pass over a text: an automaton finds them all, so its time doesn't depend on how many there are."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: More characters of terms than this do not go to a task at once: its automaton takes some 50 bytes for each.
MOST_CHARACTERS = 1 << 20


def term_counts(spark: SparkSession, text: Column, terms: list[str]) -> Column:
    """array<struct<at int, term string, n int>> of the terms that a text holds, whatever the case: the place in `terms`, the
    term in small letters, and how often.

    Occurrences of one term don't overlap, the leftmost count; those of different terms may. Null where the text is null,
    empty where it holds none. An empty term, or terms of more than MOST_CHARACTERS together, are an error. Terms that are
    equal but for case each have their count.
    """
    if not all(terms):
        raise ValueError("a term is empty")
    if (size := sum(map(len, terms))) > MOST_CHARACTERS:
        raise ValueError(f"terms of {size} characters: split them, at most {MOST_CHARACTERS} fit a task")
    low = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, t string").orderBy("k").select(F.lower("t")).collect()]  # as Spark lowers texts
    shared = spark.sparkContext.broadcast(low)

    @F.arrow_udf("array<struct<at:int,term:string,n:int>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, places = _automaton(shared.value)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("term", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            yield pa.array([None if t is None else [{"at": k, "term": term, "n": n} for term, n in _count(automaton, t).items() for k in places[term]] for t in batch.to_pylist()], type=kind)

    return count(F.lower(text))


def _automaton(terms: list[str]) -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    automaton, places = ahocorasick.Automaton(), {}
    for k, t in enumerate(terms):
        places.setdefault(t, []).append(k)
    for t in places:
        automaton.add_word(t, t)
    if places:
        automaton.make_automaton()
    return automaton, places


def _count(automaton: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """How often each term occurs; a match that overlaps the last one of its term doesn't count."""
    counts, last = {}, {}
    if len(automaton):
        for end, term in automaton.iter(text):
            if end - len(term) >= last.get(term, -1):
                counts[term] = counts.get(term, 0) + 1
                last[term] = end
    return counts


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", block: int = MOST_CHARACTERS) -> DataFrame:
    """(id, term, n) for each text and each different term of a table (term) that it holds, whatever the case.

    Terms reach the tasks in blocks of at most about `block` characters, one pass over the texts each. Null and empty terms,
    and null texts, have no hits. Terms equal but for case are one, in small letters; repeated ids have rows of their own.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = terms.select(F.lower("term").alias("term")).where("term != ''").distinct()
    found = rows.limit(0).select("id", F.lit("").alias("term"), F.lit(0).alias("n"))
    held, size = [], 0

    def meet(words: list[str]) -> DataFrame:
        return rows.select("id", F.inline(term_counts(spark, F.col("text"), words))).select("id", "term", "n")

    for r in named.orderBy("term").toLocalIterator():
        if held and size + len(r["term"]) > block:
            found, held, size = found.unionByName(meet(held)), [], 0
        held.append(r["term"])
        size += len(r["term"])
    return found.unionByName(meet(held)) if held else found
