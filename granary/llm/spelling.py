"""Grouping of spelling variants: words at one edit of each other, by merging an errata trie along its heavy paths.

The words make a trie. At every node the child with most words below it is heavy, all others are light, as is the end of
a word. Each light subtree is merged into what stands beside it, with one character passed over: its words go, with the
light character replaced by the heavy one, into the heavy subtree; with it skipped, into the node's own subtree; with the
heavy one put before it, into the heavy subtree again; and the light subtrees of a node are merged with each other by
leaving a wildcard in the character's place. Where such a copy and a word end at the same terminal, they are one edit
apart. The smaller side is always the one that moves: a word has at most log2(words) light edges, and it is copied only
there, not at each of its letters.

Nothing is held in one task: nodes are hashes of prefixes, counts of their children are aggregates, light edges come from
a join of the words' nodes with these counts, and the merges are joins of copies with words. A pair is found exactly
once: a replaced letter by its light side, or by the wildcard if both sides are light; a skipped letter at the last of a
run of equal ones. Which child is called heavy decides on cost alone, so equal hashes of two prefixes do no harm.

Wildcard groups have at most one word for each letter of the alphabet. They are not made into pairs: each word gets the
number of the others and the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import written

LETTERS = r"a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes with more than the MOST_HOT-th part of all rows are fewer than MOST_HOT, so their table has a bound of its size.
MOST_HOT = 20_000
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def corpus_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lowered, with at least `least_chars` letters and `least_count` runs.

    Where the crc32 of "id:run" is divisible by `every`, the run loses one letter, so that variants exist. Null texts
    have no runs, a null id counts as an empty string, repeated rows are counted each.
    """
    run, crc = F.col("run"), F.col("crc")
    cut = (crc % F.char_length(run)).cast("int")
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    hit = runs.withColumn("crc", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    word = F.when(crc % every == 0, F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.char_length(run)))).otherwise(run)
    return hit.select(word.alias("word")).where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def trie_edges(words: DataFrame) -> DataFrame:
    """(word_id, at, node, next) for each letter and the end (next 0) of each word; node is a hash of the letters before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids, places, nodes, nexts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(nodes, pa.int64()), pa.array(nexts, pa.int32())], names=["word_id", "at", "node", "next"])

        for batch in batches:
            ids, places, nodes, nexts = [], [], [], []
            for number, word in zip(batch.column("word_id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                node = 0
                for at, letter in enumerate(map(ord, word)):
                    ids.append(number)
                    places.append(at)
                    nodes.append(node)
                    nexts.append(letter)
                    node = (node * BASE + letter + 1) % MODULUS
                ids.append(number)
                places.append(len(word))
                nodes.append(node)
                nexts.append(0)
                if len(ids) > 1 << 16:
                    yield made(ids, places, nodes, nexts)
                    ids, places, nodes, nexts = [], [], [], []
            yield made(ids, places, nodes, nexts)

    return words.select("word_id", "word").mapInArrow(run, "word_id long, at int, node long, next int")


def light_edges(edges: DataFrame, most_hot: int = MOST_HOT) -> DataFrame:
    """(word_id, at, heavy) where a word leaves the heavy path; heavy: the letter of the heavy child, null if there is none."""
    children = edges.groupBy("node", "next").agg(F.count("*").alias("words"))
    nodes = children.groupBy("node").agg(F.sum("words").alias("size"), F.count("*").alias("branches"), F.max(F.when(F.col("next") > 0, F.struct("words", (-F.col("next")).alias("code")))).alias("most"))
    nodes = written(nodes.where("branches > 1").select("node", "size", (-F.col("most.code")).alias("heavy")), "nodes")
    hot = F.col("size") > F.lit(max(1, (edges.count()) // most_hot))
    few = F.broadcast(nodes.where(hot).select("node", "heavy"))
    wide = edges.join(few, "node").unionByName(edges.join(few.select("node"), "node", "left_anti").join(nodes.where(~hot).select("node", "heavy"), "node"))
    return wide.where(~F.col("next").eqNullSafe(F.col("heavy"))).select("word_id", "at", "heavy")


def merged(words: DataFrame, light: DataFrame) -> DataFrame:
    """(word, many, best): for each word, numbers of near words found together, and the first of them as (-n, word).

    A word's light edges are at most log2 of the number of words, so gathering them is bounded.
    """
    word, at, letter, size = F.col("word"), F.col("at"), F.col("letter"), F.char_length("word")
    before, rest, whole = F.substring(word, F.lit(1), at), F.substring(word, at + 2, size), F.substring(word, at + 1, size)
    inside = at < size
    copies = words.join(light.groupBy("word_id").agg(F.collect_list(F.struct("at", "heavy")).alias("light")), "word_id").select("word", "n", F.explode("light").alias("edge"))
    copies = written(copies.select("word", "n", "edge.at", F.decode(F.unhex(F.lpad(F.hex("edge.heavy"), 8, "0")), "UTF-32").alias("letter")), "copies")
    last_of_run = F.substring(word, at + 1, F.lit(1)) != F.substring(word, at + 2, F.lit(1))
    passed = F.array(F.when(inside & letter.isNotNull(), F.concat(before, letter, rest)), F.when(inside & last_of_run, F.concat(before, rest)), F.when(letter.isNotNull(), F.concat(before, letter, whole)))
    met = copies.select("word", "n", F.explode(F.array_compact(passed)).alias("near")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    first = lambda n, w: F.struct((-n).alias("less"), w.alias("word"))
    both = met.select(F.explode(F.array(F.struct("word", first(F.col("near_n"), F.col("near")).alias("best")), F.struct(F.col("near").alias("word"), first(F.col("n"), word).alias("best")))).alias("x"))
    pairs = both.select("x.word", F.lit(1).cast("long").alias("many"), "x.best")
    wild = copies.where(inside).groupBy(F.concat(before, F.lit("\x00"), rest).alias("hole")).agg(F.array_sort(F.collect_list(first(F.col("n"), word))).alias("all")).where(F.size("all") > 1)
    others = wild.select("all", F.posexplode("all").alias("pos", "own")).select("own.word", (F.size("all") - 1).cast("long").alias("many"), F.get("all", F.when(F.col("pos") == 0, 1).otherwise(0)).alias("best"))
    return pairs.unionByName(others)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of forms (word, form): the last form of each chain, by doubling the steps.

    Along a chain n grows at least fivefold, so it is short and has no circle."""
    up = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        up = written(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.drop("moved")
        up = up.drop("moved")


def group_spellings(words: DataFrame, factor: int = 5, most_hot: int = MOST_HOT) -> DataFrame:
    """words (word, n), each once -> word, form, root, n, n_near, form_n.

    Near words differ by one inserted, deleted or replaced code point. form is the near word of largest n (ties: smallest
    in code-point order) if its n is at least `factor` times the word's, with form_n; else both are null. root follows
    forms to the last and is the word itself without a form. Null words are left out; an empty table gives no rows;
    other columns are dropped; words of any length are handled in linear space.
    """
    numbered = written(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")).withColumn("word_id", F.monotonically_increasing_id()), "words")
    edges = written(trie_edges(numbered), "edges")
    near = merged(numbered, light_edges(edges, most_hot)).groupBy("word").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.less") >= factor * F.col("n")
    found = written(
        numbered.join(near, "word", "left").select("word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.less")).alias("form_n")),
        "spellings",
    )
    above = roots(found.where(F.col("form").isNotNull()))
    return found.join(above, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
