import random
import time

import pytest
from pyspark.sql import functions as F

from granary.functions.terms import term_counts, term_hits
from granary.operators import retrieval as R

TEXTS = [(1, "aaaa AAA"), (2, "Ünder the UNDER"), (3, None), (4, ""), (5, "abcabcab 😀x"), (5, "nothing else"), (6, "100% of a_b, İstanbul")]


def plain(text, term):
    return None if text is None else text.lower().count(term.lower())


def test_against_counting_one_by_one(spark):
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choice("abAB ") for _ in range(rnd.randint(0, 60)))) for k in range(150)]
    terms = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 5))) for _ in range(80)})
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, h.at): h.n for r in texts.select("id", term_counts(spark, F.col("text"), terms).alias("h")).collect() for h in r.h}
    assert got == {(k, at): n for k, t in rows for at, term in enumerate(terms) if (n := plain(t, term))}


def test_odd_texts_and_terms(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string").withColumn("term", F.lit("mine"))
    terms = spark.createDataFrame([(t,) for t in ("aa", "AA", "ünder", "abcab", "😀", "a_b", None, "", "aa")], "term string").withColumn("id", F.lit(0))
    want = {(1, "aa", 3), (2, "ünder", 1), (5, "abcab", 1), (5, "😀", 1), (6, "a_b", 1)}
    assert {tuple(r) for r in term_hits(texts, terms).collect()} == want
    assert {tuple(r) for r in term_hits(texts, terms, block=1).collect()} == want  # each term in a block of its own
    assert term_hits(texts, terms.limit(0)).count() == 0 and term_hits(texts.limit(0), terms).count() == 0
    assert [r.h for r in texts.where("id = 3").select(term_counts(spark, F.col("text"), ["x"]).alias("h")).collect()] == [None]
    for bad in (["a", ""], ["x" * (17 << 20)]):
        with pytest.raises(ValueError):
            term_counts(spark, F.col("text"), bad)


def test_relevance_with_free_terms_and_without_terms(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "a%b only"), (4, None), (5, "ALPHA alpha gamma delta"), (6, "a very specific phrase here")], "id int, text string")
    ids = lambda **kw: sorted(r.id for r in R.relevant_chunks(df, **kw).collect())
    assert ids(any_terms=["alpha", "beta"]) == [1, 5]
    assert ids(any_terms=["alpha", "gamma"], without=["beta"]) == [2, 5]
    assert ids(any_terms=["alpha"], all_terms=["gamma", "ALPHA"], min_hits=1) == [2, 5]
    assert ids(any_terms=["al%a"], min_hits=0) == [1, 2, 5]
    assert ids(any_terms=["alpha"], all_terms=["gam_a"], min_hits=1, without=["d%a"]) == [2]
    assert ids(any_terms=["very specific phrase"]) == [6]
    assert ids(any_terms=[]) == [1, 2, 3, 4, 5, 6] and ids(any_terms=[], keep=F.col("id") > 5) == [6]
    assert ids(any_terms=[], without=["alpha"]) == [3, 6]


def test_time_does_not_grow_with_the_terms(spark):
    texts = spark.createDataFrame([(k, f"word{k} lorem ipsum dolor sit amet " * 40) for k in range(2000)], "id int, text string").cache()
    texts.count()

    def took(n):
        start = time.time()
        assert R.relevant_chunks(texts, [f"nowhere{k}" for k in range(n)] + ["lorem"]).count() == 2000
        return time.time() - start

    took(10)
    few = took(10)
    assert took(10_000) < 3 * few + 2
