import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm.queries_words import op13_spelling_variants
from granary.llm.spelling import corpus_words, group_spellings, light_edges, trie_edges

UPPER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def naive_words(rows, every=199, least_chars=6, least_count=5):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_chars and n >= least_count}


def naive_groups(words, factor=5):
    """Near words by every place of one changed letter, told plainly."""
    near = {w: set() for w in words}
    holes, shorter = {}, {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            shorter.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for x in shorter.get(w, ()):
            near[w].add(x)
            near[x].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def checked(spark, words, **options):
    got = group_spellings(spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, form int"), **options).collect()
    assert len(got) == len(words)
    assert {tuple(r) for r in got} == naive_groups(words)


@pytest.mark.parametrize("seed,alphabet,most_hot", [(0, "ab", 20_000), (1, "abc", 3), (2, "aabéÿжЯ\U0001f600", 50), (3, "abcdefghij", 10**9)])
def test_random_words_against_brute_force(spark, seed, alphabet, most_hot):
    rnd = random.Random(seed)
    words = {"".join(rnd.choices(alphabet, k=rnd.randint(1, 9))): rnd.choice([5, 5, 6, 30, 200, 1000]) for _ in range(700)}
    checked(spark, words, most_hot=most_hot)


def test_runs_ties_chains_and_long_words(spark):
    long = "ab" * 30_000
    words = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "aaaaaaab": 624, "baaaaaaa": 625, "cabbage": 5, "cabbaga": 25, "cabbagb": 25, "abbage": 25, "x": 5, "xy": 9, "": 7, long: 5, long + "a": 40, long[:-1]: 41, "é" * 6: 5, "é" * 5 + "è": 99}
    checked(spark, words)
    rows = {r["word"]: r for r in group_spellings(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert rows["aaaaaa"]["root"] in ("aaaaaaaaa", "baaaaaaa", "aaaaaaaa") and rows[long]["form"] == long[:-1]


def test_words_are_copied_at_light_edges_only(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abcdef", k=8)) for _ in range(3000)}
    df = spark.createDataFrame([(k, w) for k, w in enumerate(sorted(words))], "word_id long, word string")
    most = light_edges(trie_edges(df)).groupBy("word_id").count().agg({"count": "max"}).first()[0]
    assert most <= 13  # log2 of 3,000, and the end


def test_words_of_texts(spark):
    rnd = random.Random(2)
    pool = ["banana", "BANANA", "Éclairé", "éclairé", "short", "straße×x", "dotted", "İstanbul", "cafés1teria", "separate", "seperate"]
    rows = [(k, rnd.choice([" ", "-", "1", "\n"]).join(rnd.choices(pool, k=30))) for k in range(300)]
    rows += [(None, "banana " * 9), (4, None), (4, ""), (4, "banana"), (4, "banana"), (7, "q" * 100_000)] + [(9, "z" * 100_000)] * 5
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    for every in (199, 3):
        words = naive_words(rows, every)
        assert {tuple(r) for r in corpus_words(df, every=every).collect()} == set(words.items())
        assert {tuple(r) for r in group_spellings(corpus_words(df, every=every)).collect()} == naive_groups(words)


def test_empty(spark):
    assert group_spellings(corpus_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert group_spellings(spark.createDataFrame([(None, 5)], "word string, n long")).count() == 0


def test_query_against_brute_force_on_whole_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = op13_spelling_variants(spark, "/root/testdata/sf0.01").collect()
    assert {tuple(r) for r in got} == naive_groups(naive_words(rows)) and sum(r["form"] is not None for r in got) > 50
