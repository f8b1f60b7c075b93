import random

import numpy as np
import pytest

from granary.llm import ngram_jaccard as nj
from granary.llm.components import components
from granary.llm.decontamination import words_of


def grams(text, n=5):
    w = words_of(text.encode() if text is not None else None)
    if not w:
        rest = (text or "").strip()
        return {rest} if rest else set()
    return {tuple(w[k : k + min(n, len(w))]) for k in range(max(1, len(w) - n + 1))}


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((key, (min(ids) if ids else None) if sets[i] else key, len(near[i])))
    return sorted(out, key=str)


def corpus(seed, groups=25, large=0):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = []
    for g in range(groups):
        base = text(rnd.choice([3, 6, 40, 120, 400]))
        for _ in range(rnd.choice([1, 1, 2, 5]) if g else max(large, 1)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
    rows += ["", "", None, "  ", "!!! ???", "!!! ???", "%%", "one", "ONE", "a b c d", "a, b c d"]
    rnd.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def test_bands_reach_the_recall():
    bands, rows = nj.choose_bands(0.8, 0.9995, 384)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 384


def test_band_hashes_agree_as_often_as_the_jaccard_similarity_says():
    rnd = np.random.default_rng(0)
    common = rnd.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rnd.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in range(40)]
    h = nj.MinHash(300, 1).band_hashes(sets)
    share = np.mean([(h[i] == h[j]).mean() for i in range(40) for j in range(i)])
    assert abs(share - 0.9) < 0.02


@pytest.mark.parametrize("tile,large", [(384, 0), (6, 40)])
def test_against_brute_force(spark, monkeypatch, tile, large):
    monkeypatch.setattr(nj, "TILE", tile)
    rows = corpus(large, large=large)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, set string, n int").repartition(3)
    assert sorted(map(tuple, nj.ngram_jaccard(df).collect()), key=str) == brute(rows)
    kept = nj.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = {c if grams(dict(rows)[k]) else k for k, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (1, "other words stand here now"), (None, text), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.ngram_jaccard(df).collect()), key=str) == brute(rows)
    assert sorted((tuple(r) for r in nj.keep_one_of_each(df).collect()), key=str) == sorted([(None, text), (1, "other words stand here now"), (None, None), (None, None)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_jaccard(df).collect() == [] and nj.keep_one_of_each(df).collect() == []


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for a, b in edges:
        if a is not None and a != b:
            group[find(a)] = find(b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(group)
    pairs = lambda label: {frozenset(n for n in got if label(n) == v) for v in {label(n) for n in got}}
    assert pairs(got.get) == pairs(find)


def test_columns_of_any_name_stay(spark):
    from granary.llm.ngram_jaccard import keep_one_of_each

    names = ["doc_id", "text", "thash", "nth", "id", "kept", "a.b", "c0"]
    same = "one two three four five six seven"
    rows = [(2, same, "x", 1, 2, 3, 4, 5), (1, same, "y", 1, 2, 3, 4, 5), (3, None, "z", 1, 2, 3, 4, 5), (3, None, "z", 1, 2, 3, 4, 5)]
    kept = keep_one_of_each(spark.createDataFrame(rows, names))
    assert kept.columns == names and sorted((tuple(r) for r in kept.collect()), key=str) == [rows[1], rows[2], rows[3]]
