import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
import numpy as np

from granary.llm.decontamination import ShardMatches, TestSuffixes as Suffixes, contamination, decontaminate, longest_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = []
    for name, text in items:
        w = words(text)
        if name is not None and w:
            n = min(window, len(w))
            wins += [(str(name), w[k : k + n]) for k in range(len(w) - n + 1)]
    out = []
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for name, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted(seed):
    rnd = random.Random(seed)
    vocab = ["the", "of", "a", "Été", "x1", "日本", "q", "zz"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.choice([0, 1, 5, 9, 10, 11, 25]))) for k in range(12)] + [(3, text(14)), (None, text(12)), (77, None)]
    items = [(k, t) for k, t in items if t is None or len(t.split()) != 1 or rnd.random() < 0.2]
    docs = [(None, text(30)), (1, None), (1, ""), (2, "ÉTÉ")]
    for k in range(40):
        parts = [text(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice([t for _, t in items if t] or [""]).upper().replace("ÉTÉ", "Été").replace(" ", rnd.choice([" ", ",\n", "--"])), text(rnd.randint(0, 4))]
        docs.append((k, " ".join(parts)))
    return docs, items


def test_against_brute_force(spark):
    for seed in range(4):
        docs, items = planted(seed)
        d = spark.createDataFrame([(*x, 1, b"x") for x in docs], "doc_id long, text string, n_hit int, __hit binary").repartition(3)
        b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
        for options in ({}, {"block_bytes": 150}):
            rows = contamination(d, b, **options).drop("longest_match", "longest_at").collect()
            assert sorted(map(tuple, rows), key=str) == brute(docs, items), (seed, options)


def test_longest_match_and_place(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = [(1, "x y " + " ".join(f"w{k}" for k in range(5, 22)) + " z " + " ".join(f"w{k}" for k in range(12)))]
    row = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.longest_match, row.longest_at, row.n_hit) == (17, 2, 29)


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


LETTERS = st.lists(st.sampled_from("abcdz"), max_size=25).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS.map(lambda t: t.replace("z", "a")), max_size=4), st.lists(LETTERS, max_size=4), st.sampled_from([1, 2, 3, 5, 10]))
def test_shards_against_brute_force(items, docs, window):
    test = Suffixes([(str(k), t.encode()) for k, t in enumerate(items)], window)
    words_ = [d.encode().split() for d in docs]
    shard, hit, names = ShardMatches(test, words_), [np.zeros(len(d), bool) for d in words_], [set() for _ in docs]
    longest = shard.mark(hit, names)
    for d, got_hit, got_names, got in zip(docs, hit, names, longest, strict=True):
        x, want_hit, want_names, best = d.split(), set(), set(), (0, -1)
        for k, t in enumerate(items):
            w = t.split()
            n = min(window, len(w))
            for o in range(max(1, len(w) - window + 1) if w else 0):
                for p in range(len(x) - n + 1):
                    if x[p : p + n] == w[o : o + n]:
                        want_hit |= set(range(p, p + n))
                        want_names.add(str(k))
                        best = max(best, (common(x[p:], w[o:]), p), key=lambda y: (y[0], -y[1]))
        assert (set(np.flatnonzero(got_hit)), got_names, got) == (want_hit, want_names, best)
    suffixes = [t.split()[o:] for t in items for o in range(len(t.split()))]
    sizes, _ = shard.of_suffixes() if suffixes else ([], [])
    assert list(sizes) == [max([0, *(common(d.split()[p:], s) for d in docs for p in range(len(d.split())))]) for s in suffixes]


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_longest_match_of_each_test_suffix(spark, block_bytes):
    docs, items = planted(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = {str(k): words(t) for k, t in docs if k is not None}
    got = {(r.item, r.at): r for r in longest_matches(d, b, block_bytes=block_bytes).collect()}
    want = {}
    for k, t in items:
        w = words(t) if k is not None else []
        for o in range(len(w)):
            found = [(-common(x[p:], w[o:]), name, p) for name, x in texts.items() for p in range(len(x)) if common(x[p:], w[o:])]
            found += [(-common(words(x)[p:], w[o:]), str(key), p) for key, x in docs if key is not None for p in range(len(words(x))) if common(words(x)[p:], w[o:])]
            if found:
                want[str(k), o] = min([*found, *([want[str(k), o]] if (str(k), o) in want else [])])
    assert {key: -r.words for key, r in got.items()} == {key: x[0] for key, x in want.items()}
    of = {}
    for key, x in docs:
        of.setdefault(str(key), []).append(words(x))
    by_id = {}
    for k, t in items:
        by_id.setdefault(str(k), []).append(words(t))
    for (item, at), r in got.items():
        assert any(x[r.place : r.place + r.words] == w[at : at + r.words] and r.words == len(x[r.place : r.place + r.words]) for x in of[r.doc] for w in by_id[item])


def test_a_long_item_and_a_long_document(spark):
    rnd = random.Random(4)
    item = [f"w{rnd.randrange(500)}" for _ in range(20_000)]
    doc = ["x", *item[3_000:19_000], "y", *item[:40]]
    d = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(reversed(item)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in contamination(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert (rows[1].longest_match, rows[1].longest_at, rows[1].n_hit) == (16_000, 1, 16_040) and not rows[2].contaminated


def test_columns_of_any_name_stay(spark):
    names = ["text", "n", "hit", "c0", "a.b", "items", "doc_id", "row"]
    long = " ".join(f"w{k}" for k in range(12))
    d = spark.createDataFrame([("clean text", 1, 2, 3, 4, 5, 6, 7), (long, 1, 2, 3, 4, 5, 6, 7), (None, 0, 0, 0, 0, 0, 0, 0)], names)
    b = spark.createDataFrame([(k, long) for k in range(9)], "item_id long, text string")
    for options in ({}, {"block_bytes": 100}):
        kept = decontaminate(d, b, **options)
        assert kept.columns == names and sorted((tuple(r) for r in kept.collect()), key=str) == [("clean text", 1, 2, 3, 4, 5, 6, 7), (None, 0, 0, 0, 0, 0, 0, 0)]


def test_only_contaminated_rows_go_and_columns_stay(spark):
    docs, items = planted(9)
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, item_id int")
    kept = decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    clean = [x for x, y in zip(docs, [brute([x], items)[0] for x in docs], strict=True) if not y[-1]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, items).collect() == []
    row = contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated, row.longest_match) == (2, 0, 0, False, 0)


def naive_longest(item, docs, window):
    """(words, place) of each item suffix's longest match over all documents laid one after another, the first of equals."""
    sequence = []
    for d in docs:
        sequence += [*d, None]
    out = []
    for k in range(len(item)):
        best = (0, -1)
        for p in range(len(sequence)):
            n = 0
            while k + n < len(item) and p + n < len(sequence) and sequence[p + n] == item[k + n]:
                n += 1
            if n > best[0]:
                best = (n, p)
        out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=3), st.lists(st.text("abc", max_size=60), min_size=1, max_size=4), st.sampled_from([1, 3, 10]))
def test_repeats_against_brute_force(items, docs, window):
    """Words of one letter, so that items and documents repeat themselves."""
    as_text = lambda x: " ".join(x).encode()
    test = Suffixes([(str(k), as_text(x)) for k, x in enumerate(items)], window)
    words_ = [[w.encode() for w in d] for d in docs]
    shard = ShardMatches(test, words_)
    hit, names = [np.zeros(len(d), dtype=bool) for d in docs], [set() for _ in docs]
    longest = shard.mark(hit, names)
    for k, d in enumerate(docs):
        want, found, best = set(), set(), (0, -1)
        for name, item in enumerate(items):
            n = min(window, len(item))
            for i in range(len(item) - n + 1 if n else 0):
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == item[i : i + n]:
                        want |= set(range(p, p + n))
                        found.add(str(name))
                        size = n
                        while n == window and p + size < len(d) and i + size < len(item) and d[p + size] == item[i + size]:
                            size += 1
                        best = max(best, (size, p), key=lambda x: (x[0], -x[1]))
        assert set(np.flatnonzero(hit[k]).tolist()) == want and names[k] == found
        assert longest[k] == best
    if len(test.rows):
        sizes, places = shard.of_suffixes()
        laid = [w for d in words_ for w in [*d, None]]
        at = 0
        for item in items:
            for k, (n, p) in enumerate(naive_longest([w.encode() for w in item], words_, window)):
                assert sizes[at + k] == n
                if n >= window:
                    assert places[at + k] == p
                elif n:
                    assert laid[places[at + k] : places[at + k] + n] == [w.encode() for w in item[k : k + n]]
            at += len(item)


def test_long_items_and_documents_of_one_word():
    """5,000 equal words against 20,000 of them: linear, in time and memory."""
    import time
    import tracemalloc

    start = time.process_time()
    tracemalloc.start()
    test = Suffixes([("song", b"a " * 5000), ("other", b"b a " * 2000)])
    shard = ShardMatches(test, [[b"a"] * 20_000, [b"b", b"a"] * 9_000, [b"c"] * 50])
    hit, names = [np.zeros(n, dtype=bool) for n in (20_000, 18_000, 50)], [set(), set(), set()]
    longest = shard.mark(hit, names)
    sizes, places = shard.of_suffixes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - start < 5 and peak < 500e6
    assert longest == [(5000, 0), (4000, 0), (0, -1)] and names == [{"song"}, {"other"}, set()] and hit[0].all() and hit[1].all() and not hit[2].any()
    assert sizes[:5000].tolist() == list(range(5000, 0, -1)) and set(places[:4990].tolist()) == {0}
