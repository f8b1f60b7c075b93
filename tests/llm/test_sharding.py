import random
import zlib
from collections import defaultdict

import numpy as np

from granary.llm.sharding import locate, shard_documents


def test_locate():
    rnd = random.Random(2)
    key = lambda: tuple(rnd.randint(0, 3) for _ in range(3))
    for _ in range(50):
        splitters, keys = sorted(key() for _ in range(rnd.randint(1, 9))), [key() for _ in range(30)]
        got = locate([np.array([k[i] for k in keys]) for i in range(3)], splitters)
        assert got.tolist() == [sum(s <= k for s in splitters) for k in keys]


def check(spark, rows, shards=16, even=None):
    df = spark.createDataFrame([(*r, 3, "z") for r in rows], "doc_id long, text string, size int, h1 string").repartition(4)
    got = shard_documents(df, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((k, size(t), zlib.crc32((t or "").encode())) for k, t in rows), key=str)
    slots, total = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / shards
    most = max((size(t) for _, t in rows), default=0)
    assert all(abs(total[k] - mean) <= 2 * (most + 0.006 * mean) for k in range(shards)) or not rows
    return got


def test_near_equal_bytes(spark):
    rnd = random.Random(1)
    check(spark, [(k, "".join(rnd.choices("aé b", k=rnd.randint(0, 200)))) for k in range(3000)])


def test_hot_copies_and_repeated_rows_are_split(spark):
    rows = [(k, "same text") for k in range(1500)] + [(7, "one row again and again")] * 1500 + [(None, None)] * 300 + [(k, f"t{k}") for k in range(1000)]
    check(spark, rows)


def test_small_groups_stay_together(spark):
    rows = [(k, f"text {k % 800}") for k in range(4000)]
    by_text = defaultdict(set)
    texts = dict(rows)
    for r in check(spark, rows, shards=4):
        by_text[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 3


def test_few_and_no_rows(spark):
    check(spark, [(1, "x" * 5000), (2, "y"), (3, None)])
    assert check(spark, []) == []
