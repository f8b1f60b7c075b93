import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from granary.llm.packing import costs, pack_block, pack_documents
from granary.llm.queries_tokens import tokenizer_file
from granary.llm.tokens import tokenizer

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(20))
def test_block_covers_every_token_once_without_padding(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 3, 60, 1023, 1024, 1025, rnd.randint(1, 5000)]) for _ in range(rnd.randint(0, 80))]
    rows, n = pack_block(lengths, 1024)
    by_doc, by_seq = {}, {}
    for doc, start, k, seq, offset in rows:
        assert k > 0
        by_doc.setdefault(doc, []).append((start, k))
        by_seq.setdefault(seq, []).append((offset, k))
    for doc, length in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc.get(doc, [])):
            assert start == at
            at += k
        assert at == length
    assert sorted(by_seq) == list(range(n))
    for parts in by_seq.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at & (at - 1) == 0 and at <= 1024


def test_lowest_cost_sequence_takes_the_next_document():
    rows, _ = pack_block([600, 500, 400, 300, 200, 48], 1024)
    assert {(d, s) for d, _, _, s, _ in rows[:4]} == {(0, 0), (1, 1), (2, 1), (3, 0)}


def naive(lengths, capacity):
    """The same rule told one piece at a time, without arrays."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if (total % capacity) >> k & 1]
    used, cost, rows = [0] * len(sizes), [0.0] * len(sizes), []
    pieces = [(capacity, d, k * capacity) for d, n in enumerate(lengths) for k in range(n // capacity)]
    pieces += sorted(((n % capacity, d, n - n % capacity) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    for n, d, start in pieces:
        while n:
            whole = [s for s in range(len(sizes)) if sizes[s] - used[s] >= n]
            some = whole or [s for s in range(len(sizes)) if sizes[s] > used[s]]
            s = min(some, key=lambda s: (cost[s], s))
            k = min(n, sizes[s] - used[s])
            rows.append((d, start, k, s, used[s]))
            used[s], cost[s], n, start = used[s] + k, cost[s] + costs(k), n - k, start + k
    return rows, len(sizes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=60), st.sampled_from([1, 8, 64]))
def test_block_against_a_naive_packer(lengths, capacity):
    assert pack_block(lengths, capacity) == naive(lengths, capacity)


def test_a_block_of_tiny_documents_is_quick():
    start = time.time()
    rows, n = pack_block([1] * (1 << 18) + [0] * 1000)
    assert n == 256 and len(rows) == 1 << 18 and len({(r[3], r[4]) for r in rows}) == 1 << 18
    assert time.time() - start < 5


def test_very_long_texts(spark):
    texts = ["x" + " " * 1_100_000 + "a", "\n" * 1_500_000, "a" * 300_000, "a b " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = pack_documents(df, PATH).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id: r["sum(length)"] for r in rows} == {r.doc_id: r["max(doc_tokens)"] for r in rows} == {k: len(x) // 4 + 1 for k, x in enumerate(tokenizer(PATH).whole(texts))}


def test_documents_round_trip(spark):
    texts = ["", None, "a b c", "x" * 9000, "hello <|endoftext|> world", "word " * 3000, "a b c"]
    df = spark.createDataFrame([(k if k != 2 else None, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, sequence_id int").coalesce(1)
    rows = pack_documents(df, PATH, with_ids=True, block_tokens=2000).collect()
    want = {k if k != 2 else None: [*tokenizer(PATH).library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    got = {k: [None] * len(v) for k, v in want.items()}
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id][r.start : r.start + r.length] = r.ids
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert got == want


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
