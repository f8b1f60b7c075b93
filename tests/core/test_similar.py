import random

import numpy as np
import pytest

from granary.operators import news as N
from granary.operators.similar import connected, links, nearest_of

SCHEMA = "ticker string, article_id string, published_at long, url string, vector array<double>"


def rows_of(n, seed, copies=0.5, tickers=("A",), width=8):
    """Unit vectors around a few centres, exact and near copies among them, in an order of publication with ties."""
    rnd, gen = random.Random(seed), np.random.default_rng(seed)
    centres, out = gen.normal(size=(max(2, n // 12), width)), []
    for k in range(n):
        v = centres[rnd.randrange(len(centres))] + gen.normal(size=width) * rnd.choice([0.0, 0.05, 0.3, 0.6])
        if out and rnd.random() < copies:
            v = np.array(rnd.choice(out)[4])
        v = v / np.linalg.norm(v)
        out.append((rnd.choice(tickers), f"x{k:05d}", rnd.randrange(n), rnd.choice(["https://news.google.com/rss/1", "https://example.com/a", None]), [float(x) for x in v]))
    return out


def by_order(rows, ticker):
    return sorted((r for r in rows if r[0] == ticker), key=lambda r: (r[2], r[1]))


@pytest.mark.parametrize("seed,n,copies,block", [(1, 900, 0.3, 90), (2, 500, 0.9, 40), (3, 300, 0.0, 1500)])
def test_copies_over_many_tasks_equal_the_greedy_order(spark, seed, n, copies, block):
    rows = rows_of(n, seed, copies, ("A", "A", "A", "B"))
    got = {r.article_id: r.duplicate_of for r in N.mark_copies(spark.createDataFrame([*rows, ("A", "null", 5, None, None)], SCHEMA), 0.9, block=block).collect()}
    assert len(got) == n + 1 and got["null"] is None
    promoted = 0
    for ticker in "AB":
        mine = by_order(rows, ticker)
        redirects = [(r[3] or "").startswith("https://news.google.com") for r in mine]
        lead = N.greedy_leaders(np.array([r[4] for r in mine]), redirects, 0.9)
        assert {r[1]: got[r[1]] for r in mine} == {r[1]: mine[v][1] if v != k else None for k, (r, v) in enumerate(zip(mine, lead))}
        promoted += sum(v > k for k, v in enumerate(lead))
    assert promoted > 5


def test_links_grow_with_the_rows_not_with_the_pairs(spark):
    """600 near copies: fewer links than rows for every two blocks, and all of them connected."""
    gen = np.random.default_rng(1)
    v = np.array([1.0, 0, 0, 0]) + gen.normal(size=(600, 4)) * 0.01
    df = spark.createDataFrame([("g", k, [float(x) for x in row / np.linalg.norm(row)]) for k, row in enumerate(v)], "group string, id long, v array<double>")
    for block, blocks in ((1500, 1), (200, 3)):
        found = links(df, 0.9, block)
        assert found.count() <= 600 * blocks * 2
        assert {r.label for r in connected(found).collect()} == {0} and connected(found).count() == 600


def test_copies_of_vectors_that_are_not_like_themselves(spark):
    rows = [("A", f"x{k}", k, None, v) for k, v in enumerate([[0.0, 0.0], [0.0, 0.0], [0.1, 0.0], [0.1, 0.0], [3.0, 0.0], [0.5, 0.0]])]
    got = {r.article_id: r.duplicate_of for r in N.mark_copies(spark.createDataFrame(rows, SCHEMA), 0.9).collect()}
    lead = N.greedy_leaders(np.array([r[4] for r in rows]), [False] * 6, 0.9)
    assert got == {f"x{k}": f"x{v}" if v != k else None for k, v in enumerate(lead)}


@pytest.mark.parametrize("seed,n,copies,block,most", [(4, 400, 0.3, 60, 10_000), (5, 350, 0.2, 60, 1), (6, 200, 0.9, 25, 3)])
def test_events_over_many_tasks_equal_average_linkage(spark, seed, n, copies, block, most):
    """Components in one task each, and (most=1) merged in rounds."""
    rows = [(*r, False, None, None) for r in rows_of(n, seed, copies, ("A", "B"), width=5)] + [("A", "zero", 3, None, [0.0] * 5, False, None, None), ("A", "zero2", 3, None, [0.0] * 5, False, None, None), ("A", "dup", 4, None, [1.0] + [0.0] * 4, True, "x00000", None), ("A", "none", 4, None, None, False, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", is_duplicate boolean, duplicate_of string, event_id string")
    got = {r.article_id: r.event_id for r in N.cluster_events(df, 0.7, block=block, most=most).collect()}
    assert len(got) == len(rows) and got["none"] is None
    assert got["dup"] == (got["x00000"] if rows[0][0] == "A" else None)
    for ticker in "AB":
        mine = [r for r in by_order(rows, ticker) if not r[5] and r[4] is not None]
        labels = N.average_linkage(np.array([r[4] for r in mine]), 0.7)
        want, found = {}, {}
        for r, label in zip(mine, labels):
            want.setdefault(label, []).append(r[1])
            found.setdefault(got[r[1]], []).append(r[1])
        assert sorted(want.values()) == sorted(found.values())
        assert len(want) < len(mine)


def test_weights_stand_for_equal_vectors():
    rnd = np.random.default_rng(9)
    v = rnd.normal(size=(40, 4))
    many = rnd.integers(1, 5, 40)
    once = N.average_linkage(v, 0.6, many)
    each = N.average_linkage(np.repeat(v, many, axis=0), 0.6)
    first = np.cumsum(many) - many
    groups = lambda labels: sorted(tuple(k for k, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(once) == groups([each[k] for k in first])


def test_connected_against_a_walk(spark):
    rnd = random.Random(3)
    edges = {(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)} | {(k, k + 1) for k in range(500, 560)} | {(600, k) for k in range(601, 680)}
    edges = {(a, b) for a, b in edges if a != b}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    got = {r.node: r.label for r in connected(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_nearest_is_that_of_sums_in_element_order():
    """Rows that differ in the order of their products only: the sums differ by rounding, and SQL's order decides."""
    gen, other = np.random.default_rng(3), 0
    for _ in range(200):
        products = gen.normal(size=64)
        rows, v = np.array([gen.permutation(products) for _ in range(12)]), np.ones(64)
        sums = []
        for row in rows.tolist():
            total = 0.0
            for x in row:
                total += x
            sums.append(total)
        assert nearest_of(rows, v) == (sums.index(max(sums)), max(sums))
        other += int((rows @ v).argmax()) != sums.index(max(sums))
    assert other > 20
    assert nearest_of(np.zeros((0, 2)), np.ones(2)) == (-1, 0.0)
