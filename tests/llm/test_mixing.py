import itertools
import random
import re

import pytest

from granary.llm.mixing import LANDING, land, mix_sources, movable, step
from granary.llm.queries_mix import op12_source_mixing


def naive_targets(sizes, weights=(1, 2, 3), share=1.0, most=3):
    """Sources' targets by sharing, cutting and sharing the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, excess, left = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while excess > 1e-9 and left:
        total = sum(weight[s] for s in left)
        given = {s: target[s] + excess * weight[s] / total for s in left}
        excess = sum(max(0, given[s] - most * sizes[s]) for s in left)
        target |= {s: min(given[s], most * sizes[s]) for s in left}
        left = {s for s in left if given[s] < most * sizes[s]}
    return target


def sizes_of(rows):
    out = {}
    for _, source, text in rows:
        out[source] = out.get(source, 0) + len(re.findall("[^ \t-\r]+", text or ""))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_steps_keep_both_totals_and_land_near(seed):
    rnd = random.Random(seed)
    units = [[rnd.random(), rnd.choice([0, 1, 5, 5, rnd.randint(1, 3000)])] for _ in range(300)]
    documents, words = sum(u[0] for u in units), sum(u[0] * u[1] for u in units)
    decided, open_ = [], []
    for u in sorted(units, key=lambda u: -u[1]):
        open_.append(u)
        while movable(open_) and len(open_) > LANDING:
            step(open_, rnd)
            decided += [x for x in open_ if x[0] in (0, 1)]
            open_ = [x for x in open_ if 0 < x[0] < 1]
    both = decided + open_
    assert len(both) == 300
    assert abs(sum(u[0] for u in both) - documents) < 1e-6 and abs(sum(u[0] * u[1] for u in both) - words) < 1e-3
    best = min(abs(sum((t - u[0]) * u[1] for t, u in zip(taken, open_))) for taken in itertools.product((0, 1), repeat=len(open_)) if abs(sum(taken) - sum(u[0] for u in open_)) < 1)
    land(open_)
    assert all(u[0] in (0, 1) for u in both)
    assert abs(abs(sum(u[0] * u[1] for u in both) - words) - best) < 1e-3 and abs(sum(u[0] for u in both) - documents) < 1


def test_chances_are_kept():
    """Over many seeds each unit is taken as often as its chance says."""
    counts = [0] * 6
    for seed in range(3000):
        units = [[0.3, 5], [0.3, 4], [0.3, 3], [0.3, 3], [0.3, 2], [0.3, 1]]
        open_, rnd = list(units), random.Random(seed)
        while movable(open_):
            step(open_, rnd)
            open_ = [u for u in open_ if 0 < u[0] < 1]
        for k, u in enumerate(units):
            counts[k] += u[0]
    assert all(abs(c / 3000 - 0.3) < 0.05 for c in counts)


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    sources = ["a", "b", "é", "B", None, "\U0001f600", "empty", "tiny"]
    out = [(k, rnd.choices(sources, weights=[30, 9, 9, 9, 9, 9, 0, 0])[0], " ".join("w" * rnd.randint(1, 400))) for k in range(n)]
    return out + [(None, "a", None), (None, "a", ""), (-1, "empty", None), (-2, "empty", " \n"), (-3, "tiny", "one two"), (5, "a", "same"), (5, "a", "same"), (-4, "a", "x " * 20_000)]


def test_mix_meets_naive_targets(spark):
    rows = rows_of(1500)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mix_sources(df, block_rows=64).collect()
    sizes = sizes_of(rows)
    targets = naive_targets(sizes)
    words = lambda t: len((t or "").split())
    by_row = {}
    for r in got:
        by_row.setdefault((r["doc_id"], r["size"]), []).append(r)
    assert len(got) == len(rows)
    taken, copies, many = {}, {}, {}
    for i, s, t in rows:
        r = by_row[i, words(t)].pop()
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s]) and r["taken"] == r["copies"] * r["size"]
        often = targets[s] / sizes[s] if sizes[s] else 0
        assert r["copies"] <= 3 and (s == "a" or int(often - 1e-6) <= r["copies"] <= int(often + 1 - 1e-9))
        taken[s], copies[s], many[s] = taken.get(s, 0) + r["taken"], copies.get(s, 0) + r["copies"], many.get(s, 0) + often
    for s in sizes:
        if s != "tiny":
            assert abs(taken[s] - targets[s]) <= max(0.001 * targets[s], 3), s
        if s != "a":  # its very long document is rounded, the others make up for it
            assert abs(copies[s] - many[s]) <= max(2, 0.01 * many[s]), s
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))


def test_partitions_do_not_matter_and_reruns_agree(spark):
    df = spark.createDataFrame(rows_of(700), "doc_id long, source string, text string")
    first = sorted(map(repr, mix_sources(df.repartition(1), block_rows=50).collect()))
    assert first == sorted(map(repr, mix_sources(df.repartition(7), block_rows=50).collect()))
    assert first == sorted(map(repr, mix_sources(df.repartition(3, "source"), block_rows=50).collect()))


def test_few_documents_are_landed_by_brute_force(spark):
    rnd = random.Random(1)
    rows = [(k, "ab"[k % 2], "w " * rnd.randint(1, 60)) for k in range(20)]
    got = {r["doc_id"]: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    targets, sizes = naive_targets(sizes_of(rows)), sizes_of(rows)
    for s in "ab":
        docs = [(k, t.count("w")) for k, x, t in rows if x == s]
        often = targets[s] / sizes[s]
        whole, part = int(often), often - int(often)
        best = min(abs(sum(n * (whole + b) for (_, n), b in zip(docs, bits)) - targets[s]) for bits in itertools.product((0, 1), repeat=len(docs)) if abs(sum(bits) - part * len(docs)) < 1)
        assert abs(sum(got[k]["taken"] for k, _ in docs) - targets[s]) <= best + 1  # large documents are landed before the others


def test_empty_caps_and_names(spark):
    schema = "doc_id long, source string, text string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert {r["taken"] for r in mix_sources(spark.createDataFrame([(1, None, None)], schema)).collect()} == {0}
    rows = [(k, "ab"[k > 2], "w w w") for k in range(9)]
    assert all(r["copies"] == 3 for r in mix_sources(spark.createDataFrame(rows, schema), share=9.0).collect())
    one = mix_sources(spark.createDataFrame([(k, "a", "w w") for k in range(5)], schema)).collect()
    assert all(r["copies"] == 1 and r["target"] == 10 for r in one)
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame([(1, "a", "w")], "size long, source string, text string"), "size")


def test_query_takes_all_documents(spark):
    got = op12_source_mixing(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.count() == docs.count()
    targets = naive_targets(sizes_of([tuple(r) for r in docs.select("doc_id", "source", "text").collect()]))
    assert sum(r["taken"] for r in got.collect()) == pytest.approx(sum(targets.values()), rel=0.02)
