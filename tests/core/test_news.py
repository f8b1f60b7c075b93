from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from granary.functions.text import display_headline, normal_headline
from granary.operators import news as N
from granary.streaming.news import counts, deduplicated

T0 = datetime(2026, 9, 10, 12)


def naive_linkage(v, threshold):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    groups = [[k] for k in range(len(v))]
    while len(groups) > 1:
        best = min((np.mean([d[a, b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if best[0] >= 1 - threshold - 1e-12:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.floats(0.1, 0.9))
def test_average_linkage(seed, n, threshold):
    v = np.random.default_rng(seed).normal(size=(n, 4))
    labels = N.average_linkage(v, threshold)
    assert {frozenset(k for k in range(n) if labels[k] == x) for x in labels} == naive_linkage(v, threshold)


def naive_leaders(v, redirects, threshold):
    lead, kept = {}, []
    for i in range(len(v)):
        sims = [(float(v[i] @ v[j]), -kept.index(j), j) for j in kept if float(v[i] @ v[j]) > 0]
        best = max(sims, default=(-1, 0, None))
        if best[2] is None or best[0] < threshold:
            kept.append(i)
        elif redirects[best[2]] and not redirects[i]:
            for k in [k for k, x in lead.items() if x == best[2]]:
                lead[k] = i
            lead[best[2]] = i
            kept.remove(best[2])
            kept.append(i)
        else:
            lead[i] = best[2]
    return [lead.get(i, i) for i in range(len(v))]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 15), st.floats(0.2, 0.95))
def test_greedy_leaders(seed, n, threshold):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    redirects = (rnd.random(n) < 0.5).tolist()
    assert N.greedy_leaders(v, redirects, threshold) == naive_leaders(v, redirects, threshold)


def test_a_resolvable_copy_takes_over(spark):
    same = [1.0, 0.0]
    rows = [("NVDA", "a", T0, "https://news.google.com/1", same), ("NVDA", "b", T0 + timedelta(hours=1), "https://news.google.com/2", same), ("NVDA", "c", T0 + timedelta(hours=2), "https://wire.com/3", same), ("NVDA", "d", T0, "https://wire.com/4", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "ticker string, article_id string, published_at timestamp, url string, vector array<double>")
    marked = N.mark_copies(df.withColumn("event_id", F.lit(None).cast("string")), 0.9)
    assert {r.article_id: r.duplicate_of for r in marked.collect()} == {"a": "c", "b": "c", "c": None, "d": None}
    events = {r.article_id: r.event_id for r in N.cluster_events(marked, 0.75).collect()}
    assert events["a"] == events["b"] == events["c"] != events["d"] and events["c"].startswith("evt-NVDA-")


def test_two_sources_beat_many_posts(spark):
    rows = [("T", f"a{k:02}", "e1", "one", T0 + timedelta(hours=k), False, "t") for k in range(18)] + [("T", "b1", "e2", "x", T0, False, None), ("T", "b2", "e2", "y", T0, False, None), ("T", "c", "e3", "z", T0, True, None), ("T", "d", None, None, T0, False, None)]
    df = spark.createDataFrame(rows, "ticker string, article_id string, event_id string, source string, published_at timestamp, is_duplicate boolean, topic string")
    ranked = N.rank_events(N.rollup(df)).orderBy("rank").collect()
    assert [(r.event_id, r.score) for r in ranked] == [("e2", 2.5), ("e1", 1.75), ("unclustered-d", 0.25)]


def test_collect(spark):
    rows = [("NVDA", "ir", 0, 0, "u1", "Anything", None, T0), ("NVDA", "yahoo", 1, 0, "u1", "Nvidia again", "s", T0), ("NVDA", "yahoo", 1, 1, "u2", "Other company", "s", T0), ("NVDA", "yahoo", 1, 2, "", "Nvidia", "s", T0), ("NVDA", "google", 2, 0, "u3", "NVIDIA chip", "", T0 - timedelta(days=30)), ("NVDA", "google", 2, 1, "u4", "NVIDIA chip", "", T0)]
    df = spark.createDataFrame(rows, "ticker string, feed string, feed_order int, pos int, url string, headline string, source string, published_at timestamp")
    got = N.collect(df, T0 - timedelta(days=7)).orderBy("url").collect()
    assert [(r.url, r.feed, r.source, r.topic) for r in got] == [("u1", "ir", "ir", None), ("u4", "google", "google", "product")]


def test_headlines(spark):
    df = spark.createDataFrame([("Nvidia's $279 Billion Bet Changes Everything (NASDAQ:NVDA) - Seeking Alpha",), ("Nvidia",)], "h string")
    rows = df.select(normal_headline(F.col("h"), "NVDA").alias("n"), display_headline(F.col("h")).alias("d")).collect()
    assert "279 Billion Bet" in rows[0].n and "vidia" not in rows[0].n and "Seeking" not in rows[0].n and rows[1].n == "Nvidia"


def test_streams(spark, tmp_path):
    rows = [("x", "T", "s", T0), ("x", "T", "s", T0), ("y", "T", "r", T0 + timedelta(hours=3)), ("z", "T", "r", T0 + timedelta(hours=9))]
    spark.createDataFrame(rows, "article_id string, ticker string, source string, published_at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("article_id string, ticker string, source string, published_at timestamp_ntz").parquet(str(tmp_path / "in"))
    for name, df, n in (("unique_articles", deduplicated(stream()), 3), ("counted", counts(stream()), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_links_and_headlines_are_trimmed_before_use(spark):
    from datetime import datetime

    at = datetime(2024, 5, 1)
    rows = [("ACME", "ir", 0, 1, " http://x", " Acme opens\t", "", at), ("ACME", "ir", 0, 2, "http://x\n", "Acme opens", "", at), ("ACME", "ir", 0, 3, " \t", "Acme", "", at), ("ACME", "ir", 0, 4, "http://y", "\u00a0", "", at)]
    got = N.collect(spark.createDataFrame(rows, "ticker string, feed string, feed_order int, pos int, url string, headline string, source string, published_at timestamp"), datetime(2024, 1, 1)).collect()
    assert [(r.url, r.headline, r.pos) for r in got] == [("http://x", "Acme opens", 1)]
