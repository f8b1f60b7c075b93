"""Operators around the stores: indexes, caches, manifests, vectors, models' labels, briefs and reports."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from granary.functions.dates import epoch_seconds
from granary.functions.text import date_of
from granary.operators import answers as A, figures as G, headlines as H, news as N, retrieval as R, sinks as S
from granary.operators.routing import labelled_route, with_model
from granary.sources import landing, tables

CHUNKS = [("a", "red ships in the bay"), ("b", "blue ships and blue sails"), ("c", "a green hill"), ("d", None)]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, text string")


def asked(spark):
    return spark.createDataFrame([(1, "blue ships", [0.0, 1.0]), (2, "hill", None)], "query_id int, text string, vector array<double>")


def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 2.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0])], "id string, vector array<double>")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_a_standing_index(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        R.load_index(spark, path)
    for _ in range(2):  # a second build takes the place of the first
        R.write_index(chunks(spark), path)
    index = R.load_index(spark, path)
    assert sorted(rows(index.postings.where("id = 'b'"), "term", "tf", "dl")) == [("blue", 2, 4), ("sails", 1, 4), ("ships", 1, 4)]
    got = rows(R.bm25(chunks(spark), asked(spark), index=index).orderBy("query_id", "rank"), "query_id", "id")
    assert got == rows(R.bm25(chunks(spark), asked(spark)).orderBy("query_id", "rank"), "query_id", "id") and got[0] == (1, "b") and (2, "c") in got
    assert R.postings(chunks(spark).limit(0)).collect() == [] == R.bm25(chunks(spark).limit(0), asked(spark)).collect()


def test_cosine_in_blocks(spark):
    for block_bytes in (1, 1 << 20):
        more = asked(spark).unionByName(spark.createDataFrame([(3, "x", [2.0, 0.0]), (4, "y", [1.0, 2.0, 3.0])], asked(spark).schema))
        got = rows(R.dense(vectors(spark), more, block_bytes=block_bytes).orderBy("query_id", "rank"), "query_id", "id", "score")
        assert got == [(1, "c", 1.0), (1, "b", 0.8), (1, "a", 0.0), (1, "e", None), (3, "a", 1.0), (3, "b", 0.6), (3, "c", 0.0), (3, "e", None)]
    assert rows(R.dense(vectors(spark), asked(spark), top=1), "id") == [("c",)] and R.dense(vectors(spark).limit(0), asked(spark)).collect() == []


def test_modes_side_by_side_survive_a_failing_one(spark):
    def broken(query, text):
        raise RuntimeError("no model here")

    found, said = R.compare_modes(R.Searcher(chunks(spark), vectors(spark), scorer=broken), asked(spark), top=1)
    assert [(x["mode"], bool(x["error"])) for x in said] == [("dense", False), ("bm25", False), ("hybrid", False), ("rerank", True)]
    assert "no model here" in said[3]["error"] and all(x["latency_ms"] >= 0 for x in said)
    assert {r.mode for r in found.collect()} == {"dense", "bm25", "hybrid"}
    encode = lambda text: F.when(F.startswith(text, F.lit("query: ")), F.array(F.lit(1.0), F.lit(0.0)))
    assert rows(R.Searcher(chunks(spark), vectors(spark), encode=encode, prefix="query: ").search("dense", asked(spark), 1), "query_id", "id") == [(1, "a"), (2, "a")]


def test_manifest_and_vectors(spark):
    cols = ", ".join(f"{c} string" for c in S.MANIFEST)
    old = spark.createDataFrame([("1", *"abcdefg"[:7], "t")], f"{cols}, ingested_at string")
    new = spark.createDataFrame([("1", *"zzzzzzz"), ("2", *"mmmmmmm"), ("2", *"kkkkkkk"), (None, *"nnnnnnn")], cols)
    got = S.insert_manifest(old, new)
    assert got.columns == old.columns and sorted(rows(got, "doc_id", "ticker", "ingested_at")) == [("1", "a", "t"), ("2", "k", None)]
    held = spark.createDataFrame([("a", "T", [1.0]), ("b", "T", [2.0])], "chunk_id string, ticker string, vector array<double>")
    fresh = spark.createDataFrame([("b", "U"), ("c", "U")], "chunk_id string, ticker string")
    points = spark.createDataFrame([("b", [5.0]), ("c", [6.0])], "chunk_id string, vector array<double>")
    assert sorted(rows(S.upsert_vectors(held, fresh, points), "chunk_id", "ticker", "vector")) == [("a", "T", [1.0]), ("b", "U", [5.0]), ("c", "U", [6.0])]
    for wrong in (points.limit(1), points.withColumn("chunk_id", F.lit("x"))):
        with pytest.raises(ValueError):
            S.upsert_vectors(held, fresh, wrong)


def test_upsert_keeps_names_and_keyless_rows(spark):
    old = spark.createDataFrame([("a", 1, 7)], "k string, nth int, __nth int")
    new = spark.createDataFrame([("a", 2, 0), ("a", 3, 1), (None, 4, 0), (None, 5, 1)], "k string, nth int, __nth int")
    assert sorted(rows(S.upsert(old, new, ["k"]), "k", "nth", "__nth"), key=str) == [("a", 3, 1), (None, 4, 0), (None, 5, 1)]


def test_a_models_label(spark):
    said = [(1, "FILING_RAG, though it borders on NEWS"), (2, "  mixed or numeric"), (3, "none"), (4, None), (5, "NEWS")]
    df = spark.createDataFrame(said, "k int, response string")
    assert rows(df.orderBy("k"), labelled_route(F.col("response"))) == [("FILING_RAG",), ("MIXED",), (None,), (None,), ("NEWS",)]
    routed = spark.createDataFrame([(k, "FILING_RAG", "no_rule_default") for k in range(1, 5)] + [(5, "NUMERIC", "rule"), (6, "FILING_RAG", "no_rule_default")], "k int, route string, method string")
    got = {r.k: (r.route, r.method) for r in with_model(routed, df, "k").collect()}
    assert got == {1: ("FILING_RAG", "llm"), 2: ("MIXED", "llm"), 3: ("FILING_RAG", "llm_invalid"), 4: ("FILING_RAG", "llm_unavailable"), 5: ("NUMERIC", "rule"), 6: ("FILING_RAG", "llm_unavailable")}


def test_facts_are_cached_until_refreshed(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "facts")
    assert [tables.cached_facts(spark, path, fetch, refresh).count() for refresh in (False, False, True, False)] == [1, 1, 2, 2] and len(calls) == 2
    assert dict(rows(tables.table_counts({"x": spark.range(3), "y": None}), "table", "n")) == {"x": 3, "y": None}


def test_landed_tables_can_be_removed(spark):
    landing.purge(spark)
    found = landing.landed(spark.range(3))
    assert found.count() == 3 and landing.purge(spark) == 1 and landing.purge(spark) == 0


def test_dates(spark):
    df = spark.createDataFrame([("2031-05-06T10:00:00Z",), ("2031-05-06",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(date_of(F.col("t"))).collect()] == [date(2031, 5, 6), date(2031, 5, 6), None, None]
    assert df.select(epoch_seconds(F.lit("1970-01-03").cast("date"))).first()[0] == 2 * 86400


FIGS = "ticker string, metric string, fiscal_year int, fiscal_qtr int, value double, unit string"


def test_growth_lines_and_evidence(spark):
    df = spark.createDataFrame([("T", "revenue", 2030, 4, 2e9, "usd"), ("T", "revenue", 2031, 1, 3e9, "usd"), ("T", "gross_margin", 2031, 1, 41.25, "pct")], FIGS)
    item = G.evidence_item(df, "qoq_growth", {"ticker": "T", "metric": "revenue"}).first()
    assert (item.key, item.label) == ("financials:T:revenue", "T · financials · qoq_growth(revenue)")
    assert item.text == "FY2031Q1: $3.00B (QoQ +50.0% vs FY2030Q4)\nFY2030Q4: $2.00B (QoQ n/a — no prior period)"
    assert G.evidence_item(df, "nope", {}) is None and G.evidence_item(df, "latest_metric", {"sql": 1}) is None
    assert G.evidence_item(df, "latest_metric", {"ticker": "U", "metric": "revenue"}).collect() == []
    assert {r.id: r.text for r in G.truth(df).collect()} == dict.fromkeys(G.TRUTH_PLANS, "")


def test_a_company_without_annual_facts_is_an_error(spark):
    fact = "ticker string, tag string, unit string, start date, end date, val double, accn string, form string, filed date"
    rows_ = [("T", "Revenues", "USD", date(2031, 1, 1), date(2031, 3, 31), 1.0, "a", "10-Q", date(2031, 5, 1))]
    with pytest.raises(Exception, match="no fiscal year end, for T"):
        G.build_figures(spark.createDataFrame(rows_, fact)).collect()


def test_evidence_is_numbered_by_store(spark):
    one = lambda kind, n: spark.createDataFrame([(1, f"{kind}{k}", "l", "t", k) for k in range(n, 0, -1)], "query_id int, key string, label string, text string, rank int")
    got = A.gathered(one("f", 1), None, one("d", 2)).orderBy("n")
    assert rows(got, "n", "key", "kind") == [(1, "f1", "financial"), (2, "d1", "filing"), (3, "d2", "filing")]


def test_the_chain_over_the_other_arm(spark):
    item = [{"kind": "filing", "label": "l", "text": "Harvests fell across northern fields in 2029."}]
    off = [(1, "Harvests fell across northern fields.", item), (2, "Harvests fell 88.5% in places [1].", item), (3, "Harvests fell 88.5% in places [1].", []), (4, "Insufficient evidence: nothing at all.", item)]
    got = H.paired_control(spark.createDataFrame(off, f"id int, text string, evidence {A.EVIDENCE}")).orderBy("id")
    assert rows(got, "would_withhold") == [("citation_coverage",), ("numeric_consistency",), (None,), (None,)] and got.columns == ["id", "text", "evidence", "would_withhold"]
    assert rows(H.remaining(spark.createDataFrame([(1,), (2,)], "id int"), got.limit(1)), "id") == [(2,)]


def test_windows_are_groups_of_their_own(spark):
    t = datetime(2031, 5, 6)
    df = spark.createDataFrame([("T", w, f"{w}{k}", t, "https://x", [1.0, 0.0] if k < 2 else None) for w in "ab" for k in range(3)], "ticker string, window string, article_id string, published_at timestamp, url string, vector array<double>")
    by = ("ticker", "window")
    marked = N.mark_copies(df, 0.9, by).withColumn("event_id", F.lit(None).cast("string"))
    assert sorted(rows(marked, "article_id", "duplicate_of"), key=str) == [("a0", None), ("a1", "a0"), ("a2", None), ("b0", None), ("b1", "b0"), ("b2", None)]
    events = {r.article_id: r.event_id for r in N.cluster_events(marked, 0.7, by).collect()}
    assert events["a0"] == events["a1"] != events["b0"] and events["a2"] is None


def test_brief_and_report(spark):
    t = datetime(2031, 5, 6, 9)
    events = spark.createDataFrame([(1, "e1", 2, 1, ["x", "y"], "deal", date(2031, 5, 6), date(2031, 5, 7), "Two firms merge.")], "rank int, event_id string, n_live long, n_duplicates long, sources array<string>, topic string, first_day date, last_day date, summary string")
    arts = spark.createDataFrame([("a", "e1", "Firms merge - Wire", "x", "https://u/1", t, False), ("b", "e1", "More", None, None, t, False), ("c", "e1", "Copy", "z", "u", t, True), ("d", "e2", "Else", "z", "u", t, False)], "article_id string, event_id string, headline string, source string, url string, published_at timestamp, is_duplicate boolean")
    text = N.brief("T", "Firm T", events, arts, 7, t)
    assert "# T — Firm T" in text and "## 1. Firms merge\n*2031-05-06–2031-05-07 · 2 article(s) · 2 source(s)* · _deal_\n\nTwo firms merge.\n\n**Sources**\n- [Firms merge](https://u/1) — x, 2031-05-06\n- [More]() — unknown, 2031-05-06\n- _(1 near-duplicate repost(s) suppressed)_" in text
    assert "Copy" not in text and "Else" not in text and "_No qualifying news" in N.brief("T", "Firm T", events.limit(0), arts, 7, t)
    scores = spark.createDataFrame([("bm25", None, 2, 0.5, 0.25, 1.0, 1.0, 0.5, 12.0), ("bm25", "odd", 1, 0.5, 0.25, 0.5, 1.0, 0.5, 12.0)], "mode string, category string, n long, recall double, precision double, mrr double, hit double, freshness double, latency_ms double")
    report = S.results_markdown(scores, "r1", R.MODES)
    assert "| `bm25` | 0.500 | 0.250 | 1.000 | 1.000 | 0.500 | 12 |" in report and "| odd | 0.500 |" in report and "`dense`" not in report


def test_modes_are_timed_as_they_run(spark):
    s = R.Searcher(chunks(spark), vectors(spark), R.build_index(chunks(spark)))
    judged = spark.createDataFrame([(1, "b", True), (2, "c", False)], "query_id int, id string, current boolean")
    got = {r["mode"]: r for r in R.evaluate_modes(s, asked(spark), judged).collect()}
    assert set(got) == set(R.MODES) and all(r.latency_ms > 0 and r.n == 2 for r in got.values())
    assert got["bm25"].recall == 1.0 and got["dense"].recall == 0.5
    with pytest.raises(RuntimeError):
        R.evaluate_modes(s, asked(spark).drop("vector"), judged, modes=("bm25", "dense"))
