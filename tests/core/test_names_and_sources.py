"""Columns of the caller's own, whatever they are called, and landed sources."""

import json
from datetime import date

from pyspark.sql import functions as F

from granary.operators import answers as A, figures as G, filings as P, retrieval as R
from granary.operators.routing import route, with_model
from granary.sources import tables


def test_route_keeps_the_callers_columns(spark):
    own = ("news", "rule", "numeric", "filing", "narrative", "reconcile", "compare", "signals", "Said", "named", "model_response")
    asked = spark.createDataFrame([(1, "What was revenue of NVIDIA?", *own), (2, "hello there", *own)], ", ".join(["id int, query string"] + [f"{c} string" for c in own]))
    routed = route(asked, F.lit(date(2026, 1, 1)))
    assert routed.columns[: len(asked.columns)] == asked.columns
    answered = with_model(routed, spark.createDataFrame([(2, "NEWS, I think")], "id int, response string"), "id")
    got = {r.id: r for r in answered.collect()}
    assert answered.columns == routed.columns and all(got[k][c] == c for k in (1, 2) for c in own)
    assert [(got[k].route, got[k].method) for k in (1, 2)] == [("NUMERIC", "rule"), ("NEWS", "llm")]


def test_ranks_leave_a_column_named_nth_alone(spark):
    filings = spark.createDataFrame([("A", "10-K", k, f"own{k}") for k in range(4)], "ticker string, form string, day int, nth string")
    got = P.choose_filings(filings, {"10-K": 2}, order=(F.desc("day"),)).orderBy("_nth").collect()
    assert [(r.nth, r["_nth"]) for r in got] == [("own3", 1), ("own2", 2)]
    series = spark.createDataFrame([("A", "revenue", 2024, q, 1.0 * q) for q in range(5)], "ticker string, metric string, fiscal_year int, fiscal_qtr int, value double")
    compared = G.compare_tickers(series, ["A"], n_quarters=2)
    assert compared.columns == series.columns and sorted(r.fiscal_qtr for r in compared.collect()) == [3, 4]
    given = spark.createDataFrame([("A", date(2025, 1, d), "Q1", "doc", "own") for d in (1, 2)], "ticker string, given_on date, fiscal_period string, source_doc_id string, nth string")
    assert [(r.nth, r.given_on.day) for r in P.latest_guidance(given, 1).collect()] == [("own", 2)]


def test_explicit_filters_replace_inferred_ones():
    said, guessed = R.Filters(tickers=("NVDA",), date_from=date(2025, 1, 1)), R.Filters(tickers=("AMD",), doc_types=("10-K",), date_to=date(2025, 6, 1))
    both = said.over(guessed)
    assert (both.tickers, both.doc_types, both.sections, both.date_from, both.date_to) == (("NVDA",), ("10-K",), (), date(2025, 1, 1), date(2025, 6, 1))
    assert R.Filters().over(guessed) == guessed and R.Filters().is_empty() and not both.is_empty()


def test_labels_leave_out_what_is_missing(spark):
    rows = spark.createDataFrame([("NVDA", "10-K", "FY2025", "MD&A", date(2025, 2, 26), "doc::mda::0003"), ("NVDA", "", None, "", None, "x")], "t string, d string, p string, s string, f date, c string")
    got = [r.label for r in rows.select(A.filing_label(*map(F.col, "tdpsfc")).alias("label")).collect()]
    assert got == ["NVDA · 10-K · FY2025 · MD&A · filed 2025-02-26 · #0003", "NVDA · #x"]


def test_questions_of_a_file_of_lines(spark, tmp_path):
    path = tmp_path / "questions.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in ({"id": "q1", "category": "numeric", "query": "How much?", "tickers": ["NVDA"], "unknown": 1}, {"id": "q2", "expected_chunk_ids": ["a", "b"]})))
    got = {r.id: r for r in tables.questions(spark, str(path)).collect()}
    assert got["q1"].tickers == ["NVDA"] and got["q1"].notes is None and got["q2"].expected_chunk_ids == ["a", "b"]


def test_company_facts_of_landed_files(spark, tmp_path):
    fact = {"start": "2024-01-01", "end": "2024-03-31", "val": 5.0, "accn": "a-1", "form": "10-Q", "filed": "2024-04-20"}
    for ticker, facts in (("NVDA", {"us-gaap": {"Revenues": {"units": {"USD": [fact, fact | {"val": 6, "start": None}]}}, "Empty": {"units": {}}}}), ("AMD", {"dei": {}})):
        (tmp_path / ticker).mkdir()
        (tmp_path / ticker / "companyfacts.json").write_text(json.dumps({"cik": 1, "facts": facts}, indent=1))
    got = tables.company_facts(spark, f"{tmp_path}/*/companyfacts.json").orderBy("val").collect()
    assert [(r.ticker, r.tag, r.unit, r.start, r.end, r.val, r.form) for r in got] == [("NVDA", "Revenues", "USD", date(2024, 1, 1), date(2024, 3, 31), 5.0, "10-Q"), ("NVDA", "Revenues", "USD", None, date(2024, 3, 31), 6.0, "10-Q")]
