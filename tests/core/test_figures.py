from datetime import date

import pytest

from granary.operators import figures as G
from granary.operators import sinks as S
from granary.sources.tables import SCHEMAS, empty, facts_rows, recent_filings

FACT = "ticker string, tag string, unit string, start date, end date, val double, accn string, form string, filed date"


def rows(spark, facts):
    return {(r.metric, r.fiscal_year, r.fiscal_qtr): r for r in G.build_figures(spark.createDataFrame(facts, FACT)).collect()}


def fact(tag, start, end, val, accn="a1", filed="2026-03-01", form="10-Q"):
    return ("NVDA", tag, "USD", date.fromisoformat(start), date.fromisoformat(end), float(val), accn, form, date.fromisoformat(filed))


BASE = [
    fact("Revenues", "2025-01-27", "2026-01-25", 215938, form="10-K"),
    fact("Revenues", "2025-01-27", "2025-10-26", 147811),
    fact("Revenues", "2025-07-28", "2025-10-26", 57006),
    fact("Revenues", "2025-07-28", "2025-10-26", 57010, accn="a2", filed="2026-04-01"),
    fact("GrossProfit", "2025-07-28", "2025-10-26", 28505),
    fact("EarningsPerShareDiluted", "2025-07-28", "2025-10-26", 1.3),
    fact("EarningsPerShareDiluted", "2025-01-27", "2026-01-25", 4.9, form="10-K"),
    fact("Revenues", "2025-07-28", "2025-10-26", 1, form="S-1", filed="2027-01-01"),
    fact("RevenueFromContractWithCustomerExcludingAssessedTax", "2017-07-28", "2017-10-26", 5),
]


def test_build(spark):
    got = rows(spark, BASE)
    assert (got["revenue", 2026, 4].value, got["revenue", 2026, 4].derived) == (215938 - 147811, True)
    assert (got["revenue", 2026, 3].value, got["revenue", 2026, 3].source_accn, got["revenue", 2026, 3].tag) == (57010, "a2", "Revenues")
    assert ("eps_diluted", 2026, 4) not in got and got["eps_diluted", 2026, 3].unit == "usd_per_share"
    assert got["gross_margin", 2026, 3].value == 50.0 * 57010 / 57010 or abs(got["gross_margin", 2026, 3].value - 50) < 0.01
    assert not any(m == "gross_profit" for m, _, _ in got)


def test_a_fourth_of_nothing_is_zero_and_has_no_margin(spark):
    """0.1 + 0.2 + 0.3 isn't 0.6 in doubles; the rest of the year must be zero all the same, and no value without end counts."""
    spans = [("2025-01-01", "2025-03-31"), ("2025-04-01", "2025-06-30"), ("2025-07-01", "2025-09-30")]
    year = ("2025-01-01", "2025-12-31")
    facts = [fact(tag, *span, val) for tag in ("Revenues", "GrossProfit") for span, val in zip(spans, (0.1, 0.2, 0.3))]
    facts += [fact("Revenues", *year, 0.6, form="10-K"), fact("GrossProfit", *year, 0.7, form="10-K"), fact("OperatingIncomeLoss", *year, float("inf"), form="10-K")]
    facts += [fact("OperatingIncomeLoss", *span, 1) for span in spans]
    got = rows(spark, facts)
    assert got["revenue", 2025, 4].value == 0.0 and got["revenue", 2025, 4].derived
    assert ("gross_margin", 2025, 4) not in got and got["gross_margin", 2025, 3].value == 100.0
    assert ("operating_income", 2025, 4) not in got


def test_growth_is_null_over_a_gap(spark):
    df = spark.createDataFrame([("T", "revenue", y, q, v, "usd") for y, q, v in [(2025, 1, 10.0), (2025, 4, 20.0), (2026, 1, 30.0), (2026, 2, 0.0), (2026, 3, 5.0)]], "ticker string, metric string, fiscal_year int, fiscal_qtr int, value double, unit string")
    got = {(r.fiscal_year, r.fiscal_qtr): r.pct for r in G.qoq_growth(df, "T", n_quarters=9).collect()}
    assert got == {(2025, 1): None, (2025, 4): None, (2026, 1): 50.0, (2026, 2): -100.0, (2026, 3): None}
    assert {(r.fiscal_year, r.fiscal_qtr): r.pct for r in G.yoy_growth(df, "T", n_quarters=3).collect()} == {(2026, 1): 200.0, (2026, 2): None, (2026, 3): None}
    assert G.lines(G.metric_series(df, "T", "revenue", 2)).first().text == "FY2026Q3: $0.00B\nFY2026Q2: $0.00B"
    assert "n/a — no prior period" in G.lines(G.qoq_growth(df, "T", n_quarters=1)).first().text
    with pytest.raises(ValueError):
        G.run(df, "drop_table")
    with pytest.raises(ValueError):
        G.run(df, "latest_metric", ticker="T", sql="x")


def test_sources(spark):
    gaap = spark.sql("select 'T' ticker, map('Revenues', named_struct('units', map('USD', array(named_struct('start', '2025-01-01', 'end', '2025-03-31', 'val', 5.0D, 'accn', 'a', 'form', '10-Q', 'filed', '2025-04-30'))))) gaap")
    r = facts_rows(gaap).first()
    assert (r.tag, r.unit, str(r.end), r.val) == ("Revenues", "USD", "2025-03-31", 5.0)
    raw = spark.sql("select 'T' ticker, named_struct('accessionNumber', array('x', 'y'), 'form', array('10-K', '8-K'), 'filingDate', array('d', 'e'), 'reportDate', array('', ''), 'items', array('', '2.02'), 'primaryDocument', array('p', 'q')) recent")
    assert [(f.pos, f.form, f["items"]) for f in recent_filings(raw).collect()] == [(0, "10-K", ""), (1, "8-K", "2.02")]
    assert all(empty(spark, name).count() == 0 for name in SCHEMAS)


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 0)], "k string, v int, __nth int")
    want = [("a", 1), ("b", 4), ("c", 5)]
    once = S.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, S.upsert(once, new, ["k"]).collect()))
    assert sorted(map(tuple, S.replace_series(old, new.drop("__nth"), ["k"]).collect())) == [("a", 1), ("b", 3), ("b", 4), ("c", 5)]
    assert [tuple(r) for r in S.delete_by(old, new.select("k").distinct()).collect()] == [("a", 1)]
    log = spark.createDataFrame([(1, 5), (2, 6)], "id int, ts int")
    assert S.append_log(log, str(tmp_path / "log")) and S.append_log(log, str(tmp_path / "log")) and not S.append_log(log, "/proc/no/such")
    assert [r.id for r in S.newest(spark.read.parquet(str(tmp_path / "log")), 1).collect()] == [2]
    assert S.markdown_table(old.orderBy("k")) == "| k | v |\n|---|---|\n| a | 1 |\n| b | 2 |"
