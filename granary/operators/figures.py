"""Quarterly figures: facts to series, derived quarters, margins, and the canned queries over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions.dates import fiscal_quarter, fiscal_year, pct_change, period_kind, period_label
from granary.functions.text import free_name
from granary.sources.landing import landed

#: Candidate tags of each metric in order, units, metrics whose parts add up, and forms that count.
TAG_CHAINS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenuesNetOfInterestExpense"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "operating_income": ["OperatingIncomeLoss"],
    "gross_profit": ["GrossProfit"],
}
UNITS = {"revenue": "usd", "eps_diluted": "usd_per_share", "operating_income": "usd", "gross_profit": "usd", "gross_margin": "pct"}
ADDITIVE = ["revenue", "operating_income", "gross_profit"]
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A", "8-K"]
RECENT_YEARS = 5
KEY = ["ticker", "metric", "fiscal_year", "fiscal_qtr"]


def duration_facts(facts: DataFrame) -> DataFrame:
    """Facts over a period of a known length, on a form that counts, with their kind of period."""
    kept = facts.where(F.col("start").isNotNull() & F.col("form").isin(*FORMS))
    return kept.withColumn("kind", period_kind(F.col("start"), F.col("end"))).where("kind is not null")


def year_end_month(facts: DataFrame) -> DataFrame:
    """(ticker, fye): the most frequent end month of annual revenue and income facts; the smallest of equals."""
    tags = [*TAG_CHAINS["revenue"], "NetIncomeLoss"]
    months = facts.where((F.col("kind") == "FY") & F.col("tag").isin(*tags)).groupBy("ticker", F.month("end").alias("m")).count()
    return months.groupBy("ticker").agg(F.max_by("m", F.struct("count", -F.col("m"))).alias("fye"))


def latest_filed(facts: DataFrame, by: list[str]) -> DataFrame:
    """One fact for each fiscal period and kind: the latest filed, then the highest accession."""
    dated = facts.withColumn("fiscal_year", fiscal_year(F.col("end"), F.col("fye"))).withColumn("fiscal_qtr", F.when(F.col("kind") == "Q", fiscal_quarter(F.col("end"), F.col("fye"))).otherwise(F.lit(0)))
    best = F.max_by(F.struct("val", F.col("end").alias("period_end"), "accn", "filed"), F.struct("filed", "accn", "val"))
    return dated.groupBy(*by, "kind", "fiscal_year", "fiscal_qtr").agg(best.alias("f")).select(*by, "kind", "fiscal_year", "fiscal_qtr", "f.*")


def choose_tags(series: DataFrame) -> DataFrame:
    """(ticker, metric, tag): most quarters of the last years, then most quarters, then the latest, then chain order.

    series: quarterly facts with ticker, metric, tag, chain (place in the metric's chain) and period_end.
    """
    anchor = F.max("period_end").over(Window.partitionBy("ticker", "metric"))
    recent = F.count(F.when(F.year("period_end") >= F.year("anchor") - RECENT_YEARS, 1))
    scores = series.withColumn("anchor", anchor).groupBy("ticker", "metric", "tag", "chain").agg(recent.alias("recent"), F.count("*").alias("n"), F.max("period_end").alias("last"))
    return scores.groupBy("ticker", "metric").agg(F.max_by("tag", F.struct("recent", "n", "last", -F.col("chain"))).alias("tag"))


def derive_fourth(quarters: DataFrame, annual: DataFrame, nine: DataFrame, by: list[str]) -> DataFrame:
    """quarters, and the fourth where it is missing: the year less nine months, or less three present quarters.

    Differences are taken in decimals of four places, so a fourth of nothing is zero whatever the order of summation.
    A value that is not finite gives no fourth.
    """
    key = [*by, "fiscal_year"]
    exact = F.col("val").try_cast("decimal(28,4)")
    have = quarters.where("fiscal_qtr = 4").select(*key)
    parts = quarters.where("fiscal_qtr in (1, 2, 3)").groupBy(*key).agg(F.sum(exact).alias("three"), F.count(exact).alias("m"))
    rest = annual.join(have, key, "left_anti").join(nine.select(*key, exact.alias("nine")), key, "left").join(parts, key, "left")
    three = F.when(F.col("m") == 3, F.col("three"))
    fourth = rest.withColumn("val", (exact - F.coalesce("nine", three)).cast("double")).where("val is not null").withColumn("fiscal_qtr", F.lit(4)).withColumn("derived", F.lit(True))
    columns = [*key, "fiscal_qtr", "val", "period_end", "accn", "filed", "derived"]
    return quarters.withColumn("derived", F.lit(False)).select(*columns).unionByName(fourth.select(*columns))


def gross_margin(rows: DataFrame) -> DataFrame:
    """Percent of revenue left as gross profit, where both are present and revenue isn't zero."""
    key = ["ticker", "fiscal_year", "fiscal_qtr"]
    revenue = rows.where("metric = 'revenue'").select(*key, F.col("val").alias("revenue"))
    profit = rows.where("metric = 'gross_profit'").join(revenue, key).where("revenue != 0")
    return profit.withColumn("metric", F.lit("gross_margin")).withColumn("val", F.lit(100.0) * F.col("val") / F.col("revenue")).withColumn("derived", F.lit(True)).drop("revenue")


def build_figures(facts: DataFrame) -> DataFrame:
    """Company facts -> (ticker, metric, fiscal_year, fiscal_qtr, value, unit, period_end, source_accn, derived, tag).

    What several branches need is landed. A company with facts but without annual ones has no fiscal year end: an error.
    """
    kept = landed(duration_facts(facts))
    chain = F.create_map(*[F.lit(x) for metric, tags in TAG_CHAINS.items() for k, tag in enumerate(tags) for x in (tag, f"{metric}:{k}")])
    named = kept.withColumn("c", F.split(chain[F.col("tag")], ":")).where("c is not null").select("*", F.col("c")[0].alias("metric"), F.col("c")[1].cast("int").alias("chain")).drop("c")
    by = ["ticker", "metric", "tag", "chain"]
    ended = named.join(year_end_month(kept), "ticker", "left")
    missing = F.concat(F.lit("no annual revenue or income facts, so no fiscal year end, for "), F.col("ticker"))
    ended = ended.withColumn("fye", F.when(F.col("fye").isNull(), F.raise_error(missing)).otherwise(F.col("fye")))
    series = landed(latest_filed(ended, by))
    chosen = choose_tags(series.where("kind = 'Q'"))
    mine = series.join(chosen, ["ticker", "metric", "tag"]).drop("chain")
    by = ["ticker", "metric", "tag"]
    quarters = mine.where("kind = 'Q'")
    adds = mine.where(F.col("metric").isin(*ADDITIVE))
    rows = landed(derive_fourth(quarters, adds.where("kind = 'FY'"), adds.where("kind = '9M'"), by))
    rows = rows.unionByName(gross_margin(rows)).where("metric != 'gross_profit'")
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return rows.select("ticker", "metric", "fiscal_year", "fiscal_qtr", F.round("val", 4).alias("value"), unit[F.col("metric")].alias("unit"), "period_end", F.col("accn").alias("source_accn"), "derived", "tag")


# --- canned queries -----------------------------------------------------------


def format_value(value: Column, unit: Column) -> Column:
    return (
        F.when(unit == "usd", F.concat(F.lit("$"), F.format_number(value / 1e9, 2), F.lit("B")))
        .when(unit == "usd_per_share", F.concat(F.lit("$"), F.format_number(value, 2)))
        .when(unit == "pct", F.concat(F.format_number(value, 1), F.lit("%")))
        .otherwise(F.format_number(value, 2))
    )


def metric_series(rows: DataFrame, ticker: str, metric: str, n_quarters: int = 4) -> DataFrame:
    """The last n quarters, newest first."""
    return rows.where((F.col("ticker") == ticker) & (F.col("metric") == metric) & (F.col("fiscal_qtr") > 0)).orderBy(F.desc("fiscal_year"), F.desc("fiscal_qtr")).limit(int(n_quarters))


def revenue_last_n_quarters(rows: DataFrame, ticker: str, n_quarters: int = 4) -> DataFrame:
    return metric_series(rows, ticker, "revenue", n_quarters)


def latest_metric(rows: DataFrame, ticker: str, metric: str) -> DataFrame:
    return metric_series(rows, ticker, metric, 1)


def _growth(rows: DataFrame, ticker: str, metric: str, n_quarters: int, back: int) -> DataFrame:
    """Growth against the quarter `back` before by name: null where that is missing, whatever stands next in order.

    Adds prior (its value), prior_period (its name), basis (QoQ or YoY) and pct.
    """
    number = F.col("fiscal_year") * 4 + F.col("fiscal_qtr") - 1
    before = rows.where((F.col("ticker") == ticker) & (F.col("metric") == metric) & (F.col("fiscal_qtr") > 0))
    before = before.select((number + back).alias("quarter_number"), F.col("value").alias("prior"), period_label(F.col("fiscal_year"), F.col("fiscal_qtr")).alias("prior_period"))
    now = metric_series(rows, ticker, metric, n_quarters).withColumn("quarter_number", number).withColumn("basis", F.lit({1: "QoQ", 4: "YoY"}[back]))
    return now.join(before, "quarter_number", "left").withColumn("pct", pct_change(F.col("value").cast("double"), F.col("prior").cast("double"))).drop("quarter_number")


def qoq_growth(rows: DataFrame, ticker: str, metric: str = "revenue", n_quarters: int = 4) -> DataFrame:
    return _growth(rows, ticker, metric, n_quarters, 1)


def yoy_growth(rows: DataFrame, ticker: str, metric: str = "revenue", n_quarters: int = 4) -> DataFrame:
    return _growth(rows, ticker, metric, n_quarters, 4)


def margin_trend(rows: DataFrame, ticker: str, n_quarters: int = 8) -> DataFrame:
    return metric_series(rows, ticker, "gross_margin", n_quarters)


def compare_tickers(rows: DataFrame, tickers: list[str], metric: str = "revenue", n_quarters: int = 1) -> DataFrame:
    nth, held = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"), F.desc("fiscal_qtr"))), free_name("nth", rows.columns)
    return rows.where(F.col("ticker").isin(*tickers) & (F.col("metric") == metric) & (F.col("fiscal_qtr") > 0)).withColumn(held, nth).where(F.col(held) <= n_quarters).drop(held)


def available_metrics(rows: DataFrame, ticker: str) -> DataFrame:
    return rows.where(F.col("ticker") == ticker).select("metric").distinct().orderBy("metric")


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ticker", "metric").agg(F.count("*").alias("n"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.count_if("derived").alias("n_derived"))


CANNED = {
    "metric_series": (metric_series, ("ticker", "metric", "n_quarters")),
    "revenue_last_n_quarters": (revenue_last_n_quarters, ("ticker", "n_quarters")),
    "latest_metric": (latest_metric, ("ticker", "metric")),
    "qoq_growth": (qoq_growth, ("ticker", "metric", "n_quarters")),
    "yoy_growth": (yoy_growth, ("ticker", "metric", "n_quarters")),
    "margin_trend": (margin_trend, ("ticker", "n_quarters")),
    "compare_tickers": (compare_tickers, ("tickers", "metric", "n_quarters")),
    "available_metrics": (available_metrics, ("ticker",)),
}


def run(rows: DataFrame, name: str, **params) -> DataFrame:
    """A canned query by name; unknown names and parameters are errors."""
    if name not in CANNED:
        raise ValueError(f"no such query: {name}; known: {', '.join(CANNED)}")
    function, known = CANNED[name]
    if unknown := sorted(set(params) - set(known)):
        raise ValueError(f"{name} does not take {', '.join(unknown)}")
    return function(rows, **params)


def shown(points: DataFrame) -> Column:
    """A point as text: 'FY2026Q3: $57.01B'; where there is growth, with it: '(YoY +12.0% vs FY2025Q3)'."""
    head = F.concat(period_label(F.col("fiscal_year"), F.col("fiscal_qtr")), F.lit(": "), format_value(F.col("value"), F.col("unit")))
    if "pct" not in points.columns:
        return head
    grown = F.concat(F.format_string("%+.1f%%", F.col("pct")), F.lit(" vs "), F.col("prior_period"))
    return F.concat(head, F.lit(" ("), F.col("basis"), F.lit(" "), F.when(F.col("pct").isNotNull(), grown).otherwise(F.lit("n/a — no prior period")), F.lit(")"))


def lines(points: DataFrame) -> DataFrame:
    """Points as one text, a line each, newest first."""
    rows = points.select("fiscal_year", "fiscal_qtr", shown(points).alias("line"))
    return rows.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("fiscal_year", "fiscal_qtr", "line")))), lambda x: x["line"]), "\n").alias("text"))


def evidence_item(rows: DataFrame, name: str, params: dict) -> DataFrame | None:
    """The result of a canned plan as one evidence item (key, kind, label, text), with no row if it has none.

    A plan that doesn't exist or doesn't take these parameters gives no item, None.
    """
    try:
        points = run(rows, name, **params)
    except (ValueError, TypeError):
        return None
    who, metric = params.get("ticker") or ",".join(params.get("tickers", [])), params.get("metric", "")
    if "value" not in points.columns:  # a list of metrics, not of points
        text = points.agg(F.array_join(F.array_sort(F.collect_list("metric")), "\n").alias("text"))
    else:
        text = lines(points)
    label = f"{who} · financials · {name}({metric})" if metric else f"{who} · financials · {name}"
    return text.where("text != ''").select(F.lit(f"financials:{who}:{metric or name}").alias("key"), F.lit("financial").alias("kind"), F.lit(label).alias("label"), "text")


#: The plans that ground the numeric questions.
TRUTH_PLANS = {
    "num-01": ("metric_series", {"ticker": "NVDA", "metric": "revenue", "n_quarters": 4}),
    "num-02": ("margin_trend", {"ticker": "MSFT", "n_quarters": 4}),
    "num-03": ("latest_metric", {"ticker": "NVDA", "metric": "eps_diluted"}),
    "num-04": ("latest_metric", {"ticker": "JPM", "metric": "revenue"}),
    "num-05": ("yoy_growth", {"ticker": "NVDA", "metric": "revenue", "n_quarters": 4}),
    "num-06": ("latest_metric", {"ticker": "MSFT", "metric": "operating_income"}),
}


def truth(rows: DataFrame, plans: dict[str, tuple[str, dict]] = TRUTH_PLANS) -> DataFrame:
    """Several canned plans evaluated to texts: (id, text); empty where a plan finds nothing."""
    return reduce(DataFrame.unionByName, (lines(run(rows, name, **params)).select(F.lit(key).alias("id"), "text") for key, (name, params) in plans.items()))
