"""Figure queries. Market segments stand for companies, quarters of order dates for periods.

Each quarter's revenue is filed twice, by line status; the later shipped filing wins. Even years have no fourth-quarter
fact, years divisible by three no nine-month fact, and 1997's second quarter is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.dates import calendar_label, fiscal_quarter, fiscal_year, period_kind, period_label
from granary.operators import figures as G
from granary.operators.sinks import known_or_null, merge_columns, replace_series, upsert
from granary.operators.stores import Store
from granary.sources.landing import landed, landing_path, stored
from granary.sources.tables import table

TAGS = {"revenue": "Revenues", "gross_profit": "GrossProfit", "eps_diluted": "EarningsPerShareDiluted"}


def facts(spark: SparkSession, d: str) -> DataFrame:
    """XBRL-like facts of quarters, nine months and years."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linestatus", "l_shipdate", "l_quantity", (F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("decimal(20,0)")).alias("rev"))
    rows = item.join(part, "l_partkey").join(o, "o_orderkey").join(c, "o_custkey").withColumn("profit", F.col("rev") - F.round(F.col("p_retailprice") * 10).cast("decimal(20,0)"))
    quarter = rows.groupBy("ticker", "y", "q", "l_linestatus").agg(F.sum("rev").alias("revenue"), F.sum("profit").alias("gross_profit"), F.count("*").alias("eps_diluted"), F.to_date(F.max("l_shipdate")).alias("filed"))
    long = quarter.unpivot(["ticker", "y", "q", "l_linestatus", "filed"], ["revenue", "gross_profit", "eps_diluted"], "metric", "cents")
    tag = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    long = landed(long.select("ticker", "y", "q", "l_linestatus", "filed", tag[F.col("metric")].alias("tag"), "cents"))

    def span(rows: DataFrame, first: str, last: str) -> DataFrame:
        day = lambda text: F.to_date(F.concat(F.col("y").cast("string"), F.lit(text)))
        return rows.select("ticker", "tag", day(first).alias("start"), day(last).alias("end"), (F.col("cents") / 100).cast("double").alias("val"), F.concat("l_linestatus", F.lit("-"), F.col("y").cast("string")).alias("accn"), F.lit("10-Q").alias("form"), "filed")

    total = lambda quarters: long.where(F.col("q").isin(*quarters)).groupBy("ticker", "y", "l_linestatus", "tag").agg(F.sum("cents").alias("cents"), F.max("filed").alias("filed"))
    out = span(total([1, 2, 3, 4]), "-01-01", "-12-31").unionByName(span(total([1, 2, 3]).where("y % 3 != 0"), "-01-01", "-09-30"))
    for q, first, last in ((1, "-01-01", "-03-31"), (2, "-04-01", "-06-30"), (3, "-07-01", "-09-30"), (4, "-10-01", "-12-31")):
        out = out.unionByName(span(long.where((F.col("q") == q) & ~((F.lit(q) == 4) & (F.col("y") % 2 == 0)) & ~((F.lit(q) == 2) & (F.col("y") == 1997))), first, last))
    return out


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The table of figures, built once in an application for each state of the tables it is made of."""
    paths = [f"{d}/{name}.parquet" for name in ("orders", "customer", "part", "lineitem")]
    return stored(spark, "figures", paths, lambda: landed(G.build_figures(facts(spark, d)), "figures"))


def fin_build_figures(spark, d):
    return rows(spark, d)


def fin_latest_fact(spark, d):
    f = G.duration_facts(facts(spark, d)).withColumn("fye", F.lit(12))
    return G.latest_filed(f, ["ticker", "tag"]).withColumn("val", F.round("val", 4))


def fin_year_end_month(spark, d):
    return G.year_end_month(G.duration_facts(facts(spark, d)))


def fin_coverage(spark, d):
    return G.coverage(rows(spark, d))


def fin_metric_series(spark, d):
    return G.metric_series(rows(spark, d), "BUILDING", "revenue", 6).select("fiscal_year", "fiscal_qtr", "value", G.format_value(F.col("value"), F.col("unit")).alias("shown"))


def fin_revenue_last_n_quarters(spark, d):
    return G.revenue_last_n_quarters(rows(spark, d), "MACHINERY", 3).select("fiscal_year", "fiscal_qtr", "value")


def fin_latest_metric(spark, d):
    return G.latest_metric(rows(spark, d), "BUILDING", "gross_margin").select("fiscal_year", "fiscal_qtr", "value")


def fin_qoq_growth(spark, d):
    return G.qoq_growth(rows(spark, d), "BUILDING", "revenue", 24).select("fiscal_year", "fiscal_qtr", "value", "prior", F.round("pct", 4).alias("pct"))


def fin_yoy_growth(spark, d):
    return G.yoy_growth(rows(spark, d), "BUILDING", "revenue", 24).select("fiscal_year", "fiscal_qtr", "value", "prior", F.round("pct", 4).alias("pct"))


def fin_margin_trend(spark, d):
    return G.margin_trend(rows(spark, d), "FURNITURE", 8).select("fiscal_year", "fiscal_qtr", "value")


def fin_compare_tickers(spark, d):
    return G.compare_tickers(rows(spark, d), ["BUILDING", "MACHINERY", "nobody"], "revenue", 2).select("ticker", "fiscal_year", "fiscal_qtr", "value")


def fin_available_metrics(spark, d):
    return G.available_metrics(rows(spark, d), "BUILDING")


def fin_truth(spark, d):
    """The six plans of the numeric questions, for three segments in place of the companies."""
    stand_in = {"NVDA": "BUILDING", "MSFT": "MACHINERY", "JPM": "FURNITURE"}
    plans = {key: (name, params | {"ticker": stand_in[params["ticker"]]}) for key, (name, params) in G.TRUTH_PLANS.items()}
    return G.truth(rows(spark, d), plans)


def financial_evidence(spark, d):
    """Evidence items of three plans; a plan that doesn't exist gives none."""
    found = rows(spark, d)
    plans = [("qoq_growth", {"ticker": "BUILDING", "metric": "revenue", "n_quarters": 24}), ("margin_trend", {"ticker": "MACHINERY", "n_quarters": 2}), ("available_metrics", {"ticker": "FURNITURE"}), ("metric_series", {"ticker": "nobody", "metric": "revenue"}), ("drop_table", {})]
    items = [item for name, params in plans if (item := G.evidence_item(found, name, params)) is not None]
    return reduce(DataFrame.unionByName, items)


def fin_tag_choice(spark, d):
    """Three candidate tags of fifty companies; a tag's quarters thin out with time, so the choice differs."""
    k = F.col("o_orderkey")
    at = F.when(F.year("o_orderdate") < 1995, k % 3).otherwise(F.col("o_custkey") % 3).cast("int")
    series = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("ticker"), F.lit("revenue").alias("metric"), at.alias("chain"), F.last_day("o_orderdate").alias("period_end")).distinct()
    return G.choose_tags(series.withColumn("tag", F.element_at(F.array(*map(F.lit, G.TAG_CHAINS["revenue"])), F.col("chain") + 1)))


def fin_periods(spark, d):
    """Kinds and fiscal periods of spans of orders for several year ends."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    o = o.withColumn("end", F.date_add("start", (F.col("o_orderkey") % 400).cast("int"))).withColumn("fye", (F.col("o_orderkey") % 12 + 1).cast("int"))
    y, q = fiscal_year(F.col("end"), F.col("fye")), fiscal_quarter(F.col("end"), F.col("fye"))
    return o.select("o_orderkey", period_kind(F.col("start"), F.col("end")).alias("kind"), y.alias("fy"), q.alias("q"), period_label(y, q).alias("label"), calendar_label(F.when(F.col("fye") == 1, "10-K").otherwise("10-Q"), F.col("end")).alias("calendar"))


def _old_new(spark, d):
    """Every order is old, new, or both."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("p"))
    old = o.where("v % 3 <> 1").groupBy("k", "s").agg(F.max("v").alias("v"))
    return old, o.where("v % 3 <> 0")


def sink_upsert_latest(spark, d):
    old, new = _old_new(spark, d)
    return upsert(old, new.select("k", "s", "v"), ["k", "s"], latest="v")


def sink_replace_series(spark, d):
    old, new = _old_new(spark, d)
    return replace_series(old, new.select("k", "s", "v"), ["k", "s"])


def sink_merge_columns(spark, d):
    old, new = _old_new(spark, d)
    return merge_columns(old, new.groupBy("k", "s").agg(F.round(F.max("p"), 2).alias("p")), ["k", "s"])


def sink_skip_existing(spark, d):
    from granary.operators.sinks import skip_existing

    old, new = _old_new(spark, d)
    return skip_existing(new.select("k", "s", "v"), old.select("k", "s"))


def sink_known_document(spark, d):
    docs = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("doc_id"))
    return known_or_null(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("source_accn")), docs)


_FACTS = """
item AS (
  SELECT c_mktsegment AS ticker, year(o_orderdate) AS y, quarter(o_orderdate) AS q, l_linestatus AS st, l_shipdate,
    CAST(round(l_extendedprice * (1 - l_discount) * 100) AS DECIMAL(20, 0)) AS rev, CAST(round(p_retailprice * 10) AS DECIMAL(20, 0)) AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
long AS (
  SELECT ticker, y, q, st, CAST(max(l_shipdate) AS DATE) AS filed, unnest(['Revenues', 'GrossProfit', 'EarningsPerShareDiluted']) AS tag,
    unnest([CAST(sum(rev) AS DECIMAL(38, 0)), CAST(sum(rev - cost) AS DECIMAL(38, 0)), CAST(count(*) AS DECIMAL(38, 0))]) AS cents
  FROM item GROUP BY ticker, y, q, st),
spans AS (
  SELECT ticker, tag, st, y, 'FY' AS kind, 0 AS qtr, sum(cents) AS cents, max(filed) AS filed, make_date(y, 12, 31) AS period_end FROM long GROUP BY ALL
  UNION ALL SELECT ticker, tag, st, y, '9M', 0, sum(cents), max(filed), make_date(y, 9, 30) FROM long WHERE q < 4 AND y % 3 <> 0 GROUP BY ALL
  UNION ALL SELECT ticker, tag, st, y, 'Q', q, cents, filed, last_day(make_date(y, 3 * q, 1)) FROM long WHERE NOT (q = 4 AND y % 2 = 0) AND NOT (q = 2 AND y = 1997)),
latest AS (
  SELECT ticker, tag, kind, y, qtr, CAST(arg_max(cents, row(filed, st)) AS DOUBLE) / 100 AS val, any_value(period_end) AS period_end, arg_max(st, row(filed, st)) || '-' || y AS accn, max(filed) AS filed
  FROM spans GROUP BY ticker, tag, kind, y, qtr),
quarters AS (SELECT * FROM latest WHERE kind = 'Q'),
fourth AS (
  SELECT f.ticker, f.tag, f.y, f.val - coalesce(n.val, p.val) AS val, f.period_end, f.accn
  FROM latest f
  LEFT JOIN latest n ON n.kind = '9M' AND (n.ticker, n.tag, n.y) = (f.ticker, f.tag, f.y)
  LEFT JOIN (SELECT ticker, tag, y, sum(val) AS val FROM quarters WHERE qtr < 4 GROUP BY ALL HAVING count(*) = 3) p ON (p.ticker, p.tag, p.y) = (f.ticker, f.tag, f.y)
  WHERE f.kind = 'FY' AND f.tag <> 'EarningsPerShareDiluted' AND coalesce(n.val, p.val) IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM quarters x WHERE x.qtr = 4 AND (x.ticker, x.tag, x.y) = (f.ticker, f.tag, f.y))),
series AS (
  SELECT ticker, tag, y, qtr, val, period_end, accn, false AS derived FROM quarters
  UNION ALL SELECT ticker, tag, y, 4, val, period_end, accn, true FROM fourth),
figs AS (
  SELECT ticker, CASE tag WHEN 'Revenues' THEN 'revenue' ELSE 'eps_diluted' END AS metric, y, qtr, val, period_end, accn, derived, tag FROM series WHERE tag <> 'GrossProfit'
  UNION ALL SELECT p.ticker, 'gross_margin', p.y, p.qtr, 100.0::DOUBLE * p.val / r.val, p.period_end, p.accn, true, p.tag
  FROM series p JOIN series r ON (p.ticker, p.y, p.qtr) = (r.ticker, r.y, r.qtr) AND p.tag = 'GrossProfit' AND r.tag = 'Revenues' WHERE r.val <> 0),
f AS (
  SELECT ticker, metric, CAST(y AS INT) AS fiscal_year, CAST(qtr AS INT) AS fiscal_qtr, round(val, 4) AS value,
    CASE metric WHEN 'revenue' THEN 'usd' WHEN 'gross_margin' THEN 'pct' ELSE 'usd_per_share' END AS unit, period_end, accn AS source_accn, derived, tag FROM figs)"""


def _last(ticker: str, metric: str, n: int, columns: str = "fiscal_year, fiscal_qtr, value") -> str:
    return f"WITH {_FACTS} SELECT {columns} FROM f WHERE ticker = '{ticker}' AND metric = '{metric}' ORDER BY fiscal_year DESC, fiscal_qtr DESC LIMIT {n}"


def _grown(back: int) -> str:
    return f"""WITH {_FACTS}, s AS (SELECT * FROM f WHERE ticker = 'BUILDING' AND metric = 'revenue')
SELECT a.fiscal_year, a.fiscal_qtr, a.value, b.value AS prior, round(100.0 * (a.value - b.value) / abs(nullif(b.value, 0)), 4) AS pct
FROM s a LEFT JOIN s b ON a.fiscal_year * 4 + a.fiscal_qtr = b.fiscal_year * 4 + b.fiscal_qtr + {back} ORDER BY 1 DESC, 2 DESC LIMIT 24"""


_SHOWN = "CASE unit WHEN 'pct' THEN format('{:,.1f}', value) || '%' WHEN 'usd' THEN '$' || format('{:,.2f}', value / 1e9) || 'B' ELSE '$' || format('{:,.2f}', value) END"


def _change(basis: str, back: int) -> str:
    """Growth of a row l against the quarter `back` before, as text."""
    prior = f"(SELECT b FROM f b WHERE (b.ticker, b.metric) = (l.ticker, l.metric) AND b.value <> 0 AND b.fiscal_year * 4 + b.fiscal_qtr + {back} = l.fiscal_year * 4 + l.fiscal_qtr)"
    return f"coalesce(' ({basis} ' || printf('%+.1f%%', 100.0::DOUBLE * (l.value - {prior}.value) / abs({prior}.value)) || ' vs FY' || {prior}.fiscal_year || 'Q' || {prior}.fiscal_qtr || ')', ' ({basis} n/a — no prior period)')"


_OLD = """
o AS (SELECT o_custkey AS k, o_orderstatus AS s, o_orderkey AS v, o_totalprice AS p FROM orders),
old AS (SELECT k, s, max(v) AS v FROM o WHERE v % 3 <> 1 GROUP BY k, s),
new AS (SELECT * FROM o WHERE v % 3 <> 0)"""


def store_of_orders(spark, d):
    """The old orders in a store, after an upsert of the new ones, a replaced third of the series and a delete: what a
    reader sees after three writes that each touch some buckets only."""
    old, new = _old_new(spark, d)
    path = landing_path(spark, "store")
    store = Store.create(spark, path, old.schema, ["k", "s"], buckets=16)
    store.upsert(old)
    store.upsert(new.select("k", "s", "v"), latest="v")
    store.replace(new.where("k % 3 = 0").select("k", "s", (-F.col("v")).alias("v")))
    store.delete(old.where("k % 5 = 0").select("k", "s"))
    return store.read()


QUERIES = {f.__name__: f for f in (store_of_orders, fin_build_figures, fin_latest_fact, fin_year_end_month, fin_coverage, fin_metric_series, fin_revenue_last_n_quarters, fin_latest_metric, fin_qoq_growth, fin_yoy_growth, fin_margin_trend, fin_compare_tickers, fin_available_metrics, fin_truth, financial_evidence, fin_tag_choice, fin_periods, sink_upsert_latest, sink_replace_series, sink_merge_columns, sink_skip_existing, sink_known_document)}
ORACLES = {
    "fin_build_figures": f"WITH {_FACTS} SELECT * FROM f",
    "fin_latest_fact": f"WITH {_FACTS} SELECT ticker, tag, kind, CAST(y AS INT) AS fiscal_year, CAST(qtr AS INT) AS fiscal_qtr, round(val, 4) AS val, period_end, accn, filed FROM latest",
    "fin_year_end_month": f"WITH {_FACTS} SELECT DISTINCT ticker, CAST(12 AS INT) AS fye FROM latest WHERE kind = 'FY'",
    "fin_coverage": f"WITH {_FACTS} SELECT ticker, metric, count(*) AS n, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, count(*) FILTER (derived) AS n_derived FROM f GROUP BY ALL",
    "fin_metric_series": _last("BUILDING", "revenue", 6, "fiscal_year, fiscal_qtr, value, '$' || format('{:,.2f}', value / 1e9) || 'B' AS shown"),
    "fin_revenue_last_n_quarters": _last("MACHINERY", "revenue", 3),
    "fin_latest_metric": _last("BUILDING", "gross_margin", 1),
    "fin_qoq_growth": _grown(1),
    "fin_yoy_growth": _grown(4),
    "fin_margin_trend": _last("FURNITURE", "gross_margin", 8),
    "fin_compare_tickers": f"WITH {_FACTS} SELECT ticker, fiscal_year, fiscal_qtr, value FROM f WHERE ticker IN ('BUILDING', 'MACHINERY') AND metric = 'revenue' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, fiscal_qtr DESC) <= 2",
    "fin_available_metrics": f"WITH {_FACTS} SELECT DISTINCT metric FROM f WHERE ticker = 'BUILDING'",
    "fin_truth": f"""WITH {_FACTS}, last AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY fiscal_year DESC, fiscal_qtr DESC) AS n, 'FY' || fiscal_year || 'Q' || fiscal_qtr || ': ' || {_SHOWN} AS line FROM f),
p(id, ticker, metric, upto, grown) AS (VALUES ('num-01', 'BUILDING', 'revenue', 4, false), ('num-02', 'MACHINERY', 'gross_margin', 4, false), ('num-03', 'BUILDING', 'eps_diluted', 1, false), ('num-04', 'FURNITURE', 'revenue', 1, false), ('num-05', 'BUILDING', 'revenue', 4, true), ('num-06', 'MACHINERY', 'operating_income', 1, false))
SELECT id, coalesce(string_agg(l.line || CASE WHEN grown THEN {_change('YoY', 4)} ELSE '' END, chr(10) ORDER BY n), '') AS text
FROM p LEFT JOIN last l ON (l.ticker, l.metric) = (p.ticker, p.metric) AND n <= upto GROUP BY id""",
    "financial_evidence": f"""WITH {_FACTS}, last AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY fiscal_year DESC, fiscal_qtr DESC) AS n, 'FY' || fiscal_year || 'Q' || fiscal_qtr || ': ' || {_SHOWN} AS line FROM f)
SELECT 'financials:BUILDING:revenue' AS key, 'financial' AS kind, 'BUILDING · financials · qoq_growth(revenue)' AS label, string_agg(l.line || {_change('QoQ', 1)}, chr(10) ORDER BY n) AS text FROM last l WHERE ticker = 'BUILDING' AND metric = 'revenue' AND n <= 24
UNION ALL SELECT 'financials:MACHINERY:margin_trend', 'financial', 'MACHINERY · financials · margin_trend', string_agg(line, chr(10) ORDER BY n) FROM last WHERE ticker = 'MACHINERY' AND metric = 'gross_margin' AND n <= 2
UNION ALL SELECT 'financials:FURNITURE:available_metrics', 'financial', 'FURNITURE · financials · available_metrics', string_agg(metric, chr(10) ORDER BY metric) FROM (SELECT DISTINCT metric FROM f WHERE ticker = 'FURNITURE')""",
    "fin_tag_choice": """
WITH s AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS ticker, CASE WHEN year(o_orderdate) < 1995 THEN o_orderkey % 3 ELSE o_custkey % 3 END AS chain, last_day(o_orderdate) AS e FROM orders),
a AS (SELECT *, max(e) OVER (PARTITION BY ticker) AS top FROM s),
g AS (SELECT ticker, chain, count(*) FILTER (year(e) >= year(top) - 5) AS recent, count(*) AS n, max(e) AS last FROM a GROUP BY ALL)
SELECT ticker, 'revenue' AS metric, ['RevenueFromContractWithCustomerExcludingAssessedTax', 'Revenues', 'RevenuesNetOfInterestExpense'][chain + 1] AS tag
FROM g QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY recent DESC, n DESC, last DESC, chain) = 1""",
    "fin_periods": """
WITH o AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS e, o_orderkey % 400 AS n, CAST(o_orderkey % 12 + 1 AS INT) AS fye FROM orders),
p AS (SELECT *, CAST(year(e) + CASE WHEN month(e) > fye THEN 1 ELSE 0 END AS INT) AS fy, CAST(((month(e) - fye + 11) % 12) // 3 + 1 AS INT) AS q FROM o)
SELECT o_orderkey, CASE WHEN n BETWEEN 80 AND 100 THEN 'Q' WHEN n BETWEEN 170 AND 190 THEN 'H' WHEN n BETWEEN 260 AND 285 THEN '9M' WHEN n BETWEEN 340 AND 380 THEN 'FY' END AS kind,
  fy, q, 'FY' || fy || 'Q' || q AS label, 'FY' || year(e) || CASE WHEN fye = 1 THEN '' ELSE 'Q' || quarter(e) END AS calendar FROM p""",
    "store_of_orders": f"""
WITH {_OLD}, n AS (SELECT k, s, max(v) AS v FROM new GROUP BY k, s),
up AS (SELECT * FROM n UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = old.k AND n.s = old.s)),
rep AS (
  SELECT k, s, -v AS v FROM new WHERE k % 3 = 0
  UNION ALL SELECT * FROM up WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k % 3 = 0 AND new.k = up.k AND new.s = up.s))
SELECT * FROM rep WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.k % 5 = 0 AND old.k = rep.k AND old.s = rep.s)""",
    "sink_upsert_latest": f"WITH {_OLD}, n AS (SELECT k, s, max(v) AS v FROM new GROUP BY k, s) SELECT * FROM n UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = old.k AND n.s = old.s)",
    "sink_replace_series": f"WITH {_OLD} SELECT k, s, v FROM new UNION ALL SELECT k, s, v FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k = old.k AND new.s = old.s)",
    "sink_merge_columns": f"WITH {_OLD}, n AS (SELECT k, s, round(max(p), 2) AS p FROM new GROUP BY k, s) SELECT k, s, v, p FROM old FULL JOIN n USING (k, s)",
    "sink_skip_existing": f"WITH {_OLD} SELECT k, s, v FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.k = new.k AND old.s = new.s)",
    "sink_known_document": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS source_accn, CAST(c_custkey AS VARCHAR) AS source_doc_id FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey",
}
