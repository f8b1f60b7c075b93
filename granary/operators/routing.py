"""Rule routing of a whole table of questions: one CASE over signal columns, no model and no clock but `now`."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from granary.config import COMPANIES
from granary.functions.text import free_name

#: The words of each signal, as patterns.
SIGNALS = {
    "numeric": r"\b(revenue|sales|eps|earnings per share|margin|operating income|gross profit|growth|grew|declined|how much|how many|what was|qoq|yoy|quarter over quarter|year over year)\b",
    "news": r"\b(news|headlines?|announced?|announcement|press release|what happened|happening|going on|developments?|coverage)\b",
    "filing": r"\b(10-?[kq]|8-?k|filings?|filed|annual report|quarterly report|quarterly filing|annual filing|risk factors?|md&a|management (said|discuss)|earnings call|prepared remarks|commentary|disclosed?|outlook|guidance|strategy|competition|segments?)\b",
    "narrative": r"\b(why|explain|reason|driver|drivers|cause|caused|because|how come|what drove|attribut\w+|commentary|context)\b",
    "reconcile": r"\b(match|consistent with|compared to what|reconcile|agree with|contradict|versus what|against what|say the same)\b",
    "compare": r"\b(compare|versus|vs\.?|against|between|which of)\b",
}
#: Metrics by the words for them, days of relative phrases in order, days of units.
METRIC_WORDS = {
    "revenue": "revenue", "sales": "revenue", "top line": "revenue", "eps": "eps_diluted", "earnings per share": "eps_diluted",
    "operating income": "operating_income", "operating profit": "operating_income", "gross margin": "gross_margin", "margin": "gross_margin",
}
RELATIVE_DAYS = {
    "today": 1, "yesterday": 2, "this week": 7, "last week": 7, "past week": 7, "last 7 days": 7, "last month": 30,
    "past month": 30, "last quarter": 120, "recently": 30, "recent": 30, "latest": 30,
}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30}
_N_UNITS = r"(?i)\b(?:last|past)\s+(\d+)\s+(day|week|month)s?\b"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def word(text: Column, phrase: str) -> Column:
    return matches(text, rf"\b{re.escape(phrase)}\b")


def tickers(text: Column) -> Column:
    """Companies named by symbol or alias as whole words, in the configuration's order."""
    named = [F.when(matches(text, r"\b(" + "|".join(map(re.escape, dict.fromkeys([t.lower(), *names]))) + r")\b"), F.lit(t)) for t, names in COMPANIES.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def window_days(text: Column) -> Column:
    """Days that a relative phrase means: 'last N units' before the table's phrases; null without one."""
    n, unit = F.regexp_extract(text, _N_UNITS, 1), F.lower(F.regexp_extract(text, _N_UNITS, 2))
    days = F.coalesce(*(F.when(unit == u, F.lit(d)) for u, d in UNIT_DAYS.items()))
    said = F.when(n != "", n.try_cast("int") * days)
    return F.coalesce(said, *(F.when(word(text, phrase), F.lit(d)) for phrase, d in RELATIVE_DAYS.items()))


def metric(text: Column) -> Column:
    """The metric of the longest phrase that stands in the text, the first metric by name of equally long ones."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(p)), F.struct(F.lit(-len(p)).alias("n"), F.lit(m).alias("m"))) for p, m in METRIC_WORDS.items()]
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull())).getField("m")


def plan(text: Column, who: Column) -> Column:
    """The canned query and its parameters; null without a ticker."""
    m = F.coalesce(metric(text), F.lit("revenue"))
    said = F.regexp_extract(text, r"(?i)\b(?:last|past)\s+(\d+)\s+quarters?\b", 1)
    n = F.coalesce(F.nullif(said, F.lit("")).try_cast("int"), F.lit(4))
    name = (
        F.when(F.size(who) > 1, "compare_tickers")
        .when(matches(text, r"\b(yoy|year over year|year-over-year|vs last year)\b"), "yoy_growth")
        .when(matches(text, r"\b(qoq|quarter over quarter|quarter-over-quarter|sequential)\b"), "qoq_growth")
        .when(m == "gross_margin", "margin_trend")
        .when(matches(text, r"\b(latest|most recent|last reported)\b"), "latest_metric")
        .when(matches(text, r"\b(chang\w+|trend|over the last|history)\b"), "metric_series")
        .otherwise("latest_metric")
    )
    quarters = F.when(name == "margin_trend", F.greatest(n, F.lit(8))).when(name != "latest_metric", n)
    return F.when(F.size(who) > 0, F.struct(name.alias("name"), who.alias("tickers"), F.when(name != "margin_trend", m).alias("metric"), quarters.alias("n_quarters")))


#: The routes, as a model may name them.
ROUTES = ("NUMERIC", "FILING_RAG", "NEWS", "MIXED", "CROSS_SOURCE")


def labelled_route(response: Column) -> Column:
    """The route whose name stands first in a model's response, whatever the case; null where none does."""
    low = F.upper(F.trim(response))
    places = F.array(*(F.struct(F.instr(low, r).alias("at"), F.lit(r).alias("route")) for r in ROUTES))
    return F.array_min(F.filter(places, lambda p: p["at"] > 0)).getField("route")


def with_model(routed: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Routed questions in which a model decides where no rule did. responses: (key, response); null: unavailable.

    method becomes llm where the response names a route, llm_invalid where it names none, and llm_unavailable where there
    is no response; the route of the last two stays FILING_RAG. Other columns stay, whatever they are called.
    """
    said = free_name("said", [*routed.columns, key])
    asked = routed.join(responses.select(key, F.col("response").alias(said)), key, "left")
    named = labelled_route(F.col(said))
    method = F.when(F.col(said).isNull(), "llm_unavailable").when(named.isNull(), "llm_invalid").otherwise("llm")
    open_ = F.col("method") == "no_rule_default"
    out = {"route": F.when(open_, F.coalesce(named, F.lit("FILING_RAG"))).otherwise(F.col("route")), "method": F.when(open_, method).otherwise(F.col("method"))}
    return asked.withColumns(out).drop(said)


def route(questions: DataFrame, now: Column, query: str = "query") -> DataFrame:
    """questions with tickers, window_days, date_from, news_signal, method, route and plan; other columns stay as they are.

    Where no rule decides, the route is FILING_RAG and the method no_rule_default; the model's seam is outside plans.
    date_from bounds only NEWS and CROSS_SOURCE.
    """
    text = F.coalesce(F.col(query), F.lit(""))
    held = free_name("signals", questions.columns)
    found = F.struct(*(matches(text, p).alias(name) for name, p in SIGNALS.items()), tickers(text).alias("tickers"), window_days(text).alias("window_days"))
    numeric, news, filing, narrative, reconcile, compare, named, days = (F.col(held)[c] for c in ("numeric", "news", "filing", "narrative", "reconcile", "compare", "tickers", "window_days"))
    several, recent = F.size(named) > 1, days.isNotNull()
    rule = (
        F.when(reconcile & (news | filing), "CROSS_SOURCE")
        .when(several & (compare | numeric | filing | news), "CROSS_SOURCE")
        .when(numeric & (narrative | filing), "MIXED")
        .when(numeric & ~news, "NUMERIC")
        .when(news | (recent & ~filing), "NEWS")
        .when(filing, "FILING_RAG")
    )
    chosen = F.coalesce(rule, F.lit("FILING_RAG"))
    out = {
        "tickers": named,
        "window_days": days,
        "route": chosen,
        "method": F.when(rule.isNull(), "no_rule_default").otherwise("rule"),
        "date_from": F.when(chosen.isin("NEWS", "CROSS_SOURCE"), F.date_sub(F.to_date(now), days)),
        "plan": F.when(chosen.isin("NUMERIC", "MIXED", "CROSS_SOURCE"), plan(text, named)),
        "news_signal": news | recent,
    }
    return questions.withColumn(held, found).withColumns(out).drop(held)
