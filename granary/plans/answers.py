"""Routing, citation, figure and validation queries: prose composed from columns, so SQL can compose it too."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from granary.operators import answers as A
from granary.operators.routing import route, with_model
from granary.sources.tables import table

ARABIC = "٠١٢٣٤٥٦٧٨٩"
NOW = datetime(2026, 9, 12, 12)
_ASKED = ["What was NVDA revenue last quarter", "Why did JPMorgan revenue decline", "What risk factors does MSFT disclose in its 10-K", "What happened to JPM in the past 3 days", "Compare NVDA and MSFT revenue growth", "Does the recent NVDA news match what they said in the 10-K", "Tell me more"]


def route_queries(spark, d):
    """One of seven questions for each order, followed by the order's number."""
    q = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    asked = table(spark, d, "orders").select("o_orderkey", F.concat(q, F.lit(" #"), F.col("o_orderkey").cast("string")).alias("query"))
    return route(asked, F.lit(NOW)).select("o_orderkey", "route", "method", F.array_join("tickers", ",").alias("tickers"), "date_from", "news_signal", F.col("plan.name").alias("plan"), F.col("plan.metric").alias("metric"), F.col("plan.n_quarters").alias("n_quarters"))


def route_conversations(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return route(asked, F.lit(NOW)).groupBy("route", "method").agg(F.count("*").alias("n"))


def _answers(spark, d):
    k = F.col("o_orderkey")
    price = F.format_string("%.2f", F.round(F.col("o_totalprice"), 2))
    text = F.concat(F.lit("Order value was $"), price, F.lit(" in the period ["), (k % 9).cast("string"), F.lit(", "), (k % 4).cast("string"), F.lit("] , with  priority [3]."))
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"), F.lit(5).alias("n_context"), "o_totalprice", "o_orderstatus")


def citation_check(spark, d):
    rows = A.check_citations(_answers(spark, d))
    return rows.select("o_orderkey", F.array_join("cited", ",").alias("cited"), F.array_join("hallucinated", ",").alias("hallucinated"), "cleaned")


def figure_extract(spark, d):
    """Checkable figures of four kinds of sentences about an order's number, some in digits of another script; a label's
    number is none."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    written = F.when(k % 8 == 1, F.translate(n, "0123456789", ARABIC)).otherwise(n)
    text = F.element_at(F.array(
        F.concat(F.lit("It cost $"), F.format_string("%.2f", F.round("o_totalprice", 2)), F.lit(" then.")),
        F.concat(F.lit("Up "), written, F.lit(" percent, not 7 points.")),
        F.concat(F.lit("About €"), n, F.lit(".5 million of it in 3 plants.")),
        F.concat(F.lit("Section "), n, F.lit(".1 lists 1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" units.")),
    ), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").withColumn("f", F.explode(A.extract_figures(text)))
    return rows.where("f.checkable").select("o_orderkey", F.col("f.raw").alias("raw"), F.round("f.value", 4).alias("value"), F.round("f.half", 6).alias("half"), F.col("f.unscaled").alias("unscaled"))


def _drafts(spark, d):
    """Drafts of seven kinds over two items: an order's value, and prose about storms."""
    k = F.col("o_orderkey")
    price = F.format_string("%.2f", F.round(F.col("o_totalprice"), 2))
    said = lambda tail: F.concat(F.lit("Order value was $"), price, F.lit(f" in the period{tail}"))
    wrong = F.concat(F.lit("Order value was $"), F.format_string("%.2f", F.round(F.col("o_totalprice") * 2 + 7, 2)), F.lit(" in the period [1]."))
    text = F.element_at(F.array(
        said(" [1]."), wrong, said("."), said(" [2]."), F.concat(F.lit("INSUFFICIENT EVIDENCE: "), said(".")), F.concat(F.lit("INSUFFICIENT EVIDENCE: "), wrong),
        F.lit("Pirates boarded several wooden ships nearby [2]."),
    ), (k % 7 + 1).cast("int"))
    item = lambda kind, label, text: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), text.alias("text"))
    evidence = F.array(item("filing", "order", said(" by priority.")), item("filing", "weather", F.lit("Storms delayed the harvest across northern fields.")))
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"), evidence.alias("evidence"), (k % 7).isin(4, 5).alias("refusal"))


def validation_chain(spark, d):
    """Each check decides about some drafts: a seventh each is sound, has a figure of no item, has a figure and no
    citation, cites the wrong item, refuses soundly, smuggles a figure into a refusal, and says what its item doesn't."""
    return A.validate(_drafts(spark, d)).select("o_orderkey", "withheld_by")


def paired_control(spark, d):
    """The chain over the texts of the arm that ran without it."""
    from granary.operators.headlines import paired_control

    return paired_control(_drafts(spark, d).drop("refusal")).groupBy("would_withhold").agg(F.count("*").alias("n"))


def claim_counts(spark, d):
    """Claims of the documents by length and citations."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(A.claim_units(F.col("text"))).alias("u"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("u.text")).alias("chars"))


def answer_rates(spark, d):
    rows = _answers(spark, d).withColumn("refused", A.is_refusal(F.when(F.col("o_orderkey") % 5 == 0, F.lit("There is no mention of it.")).otherwise(F.col("text"))))
    checked = A.check_citations(rows).withColumns({"insufficient": F.col("refused"), "uncited_figure": F.col("o_orderkey") % 10 == 1})
    scored = {"groundedness": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5 + 1), "citation_correctness": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3 + 2), "relevance": F.lit(5)}
    claims = F.when(F.col("o_orderkey") % 8 == 0, F.array(F.lit("x"))).when(F.col("o_orderkey") % 8 == 1, F.array().cast("array<string>"))
    flags = A.contract(checked).withColumns(scored | {"unsupported_claims": claims, "route_correct": F.col("o_orderkey") % 6 != 0})
    return A.answer_rates(flags.withColumnRenamed("o_orderstatus", "category"), [(), ("category",)])


def judge_parse(spark, d):
    raw = F.concat(F.lit('Sure: {"groundedness": '), (F.col("o_orderkey") % 9).cast("string"), F.lit(', "relevance": "x", "unsupported_claims": ["a", " ", "b"], "note": "'), F.col("o_orderstatus"), F.lit('"} done'))
    rows = table(spark, d, "orders").select("o_orderkey", A.parse_judge(F.when(F.col("o_orderkey") % 7 != 0, raw).otherwise(F.lit("none"))).alias("j"))
    return rows.select("o_orderkey", F.col("j.groundedness").alias("groundedness"), F.col("j.relevance").alias("relevance"), F.array_join("j.unsupported_claims", ",").alias("claims"), F.col("j.note").alias("note"))


def numbered_context(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    return A.build_context(rows.select("l_orderkey", "l_linenumber", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("label"), F.concat(F.lit("part "), F.col("p").cast("string")).alias("text")), ["l_orderkey"], ("l_linenumber",))


def evidence_order(spark, d):
    """Contexts of the benchmark items from three stores: figures for even items, two news for every third, three filings."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    q = F.col("query_id").cast("string")

    def store(name: str, rows, n: int):
        one = rows.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n))))
        mark = F.concat(F.lit(f"{name} "), q, F.lit("/"), F.col("rank").cast("string"))
        return one.select("query_id", mark.alias("key"), mark.alias("label"), F.concat(F.lit("text of "), mark).alias("text"), "rank")

    rows = A.gathered(store("figures", items.where("query_id % 2 = 0"), 1), store("news", items.where("query_id % 3 = 0"), 2), store("filing", items, 3))
    return A.build_context(rows, ["query_id"], ("n",))


def model_routes(spark, d):
    """What a model said where no rule decided: a route, two of them, none, or nothing at all."""
    said = F.element_at(F.array(F.lit("FILING_RAG, though it borders on NEWS"), F.lit("rather news, or mixed"), F.lit("cannot say"), F.lit(None).cast("string")), (F.col("conv_id") % 4 + 1).cast("int"))
    asked = table(spark, d, "conversations").where("role = 'user'").withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    routed = route(asked.select("conv_id", "turn", "key", F.col("text").alias("query")), F.lit(NOW))
    return with_model(routed, asked.select("key", said.alias("response")), "key").select("conv_id", "turn", "route", "method")


def routing_log(spark, d):
    from granary.operators.sinks import newest

    log = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("route"))
    return newest(log, 20)


_COMPOSED = """
a AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 9 AS x, o_orderkey % 4 AS y, 'Order value was $' || printf('%.2f', round(o_totalprice, 2)) || ' in the period' AS head FROM orders)"""
_VERDICTS = """
v AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'numeric_consistency' WHEN 5 THEN 'numeric_consistency' WHEN 2 THEN 'citation_coverage' WHEN 3 THEN 'grounding' WHEN 6 THEN 'grounding' END AS withheld_by FROM orders)"""
QUERIES = {f.__name__: f for f in (route_queries, route_conversations, citation_check, figure_extract, validation_chain, paired_control, claim_counts, answer_rates, judge_parse, numbered_context, evidence_order, model_routes, routing_log)}
ORACLES = {
    "route_queries": """
SELECT o_orderkey, route, method, tickers, CAST(date_from AS DATE) AS date_from, news_signal, plan, metric, CAST(n_quarters AS INT) AS n_quarters
FROM orders JOIN (VALUES
  (0, 'NUMERIC', 'rule', 'NVDA', NULL, true, 'latest_metric', 'revenue', NULL),
  (1, 'MIXED', 'rule', 'JPM', NULL, false, 'latest_metric', 'revenue', NULL),
  (2, 'FILING_RAG', 'rule', 'MSFT', NULL, false, NULL, NULL, NULL),
  (3, 'NEWS', 'rule', 'JPM', '2026-09-09', true, NULL, NULL, NULL),
  (4, 'CROSS_SOURCE', 'rule', 'NVDA,MSFT', NULL, false, 'compare_tickers', 'revenue', 4),
  (5, 'CROSS_SOURCE', 'rule', 'NVDA', '2026-08-13', true, 'latest_metric', 'revenue', NULL),
  (6, 'FILING_RAG', 'no_rule_default', '', NULL, false, NULL, NULL, NULL)) v(k, route, method, tickers, date_from, news_signal, plan, metric, n_quarters)
ON o_orderkey % 7 = k""",
    "route_conversations": "SELECT 'FILING_RAG' AS route, 'no_rule_default' AS method, count(*) AS n FROM conversations WHERE role = 'user'",
    "citation_check": f"""
WITH {_COMPOSED}, c AS (SELECT *, list_filter([x, y], lambda n: n BETWEEN 1 AND 5) AS ok, list_filter([x, y], lambda n: n NOT BETWEEN 1 AND 5) AS bad FROM a)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_append(ok, 3))), ',') AS cited, array_to_string(list_sort(list_distinct(bad)), ',') AS hallucinated,
  CASE WHEN len(bad) = 0 THEN head || ' [' || x || ', ' || y || '] , with  priority [3].'
    ELSE head || CASE WHEN len(ok) = 0 THEN '' ELSE ' [' || array_to_string(ok, ', ') || ']' END || ', with priority [3].' END AS cleaned
FROM c""",
    "figure_extract": f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || printf('%.2f', round(o_totalprice, 2)) WHEN 1 THEN CASE WHEN o_orderkey % 8 = 1 THEN translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{ARABIC}') ELSE CAST(o_orderkey AS VARCHAR) END || ' percent' WHEN 2 THEN '€' || o_orderkey || '.5 million' ELSE '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS raw,
  round(CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN o_orderkey WHEN 2 THEN (o_orderkey + 0.5::DOUBLE) * 1e6 ELSE 1000 + o_orderkey % 1000 END, 4) AS value,
  CASE o_orderkey % 4 WHEN 0 THEN 0.005::DOUBLE WHEN 2 THEN 50000.0::DOUBLE ELSE 0.5::DOUBLE END AS half, o_orderkey % 4 <> 2 AS unscaled
FROM orders""",
    "validation_chain": f"WITH {_VERDICTS} SELECT o_orderkey, withheld_by FROM v",
    "paired_control": f"WITH {_VERDICTS} SELECT withheld_by AS would_withhold, count(*) AS n FROM v GROUP BY 1",
    "claim_counts": r"""
WITH lines AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS x FROM documents),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s+', ''), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g') AS x FROM lines),
kept AS (
  SELECT doc_id, regexp_replace(x, '([.!?])\s*((?:\[\d+\]\s*)+)', ' \2\1', 'g') AS x FROM bare
  WHERE regexp_replace(x, '[*_`#\s\p{Z}]', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(x, '[*_`#]', '', 'g'), '(?i)^\s*(facts|interpretation)\s*:?\s*$') AND NOT regexp_matches(regexp_replace(x, '[*_`#]', '', 'g'), ':\s*$')),
cut AS (SELECT doc_id, regexp_replace(regexp_replace(x, '([.!?])(\s+)([A-Z$"(\[])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '(\b(?:[A-Z]|Inc|Corp|Co|Ltd|No)\.)' || chr(1) || '(\s+)' || chr(2), '\1\2', 'g') AS x FROM kept),
units AS (SELECT doc_id, unnest(regexp_split_to_array(x, chr(1) || '\s+' || chr(2))) AS x FROM cut),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\[(\d+(?:\s*,\s*\d+)*)\]', ' ', 'g'), '[*_`#]', '', 'g'), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g') AS t FROM units)
SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM plain
WHERE len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+')) >= 4 AND NOT regexp_matches(t, '(?i)' || $$"""
    + A.ABSENCE
    + """$$)
GROUP BY doc_id""",
    "answer_rates": """
WITH r AS (
  SELECT o_orderstatus AS category, o_orderkey % 5 = 0 AS refused, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 + 1 END AS g,
    (o_orderkey % 9) BETWEEN 1 AND 5 AND (o_orderkey % 4) BETWEEN 1 AND 5 AS clean, o_orderkey % 10 = 1 AS fig,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 + 2 END AS c, o_orderkey % 8 = 0 AS bad, o_orderkey % 6 <> 0 AS rc FROM orders)
SELECT category, count(*) AS n, round(avg(g), 6) AS groundedness, round(avg(c), 6) AS citation_correctness, 5.0::DOUBLE AS relevance, round(avg(CAST(rc AS INT)), 6) AS route_correct, round(avg(CAST(refused AS INT)), 6) AS refused,
  round(avg(CAST(refused OR (clean AND NOT fig) AS INT)), 6) AS compliant, 0.0::DOUBLE AS uncited, count(*) FILTER (bad) AS with_unsupported_claims, round(avg(CAST(bad AS INT)), 6) AS hallucination_rate
FROM r GROUP BY GROUPING SETS ((), (category))""",
    "judge_parse": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(greatest(1, least(5, o_orderkey % 9)) AS INT) END AS groundedness, CAST(NULL AS INT) AS relevance,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'a,b' END AS claims, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS note FROM orders""",
    "numbered_context": """
SELECT l_orderkey, string_agg('[' || n || '] (line ' || l_linenumber || ')' || chr(10) || 'part ' || p, chr(10) || chr(10) ORDER BY n) AS context
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
GROUP BY l_orderkey""",
    "evidence_order": """
WITH e AS (
  SELECT item_id AS q, 0 AS s, 'figures ' || item_id || '/1' AS key FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT item_id, 1, 'news ' || item_id || '/' || r FROM benchmark, range(1, 3) t(r) WHERE item_id % 3 = 0
  UNION ALL SELECT item_id, 2, 'filing ' || item_id || '/' || r FROM benchmark, range(1, 4) t(r)),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, key) AS n FROM e)
SELECT q AS query_id, string_agg('[' || n || '] (' || key || ')' || chr(10) || 'text of ' || key, chr(10) || chr(10) ORDER BY n) AS context FROM n GROUP BY q""",
    "model_routes": """
SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN 'NEWS' ELSE 'FILING_RAG' END AS route, CASE conv_id % 4 WHEN 2 THEN 'llm_invalid' WHEN 3 THEN 'llm_unavailable' ELSE 'llm' END AS method
FROM conversations WHERE role = 'user'""",
    "routing_log": "SELECT event_id AS id, ts, event_type AS route FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
}


def headline_gate(spark, d):
    """Summaries composed of orders, with claims of every kind in one of 3 to 17 of them."""
    from granary.operators.headlines import DECLINE, gate

    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("Chip maker opens plant in Texas [1]. "),
        F.when(k % 4 == 0, F.lit("Sales rose 4711 percent. ")).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit("Rivals suffered because of tariffs elsewhere. ")).otherwise(F.lit("")),
        F.when(k % 7 == 0, F.lit("Traders abroad expect lower margins. ")).otherwise(F.lit("")),
        F.when(k % 11 == 0, F.lit("The step is likely of use to rivals. ")).otherwise(F.lit("")),
        F.when(k % 13 == 0, F.lit("So says [9]. ")).otherwise(F.lit("")),
        F.when(k % 17 == 0, F.lit("Residue to be cleaned, based on the headlines. Sales fell due to tariffs. ")).otherwise(F.lit("")),
        F.when(k % 5 != 0, F.lit(DECLINE)).otherwise(F.lit("")),
    )
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("summary"), F.array(F.lit("Chip maker opens plant in Texas")).alias("headlines"), F.array(F.to_date("o_orderdate")).alias("days"))
    return gate(rows).select("o_orderkey", F.array_join("violations", ",").alias("violations"), "declined")


def validation_ab(spark, d):
    """Two arms over the orders: without the chain, and with it, which withholds what it fails."""
    from granary.operators.headlines import arms, compare_arms

    rows = _answers(spark, d).withColumn("id", F.col("o_orderkey")).withColumn("category", F.when(F.col("id") % 6 == 0, "insufficient_evidence").otherwise("numeric"))
    good = F.col("id") % 4 != 0
    off = rows.select("id", "category", good.alias("compliant"), (F.col("id") % 12 == 0).alias("refused"), F.lit(None).cast("string").alias("withheld_by"))
    by = F.when(F.col("id") % 8 == 0, "numeric_consistency").when(F.col("id") % 8 == 4, "citation_coverage")
    on = rows.where("id % 10 != 3").select("id", "category", F.lit(True).alias("compliant"), ((F.col("id") % 12 == 0) | by.isNotNull()).alias("refused"), by.alias("withheld_by"))
    return compare_arms(arms(off, on))


QUERIES |= {f.__name__: f for f in (headline_gate, validation_ab)}
ORACLES |= {
    "headline_gate": """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'invented figure' END, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported attribution' END, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 17 = 0 THEN 'asserted cause' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'unsupported projection' END, CASE WHEN o_orderkey % 13 = 0 THEN 'bad citation' END, CASE WHEN o_orderkey % 5 = 0 THEN 'does not decline' END) AS violations,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS INT) AS declined FROM orders""",
    "validation_ab": """
WITH p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 3),
r AS (
  SELECT 'off' AS arm, id, id % 4 <> 0 AS compliant, id % 12 = 0 AS refused, CAST(NULL AS VARCHAR) AS w FROM p
  UNION ALL SELECT 'on', id, true, id % 12 = 0 OR id % 4 = 0, CASE id % 8 WHEN 0 THEN 'numeric_consistency' WHEN 4 THEN 'citation_coverage' END FROM p)
SELECT arm, count(*) AS n, count(*) FILTER (compliant) AS compliant, count(*) FILTER (refused) AS refused, count(*) FILTER (refused AND id % 6 <> 0) AS refused_answerable, count(w) AS withheld,
  count(*) FILTER (w = 'numeric_consistency') AS numeric_consistency, count(*) FILTER (w = 'citation_coverage') AS citation_coverage, count(*) FILTER (w = 'grounding') AS grounding
FROM r GROUP BY arm""",
}
