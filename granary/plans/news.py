"""News queries. Events stand for articles: event_type for the company, user for the source, the value's range for the topic.

An article belongs to the event of its day and hour of the kind; every fifth article is a copy of the one before.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.text import display_headline, names_company, normal_headline, topic
from granary.operators import news as N
from granary.sources import feeds
from granary.sources.landing import landed
from granary.sources.tables import table

SINCE = datetime(2024, 1, 20)


def articles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hour = F.floor(F.hour("ts") / 6)
    return e.select(
        F.concat(F.lit("a"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("article_id"),
        F.col("event_type").alias("ticker"),
        F.concat(F.lit("Value "), F.floor("value").cast("string"), F.lit(" seen by "), F.col("user_id").cast("string"), F.lit(" - Wire")).alias("headline"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("s"), (F.col("user_id") % 23).cast("string"))).alias("source"),
        F.col("ts").alias("published_at"),
        F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").when(F.col("value") < 60, "high").alias("topic"),
        F.when(F.col("event_id") % 7 != 0, F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd"), F.lit("-"), hour.cast("string"))).alias("event_id"),
        (F.col("event_id") % 5 == 4).alias("is_duplicate"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("text"),
    )


def news_event_rollup(spark, d):
    return N.rollup(articles(spark, d)).withColumn("sources", F.array_join("sources", ",")).drop("first_at")


def news_ranked_events(spark, d):
    recent = articles(spark, d).where(F.col("published_at") >= F.lit(SINCE))
    return N.rank_events(N.rollup(recent)).select("ticker", "rank", "event_id", "score", "topic")


def news_window_top8(spark, d):
    return N.latest_articles(N.window(articles(spark, d), "click", SINCE)).select("article_id", "source", "published_at")


def news_summaries(spark, d):
    rows = articles(spark, d)
    return N.summaries(N.rank_events(N.rollup(rows), 3), rows)


def news_context(spark, d):
    return N.context_lines(articles(spark, d).where("event_id is not null"))


def news_counts(spark, d):
    return articles(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.count_distinct("source").alias("sources"))


def exact_dedup_first(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return N.first_of_each(docs, ["text"], "source", "doc_id").select("doc_id", "source")


def near_dup_edges(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return N.near_pairs(v, 0.35, "label")


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("ticker"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("article_id"), F.col("vec_id").alias("published_at"), F.when(F.col("vec_id") % 3 == 0, F.lit("https://news.google.com/x")).otherwise(F.lit("https://example.com/x")).alias("url"), F.col("embedding").alias("vector"))


def near_dup_greedy(spark, d):
    return N.mark_copies(_vectors(spark, d), 0.35).select("ticker", "article_id", "is_duplicate", "duplicate_of")


def cluster_events(spark, d):
    marked = landed(N.mark_copies(_vectors(spark, d), 0.40))
    return N.cluster_events(marked, 0.30).select("ticker", "article_id", "event_id", "duplicate_of")


def _items(spark, d):
    """Feed items of the events: three feeds, urls that come again, some with spaces around them, headlines of which a
    quarter don't name the company."""
    k = F.col("event_id")
    blank = F.when(F.floor(k / 40) % 2 == 1, F.lit(" \t")).otherwise(F.lit(""))
    feed = (k % 3).cast("int")
    return table(spark, d, "events").select(
        F.col("event_type").alias("ticker"), F.element_at(F.array(F.lit("ir"), F.lit("yahoo"), F.lit("google")), feed + 1).alias("feed"), feed.alias("feed_order"), k.alias("pos"),
        F.when(k % 17 != 0, F.concat(blank, F.lit("https://example.com/"), (k % 40).cast("string"), blank)).alias("url"),
        F.when(k % 4 != 0, F.concat(F.lit("All about "), "event_type", F.lit(" revenue"))).otherwise("All about others").alias("headline"),
        F.when(k % 5 != 0, F.lit("Wire")).otherwise("").alias("source"), F.col("ts").alias("published_at"), "value",
    )


def _collected(spark, d):
    return N.collect(_items(spark, d), FEED_SINCE)


def news_collect(spark, d):
    return _collected(spark, d).select("ticker", "feed", "pos", "url", "source", "topic", "article_id")


def _feeds(spark, d):
    """Feed documents made of the events, up to 60 of a kind in each: RSS and Atom in turn. Titles stand as CDATA or escaped,
    some items have no publisher, and every 13th no date that is one."""
    k, even = F.col("event_id"), F.col("event_id") % 2 == 0
    shown = F.concat(F.lit("Q&A <"), k.cast("string"), F.lit("> on "), "event_type")
    escaped = F.replace(F.replace(shown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.when(even, F.concat(F.lit("<title><![CDATA["), shown, F.lit("]]></title>"))).otherwise(F.concat(F.lit("<title> "), escaped, F.lit("</title>")))
    link = F.concat(F.lit("https://example.com/?id="), k.cast("string"), F.lit("&amp;v=1"))
    rss_date = F.when(k % 13 == 0, F.lit("soon")).when(even, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "d MMM yy HH:mm:ss"), F.lit(" +0200")))
    atom_date = F.when(k % 13 == 0, F.lit("")).when(even, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(F.concat(F.date_format(F.col("ts") - F.expr("interval 5 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
    named = F.col("user_id") % 11 != 0
    who = F.concat(F.lit("s"), (F.col("user_id") % 23).cast("string"))
    none = F.lit("")
    rss = F.concat(F.lit("<item>"), title, F.lit("<link> "), link, F.lit(" </link>"), F.when(named, F.concat(F.lit('<source url="https://example.com">'), who, F.lit("</source>"))).otherwise(none), F.lit("<pubDate>"), rss_date, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry>"), title, F.lit('<link rel="self" href="https://example.com/feed"/><link rel="alternate" href="'), link, F.lit('"/>'), F.when(named, F.concat(F.lit("<source><title>"), who, F.lit("</title></source>"))).otherwise(none), F.lit("<published>"), atom_date, F.lit("</published></entry>"))
    part = F.floor(k / 60)
    rows = table(spark, d, "events").select(F.col("event_type").alias("ticker"), part.alias("part"), F.struct(k.alias("k"), F.when(part % 2 == 0, rss).otherwise(atom).alias("x")).alias("i"))
    whole = rows.groupBy("ticker", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "\n").alias("body"))
    xml = F.when(F.col("part") % 2 == 0, F.concat(F.lit('<rss version="2.0"><channel><title>all</title>'), "body", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>'), "body", F.lit("</feed>")))
    return whole.select("ticker", "part", xml.alias("xml"))


def feed_items(spark, d):
    return feeds.items(_feeds(spark, d)).withColumn("at", F.unix_timestamp("published_at").cast("string")).drop("published_at")


def feed_histogram(spark, d):
    return N.feed_histogram(_collected(spark, d))


def article_bodies(spark, d):
    """Bodies that were fetched for three urls in four; redirects of the second feed have none."""
    rows = _collected(spark, d).withColumn("url", F.when(F.col("feed") == "yahoo", F.concat(F.lit("https://news.google.com/"), "pos")).otherwise(F.col("url")))
    bodies = rows.select("url").distinct().where(F.length("url") % 4 != 0).withColumn("text", F.concat(F.lit("body of "), "url"))
    return N.with_bodies(rows, bodies).select("ticker", "feed", "pos", "url", "text")


def normalized_vectors(spark, d):
    """Vectors three times as long, normalized again."""
    from granary.operators.retrieval import norm, normalized

    rows = table(spark, d, "embeddings").select("vec_id", normalized(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.round(norm(F.col("v")), 6).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


FEED_SINCE = datetime(2024, 1, 1)
HEADLINES = [
    ("NVDA", "Nvidia's $279 Billion Bet Changes Everything (NASDAQ:NVDA) - Seeking Alpha"),
    ("NVDA", "Nvidia"),
    ("NVDA", "China export rules hit chip makers - Reuters"),
    ("MSFT", "Microsoft beats on revenue; MSFT upgrade"),
    ("JPM", "JPMorgan Chase faces probe - WSJ"),
    ("JPM", "Markets close flat"),
    ("XYZ", "xyz wins merger vote - Bloomberg News"),
]


def headline_functions(spark, d):
    """All headline functions over the headlines, each joined to every source of the documents."""
    heads = F.array(*(F.struct(F.lit(t).alias("ticker"), F.lit(h).alias("headline")) for t, h in HEADLINES))
    rows = table(spark, d, "documents").select("source").distinct().select("source", F.inline(heads))
    h, t = F.col("headline"), F.col("ticker")
    normal = normal_headline(h, "XYZ")
    for name in ("NVDA", "MSFT", "JPM"):
        normal = F.when(t == name, normal_headline(h, name)).otherwise(normal)
    return rows.select("source", "ticker", "headline", normal.alias("normal"), display_headline(h).alias("shown"), topic(h).alias("topic"), names_company(h, t).alias("relevant"))


_ARTICLES = """
a AS (
  SELECT 'a' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS article_id, event_type AS ticker,
    'Value ' || CAST(floor(value) AS BIGINT) || ' seen by ' || user_id AS shown,
    CASE WHEN user_id % 11 <> 0 THEN 's' || (user_id % 23) END AS source, ts AS published_at,
    CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' WHEN value < 60 THEN 'high' END AS topic,
    CASE WHEN event_id % 7 <> 0 THEN event_type || '-' || strftime(ts, '%Y%m%d') || '-' || (hour(ts) // 6) END AS ev,
    event_id % 5 = 4 AS dup, CASE WHEN event_id % 3 = 0 THEN props END AS text
  FROM events)"""
_EVENTS = """
e AS (SELECT *, coalesce(ev, 'unclustered-' || article_id) AS event_id FROM a WHERE {cond}),
modal AS (SELECT ticker, event_id, topic FROM (SELECT ticker, event_id, topic, row_number() OVER (PARTITION BY ticker, event_id ORDER BY count(*) DESC, topic) AS r FROM e WHERE NOT dup AND topic IS NOT NULL GROUP BY ticker, event_id, topic) WHERE r = 1),
ro AS (
  SELECT ticker, event_id, count(*) FILTER (NOT dup) AS n_live, count(*) FILTER (dup) AS n_duplicates,
    list_sort(coalesce(list(DISTINCT source) FILTER (NOT dup AND source IS NOT NULL), [])) AS src, min(published_at) FILTER (NOT dup) AS first_at,
    CAST(min(published_at) FILTER (NOT dup) AS DATE) AS first_day, CAST(max(published_at) FILTER (NOT dup) AS DATE) AS last_day,
    arg_min(article_id, row(published_at, article_id)) FILTER (NOT dup) AS primary_id
  FROM e GROUP BY ticker, event_id HAVING count(*) FILTER (NOT dup) > 0),
r AS (SELECT *, len(src) + 0.25::DOUBLE * least(n_live, 3) AS score FROM ro LEFT JOIN modal USING (ticker, event_id))"""
_ALL = _EVENTS.format(cond="true")
_COLLECTED = """
it AS (
  SELECT event_type AS ticker, ['ir', 'yahoo', 'google'][event_id % 3 + 1] AS feed, event_id % 3 AS feed_order, event_id AS pos, CASE WHEN event_id % 17 <> 0 THEN 'https://example.com/' || (event_id % 40) END AS url,
    event_id % 4 <> 0 AS named, CASE WHEN event_id % 5 <> 0 THEN 'Wire' ELSE ['ir', 'yahoo', 'google'][event_id % 3 + 1] END AS source, ts FROM events),
top AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY ticker, feed ORDER BY pos) <= 60),
got AS (
  SELECT ticker, feed, pos, url, source, CASE WHEN named THEN 'earnings' END AS topic FROM top WHERE url IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' AND (named OR feed = 'ir')
  QUALIFY row_number() OVER (PARTITION BY ticker, url ORDER BY feed_order, pos) = 1)"""

QUERIES = {f.__name__: f for f in (news_event_rollup, news_ranked_events, news_window_top8, news_summaries, news_context, news_counts, exact_dedup_first, near_dup_edges, near_dup_greedy, cluster_events, headline_functions, news_collect, feed_items, feed_histogram, article_bodies, normalized_vectors)}
ORACLES = {
    "news_event_rollup": f"WITH {_ARTICLES}, {_ALL} SELECT ticker, event_id, n_live, n_duplicates, array_to_string(src, ',') AS sources, first_day, last_day, primary_id, score, topic FROM r",
    "news_ranked_events": f"WITH {_ARTICLES}, {_EVENTS.format(cond='published_at >= TIMESTAMP ' + repr('2024-01-20'))} SELECT ticker, CAST(row_number() OVER w AS INT) AS rank, event_id, score, topic FROM r WINDOW w AS (PARTITION BY ticker ORDER BY score DESC, first_at, event_id) QUALIFY row_number() OVER w <= 5",
    "news_window_top8": f"WITH {_ARTICLES} SELECT article_id, source, published_at FROM a WHERE ticker = 'click' AND published_at >= TIMESTAMP '2024-01-20' AND NOT dup ORDER BY published_at DESC, article_id LIMIT 8",
    "news_summaries": f"""
WITH {_ARTICLES}, {_ALL},
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score DESC, first_at, event_id) <= 3),
heads AS (
  SELECT ticker, event_id, min(shown) FILTER (n = 1) AS head, coalesce(min(source) FILTER (n = 1), 'unknown') AS who, string_agg(shown, '; ' ORDER BY n) FILTER (n IN (2, 3)) AS others
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, event_id ORDER BY published_at, article_id) AS n FROM e WHERE NOT dup) GROUP BY ticker, event_id)
SELECT ticker, event_id, head || ' (' || who || ', ' || first_day || CASE WHEN first_day <> last_day THEN ' to ' || last_day ELSE '' END || ').'
  || coalesce(' Also reported: ' || others || '.', '') || ' Covered by ' || len(src) || ' source(s): ' || array_to_string(src[1:6], ', ')
  || CASE WHEN n_duplicates > 0 THEN '; ' || n_duplicates || ' near-duplicate repost(s) suppressed.' ELSE '.' END AS summary
FROM top JOIN heads USING (ticker, event_id)""",
    "news_context": f"""
WITH {_ARTICLES}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker, ev ORDER BY published_at, article_id) AS n FROM a WHERE ev IS NOT NULL AND NOT dup)
SELECT ticker, ev AS event_id, CAST(n AS INT) AS n, '[' || n || '] (' || CAST(published_at AS DATE) || ', ' || coalesce(source, 'unknown') || ')' ||
  CASE WHEN trim(coalesce(text, '')) = '' THEN ' HEADLINE ONLY — no body text available.' || chr(10) || '    Headline: ' || shown || ' - Wire'
  ELSE ' FULL TEXT' || chr(10) || '    Headline: ' || shown || ' - Wire' || chr(10) || '    Body: ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:1500] END AS line
FROM n""",
    "news_counts": f"WITH {_ARTICLES} SELECT ticker, count(*) AS n, count(DISTINCT ev) AS events, count(DISTINCT source) AS sources FROM a GROUP BY ticker",
    "exact_dedup_first": "SELECT doc_id, source FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1",
    "near_dup_edges": """
SELECT * FROM (
  SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE sim >= 0.35""",
    "headline_functions": """
WITH h(ticker, headline, normal, shown, topic, relevant) AS (VALUES
  ('NVDA', 'Nvidia''s $279 Billion Bet Changes Everything (NASDAQ:NVDA) - Seeking Alpha', '''s $279 Billion Bet Changes Everything', 'Nvidia''s $279 Billion Bet Changes Everything (NASDAQ:NVDA)', NULL, true),
  ('NVDA', 'Nvidia', 'Nvidia', 'Nvidia', NULL, true),
  ('NVDA', 'China export rules hit chip makers - Reuters', 'China export rules hit chip makers', 'China export rules hit chip makers', 'product', false),
  ('MSFT', 'Microsoft beats on revenue; MSFT upgrade', 'beats on revenue; upgrade', 'Microsoft beats on revenue; MSFT upgrade', 'earnings', true),
  ('JPM', 'JPMorgan Chase faces probe - WSJ', 'Chase faces probe', 'JPMorgan Chase faces probe', 'regulatory', true),
  ('JPM', 'Markets close flat', 'Markets close flat', 'Markets close flat', NULL, false),
  ('XYZ', 'xyz wins merger vote - Bloomberg News', 'wins merger vote', 'xyz wins merger vote', 'deal', true))
SELECT s.source, h.* FROM h CROSS JOIN (SELECT DISTINCT source FROM documents) s""",
    "news_collect": f"WITH {_COLLECTED} SELECT ticker, feed, pos, url, source, topic, sha1(url) AS article_id FROM got",
    "feed_items": """
SELECT event_type AS ticker, event_id // 60 AS part, CAST(row_number() OVER (PARTITION BY event_type, event_id // 60 ORDER BY event_id) - 1 AS INT) AS pos,
  'https://example.com/?id=' || event_id || '&v=1' AS url, 'Q&A <' || event_id || '> on ' || event_type AS headline,
  CASE WHEN user_id % 11 <> 0 THEN 's' || (user_id % 23) END AS source, CASE WHEN event_id % 13 <> 0 THEN CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS VARCHAR) END AS at
FROM events""",
    "feed_histogram": f"WITH {_COLLECTED} SELECT ticker, feed, count(*) AS n FROM got GROUP BY ALL",
    "article_bodies": f"""
WITH {_COLLECTED}, r AS (SELECT ticker, feed, pos, CASE WHEN feed = 'yahoo' THEN 'https://news.google.com/' || pos ELSE url END AS url FROM got)
SELECT ticker, feed, pos, url, CASE WHEN feed <> 'yahoo' AND length(url) % 4 <> 0 THEN 'body of ' || url END AS text FROM r""",
    "normalized_vectors": """
WITH n AS (SELECT vec_id, embedding[1] AS x, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
SELECT vec_id, 1.0::DOUBLE AS length, round(x / n, 6) AS first FROM n""",
    "near_dup_greedy": """
WITH RECURSIVE v AS (
  SELECT 'l' || label AS ticker, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, vec_id % 3 = 0 AS red, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT ticker, k, [{'id': id, 'red': red, 'e': e}] AS stay, [{'id': id, 'of': id}] AS lead FROM v WHERE k = 1
  UNION ALL
  SELECT ticker, k,
    CASE WHEN NOT copied THEN list_append(stay, me) WHEN near.red AND NOT me.red THEN list_append(list_filter(stay, lambda x: x.id <> near.id), me) ELSE stay END,
    CASE WHEN NOT copied THEN list_append(lead, {'id': me.id, 'of': me.id})
      WHEN near.red AND NOT me.red THEN list_append(list_transform(lead, lambda x: {'id': x.id, 'of': CASE WHEN x.of = near.id THEN me.id ELSE x.of END}), {'id': me.id, 'of': me.id})
      ELSE list_append(lead, {'id': me.id, 'of': near.id}) END
  FROM (
    SELECT ticker, k, stay, lead, me, list_max(sims) > 0 AND list_max(sims) >= 0.35 AS copied, stay[list_position(sims, list_max(sims))] AS near
    FROM (
      SELECT s.ticker, v.k, s.stay, s.lead, {'id': v.id, 'red': v.red, 'e': v.e} AS me, list_transform(s.stay, lambda x: list_dot_product(x.e, v.e)) AS sims
      FROM s JOIN v ON s.ticker = v.ticker AND v.k = s.k + 1)))
SELECT ticker, x.id AS article_id, x.of <> x.id AS is_duplicate, CASE WHEN x.of <> x.id THEN x.of END AS duplicate_of
FROM (SELECT ticker, unnest(lead) AS x FROM s QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) = 1)""",
}
