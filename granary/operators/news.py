"""News: collection, near-duplicates, events, ranking and extractive summaries."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.config import DUPLICATE_SIMILARITY, EVENT_SIMILARITY, MAX_PER_FEED
from granary.functions.text import article_id, display_headline, is_redirect, names_company, source_or, strip, topic
from granary.operators.retrieval import normalized
from granary.operators.similar import BLOCK, MOST, copies, linked
from granary.sources.landing import landed


def _number(df: DataFrame) -> str:
    """A column name that df doesn't have."""
    name = "nth"
    while name in df.columns:
        name = f"_{name}"
    return name


def _numbered(df: DataFrame, number: Column) -> DataFrame:
    return df.withColumn(_number(df), number)


def collect(items: DataFrame, since: datetime, most: int = MAX_PER_FEED) -> DataFrame:
    """Feed items -> articles: the first of each feed, valid, recent, about the company, the first of each url.

    items: ticker, feed, feed_order, pos, url, headline, source, published_at. First-party feeds ('ir') are always
    about their company. Urls and headlines lose white space at their ends before anything looks at them. Urls are first
    seen in order of feed and position.
    """
    own = items.columns
    items = items.withColumns({"url": strip(F.col("url")), "headline": strip(F.col("headline"))})
    nth = F.row_number().over(Window.partitionBy("ticker", "feed").orderBy("pos"))
    kept = _numbered(items, nth).where(F.col(_number(items)) <= most).select(*own).where(
        (F.coalesce("url", F.lit("")) != "") & (F.coalesce("headline", F.lit("")) != "") & (F.col("published_at") >= F.lit(since)) & ((F.col("feed") == "ir") | names_company(F.col("headline"), F.col("ticker")))
    )
    seen = F.row_number().over(Window.partitionBy("ticker", "url").orderBy("feed_order", "pos"))
    kept = _numbered(kept, seen).where(F.col(_number(kept)) == 1).select(*own)
    return kept.withColumn("article_id", article_id(F.col("url"))).withColumn("topic", topic(F.col("headline"))).withColumn("source", source_or(F.col("source"), F.col("feed")))


def with_bodies(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Articles with fetched bodies; redirecting links have none."""
    found = bodies.where(~is_redirect(F.col("url"))).select("url", "text")
    return articles.drop("text").join(found, "url", "left")


def first_of_each(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Exact duplicates: the first row of each key in a total order."""
    return _numbered(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(_number(df)) == 1).drop(_number(df))


def near_pairs(vectors: DataFrame, threshold: float, group: str | None = None, block: int = 1500) -> DataFrame:
    """(a, b, sim) of pairs of one group that are at least this similar, a < b. vectors: id, vector (unit length).

    Each group is cut into blocks of about `block` rows by hash, and every two blocks of a group meet once, so a task holds
    two blocks however large the group is. A matrix product finds candidates; their sums are taken again in element order.
    """
    spark = vectors.sparkSession
    key = F.col(group) if group else F.lit(0)
    rows = vectors.select(key.alias("__g"), "id", F.col("vector").cast("array<double>").alias("v")).where(F.col("__g").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    rows = rows.withColumn("__d", F.size("v")).where("__d > 0")
    sizes = rows.groupBy("__g", "__d").agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    rows = rows.join(sizes, ["__g", "__d"]).withColumn("__k", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumns({"__i": F.least("__k", "__o"), "__j": F.greatest("__k", "__o")})
    id_type, group_type = vectors.schema["id"].dataType.simpleString(), rows.schema["__g"].dataType.simpleString()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["__k"] == pdf["__i"]], pdf[pdf["__k"] == pdf["__j"]]
        same = pdf["__i"].iat[0] == pdf["__j"].iat[0]
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        v, w = (np.stack(side["v"].to_list()) if len(side) else np.zeros((0, int(pdf["__d"].iat[0]))) for side in (left, right))
        found = ~(v @ w.T < threshold - 1e-5)  # not a number is no reason to drop a pair
        a, b = np.nonzero(np.triu(found, 1) if same else found)
        sim = np.zeros(len(a))
        for k in range(v.shape[1]):
            sim += v[a, k] * w[b, k]
        return pd.DataFrame({"__g": np.repeat(pdf["__g"].iat[0], len(a)), "x": ids[a], "y": others[b], "sim": sim})

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("__g", "__d", "__i", "__j", "__k", "id", "v").repartition(partitions, "__g", "__d", "__i", "__j")
    pairs = met.groupBy("__g", "__d", "__i", "__j").applyInPandas(meet, f"__g {group_type}, x {id_type}, y {id_type}, sim double")
    keys = [F.col("__g").alias(group)] if group else []
    return pairs.where("x <> y").select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("sim", 6).alias("sim")).where(F.col("sim") >= threshold)


def greedy_leaders(vectors: np.ndarray, redirects: list[bool], threshold: float) -> list[int]:
    """For items from oldest to newest, the item each is a copy of, itself where it stays.

    An item is compared with those that stay; it is a copy of the most similar (the earliest to have come to stay of
    equals) at or above the threshold. A copy that can be resolved takes the place of a redirecting original, with all
    its copies: the original then points to it, and pointers are followed at the end.
    """
    points, stay = np.arange(len(vectors)), []
    for k in range(len(vectors)):
        sims = vectors[stay] @ vectors[k] if stay else np.zeros(0)
        best = int(sims.argmax()) if len(sims) else -1
        if best < 0 or sims[best] <= 0 or sims[best] < threshold:
            stay.append(k)
        elif redirects[stay[best]] and not redirects[k]:
            points[stay.pop(best)] = k
            stay.append(k)
        else:
            points[k] = stay[best]
    while (points[points] != points).any():
        points = points[points]
    return points.tolist()


def _group(by: tuple[str, ...]) -> Column:
    """One text for the values of some columns, nulls included."""
    return F.to_json(F.struct(*by))


def mark_copies(articles: DataFrame, threshold: float = DUPLICATE_SIMILARITY, by: tuple[str, ...] = ("ticker",), block: int = BLOCK) -> DataFrame:
    """articles (ticker, article_id, published_at, url, vector) with is_duplicate and duplicate_of.

    The decisions of greedy_leaders() in each group of `by`, over as many tasks as it takes (similar.py): a company's
    articles, or with more columns those of a company's window. Rows without a vector stay as they are.
    """
    own = articles.drop("is_duplicate", "duplicate_of")
    items = own.where("vector is not null").select(_group(by).alias("group"), F.col("article_id").cast("string").alias("article_id"), "published_at", F.coalesce(is_redirect(F.col("url")), F.lit(False)).alias("redirect"), F.col("vector").cast("array<double>").alias("v"))
    found = copies(landed(items, "items"), threshold, block).select(F.col("group").alias("__group"), F.col("article_id").alias("__id"), F.col("target").alias("duplicate_of"))
    marked = own.join(found, (_group(by) == F.col("__group")) & (F.col("article_id").cast("string") == F.col("__id")), "left").drop("__group", "__id")
    return marked.withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def average_linkage(vectors: np.ndarray, threshold: float, weights: np.ndarray | None = None) -> list[int]:
    """Cluster numbers: the two clusters of the smallest mean cosine distance merge while it is below 1 - threshold.

    By chains of nearest neighbours over sums of unit vectors, so memory is linear in the items: the mean distance of two
    clusters is 1 - (sum . sum) / (size * size). No merge brings a cluster nearer to others than its parts were, so two
    that are nearest to each other may merge at once, and one whose nearest is at the cut or beyond is done. The clusters
    are those of the greedy order, but for exactly equal distances. weights: how many equal items a vector stands for.
    """
    cut = 1 - threshold
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    n = len(unit)
    size, parent = np.ones(n) if weights is None else weights.astype(float).copy(), np.arange(n)
    total = unit * size[:, None]
    names, at = np.arange(n), np.arange(n)  # the cluster of each kept row, and the row of each cluster
    mean, open_ = unit.astype(float).copy(), np.ones(n, dtype=bool)
    left, chain = n, []
    while left > 1:
        if 2 * left < len(names):  # leave out rows that are done
            names, mean, open_ = names[open_], mean[open_], np.ones(left, dtype=bool)
            at[names] = np.arange(left)
        tip = chain[-1] if chain else names[int(open_.argmax())]
        if not chain:
            chain.append(tip)
        dist = 1 - mean @ mean[at[tip]]
        last = dist[at[chain[-2]]] if len(chain) > 1 else np.inf
        dist[~open_] = np.inf
        dist[at[chain]] = np.inf  # so rounding can't turn a chain into a ring
        near = names[int(dist.argmin())]
        nearest = min(last, dist[at[near]])
        if last <= dist[at[near]] and len(chain) > 1:
            near = chain[-2]
        if nearest >= cut:
            open_[at[tip]] = False
            left -= 1
            chain.pop()
        elif len(chain) > 1 and near == chain[-2]:
            a, b = sorted((tip, near))
            total[a] += total[b]
            size[a] += size[b]
            parent[b], mean[at[a]], open_[at[b]] = a, total[a] / size[a], False
            left -= 1
            del chain[-2:]
        else:
            chain.append(near)
    for k in range(n):  # parents come before their parts
        parent[k] = parent[parent[k]]
    return parent.tolist()


def cluster_events(articles: DataFrame, threshold: float = EVENT_SIMILARITY, by: tuple[str, ...] = ("ticker",), block: int = BLOCK, most: int = MOST) -> DataFrame:
    """articles with event_id: live ones by cluster, named after the cluster's first, copies with their original.

    Clusters are those of average_linkage() in each group of `by`, over as many tasks as it takes (similar.py); live rows
    without a vector are in no event.
    """
    own = articles.drop("event_id")
    live = own.where("not is_duplicate and vector is not null")
    unit = F.transform(normalized(F.col("vector").cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    items = live.select(_group(by).alias("group"), F.col("article_id").cast("string").alias("article_id"), F.col("ticker").cast("string").alias("ticker"), "published_at", unit.alias("v"))
    members, clusters = linked(landed(items, "items"), threshold, average_linkage, block, most)
    placed = landed(members.join(clusters, "class", "left").withColumn("cluster", F.coalesce("cluster", "class")), "placed")
    first = placed.groupBy("cluster").agg(F.min(F.struct("published_at", "article_id", "ticker")).alias("first"))
    name = F.concat(F.lit("evt-"), F.col("first.ticker"), F.lit("-"), F.substring(F.sha1(F.concat("first.ticker", F.lit(":"), "first.article_id").cast("binary")), 1, 12))
    events = landed(placed.join(first.select("cluster", name.alias("event_id")), "cluster").select(F.col("group").alias("__group"), F.col("article_id").alias("__id"), "event_id"), "events")
    of = F.when(F.col("is_duplicate"), F.col("duplicate_of")).otherwise(F.col("article_id").cast("string"))
    return own.join(events, (_group(by) == F.col("__group")) & (of == F.col("__id")), "left").drop("__group", "__id")


def feed_histogram(articles: DataFrame) -> DataFrame:
    """Collected articles by company and feed."""
    return articles.groupBy("ticker", "feed").agg(F.count("*").alias("n"))


def window(articles: DataFrame, ticker: Column | str, since: datetime) -> DataFrame:
    return articles.where((F.col("ticker") == ticker) & (F.col("published_at") >= F.lit(since)))


def rollup(articles: DataFrame) -> DataFrame:
    """One row for each event with a live article: counts, sources, topic, span, first article, score.

    Articles without an event are events of their own. The topic is the most frequent, the first by name of equals.
    """
    rows = articles.withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("unclustered-"), "article_id")))
    live = ~F.col("is_duplicate")
    topics = rows.where(live & F.col("topic").isNotNull()).groupBy("ticker", "event_id", "topic").count()
    modal = topics.groupBy("ticker", "event_id").agg(F.max("count").alias("m"), F.collect_list(F.struct("count", "topic")).alias("t"))
    modal = modal.select("ticker", "event_id", F.array_min(F.transform(F.filter("t", lambda x: x["count"] == F.col("m")), lambda x: x["topic"])).alias("topic"))
    events = rows.groupBy("ticker", "event_id").agg(
        F.count_if(live).alias("n_live"),
        F.count_if("is_duplicate").alias("n_duplicates"),
        F.sort_array(F.collect_set(F.when(live, F.col("source")))).alias("sources"),
        F.min(F.when(live, F.col("published_at"))).alias("first_at"),
        F.to_date(F.min(F.when(live, F.col("published_at")))).alias("first_day"),
        F.to_date(F.max(F.when(live, F.col("published_at")))).alias("last_day"),
        F.min(F.when(live, F.struct("published_at", "article_id"))).getField("article_id").alias("primary_id"),
    )
    score = F.size("sources") + F.lit(0.25) * F.least("n_live", F.lit(3))
    return events.where("n_live > 0").withColumn("score", score).join(modal, ["ticker", "event_id"], "left")


def rank_events(events: DataFrame, top: int = 5) -> DataFrame:
    order = Window.partitionBy("ticker").orderBy(F.desc("score"), "first_at", "event_id")
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def latest_articles(articles: DataFrame, most: int = 8) -> DataFrame:
    return articles.where(~F.col("is_duplicate")).orderBy(F.desc("published_at"), "article_id").limit(most)


def summaries(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Deterministic summaries: the first headline, the next two, and who covered it."""
    live = articles.where(~F.col("is_duplicate")).withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("unclustered-"), "article_id")))
    nth = F.row_number().over(Window.partitionBy("ticker", "event_id").orderBy("published_at", "article_id"))
    top = live.withColumn("nth", nth).where("nth <= 3").select("ticker", "event_id", "nth", display_headline(F.col("headline")).alias("h"), F.coalesce("source", F.lit("unknown")).alias("s"))
    heads = top.groupBy("ticker", "event_id").agg(F.min_by("h", "nth").alias("head"), F.min_by("s", "nth").alias("by"), F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "h")))), lambda x: x["h"]).alias("others"))
    days = F.concat(F.col("first_day").cast("string"), F.when(F.col("first_day") != F.col("last_day"), F.concat(F.lit(" to "), F.col("last_day").cast("string"))).otherwise(F.lit("")))
    text = F.concat_ws(
        " ",
        F.concat("head", F.lit(" ("), "by", F.lit(", "), days, F.lit(").")),
        F.when(F.size("others") > 0, F.concat(F.lit("Also reported: "), F.array_join("others", "; "), F.lit("."))),
        F.concat(F.lit("Covered by "), F.size("sources").cast("string"), F.lit(" source(s): "), F.array_join(F.slice("sources", 1, 6), ", "), F.when(F.col("n_duplicates") > 0, F.concat(F.lit("; "), F.col("n_duplicates").cast("string"), F.lit(" near-duplicate repost(s) suppressed."))).otherwise(F.lit("."))),
    )
    return events.join(heads, ["ticker", "event_id"]).select("ticker", "event_id", text.alias("summary"))


def context_lines(articles: DataFrame, body: int = 1500) -> DataFrame:
    """Numbered context of live articles in time order: with collapsed text, or marked as a headline only."""
    n = F.row_number().over(Window.partitionBy("ticker", "event_id").orderBy("published_at", "article_id"))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.to_date("published_at").cast("string"), F.lit(", "), F.coalesce("source", F.lit("unknown")), F.lit(")"))
    only = F.trim(F.coalesce("text", F.lit(""))) == ""
    text = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, body)
    shown = F.when(only, F.concat(head, F.lit(" HEADLINE ONLY — no body text available.\n    Headline: "), "headline")).otherwise(F.concat(head, F.lit(" FULL TEXT\n    Headline: "), "headline", F.lit("\n    Body: "), text))
    return articles.where(~F.col("is_duplicate")).withColumn("n", n).select("ticker", "event_id", "n", shown.alias("line"))


def brief(ticker: str, company: str, events: DataFrame, articles: DataFrame, days: int, generated: datetime, extractive: bool = True) -> str:
    """A Markdown brief of one company's ranked events, each with its summary and its dated, linked sources.

    events: rank, event_id, n_live, n_duplicates, sources, topic, first_day, last_day, summary; articles: event_id,
    headline, source, url, published_at, is_duplicate. Both are of one company and one window, so they are small.
    """
    out = [f"# {ticker} — {company}", "", f"Weekly intelligence brief · last {days} days · generated {generated:%Y-%m-%d}", ""]
    ranked = events.orderBy("rank").collect()
    if not ranked:
        return "\n".join([*out, "_No qualifying news in this window._", ""])
    if extractive:
        out += ["> **Note:** summaries are extractive: taken from headlines, without interpretation.", ""]
    live = articles.where(~F.col("is_duplicate")).join(events.select("event_id"), "event_id", "left_semi")
    shown = live.select("event_id", display_headline(F.col("headline")).alias("head"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("url", F.lit("")).alias("url"), F.to_date("published_at").alias("day"), "published_at", "article_id")
    sources: dict[str, list] = {}
    for r in shown.orderBy("published_at", "article_id").collect():
        sources.setdefault(r["event_id"], []).append(r)
    for number, e in enumerate(ranked, 1):
        rows = sources.get(e["event_id"], [])
        span = str(e["first_day"]) if e["first_day"] == e["last_day"] else f"{e['first_day']}–{e['last_day']}"
        topic_ = f" · _{e['topic']}_" if e["topic"] else ""
        out += [f"## {number}. {rows[0]['head'] if rows else e['event_id']}", f"*{span} · {e['n_live']} article(s) · {len(e['sources'])} source(s)*{topic_}", "", e["summary"], "", "**Sources**"]
        out += [f"- [{r['head']}]({r['url']}) — {r['source']}, {r['day']}" for r in rows]
        out += [f"- _({e['n_duplicates']} near-duplicate repost(s) suppressed)_"] * bool(e["n_duplicates"]) + [""]
    return "\n".join(out)
