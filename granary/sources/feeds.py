"""Feeds: where they are, fetching them at a fixed pace over a given transport, and RSS and Atom documents as rows of items.

A feed document is a row (ticker, feed, xml), whether fetched, landed as a file or made by a query; items() opens it with
Spark's own XML functions, so nothing but fetch() leaves the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from granary.functions.dates import feed_time
from granary.functions.text import decode_entities, strip

_TEXT = "struct<_VALUE:string>"
_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_ITEM = f"array<struct<title:{_TEXT},link:{_LINKS},guid:struct<_VALUE:string,_isPermaLink:string>,source:struct<_VALUE:string,title:{_TEXT}>,pubDate:string,published:string,updated:string,`dc:date`:string>>"
#: RSS 2.0 keeps its items in a channel, RSS 1.0 beside it, Atom calls them entries.
FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ITEM}"

Transport = Callable[[str], tuple[int, bytes]]


def addresses(spark: SparkSession, searched: dict[str, str], templates: dict[str, str], own: dict[str, str], days: int) -> DataFrame:
    """(ticker, feed, feed_order, url) of all feeds of some companies, in the order in which their items are seen.

    A company's own feed ('ir'), if it has one, comes first, then the templates in their order, with {ticker}, {query}
    (what is searched for, spaces as +) and {days} filled in.
    """
    rows = []
    for ticker, query in searched.items():
        known = {"ir": own[ticker]} if ticker in own else {}
        known |= {feed: t.format(ticker=ticker, query=query.replace(" ", "+"), days=days) for feed, t in templates.items()}
        rows += [(ticker, feed, nth, url) for nth, (feed, url) in enumerate(known.items())]
    return spark.createDataFrame(rows, "ticker string, feed string, feed_order int, url string")


def fetch(urls: DataFrame, get: Transport, rps: float) -> DataFrame:
    """urls with status, content and error: what get(url) -> (status, bytes) gives, at most `rps` calls a second to a host.

    All of a host's urls are one task's work, which waits a fixed interval between the starts of two calls, so the pace
    holds however many tasks run; only a task that is tried again, or run twice by speculation, asks again. An exception
    of get() stands in `error` and the others are still fetched; null urls are not asked for. Land the result before use.
    """
    if rps <= 0:
        raise ValueError("rps must be above 0")
    asked = urls.withColumn("__host", F.lower(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1))).repartition("__host").sortWithinPartitions("__host", "url")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in urls.schema)}, status int, content binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for pdf in batches:
            said = []
            for host, url in zip(pdf["__host"], pdf["url"], strict=True):
                if url is None:
                    said.append((None, None, "no url"))
                    continue
                time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                free[host] = time.monotonic() + 1 / rps
                try:
                    said.append((*get(url), None))
                except Exception as failure:  # a feed that fails is reported, and the others are still fetched
                    said.append((None, None, f"{type(failure).__name__}: {failure}"))
            out = pdf.drop(columns="__host")
            for k, name in enumerate(("status", "content", "error")):
                out[name] = pd.Series([s[k] for s in said], index=out.index, dtype="Int32" if name == "status" else "object")
            yield out

    return asked.mapInPandas(run, schema)


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, feed, xml) of landed feed files <path>/<ticker>/<feed>.xml."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(path)
    part = lambda n: F.regexp_extract("path", r"([^/]+)/([^/]+)\.xml$", n)
    return raw.select(part(1).alias("ticker"), part(2).alias("feed"), xml_text(F.col("content")).alias("xml"))


def xml_text(content: Column) -> Column:
    """Bytes as UTF-8, what isn't becomes replacement characters; without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


_XML_ENTITY = "(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+);"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _mended(text: Column) -> Column:
    """Entities that only HTML knows become characters, other lone ampersands are escaped; text without either stays."""
    strange = f"&(?!{_XML_ENTITY})"
    shielded = F.regexp_replace(text, f"&({_XML_ENTITY})", "&amp;$1")
    return F.when(text.rlike(strange), F.regexp_replace(decode_entities(shielded), strange, "&amp;")).otherwise(text)


def lenient(xml: Column) -> Column:
    """A feed as its publisher meant it: CDATA as escaped text, HTML's entities known, no control characters."""
    clean = F.regexp_replace(xml, r"[\x00-\x08\x0B\x0C\x0E-\x1F]|<!DOCTYPE[^>\[]*>", "")

    def piece(p: Column, k: Column) -> Column:
        inside = F.substring_index(p, "]]>", 1)
        return F.when(k == 0, _mended(p)).otherwise(F.concat(_escaped(inside), _mended(F.substr(p, F.length(inside) + F.lit(4)))))

    return F.array_join(F.transform(F.split(clean, r"<!\[CDATA\["), piece), "")


def items(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Feed documents -> a row for each item: the other columns, pos (from 0), url, headline, source, published_at.

    Takes RSS 2.0, RSS 1.0 and Atom. url is the item's link (Atom: the first that is the item itself), else a guid that is
    a permanent link; source is the publisher that the item names, else null; published_at is when it was published, else
    updated, to the second; null where neither is a date. Texts lose white space at their ends, and empty ones are null.
    Null, empty and broken documents have no items. Columns of feeds that are called like one of these are replaced.
    """
    made = ("pos", "url", "headline", "source", "published_at")
    others = [f"`{c}`" for c in feeds.columns if c not in (xml_col, *made, "__item")]
    opened = feeds.select(*others, F.from_xml(lenient(F.col(xml_col)), FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "false"}).alias("__feed"))
    found = F.coalesce(*(F.when(F.size(c) > 0, F.col(c)) for c in ("__feed.channel.item", "__feed.item", "__feed.entry")))
    rows = opened.select(*others, F.posexplode(found).alias("pos", "__item"))
    filled = lambda c: F.nullif(strip(c), F.lit(""))
    itself = F.filter("__item.link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    links = F.filter(F.transform(itself, lambda x: F.coalesce(filled(x["_href"]), filled(x["_VALUE"]))), lambda x: x.isNotNull())
    guid = F.when(F.lower(F.coalesce("__item.guid._isPermaLink", F.lit("true"))) != "false", filled(F.col("__item.guid._VALUE")))
    at = F.coalesce(*(feed_time(F.col(f"__item.{c}")) for c in ("pubDate", "published", "updated", "`dc:date`")))
    return rows.select(
        *others, "pos", F.coalesce(F.get(links, F.lit(0)), guid).alias("url"), filled(F.col("__item.title._VALUE")).alias("headline"),
        F.coalesce(filled(F.col("__item.source.title._VALUE")), filled(F.col("__item.source._VALUE"))).alias("source"), at.alias("published_at"),
    )
