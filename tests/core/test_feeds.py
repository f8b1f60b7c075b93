from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from granary.functions.dates import feed_time
from granary.operators import news as N
from granary.sources import feeds as S

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>All</title><link>https://x.com</link>
<atom:link href="https://x.com/feed" rel="self"/>
<item><title> Nvidia Q&amp;A </title><link> https://x.com/1?a=1&amp;b=2 </link><pubDate>Mon, 06 Sep 2021 16:45:00 GMT</pubDate><source url="https://w.com">Wire &amp; Co</source><media:title>other</media:title></item>
<item><title><![CDATA[Nvidia <b>R&D</b> &amp; more]]></title><guid isPermaLink="true">https://x.com/2</guid><pubDate>6 Sep 2021 12:45 EDT</pubDate></item>
<item><title>Nvidia caf&eacute; & AT&T</title><guid isPermaLink="false">abc</guid><pubDate>soon</pubDate></item>
<item><title/><link/></item>
</channel></rss>"""
ATOM = """\ufeff<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><title type="html">Microsoft &lt;b&gt;up&lt;/b&gt;</title><link rel="enclosure" href="https://x.com/pic"/><link rel="alternate" href="https://x.com/3"/><updated>2021-09-07T01:00:00Z</updated><published>2021-09-06T18:45:00.5+02:00</published></entry>
<entry><title>Microsoft</title><link href="https://x.com/4"/><updated>2021-09-07</updated><source><title>Desk</title></source></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title></channel>
<item><title>JPMorgan</title><link>https://x.com/5</link><dc:date>2021-09-06T16:45:00+00:00</dc:date></item></rdf:RDF>"""
AT = datetime(2021, 9, 6, 16, 45, tzinfo=timezone.utc)


def documents(spark):
    rows = [("NVDA", "yahoo", RSS), ("MSFT", "google", ATOM), ("JPM", "ir", RDF), ("A", "null", None), ("A", "empty", ""), ("A", "broken", "<rss><channel><item><title>a</tit"), ("A", "text", "no feed at all")]
    return spark.createDataFrame(rows, "ticker string, feed string, xml string")


def test_items_of_rss_and_atom(spark):
    rows = S.items(documents(spark)).withColumn("at", F.unix_timestamp("published_at")).drop("published_at").collect()
    got = {(r["ticker"], r["pos"]): (r["url"], r["headline"], r["source"], r["at"]) for r in rows}
    at = int(AT.timestamp())
    assert got == {
        ("NVDA", 0): ("https://x.com/1?a=1&b=2", "Nvidia Q&A", "Wire & Co", at),
        ("NVDA", 1): ("https://x.com/2", "Nvidia <b>R&D</b> &amp; more", None, at),
        ("NVDA", 2): (None, "Nvidia café & AT&T", None, None),
        ("NVDA", 3): (None, None, None, None),
        ("MSFT", 0): ("https://x.com/3", "Microsoft <b>up</b>", None, at),
        ("MSFT", 1): ("https://x.com/4", "Microsoft", "Desk", int(datetime(2021, 9, 7, tzinfo=timezone.utc).timestamp())),
        ("JPM", 0): ("https://x.com/5", "JPMorgan", None, at),
    }


def test_files_reach_collect(spark, tmp_path):
    for ticker, feed, xml in ((r[0], r[1], r[2]) for r in documents(spark).where("xml is not null").collect()):
        (tmp_path / ticker).mkdir(exist_ok=True)
        (tmp_path / ticker / f"{feed}.xml").write_text(xml, encoding="utf-8")
    rows = S.items(S.feed_files(spark, str(tmp_path))).withColumn("feed_order", F.lit(0))
    got = N.collect(rows, datetime(2021, 9, 1)).select("ticker", "url", "source").collect()
    assert {tuple(r) for r in got} == {
        ("NVDA", "https://x.com/1?a=1&b=2", "Wire & Co"), ("NVDA", "https://x.com/2", "yahoo"), ("MSFT", "https://x.com/3", "google"),
        ("MSFT", "https://x.com/4", "Desk"), ("JPM", "https://x.com/5", "ir"),
    }


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("Mon, 06 Sep 2021 16:45:00 GMT", "2021-09-06T16:45:00"), ("Mon, 6 Sep 2021 18:45:00 +0200", "2021-09-06T16:45:00"), ("06 Sep 21 08:45 PST", "2021-09-06T16:45:00"),
        ("6-Sep-99 16:45:01 UT", "1999-09-06T16:45:01"), ("Monday, 6 September 2021", "2021-09-06T00:00:00"), ("Mon, 06 Sep 2021 16:45:00 +0000 (UTC)", "2021-09-06T16:45:00"),
        ("2021-09-06T16:45:00Z", "2021-09-06T16:45:00"), ("2021-09-06 16:45", "2021-09-06T16:45:00"), ("2021-09-06T10:15:00.123456789-06:30", "2021-09-06T16:45:00"),
        ("2021-09-06", "2021-09-06T00:00:00"), ("Mon, 31 Feb 2021 00:00:00 GMT", None), ("6 Foo 2021", None), ("2021-13-01", None), ("", None), ("soon", None), (None, None),
    ],
)
def test_feed_time(spark, text, shown):
    at = spark.createDataFrame([(text,)], "t string").select(F.unix_timestamp(feed_time(F.col("t"))).alias("at")).first()["at"]
    assert at == (None if shown is None else int(datetime.fromisoformat(f"{shown}+00:00").timestamp()))


def test_fetch_keeps_its_pace_and_reports_failures(spark):
    def get(url):
        import time

        if url.endswith("bad"):
            raise OSError("gone")
        return 200, str(time.time()).encode()

    urls = spark.createDataFrame([(k, f"https://a.com/{k}") for k in range(5)] + [(8, "https://A.com/bad"), (9, "https://b.com/1"), (10, None)], "k int, url string")
    rows = {r["k"]: r for r in S.fetch(urls, get, rps=10).collect()}
    times = sorted(float(rows[k]["content"]) for k in range(5))
    assert all(b - a >= 0.09 for a, b in zip(times, times[1:]))
    assert rows[8]["error"] == "OSError: gone" and rows[8]["status"] is None and rows[10]["error"] == "no url"
    assert all(rows[k]["status"] == 200 and rows[k]["error"] is None for k in (0, 1, 2, 3, 4, 9))
    assert S.fetch(urls.limit(0), get, 10).count() == 0
    with pytest.raises(ValueError):
        S.fetch(urls, get, 0)


def test_addresses(spark):
    got = S.addresses(spark, {"NVDA": "nvidia stock", "JPM": "jpmorgan"}, {"yahoo": "https://y/{ticker}", "google": "https://g/{query}?{days}d"}, {"NVDA": "https://ir/"}, 7).collect()
    assert [tuple(r) for r in got] == [
        ("NVDA", "ir", 0, "https://ir/"), ("NVDA", "yahoo", 1, "https://y/NVDA"), ("NVDA", "google", 2, "https://g/nvidia+stock?7d"),
        ("JPM", "yahoo", 0, "https://y/JPM"), ("JPM", "google", 1, "https://g/jpmorgan?7d"),
    ]
