"""Filing queries: pages to text, sections and chunks of composed filings, guidance, choice of filings and exhibits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from granary.functions.text import ENTITIES, guided_period, html_to_text, outlook_block
from granary.operators import filings as P, sinks as S
from granary.sources import tables as T
from granary.sources.tables import table


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def _pages(spark, d):
    """Filings composed of pages' numbers: a table of contents, then the items."""
    k = F.col("page_id")
    long = lambda n: F.repeat(F.lit("body text of this item "), n.cast("int"))
    lines = [
        F.lit("<div>PART I"), F.lit("Item 1. Business"), F.lit("Item 1A. Risk Factors"), F.lit("Item 7. MD&A"),
        F.lit("Item 1. Business"), long(k % 5 + 1), F.lit("PART II"), F.lit("Item 1A. Risk Factors"), long(k % 7 + 1), F.lit("Item 2. Something"), long(k % 3 + 1), F.lit("Item 7. MD&A"), long(k % 4 + 2), F.lit("</div>"),
    ]
    form = F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (k % 3 + 1).cast("int"))
    return table(spark, d, "pages").select(k.alias("id"), form.alias("form"), F.concat_ws("<br>", *lines).alias("html"))


def section_spans(spark, d):
    return P.sections(_pages(spark, d)).select("id", "section", F.length("text").alias("chars"))


def chunked_documents(spark, d):
    """Chunks of 60 words with an overlap of 12 of every document, with a digest of their verbatim text."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("section"), "text")
    return P.chunk(texts, 60, 12).select("chunk_id", "chunk_index", "n_tokens", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def _releases(spark, d):
    k = F.col("o_orderkey")
    word = F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("third"), F.lit("fourth")), (k % 4 + 1).cast("int"))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Intro\nOutlook for the "), word, F.lit(" quarter of fiscal "), F.year("o_orderdate").cast("string"), F.lit(" is as follows "), F.repeat(F.lit("x"), (k % 50).cast("int"))))
        .when(k % 5 == 1, F.concat(F.lit("Guidance\nFull-year "), F.year("o_orderdate").cast("string")))
        .when(k % 5 == 2, F.lit("our outlook is good for Q3 of fiscal 2020"))
        .otherwise(F.lit("Business outlook\nno period"))
    )
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"), "o_orderdate", text.alias("text"))


def guidance_period(spark, d):
    block = outlook_block(F.col("text"))
    return _releases(spark, d).select("o_orderkey", guided_period(block).alias("period"), F.length(block).alias("chars"))


def guidance_longest(spark, d):
    """The longest block of each document and period, the first order of equally long ones."""
    rows = _releases(spark, d).withColumn("block", outlook_block(F.col("text"))).withColumn("period", guided_period(F.col("block"))).where("period is not null")
    best = F.row_number().over(Window.partitionBy("doc_id", "period").orderBy(F.desc(F.length("block")), "o_orderkey"))
    return rows.withColumn("nth", best).where("nth = 1").select("doc_id", "period", "o_orderkey")


def top_n_per_type(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("form"), "o_orderdate", "o_orderkey")
    return P.choose_filings(o, {"F": 1, "O": 4, "P": 8}, order=(F.desc("o_orderdate"), "o_orderkey")).select("ticker", "form", "o_orderkey", "nth")


def earnings_releases(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "8-K").otherwise("10-Q").alias("form"), F.concat(F.lit("1.0"), (F.col("o_orderkey") % 3).cast("string"), F.lit(",2.0"), (F.col("o_orderkey") % 4).cast("string")).alias("items"))
    return o.where(P.earnings_releases(F.col("form"), F.col("items"))).select("o_orderkey")


def exhibits(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("filing"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("/a/b"), F.col("l_linenumber").cast("string")).alias("href"), F.array(F.lit("1"), F.lit("d"), F.lit("n"), F.when(F.col("l_returnflag") == "R", "EX-99.1").otherwise("EX-3")).alias("cells"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("filing"), F.lit("main.htm").alias("primary"))
    return P.exhibit_or_primary(i, o)



_R = """
r AS (
  SELECT o_orderkey, o_custkey AS doc_id, year(o_orderdate) AS y, o_orderkey % 5 AS k, o_orderkey % 4 + 1 AS q, o_orderkey % 50 AS x,
    ['first', 'second', 'third', 'fourth'][o_orderkey % 4 + 1] AS w FROM orders),
g AS (
  SELECT o_orderkey, doc_id, CASE k WHEN 0 THEN 'FY' || y || 'Q' || q WHEN 1 THEN 'FY' || y END AS period,
    CASE k WHEN 0 THEN length('Outlook for the ' || w || ' quarter of fiscal 2000 is as follows') + CASE WHEN x > 0 THEN 1 + x ELSE 0 END WHEN 1 THEN length('Guidance Full-year 2000') WHEN 2 THEN NULL ELSE 26 END AS chars FROM r)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NAMES = "map([" + ", ".join(map(_quoted, ENTITIES)) + "], [" + ", ".join(map(_quoted, ENTITIES.values())) + "])"


# --- a manifest of orders, with chunks of lines -----------------------------------------------------------------------


def _manifest(spark, d):
    k = F.col("o_orderkey").cast("string")
    company = (F.col("o_custkey") % 40).cast("string")
    kind = F.element_at(F.create_map(*map(F.lit, ("F", "8-K", "O", "10-Q", "P", "10-K"))), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(
        k.alias("doc_id"), F.concat(F.lit("T"), company).alias("ticker"), F.concat(F.lit("Company "), company).alias("company"), kind.alias("doc_type"), F.col("o_orderdate").alias("filing_date"),
        F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")).alias("fiscal_period"), F.concat(F.lit("https://example.com/"), k).alias("source_url"), F.concat(F.lit("raw/"), k, F.lit(".html")).alias("raw_path"),
    )


def _chunks(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    tail = lambda c: F.repeat(F.lit(c), (F.col("p") % 7).cast("int"))
    text = (
        F.when(F.col("p") % 4 == 0, F.concat(F.lit("Guidance\nFull-year "), (F.col("p") % 5 + 2000).cast("string"), tail(" x")))
        .when(F.col("p") % 4 == 1, F.concat(F.lit("Outlook for the third quarter of fiscal 2001 is as follows"), tail(" y")))
        .when(F.col("p") % 4 == 2, "our outlook of Q2 of fiscal 2003")
        .otherwise("Business outlook\nno period")
    )
    k = F.col("l_orderkey").cast("string")
    return rows.select(F.format_string("%s::body::%04d", k, "l_linenumber").alias("chunk_id"), k.alias("id"), F.concat(F.lit("S"), (F.col("p") % 3).cast("string")).alias("section"), F.col("l_linenumber").alias("chunk_index"), text.alias("text"), "p")


def documents_manifest(spark, d):
    return P.documents(_manifest(spark, d), ["T1", "T2", "T3"])


def chunk_rows(spark, d):
    """Chunks of a table of ids, those of every third part, with their documents."""
    chunks = _chunks(spark, d)
    rows = P.chunk_metadata(chunks.drop("p"), _manifest(spark, d), chunk_ids=chunks.where("p % 3 = 0").select("chunk_id"))
    return rows.select("chunk_id", "doc_id", "ticker", "doc_type", "chunk_index", "n_words")


def chunk_section_counts(spark, d):
    return P.section_counts(_chunks(spark, d))


def _candidates(spark, d):
    return P.guidance_candidates(_chunks(spark, d).withColumnRenamed("id", "doc_id").drop("section"), _manifest(spark, d))


def guidance_candidates(spark, d):
    return _candidates(spark, d).select("chunk_id", "ticker", "filing_date")


def guidance_latest(spark, d):
    """The three latest guidance rows of each company."""
    return P.latest_guidance(P.guidance(_candidates(spark, d)), 3)


def manifest_insert(spark, d):
    """Two thirds of the filings are known, two thirds come in; what is known stays as it was."""
    rows, k = _manifest(spark, d), F.col("doc_id").cast("long")
    new = rows.where(k % 3 != 0).withColumn("company", F.lit("new"))
    return S.insert_manifest(rows.where(k % 3 != 1), new).select("doc_id", "company", "doc_type")


def vector_upsert(spark, d):
    """Two thirds of the vectors are stored, two thirds come anew with the other sign."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector"))
    new = rows.where("chunk_id % 3 != 0")
    out = S.upsert_vectors(rows.where("chunk_id % 3 != 1"), new.drop("vector"), new.select("chunk_id", F.transform("vector", lambda x: -x).alias("vector")))
    return out.select("chunk_id", "label", F.size("vector").alias("n"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


def index_exhibits(spark, d):
    """The document of each filing index: a page in three has the release with a link, one without, one another exhibit."""
    k = F.col("page_id")
    row = lambda href, kind: F.concat(F.lit("<tr class=odd><td>2</td><td>a &lt;b&gt;</td><td>"), href, F.lit("</td><td> "), kind, F.lit("</td><td>9</td></tr>\n"))
    link = F.concat(F.lit('<A target="_blank" href="/x/y/ex'), k.cast("string"), F.lit('.htm">ex</A>'))
    release = F.when(k % 3 == 0, row(link, F.lit("EX-99.1<br>"))).when(k % 3 == 1, row(F.lit("none"), F.lit("EX-99.1"))).otherwise(row(link, F.lit("EX-99.2")))
    html = F.concat(F.lit("<table class='other'><tr><td>1</td><td>1</td><td><a href='/no'>n</a></td><td>EX-99.1</td></tr></table><table summary='x>y' class=\"big tableFile\"><tr><th>Seq</th></tr>"), row(F.lit("<a href='/m.htm'>m</a>"), F.lit("8-K")), release, row(F.lit("<a href='/x/late.htm'>l</a>"), F.lit("EX-99.3")), F.lit("</table>"))
    pages = table(spark, d, "pages").select(k.alias("filing"), html.alias("html"))
    primary = table(spark, d, "pages").select(k.alias("filing"), F.lit("main.htm").alias("primary"))
    return P.exhibit_or_primary(P.index_cells(pages), primary)


def table_counts(spark, d):
    """Rows of several tables, one of which isn't there."""
    return T.table_counts({name: table(spark, d, name) for name in ("documents", "embeddings", "events")} | {"financials": None})


_M = """
m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey AS k, 'T' || (o_custkey % 40) AS ticker, 'Company ' || (o_custkey % 40) AS company,
    CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN '10-Q' WHEN 'P' THEN '10-K' END AS doc_type, CAST(o_orderdate AS DATE) AS filing_date,
    'FY' || year(o_orderdate) AS fiscal_period, 'https://example.com/' || o_orderkey AS source_url, 'raw/' || o_orderkey || '.html' AS raw_path
  FROM orders),
c AS (
  SELECT l_orderkey || '::body::' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS chunk_id, CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS INT) AS chunk_index, p,
    CASE p % 4 WHEN 0 THEN 'Guidance' || chr(10) || 'Full-year ' || (p % 5 + 2000) || repeat(' x', CAST(p % 7 AS INT)) WHEN 1 THEN 'Outlook for the third quarter of fiscal 2001 is as follows' || repeat(' y', CAST(p % 7 AS INT)) END AS block,
    CASE p % 4 WHEN 0 THEN 'FY' || (p % 5 + 2000) WHEN 1 THEN 'FY2001Q3' END AS period,
    CASE p % 4 WHEN 0 THEN 3 + p % 7 WHEN 1 THEN 11 + p % 7 WHEN 2 THEN 7 ELSE 4 END AS n_words
  FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL))"""
_GUIDANCE = """
g AS (
  SELECT ticker, period AS fiscal_period, filing_date AS given_on, block AS text, doc_id AS source_doc_id FROM c JOIN m USING (doc_id)
  WHERE doc_type = '8-K' AND period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, period ORDER BY length(block) DESC, chunk_index) = 1)"""


QUERIES = {f.__name__: f for f in (html_text, section_spans, chunked_documents, guidance_period, guidance_longest, top_n_per_type, earnings_releases, exhibits, documents_manifest, chunk_rows, chunk_section_counts, guidance_candidates, guidance_latest, manifest_insert, vector_upsert, index_exhibits, table_counts)}
ORACLES = {
    "html_text": rf"""
WITH s AS (
  SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->', '', 'g'),
    '<[/!?A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[/!?A-Za-z][^>]*>', chr(10), 'g') AS t FROM pages),
found AS (SELECT page_id, t, list_distinct(regexp_extract_all(t, '&(#?[A-Za-z0-9]+);', 1)) AS names FROM s),
named AS (
  SELECT page_id, unnest(names) AS name FROM found),
known AS (SELECT k.name, k.shown FROM (SELECT unnest(map_entries(m)) AS e FROM (SELECT {_NAMES} AS m)) x, LATERAL (SELECT x.e.key AS name, x.e.value AS shown) k),
pairs AS (
  SELECT page_id, list({{'e': '&' || name || ';', 'c': shown}} ORDER BY shown = '&') AS p FROM (
    SELECT page_id, named.name, coalesce(shown, CASE WHEN starts_with(named.name, '#') AND TRY_CAST(named.name[2:] AS INT) BETWEEN 1 AND 55295 THEN chr(TRY_CAST(named.name[2:] AS INT)) END) AS shown
    FROM named LEFT JOIN known ON named.name = known.name) WHERE shown IS NOT NULL GROUP BY page_id),
e AS (
  SELECT page_id, CASE WHEN p IS NULL THEN t ELSE list_reduce(list_transform(p, lambda x: x), lambda a, x: {{'e': '', 'c': replace(a.c, x.e, x.c)}}, {{'e': '', 'c': t}}).c END AS t
  FROM found LEFT JOIN pairs USING (page_id))
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM e""",
    "guidance_period": f"WITH {_R} SELECT o_orderkey, period, CAST(chars AS INT) AS chars FROM g",
    "guidance_longest": f"WITH {_R} SELECT doc_id, period, o_orderkey FROM g WHERE period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, period ORDER BY chars DESC, o_orderkey) = 1",
    "top_n_per_type": "SELECT o_custkey AS ticker, o_orderstatus AS form, o_orderkey, CAST(row_number() OVER w AS INT) AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) QUALIFY row_number() OVER w <= CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 4 WHEN 'P' THEN 8 END",
    "earnings_releases": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 4 = 2",
    "exhibits": "SELECT o_orderkey AS filing, coalesce('b' || (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), 'main.htm') AS document FROM orders",
    "documents_manifest": f"WITH {_M} SELECT doc_id, ticker, company, doc_type, filing_date, fiscal_period, source_url, raw_path FROM m WHERE ticker IN ('T1', 'T2', 'T3')",
    "chunk_rows": f"WITH {_M} SELECT chunk_id, doc_id, ticker, doc_type, chunk_index, CAST(n_words AS INT) AS n_words FROM c JOIN m USING (doc_id) WHERE p % 3 = 0",
    "chunk_section_counts": f"WITH {_M} SELECT 'S' || (p % 3) AS section, count(*) AS n FROM c GROUP BY 1",
    "guidance_candidates": f"WITH {_M} SELECT chunk_id, ticker, filing_date FROM c JOIN m USING (doc_id) WHERE doc_type = '8-K'",
    "guidance_latest": f"WITH {_M}, {_GUIDANCE} SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY given_on DESC, fiscal_period, source_doc_id) <= 3",
    "manifest_insert": f"WITH {_M} SELECT doc_id, CASE WHEN k % 3 = 1 THEN 'new' ELSE company END AS company, doc_type FROM m",
    "vector_upsert": "SELECT vec_id AS chunk_id, label, CAST(len(embedding) AS INT) AS n, round(CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[1] ELSE -embedding[1] END AS DOUBLE), 6) AS first FROM embeddings",
    "index_exhibits": "SELECT page_id AS filing, CASE WHEN page_id % 3 = 0 THEN 'ex' || page_id || '.htm' ELSE 'main.htm' END AS document FROM pages",
    "table_counts": """SELECT 'documents' AS "table", count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'financials', NULL""",
    "section_spans": r"""
WITH p AS (
  SELECT page_id AS id, ['10-K', '10-Q', '8-K'][page_id % 3 + 1] AS form, ['PART I', 'Item 1. Business', 'Item 1A. Risk Factors', 'Item 7. MD&A', 'Item 1. Business', rtrim(repeat('body text of this item ', CAST(page_id % 5 + 1 AS INT))),
    'PART II', 'Item 1A. Risk Factors', rtrim(repeat('body text of this item ', CAST(page_id % 7 + 1 AS INT))), 'Item 2. Something', rtrim(repeat('body text of this item ', CAST(page_id % 3 + 1 AS INT))),
    'Item 7. MD&A', rtrim(repeat('body text of this item ', CAST(page_id % 4 + 2 AS INT)))] AS lines FROM pages),
l AS (SELECT id, form, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM p),
m AS (
  SELECT *, upper(nullif(regexp_extract(line, '(?i)^part\s+(iv|iii|ii|i)\b', 1), '')) AS part, upper(nullif(regexp_extract(line, '(?i)^item\s+(1a|1b|1c|7a|9a|9b|10|11|12|13|14|15|[1-9])\.?(\s|$)', 1), '')) AS item FROM l),
w AS (
  SELECT *, last_value(part IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS in_part,
    sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n) - length(line) - 1 AS pos, sum(length(line) + 1) OVER (PARTITION BY id) - 1 AS total FROM m),
heads AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY id ORDER BY n), total) - pos AS span FROM w WHERE item IS NOT NULL),
named AS (
  SELECT *, CASE WHEN form = '10-K' THEN CASE item WHEN '1' THEN 'Business' WHEN '1A' THEN 'Risk Factors' WHEN '7' THEN 'MD&A' WHEN '8' THEN 'Financial Statements' END
    WHEN form = '10-Q' THEN CASE WHEN item = '1' AND in_part = 'I' THEN 'Financial Statements' WHEN item = '2' AND in_part = 'I' THEN 'MD&A' WHEN item = '1A' AND in_part = 'II' THEN 'Risk Factors' END END AS section FROM heads),
kept AS (SELECT id, n, section FROM named WHERE section IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, item ORDER BY span DESC, pos) = 1),
started AS (SELECT l.id, l.line, section, count(section) OVER (PARTITION BY l.id ORDER BY l.n) AS k FROM l LEFT JOIN kept USING (id, n))
SELECT id, coalesce(max(section), 'body') AS section, CAST(sum(length(line) + 1) - 1 AS INT) AS chars
FROM (SELECT *, max(k) OVER (PARTITION BY id) AS most FROM started) WHERE k > 0 OR most = 0 GROUP BY id, k""",
    "chunked_documents": r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, lang, n, x, regexp_split_to_array(x, '\s+') AS w FROM (
    SELECT doc_id, lang, unnest(range(len(a))) AS n, trim(unnest(a), E' \t\n\r\x0b\x0c') AS x FROM (SELECT doc_id, lang, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\f\r]') AS a FROM documents))
  WHERE x <> ''),
cut AS (SELECT doc_id, lang, n, x, w, unnest(range(0, len(w), 60)) AS k FROM lines),
units AS (SELECT doc_id, lang, n, k, least(60, len(w) - k) AS size, CASE WHEN len(w) <= 60 THEN x ELSE regexp_extract_all(x, '\S+(?:\s+\S+){0,59}')[k // 60 + 1] END AS unit FROM cut),
d AS (SELECT doc_id, any_value(lang) AS lang, list(size ORDER BY n, k) AS z, list(unit ORDER BY n, k) AS c FROM units GROUP BY doc_id),
r AS (
  SELECT doc_id, 0 AS k, range(1, 1 + greatest(1, len(list_filter(range(1, len(z) + 1), lambda e: list_sum(z[1 : e]) <= 60)))) AS u FROM d
  UNION ALL
  SELECT doc_id, k + 1, list_concat(again, range(nxt, nxt + greatest(1, len(list_filter(range(nxt, len(z) + 1), lambda e: list_sum(z[nxt : e]) <= 60 - coalesce(list_sum(list_transform(again, lambda y: z[y])), 0))))))
  FROM (
    SELECT doc_id, k, z, nxt, CASE WHEN size = 0 THEN CAST([] AS BIGINT[]) ELSE before[len(before) - size + 1 :] END AS again FROM (
      SELECT *, least(coalesce(list_position(list_transform(ends, lambda e: e >= 12), true), len(ends)), len(list_filter(ends, lambda e: e <= least(30, 60 - z[nxt])))) AS size FROM (
        SELECT *, list_transform(range(1, len(before) + 1), lambda m: list_sum(list_transform(before[len(before) - m + 1 :], lambda y: z[y]))) AS ends FROM (
          SELECT doc_id, k, z, u[len(u)] + 1 AS nxt, u[1 : len(u) - 1] AS before FROM r JOIN d USING (doc_id) WHERE u[len(u)] < len(z))))))
SELECT doc_id || '::' || coalesce(nullif(trim(regexp_replace(lower(lang), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'body') || '::' || printf('%04d', k) AS chunk_id,
  CAST(k AS INT) AS chunk_index, CAST(list_sum(list_transform(u, lambda y: z[y])) AS INT) AS n_tokens,
  CAST(length(array_to_string(list_transform(u, lambda y: c[y]), chr(10))) AS INT) AS chars, sha256(array_to_string(list_transform(u, lambda y: c[y]), chr(10))) AS text_sha256
FROM r JOIN d USING (doc_id)""",
}
